"""Binary libraries: reading their entries, and writing new ones."""

from __future__ import annotations

import struct
import tempfile
from collections.abc import Callable, Container, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions.text import extension

# The format: block and node sizes, entries of a node, bytes of a data block, largest entry. Fixed values.
BLOCK, NODE, PER_NODE, PER_BLOCK, LARGEST = 512, 3072, 40, 502, 10_000_000
# Object types by number, and source extensions: fixed values.
TYPES = ("application", "datawindow", "window", "menu", "function", "structure", "userobject", "query", "pipeline", "project", "proxy", "binary", "embedded_sql", "web_service", "component", "soap_client", "soap_server", "web_proxy", "nativejson", "restclient")
EXTENSION_TYPES = {".sra": 0, ".srd": 1, ".srw": 2, ".srm": 3, ".srf": 4, ".srs": 5, ".sru": 6, ".srq": 7, ".srp": 8, ".srj": 9, ".srx": 10, ".sre": 12}
PREFIX_TYPES = {"d_": 1, "w_": 2, "m_": 3, "n_": 6, "u_": 6, "f_": 4, "gf_": 4, "s_": 5}
# Words in an entry's comment that name its type, before extension and prefix: fixed values.
COMMENT_TYPES = {"application": 0, "datawindow": 1, "window": 2, "menu": 3, "function": 4, "structure": 5, "user object": 6, "userobject": 6, "query": 7, "pipeline": 8, "project": 9, "proxy": 10, "embedded sql": 12}
#: Bytes of data from which entries are handed on; small libraries share a batch.
BATCH_BYTES = 1 << 20
#: Entries from which they are handed on where their data is not read.
BATCH_ROWS = 10_000
# What an entry tells between version and name, and a data block: its mark, the next one's place, its length, its data.
_ENTRY, _DATA = "<IIIHH", f"<4sIH{PER_BLOCK}s"
# Versions that the strict reader takes: fixed values.
STRICT_VERSIONS = ("0500", "0600")

ENTRY_ARROW = pa.schema([("path", pa.string()), ("ordinal", pa.int32()), ("name", pa.string()), ("type_code", pa.int32()), ("type_name", pa.string()), ("is_source", pa.bool_()), ("version", pa.string()), ("is_unicode", pa.bool_()), ("data_offset", pa.int64()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("data", pa.binary()), ("error", pa.string())])
ENTRY_SCHEMA = "path string, ordinal int, name string, type_code int, type_name string, is_source boolean, version string, is_unicode boolean, data_offset long, size long, modified timestamp, data binary, error string"


def type_of(name: str, comment: str = "") -> tuple[int, bool]:
    """Type number and whether it is source: by a word of the comment, else by extension, else by prefix, else binary."""
    low = name.lower()
    said = next((t for word, t in COMMENT_TYPES.items() if word in comment.lower()), None) if comment else None
    if said is not None:
        return said, low[max(low.rfind("."), 0) :] in EXTENSION_TYPES
    dot = low.rfind(".")
    if dot > 0 and low[dot:] in EXTENSION_TYPES:
        return EXTENSION_TYPES[low[dot:]], True
    if dot > 0:
        return 11, False
    return next((t for p, t in PREFIX_TYPES.items() if low.startswith(p)), 11), False


class Region:
    """Bytes of a library, by place. This one is of bytes in memory."""

    def __init__(self, raw: bytes):
        self.raw, self.size = raw, len(raw)

    def at(self, start: int, n: int) -> bytes:
        return self.raw[start : start + n]


def payload(region: Region, offset: int, size: int) -> bytes:
    """Data of an entry, its blocks followed one after the other; a block outside the format ends it.

    Blocks mostly follow each other, so as many as the size needs are read at
    once, and again from where the chain leaves that stretch.
    """
    out, at, seen = bytearray(), offset, set()
    start, held = 0, b""
    while 0 < at <= region.size - 10 and len(out) < size and at not in seen:
        seen.add(at)
        if not start <= at or at + BLOCK > start + len(held):
            start, held = at, region.at(at, BLOCK * -(-(size - len(out)) // PER_BLOCK))
        here = at - start
        if not held.startswith(b"DAT*", here):
            out += held[here : here + min(BLOCK, size - len(out))]
            break
        at, n = struct.unpack_from("<IH", held, here + 4)
        out += held[here + 10 : here + 10 + min(n if 0 < n <= PER_BLOCK else PER_BLOCK, size - len(out))]
    return bytes(out)


def _nodes(region: Region, first: int, both: bool) -> Iterator[bytes]:
    """Node blocks along the right siblings, or along both siblings of each; each one once."""
    todo, seen = [first], set()
    while todo:
        at = todo.pop()
        if not at or at in seen:
            continue
        block = region.at(at, NODE)
        if block[:4] != b"NOD*":
            continue
        seen.add(at)
        if len(block) < NODE:
            raise ValueError("node cut off")
        yield block
        todo.append(struct.unpack_from("<I", block, 12)[0])
        if both:
            todo.append(struct.unpack_from("<I", block, 4)[0])


def entries(raw: bytes | Region, strict: bool = False, chosen: Callable[[dict], bool] | None = None, data: bool = True, turns: tuple[Container[int], int] = ((0,), 1)) -> Iterator[dict]:
    """Entries of a library in order, the first of each name; raises ValueError for anything else.

    ``strict`` walks both siblings of every node and takes entries of the
    versions in :data:`STRICT_VERSIONS` alone. Data is read of those entries
    alone that ``chosen`` takes, by all their other values; without ``data``
    it is null. ``turns`` is which ones of every how many entries to take;
    of the others no more than the name is read.
    """
    region = raw if isinstance(raw, Region) else Region(raw)
    front = region.at(0, 2 * BLOCK + 4)
    if front[:4] != b"HDR*":
        raise ValueError("no library header")
    unicode = front[BLOCK : BLOCK + 4] != b"FRE*" and (front[2 * BLOCK : 2 * BLOCK + 4] == b"FRE*" or b"\xff\xfe" in front[:32])
    wide, charset = (2, "utf-16-le") if unicode else (1, "latin-1")
    names, versions, ordinal = set(), {}, 0
    for block in _nodes(region, (3 if unicode else 2) * BLOCK, strict):
        at = 32
        for _ in range(min(struct.unpack_from("<H", block, 20)[0], 200)):
            fixed = at + 4 + 4 * wide
            if block[at : at + 4] != b"ENT*" or fixed + 16 > NODE:
                break
            version = versions.get(block[at + 4 : fixed])
            if version is None:
                version = versions[block[at + 4 : fixed]] = block[at + 4 : fixed].decode(charset, "replace").strip("\0")
            offset, size, stamp, _, length = struct.unpack_from(_ENTRY, block, fixed)
            at = fixed + 16 + length
            name, _, comment = block[fixed + 16 : at - wide].decode(charset, "replace").rstrip("\0").partition("\0")
            name = name.strip()
            if strict and version not in STRICT_VERSIONS:
                continue
            if name and name not in names and 0 < offset <= region.size and 0 < size <= LARGEST:
                names.add(name)
                if ordinal % turns[1] not in turns[0]:
                    ordinal += 1
                    continue
                code, source = type_of(name, comment)
                found = {"ordinal": ordinal, "name": name, "type_code": code, "type_name": TYPES[code], "is_source": source, "version": version, "is_unicode": unicode, "data_offset": offset, "size": size, "modified": (stamp // 1000 if stamp > 3_000_000_000 else stamp) * 1_000_000 if stamp else None}
                if chosen is None or chosen(found):
                    found["data"] = payload(region, offset, size) if data else None
                    yield found
                ordinal += 1


def read_entries(files: DataFrame, strict: bool = False, chosen: Callable[[dict], bool] | None = None, data: bool = True) -> DataFrame:
    """Entries of every library in ``files(path, content)``; a file that is none gives one row with an error.

    A library is parsed where its file is read; nothing is shuffled. Entries
    that ``chosen`` does not take, by all values but the data, are left out.
    Who needs no data says so: it is null then, and is not handed back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    found = list(entries(raw.as_py() or b"", strict, chosen, data))
                    for e in found:
                        e["path"] = path
                except (ValueError, struct.error) as e:
                    found = [{"path": path, "error": str(e)}]
                rows += found
                held += sum(len(r.get("data") or b"") for r in found) if data else 0
                if held > BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, ENTRY_ARROW)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, ENTRY_ARROW)

    return files.select("path", "content").mapInArrow(run, ENTRY_SCHEMA)


def _blocks(data: bytes, place: int) -> bytes:
    """The chained data blocks of an entry that starts at ``place``."""
    last = _block_count(len(data)) - 1
    chained = [struct.pack(_DATA, b"DAT*", place + BLOCK * (k + 1), PER_BLOCK, data[PER_BLOCK * k : PER_BLOCK * (k + 1)]) for k in range(last)]
    rest = data[PER_BLOCK * last :]
    return b"".join([*chained, struct.pack(_DATA, b"DAT*", 0, len(rest), rest)])


def _block_count(size: int) -> int:
    return max(1, -(-size // PER_BLOCK))


def _front(items: list[tuple[str, int]], unicode: bool, version: str, stamp: int, errors: str = "strict") -> tuple[bytes, list[int]]:
    """Header and nodes of a library of ``(name, size)``, and where each entry's blocks start. Nodes are chained."""
    wide, charset = (2, "utf-16-le") if unicode else (1, "latin-1")
    header = bytearray(wide * BLOCK)
    header[:4] = b"HDR*"
    title = "PowerBuilder Library\0".encode(charset) + (version + "\0").encode(charset)
    header[4 : 4 + len(title)] = title
    struct.pack_into("<I", header, len(header) - 8, len(items))
    nodes = max(1, -(-len(items) // PER_NODE))
    place = len(header) + BLOCK + nodes * NODE
    places, body, mark, end = [], bytearray(), b"ENT*" + version.encode(charset), "\1".encode(charset)
    for k in range(nodes):
        block = bytearray(NODE)
        block[:4] = b"NOD*"
        some = items[k * PER_NODE : (k + 1) * PER_NODE]
        struct.pack_into("<I", block, 12, len(header) + BLOCK + (k + 1) * NODE if k + 1 < nodes else 0)
        struct.pack_into("<H", block, 20, len(some))
        at = 32
        for name, size in some:
            buf = name.encode(charset, errors) + end
            entry = mark + struct.pack(_ENTRY, place, size, stamp, 0, len(buf)) + buf
            if at + len(entry) > NODE:
                raise ValueError("names too long for a node")
            block[at : at + len(entry)] = entry
            at += len(entry)
            places.append(place)
            place += BLOCK * _block_count(size)
        body += block
    return bytes(header) + b"FRE*".ljust(BLOCK, b"\0") + bytes(body), places


def build(items: list[tuple[str, bytes]], unicode: bool = True, version: str = "0600", stamp: int = 0) -> bytes:
    """A library of ``(name, data)``; of names that differ only in case the last one stays. Nodes are chained."""
    last = {n.lower(): (n, d) for n, d in items}
    items = list(last.values())
    front, places = _front([(n, len(d)) for n, d in items], unicode, version, stamp, "replace")
    return front + b"".join(_blocks(d, place) for (_, d), place in zip(items, places))


#: Bytes of a library that is one value; what is larger has to be written, see :func:`library_blocks`.
LARGEST_LIBRARY = 1 << 30
#: The last place that the format can name.
LAST_PLACE = (1 << 32) - 1


def _little(c: Column, n: int) -> Column:
    """A number as ``n`` bytes, the lowest first."""
    digits = F.lpad(F.hex(c.cast("long")), 2 * n, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(n))]))


def _framed(unicode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_blocks(data, place) for place, data in zip(batch.column("at").to_pylist(), batch.column("data").to_pylist())]
            yield pa.record_batch([batch.column("library"), batch.column("at"), pa.array(out, pa.binary())], ["library", "at", "bytes"])

    return run


def library_blocks(rows: DataFrame, library: str = "library", unicode: bool = True, version: str = "0600", stamp: int = 0) -> tuple[DataFrame, DataFrame]:
    """``(library, at, bytes)``, the stretches of each group's library by place, and ``(library, error)``.

    The stretches are the header, each node and each entry's data blocks, so
    no task holds a library, whatever its size: where each of them starts
    follows from prefix sums over the names and sizes. In order of ``at`` they
    make up the bytes that :func:`build` gives. A library beyond the places
    that the format can name, or with names that a node cannot hold, has an
    error and no stretches.

    Null data is empty, null names are left out; names that differ only in
    case are one entry, with the last one's spelling and data.
    """
    wide, charset = (2, "UTF-16LE") if unicode else (1, "ISO-8859-1")
    each = rows.where(F.col("name").isNotNull()).select(F.col(library).cast("string").alias("library"), "name", F.coalesce("data", F.lit(b"")).alias("data"))
    once = each.groupBy("library", F.lower("name").alias("_low")).agg(F.min("name").alias("_first"), F.max(F.struct("name", "data")).alias("_e")).select("library", "_first", "_e.name", "_e.data")
    sized = once.select("library", "_first", "name", F.octet_length("data").alias("size"), F.greatest(F.ceil(F.octet_length("data") / PER_BLOCK), F.lit(1)).alias("blocks"))
    order = Window.partitionBy("library").orderBy("_first")
    spot = sized.select("*", (F.row_number().over(order) - 1).alias("k"), F.coalesce(F.sum("blocks").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.count("*").over(Window.partitionBy("library")).alias("n"))
    node_at, nodes = (wide + 1) * BLOCK, F.greatest(F.ceil(F.col("n") / PER_NODE), F.lit(1))
    placed = spot.select("library", "_first", "name", "size", "blocks", "n", "k", F.floor(F.col("k") / PER_NODE).alias("node"), nodes.alias("nodes"), (F.lit(node_at) + nodes * NODE + F.col("before") * BLOCK).alias("at"))
    binary = lambda b: F.lit(b)
    label = F.concat(F.encode("name", charset), F.encode(F.lit("\1"), charset))
    held = F.concat(binary(b"ENT*"), F.encode(F.lit(version), charset), _little(F.col("at"), 4), _little(F.col("size"), 4), _little(F.lit(stamp), 4), _little(F.lit(0), 2), _little(F.octet_length(label), 2), label)
    entry_rows = placed.select("library", "node", "nodes", "n", "k", (F.col("at") + F.col("blocks") * BLOCK).alias("end"), held.alias("e"))
    per_node = entry_rows.groupBy("library", "node").agg(F.max("nodes").alias("nodes"), F.max("n").alias("n"), F.max("end").alias("end"), F.count("*").alias("held"), F.sum(F.octet_length("e")).alias("bytes"), F.array_sort(F.collect_list(F.struct("k", "e"))).alias("es"))
    wrong = F.when(F.max("end") > LAST_PLACE, "too large for the format").when(F.max("bytes") + 32 > NODE, "names too long for a node")
    errors = per_node.groupBy("library").agg(wrong.alias("error")).where("error is not null")
    bad = errors.select(F.col("library").alias("_bad"))
    good = lambda df: df.join(bad, F.col("library").eqNullSafe(F.col("_bad")), "left_anti")
    following = F.when(F.col("node") + 1 < F.col("nodes"), F.lit(node_at) + (F.col("node") + 1) * NODE).otherwise(0)
    body = F.concat(binary(b"NOD*" + b"\0" * 8), _little(following, 4), binary(b"\0" * 4), _little(F.col("held"), 2), binary(b"\0" * 10), *[F.coalesce(F.get("es", F.lit(i))["e"], binary(b"")) for i in range(PER_NODE)])
    pad = lambda c, n: F.rpad(c, n, b"\0")
    nodes_out = good(per_node).select("library", (F.lit(node_at) + F.col("node") * NODE).alias("at"), pad(body, NODE).alias("bytes"))
    title = binary(b"HDR*" + ("PowerBuilder Library\0" + version + "\0").encode("utf-16-le" if unicode else "latin-1"))
    front = F.concat(pad(title, wide * BLOCK - 8), _little(F.col("n"), 4), binary(b"\0" * 4), pad(binary(b"FRE*"), BLOCK))
    headers = good(per_node.where("node = 0")).select("library", F.lit(0).cast("long").alias("at"), front.alias("bytes"))
    payloads = once.join(placed.select(F.col("library").alias("_l"), F.col("_first").alias("_f"), "at"), F.col("library").eqNullSafe(F.col("_l")) & (F.col("_first") == F.col("_f")))
    data = good(payloads.select("library", "at", "data")).mapInArrow(_framed(unicode), "library string, at long, bytes binary")
    return headers.unionByName(nodes_out).unionByName(data), errors


#: Bytes of a library's data that a task holds in memory; what is more lies in a file of its own until the library is done.
SPOOLED = 32 << 20
STRETCHES = "library string, bytes binary, error string"
_STRETCHES = pa.schema([("library", pa.string()), ("bytes", pa.binary()), ("error", pa.string())])


def _joined(stretches: Iterator[tuple]) -> Iterator[tuple]:
    """One row of a library's stretches, or of its error."""
    parts = list(stretches)
    library, _, error = parts[0]
    yield library, None if error else b"".join(part for _, part, _ in parts), error


def _stretched(unicode: bool, version: str, stamp: int, largest: int, whole: bool = False):
    """Libraries from rows in order of library and lower-case name: the stretches of each in the order of their places, or its error; ``whole`` makes them one row."""

    def stretches(library: str | None, rows: Iterator[tuple]) -> Iterator[tuple]:
        items, end, held = [], (3 if unicode else 2) * BLOCK, 0
        with tempfile.SpooledTemporaryFile(SPOOLED) as spool:
            row = next(rows, None)
            while row is not None:
                _, low, first, data = row
                best, row = (first, data), next(rows, None)
                while row is not None and row[1] == low:
                    first, best, row = min(first, row[2]), max(best, row[2:]), next(rows, None)
                end += BLOCK * _block_count(len(best[1])) + (0 if len(items) % PER_NODE else NODE)
                if end > LAST_PLACE:
                    break  # no name counts any more
                items.append((first, best[0], len(best[1]), held))
                if end <= largest:
                    held += spool.write(best[1])
            items.sort(key=itemgetter(0))
            try:
                if end > LAST_PLACE:
                    raise ValueError("too large for the format")
                front, places = _front([(name, size) for _, name, size, _ in items], unicode, version, stamp)
                if end > largest:
                    raise ValueError("too large")
            except UnicodeEncodeError:
                raise
            except ValueError as e:
                yield library, None, str(e)
                return
            yield library, front, None
            for (_, _, size, at), place in zip(items, places):
                spool.seek(at)
                yield library, _blocks(spool.read(size), place), None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[batch.column(c).to_pylist() for c in ("library", "low", "name")], (x.as_py() for x in batch.column("data")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        batch = lambda: pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*out), _STRETCHES)], schema=_STRETCHES)
        for library, rows in groupby(read(batches), itemgetter(0)):
            made = stretches(library, rows)
            for row in _joined(made) if whole else made:
                out.append(row)
                held += len(row[1] or b"")
                if held > BATCH_BYTES:
                    yield batch()
                    out, held = [], 0
        if out:
            yield batch()

    return run


def library_stretches(rows: DataFrame, library: str = "library", unicode: bool = True, version: str = "0600", stamp: int = 0, largest: int = LAST_PLACE, whole: bool = False) -> DataFrame:
    """``(library, bytes, error)``: each library's stretches one after the other in one task, or one row with its error.

    The same bytes as :func:`library_blocks`, with one shuffle and one sort of
    the data. A task holds the names of one library and :data:`SPOOLED` bytes
    of its data; the rest of it waits in a file on the task's disk. A library
    of over ``largest`` bytes is an error. ``whole`` makes a library's
    stretches one row where they are made, so its task holds all of it.
    """
    each = rows.where(F.col("name").isNotNull()).select(F.col(library).cast("string").alias("library"), F.lower("name").alias("low"), "name", F.coalesce("data", F.lit(b"")).alias("data"))
    return each.repartition("library").sortWithinPartitions("library", "low").mapInArrow(_stretched(unicode, version, stamp, largest, whole), STRETCHES)


def pack(rows: DataFrame, library: str = "library", unicode: bool = True, largest: int = LARGEST_LIBRARY) -> DataFrame:
    """``(library, content, error)``: one library of each group's ``name`` and ``data``, as a value.

    A library of over ``largest`` bytes, or one with an error as in
    :func:`library_blocks`, is a row with an error; ``sinks.write_libraries``
    writes those of any size that the format allows.
    """
    return library_stretches(rows, library, unicode, largest=largest, whole=True).select("library", F.col("bytes").alias("content"), "error")


def folder_rows(files: DataFrame, text_col: str = "content") -> DataFrame:
    """``(library, name, data)`` of a tree of source files with names as in a scan; the first folder names the library."""
    return files.select("library", "name", F.col(text_col).alias("data"))


@F.pandas_udf(BinaryType())
def _from_gbk(data: pd.Series) -> pd.Series:
    """UTF-8 bytes of GBK texts, null where they are none."""

    def one(raw: bytes | None) -> bytes | None:
        try:
            return None if raw is None else raw.decode("gbk").encode()
        except UnicodeDecodeError:
            return None

    return data.map(one)


@F.pandas_udf(BinaryType())
def _to_gbk(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else t.encode("gbk", "replace"))


def source_text(data: Column) -> Column:
    """Text of entries: by byte order mark, as UTF-16 where every other byte is zero, as UTF-8, else GBK, else Latin-1.

    All but GBK is decoded by Spark itself; bytes that are something else
    never reach the Python worker.
    """
    digits = F.hex(F.substring(data, 1, 3))
    # of the first 64 bytes, as characters, only the zeros at even places stay
    zeros = F.char_length(F.regexp_replace(F.decode(F.substring(data, 1, 64), "ISO-8859-1"), r"(?s).(\x00)|.{1,2}", "$1"))
    wide = (F.octet_length(data) >= 4) & (zeros > 0.6 * F.floor(F.least(F.octet_length(data), F.lit(64)) / 2))
    mark = F.left(digits, F.lit(4))
    whole = F.when(F.octet_length(data) % 2 == 1, F.substring(data, F.lit(1), F.octet_length(data) - 1)).otherwise(data)
    first = lambda c: F.substring_index(c, "\0", 1)
    utf16 = lambda c, charset: first(F.decode(c, charset))
    after = F.substring(whole, F.lit(3), F.octet_length(whole))
    plain = F.when(F.left(digits, F.lit(6)) == "EFBBBF", F.substring(data, F.lit(4), F.octet_length(data))).otherwise(data)
    known = mark.isin("FFFE", "FEFF") | wide
    utf8 = F.try_validate_utf8(F.when(~known, plain))
    gbk = F.decode(_from_gbk(F.when(~known & utf8.isNull(), data)), "UTF-8")
    narrow = F.replace(F.coalesce(utf8, gbk, F.decode(F.when(~known, data), "ISO-8859-1")), F.lit("\0"), F.lit(""))
    return F.when(mark == "FFFE", utf16(after, "UTF-16LE")).when(mark == "FEFF", utf16(after, "UTF-16BE")).when(wide, utf16(whole, "UTF-16LE")).otherwise(narrow)


def encoded(text: Column, charset: str = "UTF-16LE") -> Column:
    """Bytes of a text, as entries of a library hold them; GBK too."""
    return _to_gbk(text) if charset.upper() == "GBK" else F.encode(text, charset)


def listing(entry_rows: DataFrame) -> DataFrame:
    """Entries, source entries, compiled ones and errors of each library file."""
    known = F.col("error").isNull()
    return entry_rows.groupBy("path").agg(F.count_if(known).alias("entries"), F.count_if(known & F.col("is_source")).alias("source"), F.count_if(known & ~F.col("is_source")).alias("compiled"), F.count_if(~known).alias("errors"))


def of_origin(entry_rows: DataFrame, compiled: bool = False) -> DataFrame:
    """Source entries, or compiled ones."""
    return entry_rows.where(F.col("error").isNull() & (F.col("is_source") != F.lit(compiled)))


def sources(entry_rows: DataFrame) -> DataFrame:
    """Source entries with their ``text``."""
    return entry_rows.where(F.col("is_source")).withColumn("text", source_text(F.col("data"))).drop("data")


def entry(entry_rows: DataFrame, name: str) -> DataFrame:
    """The entry of a name, in any case; one for each library."""
    return entry_rows.where(F.lower("name") == name.lower()).dropDuplicates(["path"])


#: Folders of an export by type where they are not the type's own name: fixed values.
TYPE_FOLDERS = {"web_service": "webservice"}


def type_folder(type_label: Column) -> Column:
    """Folder that an export by type puts an entry into."""
    out = F.coalesce(type_label, F.lit("other"))
    for label, folder in TYPE_FOLDERS.items():
        out = F.when(out == label, folder).otherwise(out)
    return out


def type_label(code: Column) -> Column:
    """Type by number, ``other`` for an unknown one."""
    return F.coalesce(F.get(F.array(*map(F.lit, TYPES)), code), F.lit("other"))


def type_name(name: Column) -> Column:
    """Type by extension, as a column."""
    labels = F.create_map(*[F.lit(x) for e, t in EXTENSION_TYPES.items() for x in (e, TYPES[t])])
    return F.coalesce(labels[extension(name)], F.lit("binary"))
