"""Libraries as a Spark data source: a large one is split, and a filter reads only the entries it wants.

``spark.read.format("library").load(folder)`` gives the rows of
``libraries.read_entries`` without the whole file as a value: node blocks are
read to list the entries, and the data blocks of those that a task takes.
Filters on path, name and type are tried on the list, before any data is read.
"""

from __future__ import annotations

import fnmatch
import posixpath
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import attrgetter

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

from .libraries import BLOCK, ENTRY_ARROW, ENTRY_SCHEMA, Region, entries, payload

FORMAT = "library"
#: Bytes of a file that one task reads, about.
SPLIT_BYTES = 64 << 20
#: Tasks from which on they read more than one part each, up to so many bytes: with more of them, starting them costs more than reading.
TASKS = 256
#: Bytes of data that a task hands over at once.
BATCH_BYTES = 8 << 20
#: Columns that a filter is tried on before data is read.
LISTED = ("path", "name", "type_name", "type_code", "is_source", "version")


class FileRegion(Region):
    """Bytes of a file, or of the part from ``first`` on, read where they are asked for; ``read_bytes`` counts them."""

    def __init__(self, file, size: int, first: int = 0):
        self.file, self.size, self.first, self.read_bytes = file, size, first, 0

    def at(self, start: int, n: int) -> bytes:
        n = max(0, min(n, self.size - start))
        self.read_bytes += n
        return self.file.read_at(n, self.first + start) if n else b""


def member_region(archive, size: int, at: int, packed: int | None) -> Region:
    """Bytes of a file in an archive: in place, or if it is compressed, which small ones are, in memory."""
    return FileRegion(archive, size, at) if packed is None else Region(zlib.decompress(archive.read_at(packed, at), -zlib.MAX_WBITS, max(size, 1)))


@dataclass
class Part:
    """One of the ``of`` parts of a file."""

    path: str
    size: int
    k: int
    of: int


@dataclass
class Bundle(InputPartition):
    """What one task reads: a part of a large file, or as many small ones as make up a part."""

    parts: list[Part]


def bundled(parts: list[Part], most_bytes: int, most_parts: int = 2000) -> list[Bundle]:
    """Parts in order, together up to so many bytes."""
    out, held = [], 0
    for p in parts:
        size = -(-p.size // p.of)
        if not out or held + size > most_bytes or len(out[-1].parts) >= most_parts:
            out.append(Bundle([]))
            held = 0
        out[-1].parts.append(p)
        held += size
    return out


def listed(folder: str, pattern: str, split: int) -> list[Part]:
    """Parts of all files below a folder, or of the one file, whose names match."""
    store, root = fs.FileSystem.from_uri(folder)
    scheme = folder.partition("://")[0] + "://" if "://" in folder else ""
    info = store.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
    files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and (f.path == root or fnmatch.fnmatch(posixpath.basename(f.path).lower(), pattern)))
    return [Part(scheme + path, size, k, of) for path, size in files for of in [max(1, -(-size // split))] for k in range(of)]


def wanted(row: dict, filters: list[Filter]) -> bool:
    """Whether a listed entry passes the filters; equality is Spark's, null passes none."""
    for f in filters:
        value = row.get(f.attribute[0])
        if value is None:
            return False
        if isinstance(f, EqualTo) and value != f.value or isinstance(f, In) and value not in f.value:
            return False
        if isinstance(f, StringStartsWith) and not value.startswith(f.value) or isinstance(f, StringEndsWith) and not value.endswith(f.value):
            return False
    return True


class LibraryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.pattern = options["path"], options.get("pattern", "*.pb[ld]").lower()
        self.strict, self.split = options.get("strict", "false").lower() == "true", int(options.get("splitBytes", SPLIT_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and f.attribute[0] in LISTED and len(f.attribute) == 1:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Bundle]:
        paths = [f for f in self.filters if f.attribute[0] == "path"]
        parts = [p for p in listed(self.folder, self.pattern, self.split) if wanted({"path": p.path}, paths)]
        whole = sum(p.size for p in parts if p.k == 0)
        return bundled(parts, max(self.split, min(whole // TASKS, SPLIT_BYTES)))

    def read(self, bundle: Bundle) -> Iterator[pa.RecordBatch]:
        for path, parts in groupby(bundle.parts, attrgetter("path")):
            store, at = fs.FileSystem.from_uri(path)
            with store.open_input_file(at) as file:
                first, *more = parts
                yield from self.batches(first, FileRegion(file, first.size), [p.k for p in more])

    def batches(self, part: Part, region: Region, more: Iterable[int] = ()) -> Iterator[pa.RecordBatch]:
        """Every ``of``-th entry of a file, from the ``k``-th on, and from each of ``more``; it is listed once for them."""
        turns = {part.k, *more}
        try:  # all of the list first: as in read_entries, a file whose nodes are broken is one row with an error and nothing else
            found = list(entries(region, self.strict, data=False, turns=(turns, part.of)))
        except (ValueError, struct.error) as e:
            broken = {"path": part.path, "error": str(e)}
            if 0 in turns and wanted(broken, self.filters):
                yield pa.RecordBatch.from_pylist([broken], ENTRY_ARROW)
            return
        rows, held = [], 0
        for e in found:
            e["path"] = part.path
            if not wanted(e, self.filters):
                continue
            rows.append(e | {"data": payload(region, e["data_offset"], e["size"])})
            held += len(rows[-1]["data"])
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, ENTRY_ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ENTRY_ARROW)


class LibrarySource(DataSource):
    """Options: ``path`` (a folder or file), ``pattern`` of file names, ``strict`` as for read_entries, ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ENTRY_SCHEMA

    def reader(self, schema) -> LibraryReader:
        return LibraryReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LibrarySource)
