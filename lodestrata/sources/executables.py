"""Executables: header facts and the libraries embedded in them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Machines and the resource directory's index: fixed values of the format.
MACHINES = {0x14C: "x86", 0x8664: "x64", 0x1C0: "arm", 0xAA64: "arm64"}
CERTIFICATES = 4

#: Directory of resources, its levels, and what a leaf's data starts with. Fixed values of the format.
RESOURCES, LEVELS, LIBRARY_MARK = 2, 3, b"HDR*"
#: Bytes of data from which rows are handed on; files below that share a batch.
BATCH_BYTES = 1 << 20

IMAGE_ARROW = pa.schema([("path", pa.string()), ("is_pb_exe", pa.bool_()), ("is_64bit", pa.bool_()), ("machine", pa.string()), ("timestamp", pa.int64()), ("embedded", pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64()), ("place", pa.string())]))), ("sections", pa.list_(pa.struct([("name", pa.string()), ("address", pa.int64()), ("offset", pa.int64()), ("size", pa.int64())]))), ("certificates", pa.struct([("offset", pa.int64()), ("size", pa.int64())])), ("error", pa.string())])
IMAGE_SCHEMA = "path string, is_pb_exe boolean, is_64bit boolean, machine string, timestamp long, embedded array<struct<offset:long,size:long,place:string>>, sections array<struct<name:string,address:long,offset:long,size:long>>, certificates struct<offset:long,size:long>, error string"


def _header(raw: bytes) -> dict:
    """Machine, width, time stamp, sections and the directories of certificates and resources."""
    if raw[:2] != b"MZ" or len(raw) < 64:
        raise ValueError("no executable")
    pe = struct.unpack_from("<I", raw, 60)[0]
    if raw[pe : pe + 4] != b"PE\0\0":
        raise ValueError("no PE header")
    machine, count, stamp, optional = struct.unpack_from("<HHI8xH", raw, pe + 4)
    wide = optional >= 2 and struct.unpack_from("<H", raw, pe + 24)[0] == 0x20B
    directories = 112 if wide else 96

    def directory(k: int) -> tuple[int, int]:
        return struct.unpack_from("<II", raw, pe + 24 + directories + 8 * k) if optional >= directories + 8 * (k + 1) else (0, 0)

    table, sections = pe + 24 + optional, []
    for k in range(count):
        name, _, address, size, at = struct.unpack_from("<8sIIII", raw, table + 40 * k)
        sections.append({"name": name.rstrip(b"\0").decode("latin-1"), "address": address, "offset": at, "size": size})
    at, size = directory(CERTIFICATES)
    return {"machine": MACHINES.get(machine, hex(machine)), "is_64bit": wide, "timestamp": stamp, "sections": sections, "certificates": {"offset": at, "size": size} if at else None, "resources": directory(RESOURCES)[0]}


def _limits(header: dict, size: int) -> tuple[int, int]:
    end = max((x["offset"] + x["size"] for x in header["sections"]), default=0)
    certificates = (header["certificates"] or {"offset": 0})["offset"]
    return end, certificates if end <= certificates <= size and certificates else size


def bounds(front: bytes, size: int) -> tuple[int, int]:
    """Where the last section of a file of ``size`` bytes ends, and where a search for libraries stops: at certificates behind it, else at the end."""
    return _limits(_header(front), size)


def image(raw: bytes) -> dict:
    """Header facts, and ``(offset, size, place)`` of embedded libraries: appended after the last section or inside one."""
    header = _header(raw)
    end, stop = _limits(header, len(raw))
    found, at = [], raw.find(LIBRARY_MARK)
    while 0 <= at < stop:
        following = raw.find(LIBRARY_MARK, at + 4)
        until = following if 0 <= following < stop else stop
        if raw[at + 512 : at + 516] == b"FRE*" or raw[at + 1024 : at + 1028] == b"FRE*":
            found.append({"offset": at, "size": until - at, "place": "appended" if at >= end else "section"})
        at = following
    return {k: header[k] for k in ("machine", "is_64bit", "timestamp", "sections", "certificates")} | {"is_pb_exe": bool(found) or b"PowerBuilder" in raw, "embedded": found}


def resources(raw: bytes) -> Iterator[dict]:
    """Leaves of the resource tree: type, id and language, the data's place in the file, and whether it is a library.

    Directories are named by their offset in the resource section; a leaf
    alone gives an address in memory. Each directory is entered once.
    """
    header = _header(raw)

    def place(address: int) -> int:
        for x in header["sections"]:
            if x["address"] <= address < x["address"] + max(x["size"], 1):
                return address - x["address"] + x["offset"]
        return address

    base = place(header["resources"])
    todo, seen = [(0, ())] if header["resources"] else [], set()
    while todo:
        at, ids = todo.pop()
        if len(ids) == LEVELS:
            address, size = struct.unpack_from("<II", raw, base + at)
            start = place(address)
            if 0 < size and start < len(raw):
                data = raw[start : start + size]
                yield {"type_id": ids[0], "resource_id": ids[1], "language_id": ids[2], "offset": start, "size": len(data), "is_library": data[:4] == LIBRARY_MARK, "data": data}
            continue
        if at in seen or base + at + 16 > len(raw):
            continue
        seen.add(at)
        for k in reversed(range(sum(struct.unpack_from("<HH", raw, base + at + 12)))):
            if base + at + 24 + 8 * k <= len(raw):
                name, below = struct.unpack_from("<II", raw, base + at + 16 + 8 * k)
                todo.append((below & 0x7FFFFFFF, (*ids, name & 0x7FFFFFFF)))


RESOURCE_ARROW = pa.schema([("path", pa.string()), ("type_id", pa.int64()), ("resource_id", pa.int64()), ("language_id", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("is_library", pa.bool_()), ("data", pa.binary()), ("error", pa.string())])
RESOURCE_SCHEMA = "path string, type_id long, resource_id long, language_id long, offset long, size long, is_library boolean, data binary, error string"


def read_resources(files: DataFrame) -> DataFrame:
    """A row for each resource of ``files(path, content)``, images and libraries alike; other files carry an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    found = [{"path": path} | r for r in resources(raw or b"")]
                except (ValueError, struct.error) as e:
                    found = [{"path": path, "error": str(e)}]
                rows += found
                held += sum(r.get("size", 0) for r in found)
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, RESOURCE_ARROW)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, RESOURCE_ARROW)

    return files.select("path", "content").mapInArrow(run, RESOURCE_SCHEMA)


def read_images(files: DataFrame) -> DataFrame:
    """A row for each of ``files(path, content)``; files of another kind carry an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    rows.append({"path": path} | image(raw or b""))
                except (ValueError, struct.error) as e:
                    rows.append({"path": path, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, IMAGE_ARROW)

    return files.select("path", "content").mapInArrow(run, IMAGE_SCHEMA)


def embedded_libraries(files: DataFrame) -> DataFrame:
    """``(path, content)`` of every embedded library, ready to be read as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda names, parts: pa.record_batch([pa.array(names, pa.string()), pa.array(parts, pa.binary())], ["path", "content"])
        for batch in batches:
            names, parts, held = [], [], 0
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    found = image(raw or b"")["embedded"]
                except (ValueError, struct.error):
                    continue
                for x in found:
                    names.append(f"{path}#{x['offset']}")
                    parts.append(raw[x["offset"] : x["offset"] + x["size"]])
                    held += len(parts[-1])
                    if held > BATCH_BYTES:
                        yield row(names, parts)
                        names, parts, held = [], [], 0
            if names:
                yield row(names, parts)

    return files.select("path", "content").mapInArrow(run, "path string, content binary")
