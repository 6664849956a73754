"""Files written by the tasks that hold them and seen when all are done: sources as text, libraries, extracted data as it is; each by itself or many in an archive."""

from __future__ import annotations

import io
import json
import posixpath
import threading
import time
import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import batched, islice, repeat

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators.graph import library_of
from .libraries import BATCH_BYTES, library_stretches, sources, type_folder
from .library_source import member_region

#: Exported sources below so many bytes are left out: a fixed value.
LEAST_BYTES = 10


#: Where a folder keeps what tasks have written before it is committed, and the lists of what was.
STAGING, MANIFEST = "_staging", "_manifest"
MANIFEST_SCHEMA = "path string, bytes long, error string"
#: The list of files in archives tells also in which one each lies, where its data starts, and its compressed size, null if it lies there as it is.
ARCHIVE_SCHEMA = f"{MANIFEST_SCHEMA}, archive string, at long, packed long"
#: Lines of a list that are written at once.
NOTED = 1000
#: Files and bytes from which a task begins another archive.
ARCHIVE_FILES, ARCHIVE_BYTES = 20_000, 256 << 20
#: Bytes up to which a file of an archive is compressed; a larger one lies in it as it is, so that its ranges can be read.
COMPRESSED = 1 << 20
#: Files that are moved side by side when a job commits.
MOVERS = 32
#: Files that one of them moves at a time, and the list of attempts whose files wait to be moved.
MOVED, ATTEMPTS = 64, "_attempts"
#: Seconds before each try to delete what is staged.
CLEARED_AFTER = (0, 0.2, 1, 3)


def clean_path(path: str | None) -> str:
    """A path below the folder, or a ValueError."""
    clean = posixpath.normpath(path or ".")
    if clean.startswith("/") or clean.split("/")[0] in ("..", ".", STAGING, MANIFEST):
        raise ValueError("path outside the folder")
    return clean


def place_attempt(folder: str, attempt: str) -> None:
    """Move the files of an attempt to their places; those that are there already, from a move that was cut off, stay."""
    store, root = fs.FileSystem.from_uri(folder)
    made: set[str] = set()
    lock = threading.Lock()

    def move(paths: tuple[str, ...]) -> None:
        for path in paths:
            source, target = f"{attempt}/files/{path}", f"{root}/{path}"
            above = posixpath.dirname(target)
            with lock:
                if above not in made:
                    store.create_dir(above, recursive=True)
                    made.add(above)
            try:
                store.move(source, target)
            except OSError:
                there = store.get_file_info(target).type == fs.FileType.File
                if store.get_file_info(source).type == fs.FileType.NotFound:
                    if there:
                        continue
                    raise
                if not there:
                    raise
                store.delete_file(target)
                store.move(source, target)

    def paths() -> Iterator[str]:
        with store.open_input_stream(f"{attempt}/{MANIFEST}") as listed:
            for line in io.TextIOWrapper(listed, "utf-8"):
                row = json.loads(line)
                if row["error"] is None:
                    yield clean_path(row["path"])

    with ThreadPoolExecutor(MOVERS) as pool:
        every = batched(dict.fromkeys(paths()), MOVED)
        while some := [pool.submit(move, x) for x in islice(every, MOVERS)]:
            for done in some:
                done.result()


class Loose:
    """Files of an attempt, each by itself."""

    def __init__(self, store: fs.FileSystem, folder: str):
        self.store, self.folder, self.made, self.out = store, folder, set(), None

    def begin(self, path: str) -> None:
        whole = f"{self.folder}/{path}"
        above = posixpath.dirname(whole)
        if above not in self.made:
            self.store.create_dir(above, recursive=True)
            self.made.add(above)
        self.out = self.store.open_output_stream(whole)

    def write(self, data: pa.Buffer) -> int:
        return self.out.write(data)

    def end(self) -> dict:
        self.out.close()
        return {}

    def close(self) -> None:
        pass

    def drop(self) -> None:
        """Let go of what a failing task has open."""
        if self.out is not None:
            self.out.close()


class Archives:
    """Files of an attempt in ZIP archives, which are named ``name``-``k``.zip."""

    def __init__(self, store: fs.FileSystem, folder: str, name: str):
        self.store, self.folder, self.name, self.k, self.zip = store, folder, name, 0, None
        store.create_dir(folder, recursive=True)

    def begin(self, path: str) -> None:
        if "\0" in path or len(path.encode()) > zipfile.ZIP_FILECOUNT_LIMIT:
            raise ValueError("no name for an archive")
        if self.zip is None:
            self.files, self.archive = 0, f"{self.name}-{self.k}.zip"
            self.stream = self.store.open_output_stream(f"{self.folder}/{self.archive}")
            self.zip, self.k = zipfile.ZipFile(self.stream, "w"), self.k + 1
        self.path, self.held, self.out = path, bytearray(), None

    def _open(self, method: int) -> None:
        self.info = zipfile.ZipInfo(self.path)
        self.info.compress_type, self.info.compress_level = method, 1
        self.out = self.zip.open(self.info, "w", force_zip64=method == zipfile.ZIP_STORED)
        self.at = self.stream.tell()
        self.out.write(self.held)

    def write(self, data: pa.Buffer) -> int:
        if self.out is None and len(self.held) + data.size <= COMPRESSED:
            self.held += data
        else:
            if self.out is None:
                self._open(zipfile.ZIP_STORED)
            self.out.write(data)
        return data.size

    def end(self) -> dict:
        if small := self.out is None:
            self._open(zipfile.ZIP_DEFLATED)
        self.out.close()
        self.files += 1
        told = {"archive": self.archive, "at": self.at, "packed": self.info.compress_size if small else None}
        if self.files >= ARCHIVE_FILES or self.stream.tell() >= ARCHIVE_BYTES:
            self.close()
        return told

    def close(self) -> None:
        if self.zip is not None:
            self.zip.close()
            self.stream.close()
            self.zip = None

    def drop(self) -> None:
        if self.zip is not None:
            self.stream.close()


@dataclass
class Written(WriterCommitMessage):
    """What a task leaves: the folder of its attempt, and counts."""

    attempt: str
    files: int
    errors: int


class FileWriter(DataSourceArrowWriter):
    """Files of ``(path, content)`` rows; rows of one path that follow each other are one file.

    Rows may have an ``error`` too: such a path is listed with it, not written.

    A task writes below the staging folder of its attempt, with a list of what
    it wrote. Only when all tasks have ended are the files moved to their
    places, and the lists after them. With ``later`` the commit leaves the
    moves to whoever started the job, see :func:`write_files`. A task that fails or runs twice leaves
    nothing that is seen, and a job that fails leaves nothing at all.
    """

    #: How a task's list is compressed, and how it is called in its place.
    packing, listed_as = None, ".json"

    def __init__(self, folder: str, job: str, later: bool = False):
        self.folder, self.job, self.later = folder, job, later

    def files(self, store: fs.FileSystem, attempt: str) -> Loose | Archives:
        return Loose(store, f"{attempt}/files")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(self.folder)
        context = TaskContext.get()
        attempt = f"{root}/{STAGING}/{self.job}/{context.partitionId()}-{context.taskAttemptId()}" if context else f"{root}/{STAGING}/{self.job}/{uuid.uuid4().hex}"
        store.create_dir(attempt, recursive=True)
        message = Written(attempt, 0, 0)
        with store.open_output_stream(f"{attempt}/{MANIFEST}", compression=self.packing) as listed:
            lines: list[str] = []
            name, going, n, files = None, False, 0, self.files(store, attempt)

            def note(path: str | None, n: int | None, error: str | None, **more) -> None:
                lines.append(json.dumps({"path": path, "bytes": n, "error": error} | more) + "\n")
                if len(lines) >= NOTED:
                    listed.write("".join(lines).encode())
                    lines.clear()

            def close() -> None:
                nonlocal going
                if going:
                    note(name, n, None, **files.end())
                    message.files += 1
                    going = False

            try:
                for batch in batches:
                    wrong = batch.column("error").to_pylist() if "error" in batch.schema.names else repeat(None)
                    for path, data, error in zip(batch.column("path").to_pylist(), batch.column("content"), wrong):
                        if error is not None:
                            close()
                            note(path, None, error)
                            message.errors += 1
                            continue
                        if not going or path != name:
                            close()
                            name, n = path, 0
                            try:
                                clean = clean_path(path)
                                files.begin(clean)
                                going = True
                            except ValueError as e:
                                note(path, None, str(e))
                                message.errors += 1
                                continue
                        if data.is_valid:
                            n += files.write(data.as_buffer())
                close()
                files.close()
                listed.write("".join(lines).encode())
            except BaseException:
                files.drop()
                raise
        return message

    def commit(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.folder)
        attempts = [m.attempt for m in messages if m is not None]
        if self.later:
            with store.open_output_stream(f"{root}/{STAGING}/{self.job}/{ATTEMPTS}") as out:
                out.write(json.dumps(attempts).encode())
            return
        for a in attempts:
            place_attempt(self.folder, a)
        self.finish(attempts)

    def finish(self, attempts: list[str]) -> None:
        """The lists go to their places when all files are there, and what is staged goes."""
        store, root = fs.FileSystem.from_uri(self.folder)
        if attempts:
            store.create_dir(f"{root}/{MANIFEST}/{self.job}", recursive=True)
        for a in attempts:
            store.move(f"{a}/{MANIFEST}", f"{root}/{MANIFEST}/{self.job}/{posixpath.basename(a)}{self.listed_as}")
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*fs.FileSystem.from_uri(self.folder))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        own = f"{root}/{STAGING}/{self.job}"
        for left in reversed(range(len(CLEARED_AFTER))):  # a task that is being stopped may still write
            time.sleep(CLEARED_AFTER[-1 - left])
            try:
                if store.get_file_info(own).type == fs.FileType.Directory:
                    store.delete_dir(own)
                return
            except OSError:
                if not left:
                    raise


class ArchiveWriter(FileWriter):
    """The same files in archives; a job moves these, which are few, when it commits."""

    packing, listed_as = "gzip", ".json.gz"

    def files(self, store: fs.FileSystem, attempt: str) -> Archives:
        return Archives(store, f"{attempt}/files", f"{self.job}-{posixpath.basename(attempt)}")

    def commit(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.folder)
        attempts = [m.attempt for m in messages if m is not None]
        made = [info for a in attempts for info in store.get_file_info(fs.FileSelector(f"{a}/files", allow_not_found=True))]
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda info: store.move(info.path, f"{root}/{info.base_name}"), made))
        self.finish(attempts)


class FileSink(DataSource):
    """``df.write.format("tree").option("folder", ...)``: options ``folder``, a URI, ``job``, a name for its list, and ``archived``."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        kind = ArchiveWriter if self.options.get("archived", "false").lower() == "true" else FileWriter
        return kind(self.options["folder"], self.options.get("job", uuid.uuid4().hex), self.options.get("later", "false").lower() == "true")


def write_files(files: DataFrame, folder: str, path: str = "path", content: str = "content", error: str | None = None, archived: bool = False) -> DataFrame:
    """Write each row's bytes to ``path`` below ``folder``, now, and return the list of what was: ``path, bytes, error``.

    The files are written once, through whatever file system the folder's URI
    names, and moved to their places when all of them are there, by as many
    tasks as wrote them: see :class:`FileWriter`. Paths
    that lead out of the folder are rows with an error, and so are those that
    have one in the column ``error``. Of two rows of one
    path that are not side by side one stays. Null content is an empty file.

    ``archived`` puts the files into ZIP archives of at most
    :data:`ARCHIVE_FILES` files: a file system's cost of a file, mostly a
    block and a search for a free inode, is paid once for each archive. The
    list has the columns of :data:`ARCHIVE_SCHEMA` then,
    :func:`archived_files` reads the files back, and any unzip makes the tree.
    Both of two rows of one path that are not side by side are kept.
    """
    spark, job, schema = files.sparkSession, uuid.uuid4().hex, ARCHIVE_SCHEMA if archived else MANIFEST_SCHEMA
    spark.dataSource.register(FileSink)
    wrong = [F.col(error).alias("error")] if error else []
    files.select(F.col(path).cast("string").alias("path"), F.col(content).cast("binary").alias("content"), *wrong).write.format(FileSink.name()).option("folder", folder).option("job", job).option("later", "true").option("archived", str(archived)).mode("append").save()
    store, root = fs.FileSystem.from_uri(folder)
    waiting = f"{root}/{STAGING}/{job}/{ATTEMPTS}"
    if store.get_file_info(waiting).type == fs.FileType.File:
        with store.open_input_stream(waiting) as f:
            attempts = json.loads(f.read())  # one for each task that wrote
        writer = FileWriter(folder, job)
        try:
            if attempts:
                spark.createDataFrame([(a,) for a in attempts], "attempt string").repartition(len(attempts)).foreach(lambda row: place_attempt(folder, row["attempt"]))
            writer.finish(attempts)
        except Exception:
            writer.abort([])
            raise
    listed = f"{folder}/{MANIFEST}/{job}"
    if store.get_file_info(f"{root}/{MANIFEST}/{job}").type != fs.FileType.Directory:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(listed)


def archived_files(listed: DataFrame, folder: str) -> DataFrame:
    """``(path, content)`` of the files in archives below ``folder``, by the list that :func:`write_files` gave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        row = lambda rows: pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["path", "content"])
        name, file, rows, held = None, None, [], 0
        for batch in batches:
            for x in batch.to_pylist():
                if x["archive"] != name:
                    name, file = x["archive"], store.open_input_file(f"{root}/{x['archive']}")
                rows.append((x["path"], member_region(file, x["bytes"], x["at"], x["packed"]).at(0, x["bytes"])))
                held += x["bytes"]
                if held > BATCH_BYTES:
                    yield row(rows)
                    rows, held = [], 0
        if rows:
            yield row(rows)

    return listed.where("error is null").select("path", "bytes", "archive", "at", "packed").mapInArrow(run, "path string, content binary")


def discard_files(folder: str, listed: DataFrame | None = None) -> None:
    """Delete what was written to a folder, but for the lists of it; the files of ``listed`` go in tasks first."""
    store, root = fs.FileSystem.from_uri(folder)

    def delete(rows) -> None:
        own, at = fs.FileSystem.from_uri(folder)
        for row in rows:
            try:
                own.delete_file(f"{at}/{clean_path(row['path'])}")
            except FileNotFoundError:
                pass  # another row of its path, or a task that ran before

    if listed is not None:
        listed.where("error is null").select("path").foreachPartition(delete)
    for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.type == fs.FileType.Directory and info.base_name != MANIFEST:
            store.delete_dir(info.path)
        elif info.type == fs.FileType.File:
            store.delete_file(info.path)


def write_libraries(rows: DataFrame, folder: str, library: str = "library", unicode: bool = True, suffix: str = ".pbl") -> DataFrame:
    """Write a library of each group's ``name`` and ``data``, of any size that the format allows; a row per file: ``path, bytes, error``.

    The stretches of a library pass through one task in order, so its memory
    is bounded whatever the library's size. See ``libraries.library_stretches``.
    """
    made = library_stretches(rows, library, unicode).withColumn("path", F.concat("library", F.lit(suffix)))
    return write_files(made, folder, content="bytes", error="error")


#: What an export counts on its way: entries by what becomes of them.
OUTCOMES = ("sources", "compiled", "failed", "skipped")


def export_entries(entry_rows: DataFrame, folder: str, by_type: bool = True, archived: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """Write the source entries of libraries to a tree, or to archives of one; ``(list of the files, counts)``.

    The counts are observed while the export runs: sources, compiled entries,
    files that are no libraries, and sources that are too short to be written.
    Nothing is read or parsed a second time for them.
    """
    seen, short = Observation(), Observation()
    known = F.col("error").isNull()
    watched = entry_rows.observe(seen, F.count_if(known & F.col("is_source")).alias("sources"), F.count_if(known & ~F.col("is_source")).alias("compiled"), F.count_if(~known).alias("failed"))
    held = sources(watched).withColumn("library", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*\z", ""))
    parts = [F.col("library")] + ([type_folder(F.col("type_name"))] if by_type else []) + [F.col("name")]
    placed = held.select(F.concat_ws("/", *parts).alias("path"), file_bytes(F.col("text")).alias("content")).observe(short, F.count_if(F.col("content").isNull()).alias("skipped"))
    done = write_files(placed.where("content is not null"), folder, archived=archived)
    return done, {k: seen.get.get(k, short.get.get(k, 0)) for k in OUTCOMES}


def file_bytes(text: Column) -> Column:
    """UTF-8 bytes of a source without its NUL characters; null where too little is left to be a source."""
    data = F.encode(F.replace(text, F.lit("\0"), F.lit("")), "UTF-8")
    return F.when(F.octet_length(data) >= LEAST_BYTES, data)


def export_paths(sources: DataFrame, by_type: bool = False, library: str | None = None, text_col: str = "text") -> DataFrame:
    """``(path, content)`` of sources with ``name``: flat, below a folder per type, and below a folder per library if one is named.

    The names keep their extensions; too short sources are left out.
    """
    parts = ([F.col(library)] if library else []) + ([type_folder(F.col("type_name"))] if by_type else []) + [F.col("name")]
    return _long_enough(sources.select(F.concat_ws("/", *parts).alias("path"), file_bytes(F.col(text_col)).alias("content")))


def _long_enough(placed: DataFrame) -> DataFrame:
    """Without the sources that are too short.

    The filter stays where it is, above an observation: Spark would push it
    below a shuffle and make every text twice, the first time by as few tasks
    as read the keys.
    """
    return placed.observe(uuid.uuid4().hex, F.count("*").alias("placed")).where("content is not null")


def tree_paths(sources: DataFrame, project: str, custom: list[tuple[str, str]] = (), suffix: str = ".pbl", text_col: str = "text") -> DataFrame:  # type: ignore[assignment]
    """``(path, content)`` of sources below the library that each one's name implies; resources are left out."""
    placed = sources.withColumn("_library", library_of(F.col("name"), project, custom)).where("_library is not null")
    return _long_enough(placed.select(F.concat("_library", F.lit(suffix), F.lit("/"), "name").alias("path"), file_bytes(F.col(text_col)).alias("content")))


def export_note(entry_rows: DataFrame) -> DataFrame:
    """What an export of each library file says: how many sources there are, or that all entries are compiled."""
    counted = entry_rows.where("error is null").groupBy("path").agg(F.count_if("is_source").alias("sources"), F.count("*").alias("entries"))
    return counted.select("path", "sources", F.when(F.col("sources") == 0, F.concat(F.lit("only compiled entries: "), "entries")).otherwise(F.concat("sources", F.lit(" exported"))).alias("note"))


def embedded_paths(resource_rows: DataFrame) -> DataFrame:
    """``(path, content)`` of resources read from executables, libraries and images alike, named by type, id and language."""
    name = F.concat_ws("_", "type_id", "resource_id", "language_id")
    folder = F.element_at(F.split("path", "/"), -1)
    return resource_rows.where("error is null").select(F.concat(folder, F.lit("/"), name, F.when(F.col("is_library"), ".pbd").otherwise(".bin")).alias("path"), F.col("data").alias("content"))
