"""Scans of folders: source files, libraries, executables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension

#: Folders that a source scan leaves out, besides those that start with a dot.
SKIPPED = ("node_modules", "target")
SOURCE_EXTENSIONS = (".sra", ".srd", ".srw", ".srm", ".srf", ".srs", ".sru", ".srq", ".srp", ".srj", ".srx", ".sre")


def scan(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """``path, modificationTime, length, content`` of every file; content is read only where it is used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)


def relative(path: Column, root: str) -> Column:
    """The path below ``root``."""
    clean = "/" + root.split("://")[-1].strip("/") + "/"
    return F.element_at(F.split(path, rf"\Q{clean}\E", 2), -1)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def with_names(files: DataFrame, root: str) -> DataFrame:
    """Adds ``relative``, ``name``, ``ext``, ``depth`` and ``library`` (the first folder, ``(root)`` for files in none)."""
    rel = relative(F.col("path"), root)
    return files.withColumn("relative", rel).withColumn("name", file_name(F.col("path"))).withColumn("ext", extension(F.col("name"))).withColumn("depth", F.size(F.split("relative", "/")) - 1).withColumn("library", F.when(F.col("depth") == 0, "(root)").otherwise(F.substring_index("relative", "/", 1)))


def source_files(files: DataFrame, extensions: tuple[str, ...] = SOURCE_EXTENSIONS, skip_folders: bool = True, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """Files of :func:`with_names` with one of the extensions, in any case, outside skipped folders.

    Folders that start with a dot are skipped, and those named in ``skipped``;
    with none named, dot folders alone. Without ``skip_folders`` the whole
    tree counts.
    """
    out = files.where(F.col("ext").isin(*[e.lower() for e in extensions]))
    if skip_folders:
        folder = F.lit(rf"(?:^|/)(?:{'|'.join([r'\.[^/]*', *skipped])})/")
        out = out.where(~F.regexp_like("relative", folder))
    return out


def library_files(files: DataFrame) -> DataFrame:
    """Libraries anywhere in a tree."""
    return source_files(files, (".pbl",), skip_folders=False)


def report_files(files: DataFrame) -> DataFrame:
    """Libraries, compiled libraries and executables of a tree, names in lower case."""
    return source_files(files, (".pbl", ".pbd", ".exe"), skip_folders=False).withColumn("name", F.lower("name"))


def shallow_files(files: DataFrame, depth: int = 3, quick: bool = False) -> DataFrame:
    """Files at most ``depth`` folders down, with their ``kind`` by first bytes; ``quick`` goes by the extension and reads no content."""
    near = files.where(F.col("depth") <= depth)
    return near.withColumn("kind", F.replace("ext", F.lit("."), F.lit("")) if quick else file_kind(F.col("content"), F.col("name")))


def file_kind(content: Column, name: Column) -> Column:
    """``pbl``, ``pbd``, ``exe`` or the extension, by the first bytes."""
    head = F.substring(content, 1, 4)
    return F.when(head == F.lit(b"HDR*"), F.when(extension(name) == ".pbd", "pbd").otherwise("pbl")).when(head == F.lit(b"PBD*"), "pbd").when(F.substring(content, 1, 2) == F.lit(b"MZ"), "exe").otherwise(F.replace(extension(name), F.lit("."), F.lit("")))


def decoded(content: Column) -> Column:
    """Text by byte order mark: UTF-16 or UTF-8; without one UTF-8, else Latin-1."""
    head2, head3 = F.substring(content, 1, 2), F.substring(content, 1, 3)
    rest = lambda n: F.substring(content, n, 2**31 - 1)
    utf8 = F.try_validate_utf8(content.cast("string"))
    return F.when(head2 == F.lit(b"\xff\xfe"), F.decode(rest(3), "UTF-16LE")).when(head2 == F.lit(b"\xfe\xff"), F.decode(rest(3), "UTF-16BE")).when(head3 == F.lit(b"\xef\xbb\xbf"), F.decode(rest(4), "UTF-8")).otherwise(F.coalesce(utf8, F.decode(content, "ISO-8859-1")))


def read_sources(spark: SparkSession, root: str, extensions: tuple[str, ...] = SOURCE_EXTENSIONS) -> DataFrame:
    """``path, relative, library, name, ext, size, modified, text`` of the source files below ``root``."""
    files = source_files(with_names(scan(spark, root), root), extensions)
    return files.select("path", "relative", "library", "name", "ext", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), decoded(F.col("content")).alias("text"))


def projects(files: DataFrame) -> DataFrame:
    """One row about the files right below the root: names by kind, and whether there is any library."""
    top = files.where("depth = 0")
    of = lambda *e: F.array_sort(F.collect_list(F.when(F.col("ext").isin(*e), F.col("name"))))
    return top.agg(of(".pbl").alias("libraries"), of(".pbt").alias("targets"), of(".pbw").alias("workspaces"), of(".exe", ".pbd").alias("binaries")).withColumn("is_valid", F.size("libraries") > 0)
