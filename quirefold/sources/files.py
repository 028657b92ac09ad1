"""PDF discovery and file metadata through Spark's own readers, so any store they know will do."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions.text import basename, media_type, relative

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def check_input(path: str, root: str) -> str:
    """path if it lies below root, else ValueError."""
    bare = lambda p: p.split("://", 1)[-1].rstrip("/")
    if PurePosixPath(bare(root)) not in [PurePosixPath(bare(path)), *PurePosixPath(bare(path)).parents]:
        raise ValueError(f"{path} isn't below {root}")
    return path


def discover(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """A row (path, modificationTime, length, content) for each *.pdf in a folder and below, or for one such file. Without any the
    table is empty. content is only read by plans that use it."""
    check_input(path, root or path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        raise ValueError(f"{path} doesn't exist")
    if fs.getFileStatus(hadoop).isFile() and not path.endswith(".pdf"):
        raise ValueError(f"{path} is no PDF")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(path)


def bare_path(path):
    """Without a scheme, as the root is compared."""
    return F.regexp_replace(path, "^[a-z][a-z0-9+.-]*:(//[^/]*)?", "")


def file_metadata(files: DataFrame, root: str, cache_dir: str | None = None) -> DataFrame:
    """One struct of file data beside path; creation and access times aren't known to Spark's reader and stay null."""
    plain = bare_path(F.col("path"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return files.select("path", F.struct(plain.alias("file_path"), basename(plain).alias("file_name"), media_type(plain).alias("file_type"), F.col("length").alias("file_size"), F.lit(None).cast("string").alias("creation_date"), day("modificationTime").alias("last_modified_date"), F.lit(None).cast("string").alias("last_accessed_date"), relative(plain, root.split("://", 1)[-1]).alias("relative_path"), F.lit(cache_dir).cast("string").alias("cache_dir")).alias("file"))


def attach_extra(files: DataFrame, extra: DataFrame, key: str = "path") -> DataFrame:
    """Extra columns by key, never by position; every file needs its row."""
    from quirefold.operators.checks import none_of

    none_of(files.select(key).join(extra.select(key), key, "left_anti"), "files without extra information")
    return files.join(extra, key)
