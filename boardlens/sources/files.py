"""Files as tables: logs in batch or as a stream, code trees, signature libraries and binary images."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlens.operators import index, logs

#: Bytes that no text file has, and that make a log file one to look at.
_NOT_TEXT = "\x00"


def text_of(content: Column) -> Column:
    """Bytes as UTF-8; what isn't becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def _logs(df: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    out = df.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("file"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), text_of(F.col("content")).alias("content"))
    return out.where(logs.is_log_file(F.col("file"), F.lit(logs.V.LEAST_FILE_BYTES)))


def log_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, path, size, modified, content) of log files: those right in a directory, or files that are named. Bad bytes become U+FFFD."""
    return _logs(spark.read.format("binaryFile").load([*paths]))


def log_stream(spark: SparkSession, directory: str, files_per_batch: int = 100) -> DataFrame:
    """The same as a stream: each file once, when it appears; files that are gone by the time they are read are passed over."""
    read = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_per_batch).option("ignoreMissingFiles", True)
    return _logs(read.schema("path string, modificationTime timestamp, length long, content binary").load(directory))


def file_error(file: Column, size: Column, content: Column) -> Column:
    """What keeps a file from being parsed, else null."""
    return F.when(size < logs.V.LEAST_FILE_BYTES, F.concat(F.lit("too short: "), size.cast("string"), F.lit(" bytes"))).when(content.contains(_NOT_TEXT), "not text")


def code_files(spark: SparkSession, *roots: str) -> DataFrame:
    """(root, file_path, content) of the code below roots; file_path is relative to its root. A file below two roots comes once.

    Only what stands below a root decides what is skipped, so a root may lie anywhere.
    """

    def below(root: str) -> DataFrame:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        at = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath().rstrip("/")
        got = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(root)
        whole = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
        own = got.select(F.lit(root).alias("root"), whole.alias("whole"), F.substring(whole, len(at) + 2, 1 << 20).alias("file_path"), F.col("value").alias("content"))
        return own.where(index.wanted(F.col("file_path")))

    return reduce(DataFrame.unionByName, map(below, roots)).dropDuplicates(["whole"]).drop("whole")


def images(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").load([*paths]).select("path", "content")
