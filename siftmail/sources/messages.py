"""Messages from files and pasted text, batch and streaming, and a mailbox made of text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mailfiles import read_mail

FILES = "path string, modificationTime timestamp, length long, content binary"


def _named(files: DataFrame) -> DataFrame:
    return files.select(
        F.sha2("content", 256).alias("message_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.col("length").alias("size_bytes"), F.col("content").alias("raw"),
        F.col("modificationTime").alias("arrived"),
    )


def read_messages(spark: SparkSession, path: str, extensions: str = "eml,txt", mailboxes: str = "mbox", partition_bytes: int = 64 << 20) -> DataFrame:
    """message_id (sha-256 of the bytes), filename, size_bytes, raw, read_error: one row per file below ``path`` and per
    message of a mailbox. A file that can't be read has its fault in read_error, and an id made of its path."""
    files = read_mail(spark, path, extensions=extensions, mboxExtensions=mailboxes, partitionBytes=str(partition_bytes))
    named = F.sha2(F.coalesce("raw", F.concat("path", F.lit(":"), "start").cast("binary")), 256)
    return files.select(named.alias("message_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "size_bytes", "raw", "read_error")


def stream_messages(spark: SparkSession, path: str, glob: str = "*.{eml,txt}", files_per_trigger: int = 1000) -> DataFrame:
    """The same as a stream of the files that arrive, with ``arrived``, their time of modification."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return _named(files.option("maxFilesPerTrigger", files_per_trigger).load(path))


def pasted(texts: DataFrame, column: str = "text") -> DataFrame:
    """Rows of pasted text that look like a message: at least 40 characters and a header line. Encoded as UTF-8."""
    t = F.col(column)
    raw = F.encode(t, "UTF-8")
    rows = texts.where((F.length(t) >= 40) & t.rlike(r"(?m)^[\w-]+\s*:"))
    return rows.select(F.sha2(raw, 256).alias("message_id"), F.lit("pasted.eml").alias("filename"), F.octet_length(raw).cast("long").alias("size_bytes"), raw.alias("raw"))
