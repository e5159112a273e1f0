"""Reports kept as a table: each message is analysed once, however often its file is seen, and every view reads the table.

The table is a folder of Parquet files with one nested row a message (so the nine tables of ``report.tables`` come from one
write), partitioned by the first digit of a digest of id and content. An update takes the messages whose id and content aren't
there yet: it joins them against the digests of the partitions that they fall into, which is all that is read of the
table. A batch that is given twice, or again after a failure, adds nothing the second time.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import rules as R
from ..sources.messages import stream_messages
from .analyze import analyze

KEY = ["bucket", "digest"]


def digest(raw: str = "raw") -> Column:
    """Of id and content; a null is a value of its own in either."""
    told = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    return F.sha2(F.concat_ws(":", told(F.sha2(F.col(raw), 256)), told(F.col("message_id").cast("string"))).cast("binary"), 256)


def keyed(messages: DataFrame, raw: str = "raw") -> DataFrame:
    return messages.withColumn("digest", digest(raw)).withColumn("bucket", F.substring("digest", 1, 1))


def stored(spark: SparkSession, target: str) -> DataFrame | None:
    """The reports in ``target``, with bucket and digest; None before the first update."""
    try:
        return spark.read.parquet(target)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def unknown(messages: DataFrame, known: DataFrame | None, raw: str = "raw") -> DataFrame:
    """The messages that ``known`` has no report of, each once."""
    new = keyed(messages, raw)
    if known is not None:
        buckets = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # sixteen at most
        new = new.join(known.where(F.col("bucket").cast("string").isin(buckets)).select(F.col("bucket").cast("string").alias("bucket"), "digest"), KEY, "left_anti")
    return new.dropDuplicates(KEY)


def update_reports(messages: DataFrame, target: str, *, raw: str = "raw", book: R.Book = R.CATALOGUE) -> int:
    """Reports of the messages (message_id, raw, ...) that ``target`` hasn't yet are added to it; their number."""
    spark = messages.sparkSession
    known = stored(spark, target)
    before = 0 if known is None else known.count()
    new = unknown(messages, known, raw)
    if known is not None and new.isEmpty():
        return 0
    analyze(new, raw, book).drop(raw).write.mode("append").partitionBy("bucket").parquet(target)
    return stored(spark, target).count() - before


def reports_of(messages: DataFrame, target: str, raw: str = "raw") -> DataFrame:
    """The reports of these very messages from ``target``, which must have them: one row a row."""
    rows = keyed(messages, raw).select(*KEY)
    known = stored(messages.sparkSession, target)
    return rows.join(known.withColumn("bucket", F.col("bucket").cast("string")), KEY).drop("bucket", "digest")


def keep_up(spark: SparkSession, source: str, target: str, checkpoint: str, *, once: bool = True, book: R.Book = R.CATALOGUE) -> StreamingQuery:
    """Analyse the files that arrive below ``source`` into ``target``; a file's content counts once, whatever its name."""

    def take(batch: DataFrame, _: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            update_reports(batch, target, book=book)
        finally:
            batch.unpersist()

    out = stream_messages(spark, source).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
