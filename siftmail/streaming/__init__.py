"""The analysis as a stream, and stateful views of what it has analysed.

``operators.store.keep_up`` analyses files as they arrive, each content once, into a table of reports. The views here read
that table as a stream, so no message is parsed again for them:

* ``verdict_counts``: verdicts by windows of the arrival time; a window is given out once the watermark has passed it.
* ``first_sightings``: each indicator with the time of its first message; a late message moves that time back.

``once_each`` drops what comes again within the watermark; ``analyze_stream`` goes from files to summaries without a table or
state. Arrival is a file's time of modification. State is a number for each open window and verdict, an id for each message
within the watermark, and a time and an id for each indicator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.analyze import analyze
from ..operators.report import summary
from ..sources.messages import stream_messages

def once_each(messages: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream of (message_id, arrived, ...) without those that come again within the watermark."""
    return messages.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["message_id"])


def analyze_stream(spark: SparkSession, source: str, target: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Analyse the files that arrive below ``source``; summaries go to ``target`` as Parquet, each file once."""
    out = summary(analyze(stream_messages(spark, source))).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def report_stream(spark: SparkSession, target: str, files_per_trigger: int = 1000) -> DataFrame:
    """The table of reports in ``target`` as a stream of what is added to it."""
    return spark.readStream.schema(spark.read.parquet(target).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(target)


def verdict_counts(reports: DataFrame, *, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """start, verdict, n, highest score: by windows of the arrival time. Works on a table as well."""
    timed = reports.select("arrived", "verdict", "score")
    timed = timed.withWatermark("arrived", late) if reports.isStreaming else timed
    rows = timed.groupBy(F.window("arrived", window).alias("w"), "verdict").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("highest"))
    return rows.select(F.col("w.start").alias("start"), "verdict", "n", "highest")


def sightings(reports: DataFrame) -> DataFrame:
    """kind, value, arrived, message_id: the indicators of each message."""
    kinds = {"domain": "domains", "ip": "ips", "url": "urls", "hash": "hashes", "email": "emails"}
    named = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    told = F.flatten(F.array(*(named(k, F.col(f"iocs.{c}")) for k, c in kinds.items())))
    return reports.select("message_id", "arrived", F.explode(told).alias("i")).select("i.kind", "i.value", "arrived", "message_id")


def first_sightings(reports: DataFrame) -> DataFrame:
    """kind, value, first_seen, message_id: when an indicator was first seen and with what message (of equal times the
    smallest id). As a stream (output mode ``update``) a row comes whenever an indicator is seen in a batch; a message that
    came late moves the time back. Sums within tasks come first, so an indicator of very many messages is one row a task.
    Works on a table as well."""
    first = F.min(F.struct("arrived", "message_id")).alias("f")
    return sightings(reports).groupBy("kind", "value").agg(first).select("kind", "value", F.col("f.arrived").alias("first_seen"), F.col("f.message_id").alias("message_id"))
