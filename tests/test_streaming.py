"""Streams against the batch: waves of files, some late, some given twice."""

import os

import pytest
from pyspark.sql import functions as F

from siftmail.operators import store
from siftmail.operators.analyze import analyze
from siftmail.plans.envelopes import ENVELOPES
from siftmail.streaming import first_sightings, once_each, report_stream, sightings, verdict_counts

AT = 1_786_000_000  # seconds; a wave is some hours later
NAMES = ["plain", "spf fail", "no hops", "link home", "program", "all at once", "chief asks for money", "one hop", "private hop", "tagged address of six", "brand in the name", "page"]
RAW = {e.name: e.raw("some text") for e in ENVELOPES if e.name in NAMES}


@pytest.fixture
def one_partition(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def put(box, name, raw, hours):
    (box / f"{name}.eml").write_bytes(raw)
    os.utime(box / f"{name}.eml", (AT + 3600 * hours, AT + 3600 * hours))


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def test_waves_equal_the_batch(spark, tmp_path, one_partition):
    box = tmp_path / "in"
    box.mkdir()
    names = list(RAW)
    assert len(names) >= 10
    at = {}
    waves = [[(n, i) for i, n in enumerate(names[:6])], [(names[0], 7), (names[6], 2), *((n, 20 + i) for i, n in enumerate(names[7:]))]]  # one again, one late
    target, counts, first = f"{tmp_path}/reports", f"{tmp_path}/counts", f"{tmp_path}/first"
    for w, wave in enumerate(waves):
        for n, hours in wave:
            put(box, f"{w}-{n}", RAW[n], hours)
            at.setdefault(n, hours)  # the first file of a content counts
        run(store.keep_up(spark, str(box), target, f"{tmp_path}/c0"))
        run(verdict_counts(report_stream(spark, target), window="6 hours", late="6 hours").writeStream.format("parquet").option("path", counts).option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start())
        run(first_sightings(report_stream(spark, target)).writeStream.outputMode("update").foreachBatch(lambda b, _: b.write.mode("append").parquet(first)).option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start())
    batch = analyze(spark.createDataFrame([(n, RAW[n], AT + 3600 * h) for n, h in at.items()], "name string, raw binary, t long").select(F.sha2("raw", 256).alias("message_id"), F.timestamp_seconds("t").alias("arrived"), "raw")).persist()
    want = {(r["start"], r["verdict"]): (r["n"], r["highest"]) for r in verdict_counts(batch, window="6 hours").collect()}
    got = {(r["start"], r["verdict"]): (r["n"], r["highest"]) for r in spark.read.parquet(counts).collect()}
    # windows that the watermark (the last arrival less six hours) has passed are out, each once and as in the batch
    passed = {k: v for k, v in want.items() if k[0].timestamp() + 6 * 3600 <= AT + 3600 * (max(at.values()) - 6)}
    assert passed and got == passed and spark.read.parquet(counts).count() == len(passed)
    rows = spark.read.parquet(first)
    best = {(r["kind"], r["value"]): (r["first_seen"], r["message_id"]) for r in first_sightings(batch).collect()}
    last = {(r["kind"], r["value"]): (r["t"], r["m"]) for r in rows.groupBy("kind", "value").agg(F.min("first_seen").alias("t"), F.min_by("message_id", F.struct("first_seen", "message_id")).alias("m")).collect()}
    assert last == best and len(best) == sightings(batch).select("kind", "value").distinct().count()
    batch.unpersist()


def test_late_message_moves_a_sighting_back(spark, tmp_path, one_partition):
    rows = lambda n, hours: spark.createDataFrame([(n, AT + 3600 * hours, ["x.example"])], "message_id string, t long, d array<string>").select(
        "message_id", F.timestamp_seconds("t").alias("arrived"), F.struct(F.col("d").alias("domains"), *(F.array().cast("array<string>").alias(c) for c in ("ips", "urls", "hashes", "emails"))).alias("iocs"),
    )
    told = []
    for n, hours in (("a", 5), ("b", 9), ("c", 1)):
        rows(n, hours).write.mode("append").parquet(f"{tmp_path}/reports")
        query = first_sightings(report_stream(spark, f"{tmp_path}/reports")).writeStream.outputMode("update")
        run(query.foreachBatch(lambda b, _: told.extend(r["message_id"] for r in b.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start())
    assert told == ["a", "a", "c"]


def test_messages_that_come_twice_count_once(spark, tmp_path, one_partition):
    got = []
    for wave in ([("a", 0), ("b", 1), ("a", 2)], [("b", 3), ("c", 4)]):
        spark.createDataFrame([(n, AT + 3600 * h) for n, h in wave], "message_id string, t long").select("message_id", F.timestamp_seconds("t").alias("arrived")).write.mode("append").parquet(f"{tmp_path}/in")
        query = once_each(spark.readStream.schema("message_id string, arrived timestamp").parquet(f"{tmp_path}/in")).writeStream.foreachBatch(lambda b, _: got.extend(r["message_id"] for r in b.collect()))
        run(query.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start())
    assert sorted(got) == ["a", "b", "c"]
