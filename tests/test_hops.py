"""Hops of users against one plain window: keys of ordinary size, and hot ones in ranges."""

import datetime as dt
import random

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftmail.operators.sequences import with_places
from siftmail.plans.events import first_long_delay, hop_delays


def _plain(rows):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return rows.select("user_id", "event_id", F.row_number().over(order).cast("long").alias("hop"), F.timestamp_diff("SECOND", F.lag("ts").over(order), F.col("ts")).alias("delay_seconds"))


def _same(spark, tmp_path, rows):
    schema = "user_id long, event_id long, ts timestamp_ntz, more string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/events.parquet")
    got, want = hop_delays(spark, str(tmp_path)), _plain(spark.read.parquet(f"{tmp_path}/events.parquet"))
    assert got.dtypes == want.dtypes
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    return {r.user_id: (r.hop, r.delay_seconds) for r in first_long_delay(spark, str(tmp_path)).collect()}


def test_hops_over_days_gaps_ties_and_nulls(spark, tmp_path):
    at = dt.datetime(2024, 2, 28, 23, 59, 30)
    hot = [(1, i, at + dt.timedelta(minutes=7 * i), "x") for i in range(600)]  # three days of one user
    gaps = [(2, 700, at, None), (2, 701, at + dt.timedelta(days=9), None), (2, 702, at + dt.timedelta(days=9), None)]
    nulls = [(None, 800, at, None), (None, 801, at + dt.timedelta(seconds=40), None), (3, 802, None, None), (3, 803, at, None), (3, 804, None, None)]
    long = _same(spark, tmp_path, hot + gaps + nulls)
    assert long == {2: (2, 9 * 86400)}


def test_no_events(spark, tmp_path):
    assert _same(spark, tmp_path, []) == {}


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("hot", ["one key, one day", "several hot keys", "null key", "equal times"])
def test_hot_keys_go_in_ranges(spark, many_ranges, hot):
    """All of a day of one user over all tasks; keys that begin and end within ranges; a null key; times that are all alike."""
    at, rng = dt.datetime(2024, 1, 1), random.Random(3)
    n, keys = 4000, {"one key, one day": [7], "several hot keys": [7, 8, 9, None], "null key": [None], "equal times": [7, None]}[hot]
    rows = [(rng.choice(keys), i, None if i % 97 == 0 else at if hot == "equal times" else at + dt.timedelta(seconds=rng.randrange(86_000)), "x") for i in range(n)]
    rows += [(100 + i % 50, n + i, at + dt.timedelta(seconds=i * 31), "x") for i in range(200)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, more string").repartition(5)
    got = with_places(df, "user_id", ["ts", "event_id"], hot_rows=300)
    assert got.columns == [*df.columns, "place", "previous"]
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    want = df.withColumns({"place": F.row_number().over(order).cast("long"), "previous": F.lag("ts").over(order)})
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    spread = got.where(f"user_id <=> {'NULL' if keys[0] is None else keys[0]}").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in spread) <= n * 0.6
