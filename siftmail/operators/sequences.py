"""Rows of a key in order: the place of each and the time of the one before, for keys of any size.

Keys of an ordinary size go through a window. Keys with more than ``hot_rows`` rows (so there are few of them) are sorted
by ranges of (key, order) instead, which may cut a key anywhere, also within equal times: a range numbers its rows as
they come, and one row a range (its first and its last key, rows and last time of these) tells what a key had before.

A null key is a key. Null times come first. Rows that are alike in key and order are numbered in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..sources.scratch import new_folder


def with_places(df: DataFrame, key: str, order: list[str], *, hot_rows: int = 1_000_000) -> DataFrame:
    """``df`` with ``place`` (from 1) and ``previous`` (the first of ``order`` in the row before) of each row of a key."""
    large = [r[key] for r in df.groupBy(key).count().where(F.col("count") > hot_rows).select(key).collect()]  # rows / hot_rows at most
    by_key = Window.partitionBy(key).orderBy(*order)
    windowed = lambda rows: rows.withColumns({"place": F.row_number().over(by_key).cast("long"), "previous": F.lag(order[0]).over(by_key)})
    if not large:
        return windowed(df)
    hot = F.coalesce(F.col(key).isin([k for k in large if k is not None]), F.lit(False)) | (F.col(key).isNull() & F.lit(None in large))
    return windowed(df.where(~hot)).unionByName(_by_ranges(df.where(hot), key, order))


def _by_ranges(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    spark = df.sparkSession
    time = df.schema[order[0]]
    extra = [StructField("place", LongType()), StructField("previous", time.dataType), StructField("_part", LongType()), StructField("_at", LongType()), StructField("_first", BooleanType())]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, now, place, first, before = TaskContext.get().partitionId(), 0, None, 0, True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            places, firsts, begins = [], [], []
            for k in batch.column(key).to_pylist():
                if at and k != now:
                    first, place = False, 0
                now, at, place = k, at + 1, place + 1
                places.append(place)
                firsts.append(first)
                begins.append(place == 1)
            times = batch.column(order[0])
            shifted = pa.concat_arrays([before if before is not None else pa.nulls(1, times.type), times.slice(0, batch.num_rows - 1)])
            before = times.slice(batch.num_rows - 1)
            previous = pc.if_else(pa.array(begins), pa.scalar(None, times.type), shifted)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(places, pa.int64()), previous, pa.array([part] * n, pa.int64()), pa.array(range(at - n, at), pa.int64()), pa.array(firsts)],
                [*batch.schema.names, *(f.name for f in extra)],
            )

    path = new_folder(spark, "ranges")
    df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).mapInArrow(number, StructType([*df.schema.fields, *extra])).write.parquet(path)
    placed = spark.read.parquet(path)
    end = lambda f, c: f(F.col(c), F.col("_at"))
    ends = placed.groupBy("_part").agg(
        end(F.min_by, key).alias("a"), end(F.max_by, key).alias("b"), end(F.max_by, "place").alias("n"), end(F.max_by, order[0]).alias("t"), end(F.max_by, "_first").alias("one"),
    )
    out, rows, last, known = [], 0, None, object()
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):  # one row a range
        on = r["a"] == known
        out.append((r["_part"], rows if on else 0, last if on else None, on))
        rows, last, known = (rows if on and r["one"] else 0) + r["n"], r["t"], r["b"]
    carried = spark.createDataFrame(out, StructType([StructField("_part", LongType()), StructField("_rows", LongType()), StructField("_last", time.dataType), StructField("_on", BooleanType())]))
    joined = placed.join(F.broadcast(carried), "_part")
    goes_on: Column = F.col("_first") & F.col("_on")
    return joined.select(
        *df.columns, (F.col("place") + F.when(goes_on, F.col("_rows")).otherwise(0)).alias("place"),
        F.when(goes_on & (F.col("place") == 1), F.col("_last")).otherwise(F.col("previous")).alias("previous"),
    )
