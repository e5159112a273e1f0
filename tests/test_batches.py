"""Python holds a piece of an Arrow batch at a time, whatever the batch."""

import pyarrow as pa
from pyspark.sql import functions as F

from siftmail.operators import batches, parse
from siftmail.operators.markup import page_links
from siftmail.operators.parse import with_parsed


def test_pieces_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(batches, "ROWS", 4)
    monkeypatch.setattr(batches, "BYTES", 10)
    values = [b"a" * 3, None, b"", b"b" * 9, b"c" * 50, b"", b"d", *[b""] * 9, None, b"e" * 10, b"f"]
    for kind in (pa.binary(), pa.large_binary()):
        own = [p.to_pylist() for p in batches.pieces(pa.array([b"before", *values], kind).slice(1))]
        assert [x for p in own for x in p] == values
        assert all(len(p) <= 4 and (len(p) == 1 or sum(len(x or b"") for x in p) <= 10) for p in own) and [b"c" * 50] in own
    assert [p.to_pylist() for p in batches.pieces(pa.array(["é" * 5, "x"]))] == [["é" * 5], ["x"]]
    assert list(batches.pieces(pa.array([], pa.binary()))) == []


def test_a_batch_is_parsed_in_pieces(spark, monkeypatch):
    """One Arrow batch of 3000 messages comes out in pieces that keep its order; before, it was parsed as one."""
    made = []
    monkeypatch.setattr(parse.F, "arrow_udf", lambda _: lambda f: made.append(f) or (lambda c: F.lit(None).cast(parse.PARSED)))
    with_parsed(spark.createDataFrame([(b"",)], "raw binary"))
    raws = [f"Subject: {i}\n\n{'x' * (i % 7)}".encode() for i in range(3000)]
    out = list(made[0](iter([pa.array(raws), pa.array([], pa.binary())])))
    assert sum(map(len, out)) == 3000 and max(map(len, out)) <= batches.ROWS
    assert [r["headers"][0]["value"] for b in out for r in b.to_pylist()] == [str(i) for i in range(3000)]


def test_rows_stay_beside_their_messages(spark):
    rows = [(i, f"Subject: {i}\n\n".encode() + b"y" * (i % 5 * 1000) if i % 11 else None, f"<a href='http://h{i}.example/'>t</a>" if i % 3 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, raw binary, html string").coalesce(1)
    got = with_parsed(df.withColumn("found", page_links(F.col("html")))).selectExpr("i", "get(headers, 0).value AS s", "get(found, 0).url AS u").collect()
    assert sorted((r["i"], r["s"], r["u"]) for r in got) == [(i, str(i) if i % 11 else None, f"http://h{i}.example/" if i % 3 else None) for i in range(3000)]
