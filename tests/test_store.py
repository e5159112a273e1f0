"""A table of reports that is kept up to date, and books of one's own."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from siftmail import rules as R
from siftmail.operators import report, store
from siftmail.operators import analyze as A
from siftmail.plans.envelopes import ENVELOPES

MESSAGES = [(e.name, f"{e.name}.eml", e.raw("some text")) for e in ENVELOPES[:30]]
SCHEMA = "message_id string, filename string, raw binary"


def test_nothing_is_parsed_twice(spark, tmp_path, monkeypatch):
    target = f"{tmp_path}/reports"
    parsed = []
    monkeypatch.setattr(store, "analyze", lambda df, *a, f=A.analyze: (parsed.append(df.count()), f(df, *a))[1])
    first = spark.createDataFrame(MESSAGES[:20], SCHEMA)
    assert store.stored(spark, target) is None and store.update_reports(first, target) == 20
    assert store.update_reports(first, target) == 0 and parsed == [20]
    more = spark.createDataFrame(MESSAGES + MESSAGES[:5] + [("plain", "plain.eml", b"Subject: other content\n\nx")], SCHEMA)
    assert store.update_reports(more, target) == 11 and parsed == [20, 11] and store.update_reports(more, target) == 0
    got, want = store.stored(spark, target), A.analyze(spark.createDataFrame(MESSAGES, SCHEMA))
    plain = lambda df: sorted((r["message_id"], r["score"], r["verdict"], str(r["findings"]), str(r["iocs"])) for r in df.collect())
    assert plain(store.reports_of(spark.createDataFrame(MESSAGES, SCHEMA), target)) == plain(want)
    assert store.reports_of(spark.createDataFrame(MESSAGES[:3] * 2, SCHEMA), target).count() == 6
    assert got.count() == 31 and {n: t.count() for n, t in report.tables(store.reports_of(spark.createDataFrame(MESSAGES, SCHEMA), target)).items()} == {n: t.count() for n, t in report.tables(want).items()}


def test_null_ids_and_contents(spark, tmp_path):
    target = f"{tmp_path}/reports"
    odd = spark.createDataFrame([(None, "a", b"Subject: x\n\ny"), (None, "b", b"Subject: z\n\ny"), ("m", "c", None), (None, "d", None), (None, "a", b"Subject: x\n\ny")], SCHEMA)
    assert store.update_reports(odd, target) == 4 and store.update_reports(odd, target) == 0
    assert sorted(r["subject"] for r in store.reports_of(odd, target).collect()) == ["", "", "x", "x", "z"]


def test_only_the_partitions_of_a_batch_are_read(spark, tmp_path):
    target = f"{tmp_path}/reports"
    store.update_reports(spark.createDataFrame(MESSAGES, SCHEMA), target)
    one = spark.createDataFrame(MESSAGES[:1], SCHEMA)
    plan = store.unknown(one, store.stored(spark, target))._jdf.queryExecution().toString()
    scan = plan.split("== Physical Plan ==")[1]
    assert "PartitionFilters: [isnotnull(bucket" in scan or "PartitionFilters: [" in scan and "bucket" in scan.split("PartitionFilters: [")[1][:80]
    assert "ReadSchema: struct<digest:string>" in scan


def test_stream_of_files(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    for name, _, raw in MESSAGES[:4]:
        (box / f"{name}.eml").write_bytes(raw)
    run = lambda: store.keep_up(spark, str(box), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    run()
    (box / "a copy under another name.eml").write_bytes(MESSAGES[0][2])
    (box / "late.eml").write_bytes(MESSAGES[9][2])
    run()
    run()
    assert store.stored(spark, f"{tmp_path}/out").count() == 5


def rules(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, cat string, points int, sev string, condition string, text string")


def test_own_book(spark):
    raws = spark.createDataFrame([(e.name, e.raw("some text")) for e in ENVELOPES if e.name in ("spf fail", "one hop", "plain")], "message_id string, raw binary")
    book = R.CATALOGUE.changed(
        rules(spark, ("spf-fail", None, 1, None, None, None), ("rcv-one", None, None, None, "size(hops) = 2", "two hops"), ("own", "own", 70, "high", "message_id = 'plain'", None)),
        spark.createDataFrame([("own", 60)], "cat string, cap int"),
    )
    got = {r["message_id"]: r for r in A.analyze(raws, book=book).collect()}
    ids = {n: [(f["id"], f["points"], f["sev"], f["msg"]) for f in r["findings"]] for n, r in got.items()}
    assert ids["spf fail"] == [("spf-fail", 1, "high", ids["spf fail"][0][3]), ("rcv-one", 3, "low", "two hops")] and ids["one hop"] == []
    assert ids["plain"] == [("rcv-one", 3, "low", "two hops"), ("own", 70, "high", "own")] and got["plain"]["score"] == 63 and got["plain"]["verdict"] == "ALTO"
    assert [b["cat"] for b in got["plain"]["score_breakdown"]] == [*R.CAPS, "own"]
    assert R.CATALOGUE.changed() == R.CATALOGUE


def test_books_with_faults(spark, monkeypatch):
    with pytest.raises(ValueError, match="without a cap"):
        R.CATALOGUE.changed(rules(spark, ("x", "nowhere", 1, "low", "true", None)))
    with pytest.raises(ValueError, match="repeated"):
        R.CATALOGUE.changed(rules(spark, ("x", "auth", 1, "low", "true", None), ("x", "auth", 2, "low", "true", None)))
    raws = spark.createDataFrame([("m", b"A: b\n\nx")], "message_id string, raw binary")
    with pytest.raises(AnalysisException, match="no_such_column"):
        A.analyze(raws, book=R.CATALOGUE.changed(rules(spark, ("x", "auth", 1, "low", "no_such_column > 1", None))))
    monkeypatch.setattr(R, "MOST_RULES", 2)
    with pytest.raises(ValueError, match="more than 2"):
        R.CATALOGUE.changed(R.rules(spark).select("*", F.lit(None).cast("string").alias("condition")))
