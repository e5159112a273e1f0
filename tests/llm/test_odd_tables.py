"""Every query on a table with nulls in each column, repeated rows, ties, odd texts and columns of clashing names; on an
empty one; and on one where a third of the rows are copies."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftmail.llm import registry

from .conftest import DOCS
from .test_selection import ODD

CLASH = "n k uid ids node bucket host kept w start score h1 media part label train seq held_out p id x runs a b key base payload feature tokens found component".split()
ROWS = [(i, t, None if i % 3 else "en", None if i % 4 else "src", None if i % 5 else 3) for i, t in enumerate(ODD)]
ROWS += [ROWS[4], ROWS[4], (None, "a text without an id", "en", "src", 1), (None, None, None, None, None), (77, "a b", None, None, None)]
NAMES = sorted(n for n in registry.queries() if n != "op12_whitening")  # reads embeddings: test_whitening has its odd rows
#: Rows that are alike differ by their place in these.
PLACED = ("op1_", "op11_", "op13_")


def written(spark, path, rows, labels):
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in CLASH})
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("odd"), ROWS, [(0, 1, 1), (3, None, 0), (4, 1, None), (None, 1, 1), (5, 1, 1), (5, 1, 0)])


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("empty"), [], [])


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    text = "one passage that many rows share, word for word, and long enough to be found again " * 6
    rows = [(i, text if i % 3 == 0 else f"{text} but {i} differs" if i % 3 == 1 else f"row {i} of its own {i * 7919}", "en", "src", 1) for i in range(300)]
    return written(spark, tmp_path_factory.mktemp("copies"), rows, [(i, 1, i % 2) for i in range(50)])


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd, name):
    got = [r.asDict() for r in registry.queries()[name](spark, odd).collect()]
    if name.startswith("op1_"):
        got = [r for r in got if r["start"] == 0]
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ROWS)
    if not name.startswith(PLACED):  # rows of one id and text get one result
        assert len({str(r) for r in got if r["doc_id"] == ROWS[4][0]}) == 1


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, empty, name):
    assert registry.queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", [n for n in NAMES if n.startswith(("op1_", "op3_", "op7_", "op8_"))])
def test_copies(spark, copies, name):
    got = registry.queries()[name](spark, copies).toPandas()
    assert set(got.doc_id) == set(range(300))
    if name.startswith("op3_"):
        assert got[got.doc_id % 3 == 0].component_id.eq(0).all() and got[got.doc_id % 3 == 2].kept.all()
    if name.startswith("op7_"):
        assert (got[got.doc_id % 3 == 0].n_removed == got[got.doc_id % 3 == 0].n_bytes).all() and (got[got.doc_id % 3 == 2].n_removed == 0).all()


def test_scratch_tables_go(spark, copies):
    from siftmail.llm import common

    with common.scratch(spark):
        registry.queries()["op2_host_rules"](spark, copies).count()
        own = common._own.written[-1]
        assert spark.read.parquet(own).count() == 300
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(own)


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from siftmail.llm import common

    conf = lambda **kw: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: kw.get(k.rsplit(".", 1)[-1], d)))
    assert common.scratch_dir(conf(master="local[4]")) == common.LOCAL_SCRATCH and common.scratch_dir(conf(master="yarn", dir="hdfs:///x")) == "hdfs:///x"
    with pytest.raises(ValueError, match="checkpoint.dir"):
        common.scratch_dir(conf(master="spark://host:7077"))
