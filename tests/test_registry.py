"""Every query with SQL gives DuckDB's rows, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from siftmail import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def rows(df):
    def plain(v):
        v = v.item() if hasattr(v, "item") else v
        v = int(v) if isinstance(v, float) and v == int(v) else v  # whole numbers beside nulls
        return list(v) if hasattr(v, "__array__") else v

    return sorted(repr(tuple(map(plain, r))) for r in df.astype(object).where(df.notna(), None)[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry_without_the_training_operators(monkeypatch, spark):
    import importlib

    import __spark_entry__ as e

    monkeypatch.setattr(importlib.util, "find_spec", lambda name, f=importlib.util.find_spec: None if name.startswith(("siftmail.llm", "corpus_pipeline")) else f(name))
    assert set(e.queries()) == set(registry.queries()) and set(e.oracle_sql()) == set(registry.oracle_sql())
    assert e.entry(spark).count() > 0


def test_the_rest_works_without_the_folders(tmp_path):
    """The repository without the training operators, their tests and the pipeline: it imports, and queries run."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("siftmail", "__spark_entry__.py"):
        copy = shutil.copytree if os.path.isdir(f"{root}/{name}") else shutil.copy
        copy(f"{root}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "siftmail" / "llm")
    code = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
names = set(e.queries())
assert names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names and set(e.oracle_sql()) <= names
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert e.entry(spark).count() > 0 and e.queries()["html_anchors"](spark, "/root/testdata/sf0.001").count() > 0
print("works")
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_ENV_LOADED")}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.stdout.strip().endswith("works"), done.stderr[-2000:]
