"""Whitening against numpy over all rows at once."""

import math

import numpy as np
import pytest

from siftmail.llm.queries_whitening import op12_whitening
from siftmail.llm.whitening import Moments, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, n string, state string"


def stored(spark, path, rows, parts=3):
    spark.createDataFrame([(i, v, 0, "x", "x", "x") for i, v in rows], SCHEMA).repartition(parts).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def brute(vectors, k=32):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(0)
    centred = np.array([[float((n * a - b)) / n for a, b in zip(r, s)] for r in x])
    values, own = np.linalg.eigh(centred.T @ centred / n)
    values, own = values[::-1], own[:, ::-1]
    k = min(k, x.shape[1])
    return n, [int(sum((n * a - b) ** 2 for a, b in zip(r, s))) for r in x], (centred @ own)[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


@pytest.mark.parametrize(("rows", "dims"), [(400, 40), (90, 5), (64, 33)])
def test_equals_numpy(spark, tmp_path, rows, dims):
    rng = np.random.default_rng(rows)
    vectors = (rng.standard_normal((rows, dims)) @ np.diag(np.linspace(3, 0.5, dims))).astype(np.float32)
    vectors[: rows // 3] = vectors[0]  # a third of the rows are copies
    got = op12_whitening(spark, stored(spark, tmp_path, [(i, v.tolist()) for i, v in enumerate(vectors)])).toPandas().sort_values(["vec_id", "component"])
    n, deviation, white, explained = brute(vectors)
    k = min(32, dims)
    assert len(got) == rows * k and got.component.tolist() == [*range(1, k + 1)] * rows and (got.n == n).all()
    assert got.deviation.tolist() == np.repeat(deviation, k).tolist()
    w = got.whitened.to_numpy().reshape(rows, k)
    assert np.allclose(w * np.sign((w * white).sum(0)), white, atol=1e-7)
    assert np.allclose(got.explained.to_numpy().reshape(rows, k), explained, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_merging_equals_one_pass():
    rng = np.random.default_rng(1)
    z = rng.integers(-500, 500, (1000, 7)) + 10**7
    whole = Moments.of(z, True)
    parts = [Moments.of(z[a:b], True) for a, b in ((0, 1), (1, 1), (1, 400), (400, 1000))]
    for order in ((0, 1, 2, 3), (3, 2, 1, 0), (1, 3, 0, 2)):
        m = parts[order[0]]
        for i in order[1:]:
            m = m.merge(parts[i])
        assert m.n == 1000 and m.sums == whole.sums == z.sum(0).tolist()
        assert np.abs(m.scatter - whole.scatter).max() < 1e-10 * np.trace(whole.scatter)


def test_odd_rows(spark, tmp_path):
    good = [[1.0, 2.0, 0.5], [0.1, -2.0, 3.5], [4.0, 4.0, -1.0], [4.0, 4.0, -1.0], [0.0, 9.0, 2.0]]
    odd = [None, [], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [1.0, float("inf"), 1.0], [1.0, float("-inf"), 1.0], [1.0, 2.0], [1.0, 2.0, 3.0, 4.0]]
    rows = [(i, v) for i, v in enumerate(good + odd)] + [(None, good[0]), (0, good[0])]
    got = op12_whitening(spark, stored(spark, tmp_path, rows)).toPandas()
    used = [*good, good[0], good[0]]
    n, deviation, _, _ = brute(used)
    assert (got.n == n).all() and len(got) == 3 * n and got.vec_id.isna().sum() == 3
    assert sorted(got[got.component == 1].deviation) == sorted(deviation)


def test_nothing_varies(spark, tmp_path):
    got = op12_whitening(spark, stored(spark, tmp_path, [(i, [1.5, -2.0]) for i in range(4)])).collect()
    assert len(got) == 8 and all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (4, 0, None, None, None) for r in got)


def test_directions_without_variance(spark, tmp_path):
    rows = [(i, [float(i), 2.0 * i, 7.0]) for i in range(10)]
    got = op12_whitening(spark, stored(spark, tmp_path, rows)).toPandas()
    assert got[got.component == 1].whitened.notna().all() and got[got.component > 1].whitened.isna().all()
    assert np.allclose(got[got.component == 1].explained, 1) and (got[got.component > 1].explained == 0).all() and got.identity_error.max() < 1e-9


def test_numbers_beyond_64_bits(spark):
    df = spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [1e9, 2.0])], "vec_id long, embedding array<float>")
    got = whiten(df).toPandas()
    assert len(got) == 6 and got.deviation.isna().all() and got[got.component == 1].whitened.notna().all()


def test_empty(spark, tmp_path):
    assert op12_whitening(spark, stored(spark, tmp_path, [])).count() == 0
    assert whiten(spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")).count() == 0
