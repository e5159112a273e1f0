"""The pipeline's stages against brute force on a small corpus, one stage's output being the next one's input."""

import random
import re

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp

from .test_repeat_dedup import brute

WORDS = {
    "en": "the of and to in is that it was for with as his they at be this from have or by one had not but what all were when we there can an".split(),
    "de": "der die und das nicht ein ist ich sie mit sich auf dass für eine auch als nach bei über wenn nur noch werden aus wird sind durch über".split(),
}
BAD = "blockhead numbskull".split()


def corpus():
    rng = random.Random(2)
    text = lambda lang, k: " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "a", "er", "ing"]) for _ in range(k))
    rows, labels = [], []

    def add(t, lang="en", toxic=None):
        rows.append((len(rows) + 1, t, lang, f"src{len(rows) % 3}", len(t or "")))
        if toxic is not None:
            labels.append((len(rows), 1, toxic))

    for i in range(120):
        lang = "en" if i % 3 else "de"
        add(text(lang, 60), lang, 0)
        if i % 2:
            w = text("en", 50).split()
            w[rng.randrange(50)] = BAD[i // 2 % 2]
            add(" ".join(w), "en", 1)
    base = text("en", 120)
    for _ in range(4):
        w = base.split()
        w[rng.randrange(len(w))] = "changed"
        add(" ".join(w))
    add(base)
    add(base)
    passage = text("en", 70)
    for _ in range(3):
        add(text("de", 40) + " " + passage + " " + text("en", 40))
    for t in (None, "", "123 456 !!"):
        add(t)
    add(text("en", 30) + " blokhead numskull", "en")
    return rows, labels


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows, labels = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    out, docs = {}, spark.read.parquet(f"{d}/documents.parquet")
    out["input"] = {r["doc_id"]: r for r in docs.collect()}
    for name, f in cp.STAGES:
        f(spark, docs, d).write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        if name != "packing":
            assert docs.columns == cp.COLUMNS
            out[name] = {r["doc_id"]: r for r in docs.collect()}
    out["packing"] = docs.toPandas()
    return out, {i: t for i, _, t in labels}


def test_language(stages):
    got = stages[0]
    gone = set(got["input"]) - set(got["language_id"])
    assert gone == {i for i, r in got["input"].items() if not re.search(r"[^\W\d_]", r["text"] or "")}


def test_toxicity(stages):
    got, labels = stages
    gone = set(got["language_id"]) - set(got["toxicity"])
    assert gone == {i for i, r in got["language_id"].items() if any(b in r["text"] for b in [*BAD, "blokhead"])}
    assert not any(labels.get(i) == 0 for i in gone)


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_duplicates(stages):
    rows = {i: shingles(r["text"]) for i, r in stages[0]["toxicity"].items()}
    label = {i: i for i in rows}
    for a in rows:
        for b in rows:
            if a < b and 100 * len(rows[a] & rows[b]) >= 80 * len(rows[a] | rows[b]):
                x, y = sorted((label[a], label[b]))
                label = {k: x if v == y else v for k, v in label.items()}
    assert set(stages[0]["near_duplicates"]) == {i for i in rows if label[i] == i} < set(rows)


def test_repeated_passages(stages):
    before, after = stages[0]["near_duplicates"], stages[0]["repeated_passages"]
    assert set(before) == set(after)
    ids = sorted(before)
    want = brute([before[i]["text"] for i in ids])
    assert sum(w[1] > 0 for w in want) >= 3
    for i, w in zip(ids, want, strict=True):
        assert len(after[i]["text"].encode()) == w[0] - w[1] and after[i]["n_chars"] == len(after[i]["text"])


def test_packing(stages):
    docs, got = stages[0]["repeated_passages"], stages[0]["packing"]
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for i, r in docs.items():
        own = got[got.doc_id == i].sort_values("start")
        ids = np.concatenate([np.frombuffer(x, "<u4") for x in own.ids])
        assert ids.tolist() == [*t.encode(r["text"], add_special_tokens=False).ids, 0]
    full = got.groupby("sequence_id").length.sum()
    assert (full.sort_index().iloc[:-1] == 1024).all()


def test_empty_table_and_nulls(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
    rows = [(None, "words of a text without an id", None, None, None, "x"), (1, None, None, None, None, "x"), (2, "some other words here", "en", None, None, "x"), (2, "some other words here", "en", None, None, "x")]
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert sorted({r["doc_id"] for r in cp.run(spark, str(tmp_path)).collect()}, key=str) == [2, None]


def test_near_duplicates_of_one_id_with_several_texts(spark, tmp_path):
    rng = random.Random(4)
    a, b, c = (" ".join(f"{k}{rng.randrange(10_000)}" for _ in range(100)) for k in "abc")
    near = a + " end"
    rows = [(1, c), (5, a), (5, b), (5, near), (5, b), (7, near), (9, b), (None, a), (None, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.repartition(5, "text"), docs.orderBy("text", ascending=False)):
        got = cp.near_duplicates(spark, some, str(tmp_path)).collect()
        assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([(1, c), (5, a), (5, b), (0, a), (0, b)])
    # what is linked with a smaller id goes, the other text of the same id stays
    got = cp.near_duplicates(spark, docs.unionByName(docs.where("doc_id = 1").selectExpr("9L AS doc_id", "text", "lang", "source", "n_chars")).where("doc_id IN (1, 9)"), str(tmp_path)).collect()
    assert {(r["doc_id"], r["text"]) for r in got} == {(1, c), (9, b)}


def test_stages_chain_without_a_write_between(spark, tmp_path):
    """Each stage called on the frame of the one before, all evaluated at the end; and ``run`` leaves nothing behind."""
    rows, labels = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    lazy = cp.repeated_passages(spark, cp.near_duplicates(spark, docs, str(tmp_path)), str(tmp_path))
    got = sorted((r["doc_id"], r["text"] or "") for r in lazy.collect())
    cp.near_duplicates(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/near")
    again = cp.repeated_passages(spark, spark.read.parquet(f"{tmp_path}/near"), str(tmp_path))
    assert got == sorted((r["doc_id"], r["text"] or "") for r in again.collect())

    from siftmail.llm import common

    mark = common.written()
    with common.scratch(spark):
        assert cp.run(spark, str(tmp_path)).count() > 0
        left = common._own.written[mark:]
    assert left
    for path in left:
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            spark.read.parquet(path)
