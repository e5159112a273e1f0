"""The hidden Markov model against brute force: unigram figures, forward sums over all paths, and Baum-Welch's promise."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np

import pytest
from pyspark.sql import functions as F

from siftmail.llm import hidden_markov
from siftmail.llm.hidden_markov import Model, fit, normalised, scored, token_hash
from siftmail.llm.queries_hidden_markov import op8_hidden_markov

TEXTS = [None, "", "a b", *(["the cat sat on the mat", "A dog ran. The END", "le chat noir et le chien", "x" * 3000, "zz zz zz"] * 12), "only once here", " \t\n "]


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]


def test_query_against_brute_force(spark, docs_of, tmp_path):
    docs_of(TEXTS, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op8_hidden_markov(spark, str(tmp_path)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(1, len(TEXTS) + 1)}
    c = Counter(w for i, t in enumerate(TEXTS, 1) if not held[i] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(TEXTS, 1):
        r, w = got[i], tokens(t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(w), sum(x in c for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r["score"] < 0
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())


def test_small_tables_go_by_the_join(spark, docs_of):
    """The same figures whether a token's count travels in the tables or comes by the join."""
    from siftmail.llm.hidden_markov import score

    df = docs_of(TEXTS)
    a, b = ({r["doc_id"]: r for r in score(df, F.col("doc_id") % 3 != 0, emit=4, known=k, rounds=1).collect()} for k in (1000, 4))
    for i in a:
        assert a[i]["n_known"] == b[i]["n_known"] and math.isclose(a[i]["base_score"], b[i]["base_score"], rel_tol=1e-9) and b[i]["score"] < 0


def random_model(k, m, seed):
    rng = np.random.default_rng(seed)
    norm = lambda x, a: x / x.sum(a, keepdims=True)
    return Model(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((m, k)), 0))


def all_paths(m, s):
    """(path, probability) of every path of states under the symbols."""
    for p in itertools.product(range(len(m.start)), repeat=len(s)):
        steps = (m.move[p[t - 1], p[t]] * m.emit[s[t], p[t]] for t in range(1, len(s)))
        yield p, m.start[p[0]] * m.emit[s[0], p[0]] * math.prod(steps)


@pytest.mark.parametrize("piece", [1, 2, 3, 512])
def test_forward_and_baum_welch_are_sums_over_paths(monkeypatch, piece):
    """Whole sequences, however they are cut: no piece starts anew and no transition is lost."""
    monkeypatch.setattr(hidden_markov, "PIECE", piece)
    m = random_model(3, 5, 1)
    rng = np.random.default_rng(2)
    seqs = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 4, 2, 6, 8, 3, 7)]
    starts, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s, got in zip(seqs, m.log10_likelihood(seqs), strict=True):
        total = sum(q for _, q in all_paths(m, s))
        assert math.isclose(got, math.log10(total), rel_tol=1e-12)
        for p, q in all_paths(m, s):
            starts[p[0]] += q / total
            for t in range(len(s)):
                emits[s[t], p[t]] += q / total
                if t:
                    moves[p[t - 1], p[t]] += q / total
    for got, want in zip(m.expected(seqs), (starts, moves, emits), strict=True):
        assert np.allclose(got, want, rtol=1e-4, atol=1e-6)


def test_long_sequences_in_pieces(monkeypatch):
    m = random_model(8, 300, 3)
    rng = np.random.default_rng(6)
    seqs = [rng.integers(0, 300, n).astype(np.uint16) for n in (1, 5000, 512, 513, 1024, 30, 2047)]
    got = m.log10_likelihood(seqs), *m.expected(seqs)
    monkeypatch.setattr(hidden_markov, "PIECE", 1 << 20)
    want = m.log10_likelihood(seqs), *m.expected(seqs)
    assert all(np.allclose(a, b, rtol=1e-3, atol=1e-4) for a, b in zip(got, want, strict=True)) and np.allclose(got[0], want[0], rtol=1e-12)


def test_score_against_all_paths(spark, docs_of):
    """The query's score: the sum over all paths of states times each token's share of its class, and a proper
    distribution over texts (lengths up to ten have at most all of it)."""
    texts = ["a b", "a c b", "b", None, "c c a", "rare words", "b rare"] * 3 + ["never seen", "a seen b"]
    fitted = fit(docs_of(texts), F.col("doc_id") <= 21, states=2, emit=4, rounds=2)
    got = {r["doc_id"]: r["score"] for r in scored(fitted).collect()}
    counts = Counter(w for t in texts[:21] for w in tokens(t))
    hashed = {w: hidden_markov.END if w is None else token_hash(w.encode()) for t in texts for w in tokens(t)}
    own = sorted(counts, key=lambda w: (-counts[w], hashed[w]))[:4]
    rare = lambda w: hashed[w] & (hidden_markov.RARE - 1)

    def class_and_share(w):
        if w in own:
            return own.index(w), 1.0
        fellows = [counts[x] for x in counts if x not in own and rare(x) == rare(w)]
        return 4 + rare(w), (counts[w] + 0.5) / (sum(fellows) + 0.5 * (len(fellows) + 1))

    for i, t in enumerate(texts, 1):
        classes, shares = zip(*map(class_and_share, tokens(t)))
        total = sum(q for _, q in all_paths(fitted.model, classes)) * math.prod(shares)
        assert math.isclose(got[i], math.log10(total), rel_tol=1e-9), t
    m, end = fitted.model, class_and_share(None)[0]
    assert np.allclose(m.emit.sum(0), 1) and np.allclose(m.move.sum(1), 1) and math.isclose(m.start.sum(), 1)
    on, mass = m.start, 0.0
    for _ in range(10):  # no end yet, then the end
        mass += float((on * m.emit[end]).sum())
        on = (on * (1 - m.emit[end])) @ m.move
    assert mass < 1 and math.isclose(mass + on.sum(), 1, rel_tol=1e-9)


def test_shares_grow_to_the_whole_corpus(spark, docs_of, monkeypatch):
    """Rounds go over growing shares by hash, each a part of the next; small ones give way to larger; no sequence reaches
    the driver, however long."""
    docs = docs_of([f"a b{i} c" for i in range(2000)] + ["v " * 9000])
    seen, plain = [], hidden_markov._round

    def noted(rows, *args):
        seen.append(rows.count())
        return plain(rows, *args)

    monkeypatch.setattr(hidden_markov, "_round", noted)
    monkeypatch.setattr(hidden_markov, "SHARES", ((3, 2), (2, 1), (1, 1)))
    monkeypatch.setattr(hidden_markov, "FLOOR", 200)
    fitted = fit(docs, F.lit(True), states=2, emit=64, rounds=2, gain=-math.inf)
    assert len(seen) == 6 and seen[0] == seen[1] < seen[2] < seen[3] < seen[4] == seen[5] == 2001
    assert all(n / 2 < s < n * 2 for s, n in zip(seen[1:4], (31, 125, 500), strict=True))
    seen.clear()
    monkeypatch.setattr(hidden_markov, "FLOOR", 1 << 30)
    fit(docs, F.lit(True), states=2, emit=64, rounds=1, gain=-math.inf)
    assert seen == [2001] * 5
    seen.clear()
    fit(docs, F.lit(True), states=2, emit=64, rounds=9, gain=1.0)
    assert seen == [2001] * 6  # the second round over all gains less than asked
    assert fitted.rows.selectExpr("max(n_tokens) AS n").first()["n"] == 9001


def test_a_round_on_spark_is_a_round_on_all_sequences(spark, docs_of):
    docs = docs_of(["a b c", "b", None, "c c a", "x " * 1500])
    fitted = fit(docs, F.lit(True), states=3, emit=4, rounds=0)
    seqs = [np.frombuffer(bytes(r["seq"]), "<u2") for r in fitted.rows.collect()]
    models = [fitted.model, random_model(3, len(fitted.tables.prior), 1)]
    made = hidden_markov._round(fitted.rows, models, fitted.tables.prior, 0.02)
    for before, (model, likelihood) in zip(models, made, strict=True):
        want = normalised(*before.expected(seqs), fitted.tables.prior, 0.02)
        assert np.allclose(model.emit, want.emit) and np.allclose(model.move, want.move) and np.allclose(model.start, want.start)
        assert math.isclose(likelihood, before.log10_likelihood(seqs).sum() / sum(map(len, seqs)), rel_tol=1e-4)


def test_baum_welch_never_lowers_the_likelihood():
    rng = np.random.default_rng(4)
    seqs = [rng.choice(6, n, p=[0.4, 0.3, 0.1, 0.1, 0.05, 0.05]).astype(np.uint16) for n in rng.integers(1, 60, 40)]
    m, last = random_model(3, 6, 9), -math.inf
    for _ in range(15):
        now = m.log10_likelihood(seqs).sum()
        assert now >= last - 1e-3
        last = now
        s, mv, e = m.expected(seqs)
        assert math.isclose(e.sum(), sum(map(len, seqs)), rel_tol=1e-5) and math.isclose(s.sum(), len(seqs), rel_tol=1e-5) and math.isclose(mv.sum(), sum(len(x) - 1 for x in seqs), rel_tol=1e-5)
        m = Model(s / s.sum(), mv / mv.sum(1, keepdims=True), e / e.sum(0))


def test_one_empty_table(spark, docs_of, tmp_path):
    docs_of(["x"], extra=False).where("doc_id < 0").write.parquet(f"{tmp_path}/documents.parquet")
    assert op8_hidden_markov(spark, str(tmp_path)).count() == 0
    assert normalised(np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2)), np.full(3, 1 / 3), 1.0).emit.shape == (3, 2)


@pytest.mark.parametrize("least, parts", [(1, 16), (1000, 4), (1 << 30, 1)])
def test_every_start_learns_from_every_text(spark, docs_of, monkeypatch, least, parts):
    """The first pass takes each text as often as any other, for all starts; each model comes of the counts of all parts."""
    docs = docs_of([f"a b{i} c" for i in range(1000)] + ["v " * 900])
    seen, plain = [], hidden_markov._sums

    def noted(rows, models):
        seen.append((len(models), sorted(r["doc_id"] for r in rows.select("doc_id").collect())))
        return plain(rows, models)

    monkeypatch.setattr(hidden_markov, "_sums", noted)
    monkeypatch.setattr(hidden_markov, "LEAST", least)
    fitted = fit(docs, F.col("doc_id") > 1, states=2, emit=64, rounds=2, gain=-math.inf)
    assert [m for m, _ in seen] == [4] * 16 + [1] * 2
    for i in range(0, 16, parts):
        assert sorted(d for _, own in seen[i : i + parts] for d in own) == seen[16][1] == seen[17][1] == list(range(2, 1002))
    assert np.allclose(fitted.model.emit.sum(0), 1)


def test_the_first_pass_of_one_part_is_rounds_on_all_sequences(spark, docs_of):
    docs = docs_of(["a b c", "b", None, "c c a", "x " * 1500] * 4)
    fitted = fit(docs, F.lit(True), states=3, emit=4, rounds=0)
    seqs = [np.frombuffer(bytes(r["seq"]), "<u2") for r in fitted.rows.collect()]
    models = hidden_markov.first_models(fitted.tables.prior, 3, 4)
    for _ in range(16):
        told = [m.log10_likelihood(seqs).sum() for m in models]
        models = [normalised(*m.expected(seqs), fitted.tables.prior, 0.02) for m in models]
    best = models[int(np.argmax(told))]
    assert np.allclose(fitted.model.emit, best.emit, rtol=1e-2, atol=1e-4) and np.allclose(fitted.model.move, best.move, rtol=1e-2, atol=1e-4)
