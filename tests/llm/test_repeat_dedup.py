"""Repeated-string removal against brute force over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from siftmail.llm.column_bwt import repeated_windows
from siftmail.llm.queries_repeat_dedup import op7_suffix_dedup
from siftmail.llm.repeat_dedup import fragments


def brute(texts, width=200):
    raw = [(t or "").encode() for t in texts]
    c = Counter(x[a : a + width] for x in raw for a in range(len(x) - width + 1))
    out = []
    for x in raw:
        gone = [False] * len(x)
        for a in range(len(x) - width + 1):
            if c[x[a : a + width]] > 1:
                gone[a : a + width] = [True] * width
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((len(x), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, base = text(60), text(150)
    out = [None, "", "short", "x" * 199, "y" * 200, "z" * 201, "ab" * 300, text(400), base, base, "q" * 450 + text(20)]
    for i in range(n):
        kind = i % 6
        if kind == 0:
            out.append(text(30) + " " + passage + " " + text(30))
        elif kind == 1:
            w = base.split(" ")
            w[rng.randrange(len(w))] = text(1)
            out.append(" ".join(w))
        elif kind == 2:
            p = passage[rng.randrange(100) :]
            out.append(p + text(10) + p)
        elif kind == 3:
            out.append(text(20) + passage[: rng.randint(150, 260)] + text(20))
        else:
            out.append(text(rng.randint(1, 120)))
    return out


@pytest.mark.parametrize("most", [2000, 3, 1])
def test_against_brute_force(spark, docs_of, tmp_path, monkeypatch, most):
    import siftmail.llm.queries_repeat_dedup as q

    monkeypatch.setattr(q, "remove_repeats", lambda d, f=q.remove_repeats: f(d, most=most, batch=7))
    texts = corpus(5)
    docs_of(texts, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in op7_suffix_dedup(spark, str(tmp_path)).collect()}
    want = brute(texts)
    assert sum(w[1] > 0 for w in want) > 30
    for i, w in enumerate(want, 1):
        assert got[i] == w, i


def test_fragments_cover_each_window_once():
    texts = [(t or "").encode() for t in corpus(6)]
    seen = Counter()
    for i, start, length, *_ in fragments(texts, 200):
        for s, n in zip(start, length):
            seen.update((i, a) for a in range(s, s + n - 199))
    assert set(seen.values()) == {1} and len(seen) == sum(max(0, len(x) - 199) for x in texts)


def test_construction_against_counting():
    rng = random.Random(1)
    for _ in range(400):
        n = rng.randint(1, 9)
        s = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 14))) for _ in range(n)]
        columns = np.array([-rng.randint(0, 4) for _ in s])
        groups = np.sort([rng.randint(0, 2) for _ in s])
        w = rng.randint(1, 5)
        c = Counter((g, a + o, x[a : a + w]) for x, o, g in zip(s, columns, groups) for a in range(len(x) - w + 1))
        want = [[a for a in range(len(x) - w + 1) if c[g, a + o, x[a : a + w]] > 1] for x, o, g in zip(s, columns, groups)]
        assert [g.tolist() for g in repeated_windows(s, columns, groups, w)] == want


def test_empty(spark, docs_of, tmp_path):
    docs_of(["x"], extra=False).where("doc_id < 0").write.parquet(f"{tmp_path}/documents.parquet")
    assert op7_suffix_dedup(spark, str(tmp_path)).count() == 0
