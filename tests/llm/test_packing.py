"""Packing: every id of every document in exactly one piece, sequences gapless, ids as the tokenizers library gives them."""

import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from siftmail.llm.curve_packing import hilbert
from siftmail.llm.queries_curve_packing import op1_curve_packing

TEXTS = [None, "", "a b", "the cat sat. " * 400, "le chat noir. " * 300, "<|endoftext|> x", "a b", "é" * 3000, *["copy of a text"] * 40]


def test_hilbert_neighbours_touch():
    g = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    key = hilbert(g, 3)
    assert sorted(key) == list(range(512))
    walk = g[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_pieces(spark, docs_of, tmp_path):
    docs_of(TEXTS, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = op1_curve_packing(spark, str(tmp_path)).toPandas()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for i, text in enumerate(TEXTS, 1):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = got[got.doc_id == i].sort_values("start")
        assert (own.doc_tokens == len(ids)).all()
        assert own.start.tolist() == [0, *own.length.cumsum()[:-1]] and own.length.sum() == len(ids)
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length)]
    used = []
    for _, s in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]]
        used.append(s.length.sum())
    assert set(used[:-1]) == {1024} and used[-1] <= 1024


def test_empty(spark, docs_of, tmp_path):
    docs_of(["x"], extra=False).where("doc_id < 0").write.parquet(f"{tmp_path}/documents.parquet")
    assert op1_curve_packing(spark, str(tmp_path)).count() == 0
