"""Chunked BPE and unigram counts against the tokenizer libraries."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest

from siftmail.llm.chunked_bpe import decode, encode, encoder, ranks_from_json, ranks_from_tiktoken
from siftmail.llm.unigram_count import Counter, piece_counts, vocabulary

TEXTS = [
    None, "", " ", "\n\n  \n", "a", "The quick  brown fox, it's 12 o'clock.", "naïve — 日本語 🜁 text\t tabs \r\n",
    "word " * 500, "x" * 700, " " * 700 + "end", "it's we'll they've " * 60, "l'été   où\n\n\n" * 80, "<|endoftext|> <0x0A> ▁",
    "The quick  brown fox, it's 12 o'clock.",
]


@pytest.mark.parametrize("chunk,overlap", [(100, 30), (64, 7), (32_768, 2_048)])
def test_chunked_bpe_equals_tiktoken(spark, docs_of, chunk, overlap):
    ranks = ranks_from_tiktoken(P.path("byte_bpe_multi_50k.tiktoken"))
    e = encoder(ranks, P.PATTERN)
    got = decode(encode(docs_of(TEXTS), ranks, P.PATTERN, chunk=chunk, overlap=overlap), ranks).toPandas().set_index("doc_id")
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS, 1):
        assert np.frombuffer(got.ids[i], "<u4").tolist() == e.encode_ordinary(t or ""), t
        assert bytes(got.decoded[i]) == (t or "").encode()


def test_empty_table(spark, docs_of):
    ranks = ranks_from_tiktoken(P.path("byte_bpe_multi_50k.tiktoken"))
    assert decode(encode(docs_of(["a"]).where("doc_id < 0"), ranks, P.PATTERN), ranks).count() == 0


def test_ranks_of_the_json_form():
    assert ranks_from_json(P.path("byte_bpe_50k.json")) == ranks_from_tiktoken(P.path("byte_bpe_50k.tiktoken"))


def test_query_digests(spark, tmp_path, docs_of):
    from siftmail.llm.queries_chunked_bpe import op5_chunked_bpe

    docs_of(TEXTS, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    e = encoder(ranks_from_tiktoken(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    for r in op5_chunked_bpe(spark, str(tmp_path)).collect():
        t = TEXTS[r["doc_id"] - 1] or ""
        ids = np.array(e.encode_ordinary(t), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def _unigram(pieces):
    """The tokenizers library's unigram model over the same pieces, with byte fallback."""
    from tokenizers import Tokenizer, models

    taken = {p for p, _ in pieces}
    top = max(s for _, s in pieces)
    extra = [(f"<0x{b:02X}>", top) for b in range(256) if f"<0x{b:02X}>" not in taken]
    return Tokenizer(models.Unigram([("<unk>", top), *pieces, *extra], unk_id=0, byte_fallback=True))


def test_unigram_counts_equal_the_library(spark, docs_of):
    pieces = vocabulary(P.path("piece_bpe_32k.model"))
    model = _unigram(pieces)
    texts = [t for t in TEXTS if not t or "<" not in t]
    df = docs_of(texts)
    got = {r["doc_id"]: r["c"]["n_tokens"] for r in df.select("doc_id", piece_counts(df["text"], pieces).alias("c")).collect()}
    for i, t in enumerate(texts, 1):
        want = len(model.encode("▁" + t.replace(" ", "▁")).ids) if t else 0
        assert got[i] == want, t


def test_ties_take_the_longest_last_piece():
    c = Counter([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("bc", -3.0), ("c", -2.0), ("abc", -4.0), ("▁", -1.0)])
    assert c.text("ab") == (2, -3.0)  # ▁ ab, not ▁ a b
    assert c.text("abc") == (2, -5.0)
    assert c.text("é") == (3, -15.0)  # unknown: its two bytes
