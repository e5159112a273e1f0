"""Token files against the tokenizers library and a plain count; the format against hand-made files."""

import json
import os
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftmail.llm import token_files as T
from siftmail.llm.queries_token_files import op13_token_files

SPEC = open(P.path("word_bpe_49k.json"), encoding="utf-8").read()
TEXTS = [
    None, "", " ", "a b", "The CAT's hat, it'LL 'VE 'sfoo \"'s it''s", "le garçon naïve ŒUVRE, Straße ÅNGSTRÖM ĲSSEL", "İstanbul ſtop ſ's 'ſ", "été ́x å",
    "<|endoftext|> x <|startoftext|>", "日本語 テキスト 123 ４５ ½", "a b c\u0085d\x1ce", "🙂!🙂 ...—,—. #*$", "x" * 5000, "é" * 3000, "12345 3.14", "\0 \x07", "ΣΑΣ ὈΔΥΣΣΕΎΣ", "the cat sat. " * 3000, "a b", "DŽ ǅ ŉ ÿ",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_str(SPEC)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def check(rows, docs, library):
    """``rows`` are those of ``docs`` (doc_id, text), ascending, ids of each then 2."""
    want, at = [], 0
    for doc_id, text in docs:
        ids = np.array([*library(text), 2], "<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in sorted(rows, key=lambda r: r["start"])] == want


def test_query(spark, docs_of, tmp_path, library, many_shards):
    docs_of(TEXTS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    check(op13_token_files(spark, str(tmp_path)).collect(), [*enumerate(TEXTS, 1)], library)


def test_given_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    check(op13_token_files(spark, "/root/testdata/sf0.001").collect(), [tuple(r) for r in docs], library)


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("aÀéŝ'sStTrRvVeElLdD09 \t\n,.!—ſİ́  日ß🙂Σ<|>\x1c"), max_size=40))
def test_pieces_encode_alone(text):
    e = T._encoder(SPEC, "<u2")
    assert np.frombuffer(e.encode(text), "<u2").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_forgotten(library, monkeypatch):
    monkeypatch.setattr(T, "MOST_PIECES", 3)
    e = T.WordEncoder(SPEC, "<u4")
    for text in TEXTS:
        assert np.frombuffer(e.encode(text or ""), "<u4").tolist() == library(text)


def rows_of(spark, docs, kind):
    return spark.createDataFrame([(i, bytearray(np.array(x, kind).tobytes())) for i, x in docs], "doc_id long, ids binary").repartition(3)


@pytest.fixture
def many_shards(spark):
    """Small ranges stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_word_tokens(spark, docs_of, library):
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u2").tolist() for r in T.word_tokens(docs_of(TEXTS), SPEC, end_id=2).collect()}
    assert got == {i: [*library(t), 2] for i, t in enumerate(TEXTS, 1)}


@pytest.mark.parametrize("kind", ["<u2", "<u4"])
def test_files(spark, tmp_path, kind, many_shards):
    """Null ids, a hot id, ties and an empty document; the flat files, access by document and by run of the stream."""
    docs = [(None, [9]), (None, [8, 8]), (5, []), (5, [1, 2]), (5, [1, 2]), (5, [3]), (-7, [4] * 1000), (2**40, [65535])] + [(6, [k, 1]) for k in range(200)]
    uri = f"{tmp_path}/files"
    manifest = T.write_tokens(rows_of(spark, docs, kind), uri, kind=kind)
    assert len(manifest["shards"]) > 1 and manifest["docs"] == len(docs) and manifest["tokens"] == sum(len(x) for _, x in docs)
    files = T.TokenFiles(uri)
    got = [files.document(i) for i in range(len(files))]
    assert [g[0] for g in got] == sorted((d for d, _ in docs), key=lambda d: (d is not None, d or 0))
    assert sorted((str(i), x.tolist()) for i, _, x in got) == sorted((str(i), x) for i, x in docs)
    stream = [t for _, _, x in got for t in x.tolist()]
    assert files.tokens(0, 10**9).tolist() == stream and files.tokens(700, 1204).tolist() == stream[700:1204]
    assert all(stream[a : a + len(x)] == x.tolist() for _, a, x in got)
    flat = b"".join(open(f"{uri}/{s['name']}.bin", "rb").read() for s in manifest["shards"])
    assert np.frombuffer(flat, kind).tolist() == stream
    assert T.read_tokens(spark, uri, run_docs=7).rdd.getNumPartitions() >= len(docs) / 7
    rows = sorted(T.read_tokens(spark, uri, run_docs=7).collect(), key=lambda r: (r["start"], r["n_tokens"]))
    assert [(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in rows] == sorted(((i, a, x.tolist()) for i, a, x in got), key=lambda r: (r[1], len(r[2])))
    with pytest.raises(IndexError):
        files.document(len(docs))


def test_attempts_that_failed_leave_nothing(spark, tmp_path):
    uri = f"{tmp_path}/files"
    os.makedirs(uri)
    open(f"{uri}/shard-000000-lost.bin", "wb").write(b"half a shard")
    T.write_tokens(rows_of(spark, [(1, [1]), (2, [2])], "<u2"), uri, kind="<u2")
    assert not [f for f in os.listdir(uri) if "lost" in f]
    assert json.load(open(f"{uri}/manifest.json"))["tokens"] == 2


def test_empty(spark, tmp_path):
    uri = f"file://{tmp_path}/files"
    T.write_tokens(rows_of(spark, [(1, [1])], "<u2").where("doc_id < 0"), uri, kind="<u2")
    assert T.read_tokens(spark, uri).count() == 0 and len(T.TokenFiles(uri)) == 0 and len(T.TokenFiles(uri).tokens(0, 5)) == 0
