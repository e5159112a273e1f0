"""Texts longer than a segment give what they give whole; megabytes of text go through every scan."""

import numpy as np
import pytest

from siftmail.llm import common, curve_packing, flac, lang_spans, toxic_lexicon
from siftmail.llm.chunked_bpe import encoder, ranks_from_json
from siftmail.llm.hidden_markov import words_of
from siftmail.llm.shingles import WordHashes, shingle_set
from siftmail.llm.unigram_count import Counter, vocabulary

TEXT = "The idiot  said: it's an idiott,\n\tnaïve l'été 日本 word—s  12 o'clock. " * 40 + "x" * 300 + " " * 90 + "end of it"


@pytest.fixture
def tiny(monkeypatch):
    def set_(size):
        monkeypatch.setattr(common, "SEGMENT", size)

    return set_


def test_segments_join_to_the_text(tiny):
    for size in (1, 7, 100):
        tiny(size)
        assert "".join(common.segments(TEXT)) == TEXT and len(list(common.segments(TEXT))) > 20
    assert list(common.segments("")) == [""]


def test_results_do_not_depend_on_segments(tiny):
    import public_tokenizers as P

    e = encoder(ranks_from_json(P.path("byte_bpe_50k.json")), P.PATTERN)
    m = toxic_lexicon.Matcher(toxic_lexicon.Lexicon(["idiot"]))
    rng = np.random.default_rng(0)
    model = lang_spans.Model(["a", "b"], rng.normal(-9, 1, (lang_spans.BUCKETS, 2)).astype(np.float32), np.ones((lang_spans.OTHER + 2, 2), bool))

    def all_():
        w = lang_spans.label_words([TEXT, "", TEXT[:50]], model, 3.0)
        return (
            shingle_set(TEXT, WordHashes(), 5).tolist(), list(words_of(TEXT)), curve_packing._ids(e, TEXT, 0, "<u2").tolist(), toxic_lexicon.hits(TEXT, m),
            [x.tolist() for x in (w.text, w.start, w.length, w.n_letters, w.label)],
        )

    whole = all_()
    for size in (1, 7, 20, 333):
        tiny(size)
        assert all_() == whole


def test_context_crosses_segments(tiny):
    m = toxic_lexicon.Matcher(toxic_lexicon.Lexicon(["idiot"]))
    texts = ["he said idiot", "idiot he said so", "idiot a b c d e said", "you   are not the very idiot", "a b c d e f g idiot x x x x x ", "idiot", ""]
    whole = [toxic_lexicon.hits(t, m) for t in texts]
    assert [bool(h and h[0]["quoted"]) for h in whole] == [True, True, False, False, False, False, False]
    for size in (1, 3, 6, 12):
        tiny(size)
        assert [toxic_lexicon.hits(t, m) for t in texts] == whole


def test_flac_in_slices(monkeypatch):
    rng = np.random.default_rng(1)
    data = [rng.integers(60, 90, n, np.uint8).tobytes() for n in (70_000, 64, 9000)]
    whole = flac.encode(data)
    monkeypatch.setattr(flac, "ROWS", 3)
    monkeypatch.setattr(flac, "TOGETHER", 9000)
    assert flac.encode(data) == whole
    for x, (_, got) in zip(data, flac.decode(whole), strict=True):
        assert (np.concatenate([g[0] for g in got]) + 128).astype(np.uint8).tobytes() == x


def test_megabytes_in_one_text(spark, tmp_path):
    import random

    import public_tokenizers as P

    from siftmail.llm import registry

    rng = random.Random(0)
    big = " ".join(f"w{rng.randrange(50_000)}" for _ in range(400_000))
    rows = [(1, big, "en", "s", len(big)), (2, "a small text with some words in it", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {n: f(spark, str(tmp_path)).toPandas() for n, f in registry.queries().items() if n != "op12_whitening"}  # reads no texts
    assert all(set(g.doc_id) == {1, 2} for g in got.values())
    c = Counter(vocabulary(P.path("piece_bpe_32k.model")))
    assert got["op10_token_counts"].set_index("doc_id").n_tokens[1] == sum(c[u][0] for u in c.unit.findall("▁" + big.replace(" ", "▁")))
    assert got["op2_host_rules"].set_index("doc_id").n_words[1] == 400_000 and got["op6_flac_media"].set_index("doc_id").n_bytes[1] == len(big)
    from tokenizers import Tokenizer

    words = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert got["op13_token_files"].set_index("doc_id").n_tokens[1] == len(words.encode(big, add_special_tokens=False).ids) + 1
    assert got["op11_merkle_manifest"].verified.all()
