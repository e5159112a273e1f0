"""Language ID: script ranges narrow the candidates, then Viterbi over per-word scores with a switching penalty
labels the spans of a text.

Model. For each learned language: log probabilities of hashed character 3- and 4-grams of its lower-cased words
(word ends included), and the scripts that hold at least 1 % of its letters. It is fitted on a hash-chosen
sample of labelled rows of at most about ``per_lang`` documents a language (the documented bound); counting is
one Spark aggregation, and what reaches the driver is languages x buckets, whatever the size of the table.

Decision. A word is a run between blanks; its candidates are the languages that use the script of most of its
letters (all languages if none does), its score for each the sum of its grams' log probabilities. Viterbi finds
the best label sequence, each change of language costing ``switch``. Words without letters get no label and cost
nothing. A text's language is the one whose spans hold most letters (ties: the first in alphabetical order), its
score the share of letters in those spans.

Null text, or a text without a letter: ``und``, score 0. With no learned language (no labelled rows) every text
is ``und``. Repeated rows are predicted each; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import segments

BUCKETS = 1 << 16
UND = "und"

# Unicode block ranges of the scripts told apart (first, last code point).
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)),
}
OTHER = len(SCRIPTS)  # letters of any other script

_tables: tuple[np.ndarray, np.ndarray] | None = None


def _char_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its script (OTHER: another one; OTHER + 1: no letter), and whether it is a blank."""
    global _tables
    if _tables is None:
        letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        script = np.full(0x110000, OTHER, np.uint8)
        for k, ranges in enumerate(SCRIPTS.values()):
            for a, b in ranges:
                script[a : b + 1] = k
        script[~letter] = OTHER + 1
        blank = np.zeros(0x110000, bool)
        blank[[9, 10, 11, 12, 13, 32]] = True
        _tables = script, blank
    return _tables


def _lower(text: str) -> str:
    """Lower case of the same length, so that places in it are places in the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(y if len(y := c.lower()) == 1 else c for c in text)


class Words:
    """The words of a batch of texts, as arrays over one buffer of code points."""

    def __init__(self, texts: list[str]):
        script, blank = _char_tables()
        low = [_lower(x) for x in texts]
        # a blank before, between and after the texts, so that each word has an end on both sides
        buf = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        self.ends = np.cumsum([len(x) + 1 for x in low])  # of each text, in buf
        is_blank = blank[buf]
        edge = np.flatnonzero(is_blank[1:] != is_blank[:-1]) + 1
        self.first, self.last = edge[::2], edge[1::2]  # words are buf[first:last]
        self.text = np.searchsorted(self.ends, self.first, side="left")
        self.buf = np.where(is_blank, np.uint32(32), buf)
        kind = script[buf]
        self.n_letters = np.zeros(len(self.first), np.int64)
        self.script = np.zeros(len(self.first), np.uint8)
        if len(self.first):
            cuts = np.stack([self.first, self.last], 1).ravel()
            best = np.zeros(len(self.first), np.int64)
            for k in np.unique(kind[kind <= OTHER]):
                n = np.add.reduceat(np.append(kind == k, False), cuts, dtype=np.int64)[::2]
                self.n_letters += n
                self.script = np.where(n > best, np.uint8(k), self.script)
                best = np.maximum(best, n)

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For n = 3 and 4: the bucket of the n-gram at each place of the buffer, and where it is inside a word and its ends."""
        b = self.buf.astype(np.uint64)
        h = b * np.uint64(0x9E3779B97F4A7C15)
        blank = self.buf == 32
        for n in (3, 4):
            if len(b) < n:
                continue
            x = h[: len(b) - n + 1].copy()
            ok = ~blank[1 : len(b) - n + 2]
            for k in range(1, n):
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : len(b) - n + 1 + k]
                if k < n - 1:
                    ok &= ~blank[k : len(b) - n + 1 + k]
            yield (((x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(48)).astype(np.int64), ok


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each bucket and of letters of each script, by language, of one partition."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        rows = pd.DataFrame({"text": batch.column(0).to_pylist(), "lang": batch.column(1).to_pylist()})
        for lang, own in rows.groupby("lang"):
            w = Words(list(own["text"]))
            c = counts.setdefault(lang, np.zeros(BUCKETS + OTHER + 1, np.int64))
            for g, ok in w.grams():
                c[:BUCKETS] += np.bincount(g[ok], minlength=BUCKETS)
            c[BUCKETS:] += np.bincount(w.script, weights=w.n_letters, minlength=OTHER + 1).astype(np.int64)[: OTHER + 1]
    for lang, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int64()), "n": pa.array(c[at], pa.int64())})


class Model:
    """langs: in alphabetical order; logp: buckets x languages; scripts: scripts x languages, whether it is used."""

    def __init__(self, langs: list[str], logp: np.ndarray, scripts: np.ndarray):
        self.langs, self.logp, self.scripts = langs, logp, scripts


def fit(labelled: DataFrame, *, per_lang: int = 3000, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """``labelled``: rows whose language is known; null languages and texts are left out. The sample is drawn by a
    hash of the id at a rate that gives ``per_lang`` documents a language, all of them where there are fewer."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col)).alias("h")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((OTHER + 2, 0), bool))
    wanted = F.lit(False)
    for lang, n in sizes.items():
        rate = min(1.0, per_lang / n)
        wanted = wanted | ((F.col("lang") == lang) & (F.pmod("h", F.lit(1_000_000)) < int(rate * 1_000_000) + (rate == 1)))
    got = rows.where(wanted).select("text", "lang").mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sizes)
    c = np.zeros((BUCKETS + OTHER + 1, len(langs)))
    c[got["bucket"], got["lang"].map(langs.index)] = got["n"]
    grams, letters = c[:BUCKETS] + 0.5, c[BUCKETS:]
    scripts = letters >= np.maximum(1, 0.01 * letters.sum(0))
    return Model(langs, np.log(grams / grams.sum(0)).astype(np.float32), np.vstack([scripts, np.zeros((1, len(langs)), bool)]))


def _viterbi(score: np.ndarray, text: np.ndarray, n_texts: int, switch: float) -> np.ndarray:
    """Best label of each word. score: words x languages, the words of a text together; texts advance side by side."""
    n, k = score.shape
    start = np.searchsorted(text, np.arange(n_texts))
    length = np.append(start[1:], n) - start
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    kind = np.uint8 if k <= 256 else np.uint16 if k <= 65536 else np.int64  # of a label's number
    came = np.zeros((n, k), kind)
    best = np.zeros((n_texts, k), np.float32)
    alive = int(np.count_nonzero(length > 0))
    best[:alive] = score[start[:alive]]
    final = np.zeros(n_texts, np.int64)
    states = np.arange(k, dtype=kind)
    steps = int(length[0]) if len(length) else 0
    left = np.searchsorted(-length, -np.arange(1, steps + 2), side="right")  # texts with at least so many words
    for t in range(1, steps):
        m = left[t]
        b = best[:m]
        top = b.argmax(1)
        jump = b[np.arange(m), top] - switch
        stay = b >= jump[:, None]
        at = start[:m] + t
        came[at] = np.where(stay, states, top[:, None].astype(kind))
        best[:m] = np.where(stay, b, jump[:, None]) + score[at]
    final[:] = best.argmax(1)
    label = np.zeros(n, kind)
    now = final.copy()
    for t in range(steps - 1, -1, -1):
        m = left[t]
        at = start[:m] + t
        label[at] = now[:m]
        now[:m] = came[at, now[:m]]
    return label


class Labelled:
    """The words of some texts: text, start and length in it, letters, and the number of the language."""

    def __init__(self, text: np.ndarray, start: np.ndarray, length: np.ndarray, n_letters: np.ndarray, label: np.ndarray):
        self.text, self.start, self.length, self.n_letters, self.label = text, start, length, n_letters, label


def _scores(w: Words, model: Model) -> np.ndarray:
    """Words x languages: what each language makes of each word."""
    k = len(model.langs)
    total = np.zeros((len(w.first), k), np.float32)
    for n, (g, ok) in zip((3, 4), w.grams(), strict=False):
        # the n-grams of a word begin at the blank before it and end with the blank after it
        a, b = w.first - 1, np.maximum(w.last + 2 - n, w.first - 1)
        for j in range(k):
            run = np.concatenate([[0.0], np.cumsum(np.where(ok, model.logp[g, j], np.float32(0)), dtype=np.float64)])
            total[:, j] += run[np.minimum(b, len(run) - 1)] - run[np.minimum(a, len(run) - 1)]
    can = model.scripts[w.script]
    can |= ~can.any(1, keepdims=True)
    total = np.where(can, total, np.float32(-1e6))
    total[w.n_letters == 0] = 0
    return total


def label_words(texts: list[str], model: Model, switch: float) -> Labelled:
    """Words are scored segment by segment; the best path runs over the whole text."""
    parts, owner, offset = [], [], []
    for i, t in enumerate(texts):
        at = 0
        for part in segments(t):
            parts.append(part)
            owner.append(i)
            offset.append(at)
            at += len(part)
    own, off = np.array(owner, np.int64), np.array(offset, np.int64)
    score, text, start, length, letters = [np.zeros((0, len(model.langs)), np.float32)], *([np.zeros(0, np.int64)] for _ in range(4))
    done = 0
    for run in _pieces(parts):
        w = Words(run)
        score.append(_scores(w, model))
        text.append(own[done + w.text])
        start.append(w.first - (np.append(0, w.ends)[w.text] + 1) + off[done + w.text])
        length.append(w.last - w.first)
        letters.append(w.n_letters)
        done += len(run)
    all_ = np.concatenate(text)
    label = _viterbi(np.concatenate(score), all_, len(texts), switch) if model.langs and len(all_) else np.zeros(len(all_), np.uint8)
    return Labelled(all_, np.concatenate(start), np.concatenate(length), np.concatenate(letters), label)


def _predict(texts: list[str | None], model: Model, switch: float) -> tuple[list[str], np.ndarray]:
    w = label_words([x or "" for x in texts], model, switch)
    k = max(1, len(model.langs))
    share = np.bincount(w.text * k + w.label, weights=w.n_letters, minlength=len(texts) * k).reshape(len(texts), k)
    total = share.sum(1)
    top = share.argmax(1)
    known = (total > 0) & bool(model.langs)
    return [model.langs[t] if y else UND for t, y in zip(top, known, strict=True)], np.where(known, share.max(1) / np.maximum(total, 1), 0.0)


def _pieces(texts: list, chars: int = 1_000_000) -> Iterator[list]:
    """Runs of texts of bounded size together (a longer text alone)."""
    own, size = [], 0
    for x in texts:
        if own and size + len(x or "") > chars:
            yield own
            own, size = [], 0
        own.append(x)
        size += len(x or "")
    if own:
        yield own


def language_of(text: Column, model: Model, *, switch: float = 8.0) -> Column:
    """A column (lang string, score double) for a text column. The model is languages x 65 536 floats."""
    sent = None

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            langs, scores = [], [np.zeros(0)]
            for own in _pieces(s.tolist()):
                a, b = _predict(own, sent.value, switch)
                langs += a
                scores.append(b)
            yield pd.DataFrame({"lang": langs, "score": np.concatenate(scores)})

    from pyspark.sql import SparkSession

    sent = SparkSession.active().sparkContext.broadcast(model)
    return predict(text)


def spans(docs: DataFrame, model: Model, *, switch: float = 8.0, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per maximal run of words of one language: doc_id, start and length in characters, lang, n_letters."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            w = label_words(texts, sent.value, switch)
            lab = w.label
            if not len(lab) or not sent.value.langs:
                continue
            real = np.flatnonzero(w.n_letters > 0)
            cut = np.flatnonzero((np.diff(w.text[real]) != 0) | (np.diff(lab[real]) != 0)) + 1
            a, b = np.append(0, cut), np.append(cut, len(real))
            rows = [(x, y) for x, y in zip(a, b, strict=True) if y > x]
            f, z = [real[x] for x, _ in rows], [real[y - 1] for _, y in rows]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([ids[w.text[i]] for i in f], pa.int64()),
                "start": pa.array(w.start[f], pa.int64()),
                "length": pa.array(w.start[z] + w.length[z] - w.start[f], pa.int64()),
                "lang": pa.array([sent.value.langs[lab[i]] for i in f], pa.string()),
                "n_letters": pa.array([int(w.n_letters[real[x:y]].sum()) for x, y in rows], pa.int64()),
            })

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(label, "doc_id long, start long, length long, lang string, n_letters long")
