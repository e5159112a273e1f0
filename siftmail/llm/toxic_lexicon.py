"""Toxicity: Levenshtein automata intersected with a lexicon trie catch misspelled terms; scores of the words around
a hit separate quotation from abuse.

Model, all learned from labelled rows:
* lexicon: words (at least 4 letters) whose share of toxic documents is far above the base rate, by document counts;
* exceptions: words within the automaton's reach that clean documents use;
* a logistic model of a document's evidence: hits, misspelled hits, hits in quotation, hits beside address.
It is fitted on at most about ``max_docs`` labelled documents drawn by a hash of the text (the documented bound);
copies and most near copies in the sample count once (documents with the same four smallest word hashes), so that a
text repeated a thousand times does not make its words terms. Word counts are a Spark aggregation; to the driver
come all terms and exceptions (words of the sample, so bounded by it) and six numbers for each sampled document.

Matching. The trie of the lexicon and the automata of one error (two from 8 letters on) are walked together: a
state is the set of (trie node, errors) reachable, made on demand, kept, and followed letter by letter; most words
leave the trie after two or three letters. A word is looked up once a batch.

Context. A hit counts as quoted if a quotation mark or a word of reporting stands within ``WINDOW`` words, as
addressed if a word of address does; long texts are judged as whole as short ones.

Null and empty texts have no evidence and get the score of a document without hits. Without labelled rows the lexicon
is empty and every score 0.05. Repeated rows are scored each; other columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import segments

WINDOW = 5
WORD = re.compile(r"\w+(?:[@$!]+\w+)*")

# Words of reporting and of address, and quotation marks.
REPORTING = frozenset("said says quote quoted quotes quoting wrote writes called term word cites cited dit cite zitat zitiert sagte dijo cita".split())
ADDRESS = frozenset("you your youre u ur du dein dich dir toi tu ton vous tú usted eres".split())
MARKS = frozenset("\"“”«»„‟'‘’")


def errors_for(term: str) -> int:
    """Errors within which a word still is this term."""
    return 2 if len(term) >= 8 else 1


class Lexicon:
    """The terms' trie, walked together with their Levenshtein automata."""

    def __init__(self, terms: list[str], exceptions: frozenset[str] = frozenset()):
        self.terms, self.exceptions = list(terms), exceptions
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]  # number of the term that ends here
        self.most: list[int] = [0]  # errors allowed to any term below
        for i, term in enumerate(self.terms):
            node = 0
            self.most[0] = max(self.most[0], errors_for(term))
            for c in term:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.ends.append(-1)
                    self.most.append(0)
                node = self.child[node][c]
                self.most[node] = max(self.most[node], errors_for(term))
            self.ends[node] = i
        self.state_of: dict[frozenset, int] = {}
        self.states: list[dict[int, int]] = []
        self.step: list[dict[str, int]] = []
        self.accept: list[tuple[int, int] | None] = []
        self.begin = self._state({0: 0})

    def _state(self, reach: dict[int, int]) -> int:
        """Number of the state that reaches ``reach``: trie node -> fewest errors; letters of the trie may be left out."""
        todo = sorted(reach.items(), key=lambda x: x[1])
        while todo:
            node, e = todo.pop()
            if reach.get(node, 99) < e:
                continue
            for nxt in self.child[node].values():
                if e + 1 <= self.most[nxt] and e + 1 < reach.get(nxt, 99):
                    reach[nxt] = e + 1
                    todo.append((nxt, e + 1))
        key = frozenset(reach.items())
        if key not in self.state_of:
            self.state_of[key] = len(self.states)
            self.states.append(reach)
            self.step.append({})
            ends = [(e, self.ends[n]) for n, e in reach.items() if self.ends[n] >= 0 and e <= errors_for(self.terms[self.ends[n]])]
            self.accept.append(min(ends) if ends else None)
        return self.state_of[key]

    def _next(self, state: int, c: str) -> int:
        """-1: no term can be reached any more."""
        reach: dict[int, int] = {}
        for node, e in self.states[state].items():
            if e + 1 <= self.most[node]:  # c is one too many
                reach[node] = min(reach.get(node, 99), e + 1)
            for letter, nxt in self.child[node].items():
                cost = e + (letter != c)
                if cost <= self.most[nxt]:
                    reach[nxt] = min(reach.get(nxt, 99), cost)
        to = self._state(reach) if reach else -1
        self.step[state][c] = to
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(errors, term) of the nearest term within reach, first by errors, then by the term's number."""
        state = self.begin
        for c in word:
            step = self.step[state]
            state = step[c] if c in step else self._next(state, c)
            if state < 0:
                return None
        found = self.accept[state]
        if found and found[0] and word in self.exceptions:
            return None
        return found


class Matcher(dict):
    """word -> match, each word walked once; emptied when it grows large."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str):
        if len(self) > 300_000:
            self.clear()
        found = self[word] = self.lexicon.match(word) if len(word) >= 3 else None
        return found


def hits(text: str, matcher: Matcher) -> list[dict]:
    """Each hit in the lower-cased text with its place, term, errors and context. A long text is taken apart in segments;
    ``WINDOW`` words of the neighbours stand on both sides of each, so a hit's context does not depend on the cuts."""
    low = text.lower()
    out: list[dict] = []
    before: list[tuple[int, int]] = []  # the last words of the segments before
    held: tuple[list, list, list] | None = None  # words before a segment, its own, and where its hits are
    at = 0
    for part in segments(low):
        words = WORD.findall(part)
        found = [i for i, w in enumerate(words) if matcher[w] is not None]
        # places of the words only where a hit is near, or at the ends
        need = bool(found) or held is not None or len(low) > len(part)
        own = [(m.start() + at, m.end() + at) for m in WORD.finditer(part)] if need else []
        at += len(part)
        if held is not None:
            if len(own) < WINDOW and at < len(low):  # too few words to see the context: one longer segment
                held = (held[0], held[1] + own, held[2] + [i + len(held[1]) for i in found])
                continue
            out += _contexts(low, *held, own[:WINDOW], matcher)
            before = (held[0] + held[1])[-WINDOW:]
        held = (before, own, found)
    return out + (_contexts(low, *held, [], matcher) if held and held[2] else [])


def _contexts(low: str, before: list, own: list, found: list, after: list, matcher: Matcher) -> list[dict]:
    """The hits ``found`` among the words ``own`` (start, end), seen amid the words before and after."""
    spans = before + own + after
    out = []
    for i in (f + len(before) for f in found):
        around = spans[max(0, i - WINDOW) : i + WINDOW + 1]
        near = {low[a:b] for a, b in around}
        seen = low[around[0][0] : around[-1][1] + 1]
        marked = any(c in MARKS and (k == 0 or not seen[k - 1].isalnum() or k + 1 == len(seen) or not seen[k + 1].isalnum()) for k, c in enumerate(seen))
        word = low[spans[i][0] : spans[i][1]]
        e, term = matcher[word]
        out.append({"start": spans[i][0], "word": word, "term": matcher.lexicon.terms[term], "errors": e, "quoted": marked or bool(near & REPORTING), "addressed": bool(near & ADDRESS)})
    return out


def evidence(text: str | None, matcher: Matcher) -> tuple[float, float, float, float]:
    """Hits, those of them with errors, quoted and addressed, each as log(1 + n)."""
    found = hits(text or "", matcher)
    if not found:
        return 0.0, 0.0, 0.0, 0.0
    n = (len(found), sum(h["errors"] > 0 for h in found), sum(h["quoted"] for h in found), sum(h["addressed"] for h in found))
    return tuple(map(math.log1p, n))  # type: ignore[return-value]


#: What is believed of the evidence's weights before any label: hits speak for toxicity, misspelled ones nearly as
#: much, quotation against it.
PRIOR = np.array([2.0, -0.5, -1.0, 0.5])


class Model:
    def __init__(self, lexicon: Lexicon, bias: float, weights: np.ndarray):
        self.lexicon, self.bias, self.weights = lexicon, bias, weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + x @ self.weights, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Newton's method with a Gaussian prior around PRIOR."""
    a = np.hstack([np.ones((len(x), 1)), x])
    mean, precision = np.append(-3.0, PRIOR), np.append(1e-3, np.full(len(PRIOR), 1.0))
    w = mean.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (y - p) - precision * (w - mean)
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(precision)
        step = np.linalg.solve(h, g)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), w[1:]


def fit(labelled: DataFrame, *, max_docs: int = 20_000, min_docs: int = 5, text_col: str = "text", label_col: str = "toxic") -> Model:
    """``labelled``: texts with 0/1 labels; rows without either are left out."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("y")).where("text IS NOT NULL AND y IS NOT NULL")
    n = rows.count()
    if not n:
        return Model(Lexicon([]), math.log(0.05 / 0.95), PRIOR)
    rate = min(1.0, max_docs / n)
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), 1))
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.lit(int(rate * 1_000_000))).withColumn("words", words)
    hashed = F.transform("words", lambda w: F.xxhash64(w))
    sample = sample.groupBy(F.slice(F.sort_array(hashed), F.lit(1), F.lit(4)).alias("a")).agg(F.max_by("words", F.xxhash64("text")).alias("words"), F.max_by("text", F.xxhash64("text")).alias("text"), F.max_by("y", F.xxhash64("text")).alias("y"))
    sample = sample.persist()  # at most about max_docs texts
    try:
        totals = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")).first()
        n, pos = totals["n"], totals["pos"] or 0
        base = (pos + 0.5) / (n + 1)
        df = sample.select("y", F.explode("words").alias("w")).where("length(w) >= 4").groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
        # lower end of the 99.9 % Wilson interval of the word's share of toxic documents
        z, p = 3.1, F.col("pos") / F.col("n")
        low = (p + z * z / (2 * F.col("n")) - z * F.sqrt(p * (1 - p) / F.col("n") + z * z / (4 * F.col("n") * F.col("n")))) / (1 + z * z / F.col("n"))
        strong = df.where((F.col("pos") >= min_docs) & (p >= 0.6) & (low > base + 0.25 * (1 - base))).select("w").collect()
        terms = sorted(r["w"] for r in strong)
        reach = Lexicon(terms)

        def clean_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = Matcher(reach)
            for batch in batches:
                keep = [w for w in batch.column(0).to_pylist() if (f := m[w]) and f[0]]
                yield pa.RecordBatch.from_pydict({"w": pa.array(keep, pa.string())})

        spelled = df.where("n - pos > 0 AND 2 * (n - pos) >= pos").select("w").mapInArrow(clean_words, "w string").collect() if terms else []
        lexicon = Lexicon(terms, frozenset(r["w"] for r in spelled))

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = Matcher(lexicon)
            for batch in batches:
                x = np.array([evidence(t, m) for t in batch.column(0).to_pylist()]).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, i]) for i in range(4)] + [batch.column(1)], ["a", "b", "c", "d", "y"])

        got = sample.select("text", "y").mapInArrow(measure, "a double, b double, c double, d double, y int").toPandas()
    finally:
        sample.unpersist()
    bias, weights = _logistic(got[["a", "b", "c", "d"]].to_numpy(), got["y"].to_numpy(float))
    return Model(lexicon, bias, weights)


def toxicity(text: Column, model: Model) -> Column:
    """Score between 0 and 1 for a text column. The model is broadcast."""
    sent = SparkSession.active().sparkContext.broadcast((model.lexicon.terms, model.lexicon.exceptions, model.bias, model.weights))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms, exceptions, bias, weights = sent.value
        own = Model(Lexicon(terms, exceptions), bias, weights)
        matcher = Matcher(own.lexicon)
        for s in batches:
            x = np.array([evidence(t, matcher) for t in s]).reshape(-1, len(PRIOR))
            yield pd.Series(own.score(x))

    return score(text)


def hit_spans(docs: DataFrame, model: Model, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per hit: doc_id, start (character of the lower-cased text), word, term, errors, quoted, addressed."""
    sent = docs.sparkSession.sparkContext.broadcast((model.lexicon.terms, model.lexicon.exceptions))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(Lexicon(*sent.value))
        for batch in batches:
            rows = [{"doc_id": i} | h for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for h in hits(t or "", matcher)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("word", pa.string()), ("term", pa.string()), ("errors", pa.int32()), ("quoted", pa.bool_()), ("addressed", pa.bool_())]))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(find, "doc_id long, start long, word string, term string, errors int, quoted boolean, addressed boolean")
