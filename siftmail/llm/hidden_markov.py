"""A hidden Markov language model: Baum-Welch counts aggregated over all partitions train its states; the scaled forward
recursion gives a text's exact likelihood.

Tokens are the lower-cased (A-Z) words of a text and one end token. Emissions are classes: each of the ``emit`` most
frequent tokens is its own, all others fall into ``RARE`` classes by their first and last two bytes; within a class a
token has its smoothed share of the class's training count, with one share for all unseen tokens. So the model is a
proper distribution over texts, and the log probability of a text is its class sequence's, by the forward recursion,
plus its tokens' shares.

Training. 1. Token counts of all training texts: one aggregation; it grows with the corpus. 2. Class sequences of all
texts, two bytes a token, in a scratch table. 3. Baum-Welch, which ends in a local optimum, from several ``starts``
(disturbed unigrams) side by side: a first pass takes the training texts in ``BLOCKS`` parts by hash, disjoint and
growing with the input, and goes on after each with the counts of all parts so far, so that every start learns from
every text; of a small corpus there are fewer parts, each taken several times, its counts in place of its former ones.
The start under which all the texts are likeliest goes on, in rounds over the whole corpus, until one gains less than
``gain`` (log10 likelihood of a token), or after ``rounds``. No count and no choice rests on a part of the texts. In a
round each task adds up expected counts of its texts, Spark adds up the tasks' (classes x states numbers, whatever the
corpus), the driver normalises; no sequence reaches the driver. Sequences are taken whole: a long one is cut so that its
pieces advance side by side, each from the exact forward and backward values at its borders.

Counts of rare tokens never gather anywhere: the ``known`` most frequent tokens (a fixed bound, by a threshold on the
count) travel to the tasks, the rest are looked up by a join of (text, token) with the counts.

Tokens are told apart by 64-bit hashes. Null text counts as empty: the end token alone. Repeated rows are scored and
counted each. With no training text every count is 0 and all classes are alike. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, segments
from .shingles import LOWER

RARE = 512
_LOW = RARE - 1
END = -(1 << 63) + _LOW  # the end token's hash; its class, if it were rare, is the last


def token_hash(word: bytes) -> int:
    """Signed 64-bit hash whose low bits are the word's rare class."""
    h = (xxhash.xxh3_64_intdigest(word) & ~_LOW) | (xxhash.xxh3_64_intdigest(word[:2] + b" " + word[-2:]) & _LOW)
    return h - (1 << 64) if h >= 1 << 63 else h


def words_of(text: str | None) -> Iterator[bytes]:
    for part in segments(text or ""):
        yield from part.encode("utf-8", "surrogatepass").translate(LOWER).split()


class Numbered(dict):
    """Word -> running number in order of first sight; ``hashes`` has each number's hash, the end token's first."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = [END]

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.hashes)
        self.hashes.append(token_hash(word))
        return n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the tokens of one partition, added up as far as memory of a fixed size goes."""
    seen, total = Numbered(), np.zeros(0, np.int64)

    def summed():
        return pa.RecordBatch.from_arrays([pa.array(np.array(seen.hashes[: len(total)], np.int64)), pa.array(total)], ["h", "c"])

    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            found: list[int] = [0] * part.num_rows  # the end tokens
            for text in part.column(0):
                found.extend(map(seen.__getitem__, words_of(text.as_py())))
            n = np.bincount(np.array(found), minlength=len(seen.hashes))
            n[: len(total)] += total
            total = n
            if len(total) > 250_000:
                yield summed()
                seen, total = Numbered(), np.zeros(0, np.int64)
    if len(total):
        yield summed()


class Tables:
    """What the tasks need to turn texts into classes: all of fixed size."""

    def __init__(self, h: np.ndarray, c: np.ndarray, emit: int, rare_n: np.ndarray, rare_v: np.ndarray, total: int, distinct: int):
        order = np.argsort(h)
        self.h, self.c = h[order], c[order]
        rank = np.lexsort((self.h, -self.c))[:emit]
        self.cls = emit + (self.h & _LOW)
        self.cls[rank] = np.arange(len(rank))
        self.emit, self.total, self.distinct = emit, total, distinct
        own = np.zeros(len(self.h), bool)
        own[rank] = True
        # counts and distinct tokens of each rare class, without those that are classes of their own
        self.n = rare_n - np.bincount(self.h[own] & _LOW, weights=self.c[own], minlength=RARE)
        self.v = rare_v - np.bincount(self.h[own] & _LOW, minlength=RARE)
        self.log_norm = np.log10(self.n + 0.5 * (self.v + 1))
        self.log_base = float(np.log10(total + 0.5 * (distinct + 1)))
        self.prior = np.zeros(emit + RARE)
        self.prior[: len(rank)] = self.c[rank] + 0.5
        self.prior[emit:] = self.n + 0.5 / RARE  # what no training text has weighs half a token, as in the unigram
        self.prior /= self.prior.sum()


def tables_of(counts: DataFrame, emit: int, known: int) -> tuple[Tables, int]:
    """From all token counts (h, c): the tables, and the count at and above which a token is in them. The threshold is
    the lowest of a scale of eight steps a doubling that no more than ``known`` tokens reach."""
    step = F.floor(F.log2(F.col("c").cast("double")) * 8).cast("int")
    scale = counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n"), F.min("c").alias("least")).orderBy(F.col("s").desc()).collect()
    rare = counts.groupBy(F.expr(f"h & {_LOW}").alias("r")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()  # RARE rows
    least, held = 1 << 62, 0
    for row in scale:
        held += row["v"]
        if held > known:
            break
        least = row["least"]
    top = counts.where(F.col("c") >= least).toPandas()
    n, v = np.zeros(RARE), np.zeros(RARE)
    for row in rare:
        n[row["r"]], v[row["r"]] = row["n"], row["v"]
    return Tables(top["h"].to_numpy(np.int64), top["c"].to_numpy(np.int64), emit, n, v, sum(r["n"] for r in scale), sum(r["v"] for r in scale)), least


class _Known:
    """Numbers of one task's words with what the tables say of each; emptied when it grows large."""

    def __init__(self, t: Tables):
        self.t = t
        self.clear()

    def clear(self) -> None:
        self.seen, self.done = Numbered(), 0
        self.h, self.cls, self.log_c, self.there = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)

    def look_up(self) -> None:
        """The words that came since the last time."""
        t = self.t
        h = np.array(self.seen.hashes[self.done :], np.int64)
        self.done = len(self.seen.hashes)
        there, c, cls = np.zeros(len(h), bool), np.zeros(len(h), np.int64), t.emit + (h & _LOW)
        if len(t.h):
            at = np.minimum(np.searchsorted(t.h, h), len(t.h) - 1)
            there = t.h[at] == h
            c, cls = np.where(there, t.c[at], 0), np.where(there, t.cls[at], cls)
        self.h, self.cls = np.append(self.h, h), np.append(self.cls, cls)
        self.log_c, self.there = np.append(self.log_c, np.log10(c + 0.5)), np.append(self.there, there)


def _classes(docs: DataFrame, sent) -> DataFrame:
    """uid, doc_id, train, seq (classes, 16 bits each), n_tokens, n_known, base, share and the tokens that the tables
    lack (rare: h, n), counted as unseen so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Tables = sent.value
        known = _Known(t)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                if len(known.seen) > 200_000:
                    known.clear()
                found: list[int] = []
                ends = []
                for text in part.column(2):
                    found.extend(map(known.seen.__getitem__, words_of(text.as_py())))
                    found.append(0)
                    ends.append(len(found))
                known.look_up()
                x = np.array(found)
                end = np.array(ends)
                first = np.append(0, end[:-1])
                cls, log_c, there = known.cls[x], known.log_c[x], known.there[x]
                shared = np.zeros(len(x))
                by_class = cls >= t.emit
                shared[by_class] = log_c[by_class] - t.log_norm[cls[by_class] - t.emit]
                lost = np.flatnonzero(~there)
                doc = np.searchsorted(end, lost, side="right")
                order = np.lexsort((known.h[x[lost]], doc))
                doc, h = doc[order], known.h[x[lost]][order]
                new = np.ones(len(h), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
                at_new = np.flatnonzero(new)
                pairs = pa.StructArray.from_arrays([pa.array(h[at_new]), pa.array(np.diff(np.append(at_new, len(h))))], ["h", "n"])
                offsets = np.searchsorted(doc[at_new], np.arange(part.num_rows + 1))
                raw = cls.astype("<u2").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array((raw[2 * a : 2 * b] for a, b in zip(first, end, strict=True)), pa.binary()), pa.array(end - first),
                        pa.array(np.add.reduceat(there.astype(np.int64), first)), pa.array(np.add.reduceat(log_c, first) - (end - first) * t.log_base),
                        pa.array(np.add.reduceat(shared, first)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs),
                    ],
                    ["doc_id", "train", "seq", "n_tokens", "n_known", "base", "share", "rare"],
                )

    made = docs.mapInArrow(run, "doc_id long, train boolean, seq binary, n_tokens long, n_known long, base double, share double, rare array<struct<h: long, n: long>>")
    return made.withColumn("uid", F.monotonically_increasing_id())


#: Symbols of a sequence that are taken one after the other; longer sequences have several such pieces side by side.
PIECE = 1024


class Lanes:
    """Sequences cut into pieces that all advance together, the longest first. Symbols are stored step by step, so that
    a step of all pieces that are still there is one slice: ``at(t)``."""

    def __init__(self, seqs: list[np.ndarray], piece: int = 0):
        piece = piece or PIECE
        whole = np.array([len(s) for s in seqs], np.int64)
        pieces = -(-whole // piece)
        seq = np.repeat(np.arange(len(seqs)), pieces)
        nth = np.arange(len(seq)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(piece, whole[seq] - nth * piece)
        order = np.argsort(-length, kind="stable")
        self.seq, self.nth, self.length = seq[order], nth[order], length[order]
        self.lane = np.empty(len(order), np.int64)  # of the pieces in the order of their sequences
        self.lane[order] = np.arange(len(order))
        self.first_piece = np.cumsum(pieces) - pieces  # of each sequence, in that order
        self.pieces = pieces
        self.steps = int(self.length[0]) if len(order) else 0
        self.alive = np.searchsorted(-self.length, -np.arange(1, self.steps + 1), side="right")
        self.begin = np.cumsum(self.alive) - self.alive
        flat = np.concatenate([np.zeros(0, np.uint16), *seqs]).astype(np.int64)
        own = np.repeat(np.arange(len(seq)), length)  # piece of each symbol
        t = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
        self.obs = np.empty_like(flat)
        self.obs[self.begin[t] + self.lane[own]] = flat

    def at(self, t: int, lanes: int | None = None) -> slice:
        return slice(self.begin[t], self.begin[t] + (self.alive[t] if lanes is None else lanes))


class Model:
    """start: states; move: states x states; emit: classes x states (all float64)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    def _transfers(self, x: Lanes, lanes: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Of the pieces in ``lanes`` (ascending): the matrix that takes the forward values before a piece to those at
        its end (of a first piece: the start distribution), scaled, and the log10 of the scale."""
        k = len(self.start)
        move, emit = self.move.astype(kind), self.emit.astype(kind)
        out, log = np.tile(np.eye(k, dtype=kind), (len(lanes), 1, 1)), np.zeros(len(lanes))
        first = x.nth[lanes] == 0
        for t in range(x.steps):
            m = int(np.searchsorted(lanes, x.alive[t]))
            if not m:
                break
            e = emit[x.obs[x.begin[t] + lanes[:m]]]
            y = (out[:m].reshape(-1, k) @ move).reshape(m, k, k) if t else np.where(first[:m, None, None], out[:m], move)
            y *= e[:, None, :]
            out[:m] = y
            if t % 4 == 3 or t == x.steps - 1 or x.alive[t + 1] < x.alive[t]:
                scale = y.reshape(m, -1).max(1)
                out[:m] /= scale[:, None, None]
                log[:m] += np.log10(scale)
        return out, log

    def _chains(self, x: Lanes, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The exact values at the borders of pieces: forward before each piece (of a first one: the start), backward at
        its end (scale left open), and the log10 likelihood of each sequence of several pieces (0 of others)."""
        k = len(self.start)
        before = np.tile(self.start.astype(kind), (len(x.seq), 1))
        behind = np.ones((len(x.seq), k), kind)
        total = np.zeros(len(x.pieces))
        several = np.flatnonzero(x.pieces > 1)
        if not len(several):
            return before, behind, total
        lanes = np.flatnonzero(x.pieces[x.seq] > 1)
        matrix, log = self._transfers(x, lanes, kind)
        by_lane = np.full(len(x.seq), -1)
        by_lane[lanes] = np.arange(len(lanes))
        a = np.tile(self.start.astype(kind), (len(several), 1))
        for p in range(int(x.pieces.max())):
            on = np.flatnonzero(x.pieces[several] > p)
            lane = x.lane[x.first_piece[several[on]] + p]
            before[lane] = a[on]
            y = np.einsum("ni,nij->nj", a[on], matrix[by_lane[lane]])
            scale = y.sum(1)
            a[on] = y / scale[:, None]
            total[several[on]] += np.log10(scale) + log[by_lane[lane]]
        b = np.ones((len(several), k), kind)
        for p in range(int(x.pieces.max()) - 1, 0, -1):
            on = np.flatnonzero(x.pieces[several] > p)
            y = np.einsum("nij,nj->ni", matrix[by_lane[x.lane[x.first_piece[several[on]] + p]]], b[on])
            b[on] = y / y.sum(1, keepdims=True)
            behind[x.lane[x.first_piece[several[on]] + p - 1]] = b[on]
        return before, behind, total

    def log10_likelihood(self, seqs: list[np.ndarray]) -> np.ndarray:
        """Scaled forward recursion; a sequence has at least one symbol. The pieces of a long one are summed up as
        matrices side by side and multiplied in their order: the same sum over all paths."""
        x = Lanes(seqs)
        _, _, total = self._chains(x, np.float64)
        short = np.flatnonzero(x.pieces[x.seq] == 1)
        a, log = np.tile(self.start, (len(short), 1)), np.zeros(len(short))
        for t in range(x.steps):
            m = int(np.searchsorted(short, x.alive[t]))
            if not m:
                break
            a = (a[:m] @ self.move if t else a[:m]) * self.emit[x.obs[x.begin[t] + short[:m]]]
            scale = a.sum(1)
            a /= scale[:, None]
            log[:m] += np.log10(scale)
        total[x.seq[short]] = log
        return total

    def expected(self, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch: expected starts, moves and emissions of whole sequences."""
        return self.expected_and_likelihood(seqs)[:3]

    def expected_and_likelihood(self, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """The expected counts and the log10 likelihood of all sequences together (in single precision). Pieces of long
        ones advance side by side from the exact forward and backward values at their borders."""
        x, k = Lanes(seqs), len(self.start)
        if not x.steps:
            return np.zeros(k), np.zeros((k, k)), np.zeros((len(self.emit), k)), 0.0
        emit, move = self.emit.astype(np.float32), self.move.astype(np.float32)
        ones = np.ones(k, np.float32)
        before, b, _ = self._chains(x, np.float32)
        later = x.nth > 0
        a = before.copy()
        a[later] = before[later] @ move
        said = emit[x.obs]
        out = said.copy()  # step by step: emission, then scaled forward, then posterior
        scale = np.empty(len(x.obs), np.float32)
        for t in range(x.steps):
            now = out[x.at(t)]
            now *= a if t == 0 else a[: len(now)] @ move
            s = scale[x.at(t)] = now @ ones
            now /= s[:, None]
            a = now
        b /= ((out[x.begin[x.length - 1] + np.arange(len(x.length))] * b) @ ones)[:, None]
        moves = np.zeros((k, k))
        for t in range(x.steps - 1, -1, -1):
            now, m = out[x.at(t)], int(x.alive[t])
            w = said[x.at(t)]
            w *= b[:m]
            w /= scale[x.at(t)][:, None]
            if t:
                moves += out[x.at(t - 1, m)].T @ w
                now *= b[:m]
                b[:m] = w @ move.T
            else:
                moves += before[later].T @ w[later]
                now *= b
        emits = np.stack([np.bincount(x.obs, weights=out[:, j], minlength=len(emit)) for j in range(k)], 1)
        return out[x.at(0)][~later].sum(0, dtype=np.float64), moves * self.move, emits, float(np.log10(scale).sum(dtype=np.float64))


def normalised(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, prior: np.ndarray, weight: float) -> Model:
    """The model of expected counts; the unigram distribution is added to each state, ``weight`` of a state's mean mass."""
    k = len(starts)
    m = moves + 1.0 / k
    e = emits + max(1.0, weight * emits.sum() / k) * prior[:, None]
    return Model((starts + 1.0 / k) / (starts.sum() + 1), m / m.sum(1, keepdims=True), e / e.sum(0))


def _seqs(column: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Runs of sequences of bounded size together (a longer one alone), with the first one's number."""
    own, total, first = [], 0, 0
    for i, x in enumerate(column):
        s = np.frombuffer(x.as_py(), "<u2")
        if own and total + len(s) > size:
            yield first, own
            own, total, first = [], 0, i
        own.append(s)
        total += len(s)
    if own:
        yield first, own


#: Parts of the first pass, how often it takes one in all, and the expected tokens that a part must have.
BLOCKS, LEAST = 16, 100_000
#: For callers in a hurry, in place of the first pass: rounds over shares, (level, times) each, of the texts of this level
#: and more, one in 4 ** level of all. None here: they leave the choice among starts to a part of the texts.
SHARES: tuple[tuple[int, int], ...] = ()
#: Expected tokens that a share must have.
FLOOR = 200_000


def with_parts(rows: DataFrame) -> DataFrame:
    """``rows`` with the block of each, 0 to ``BLOCKS`` - 1, and its level (3 for one in 64, 2 and more for one in 16, 1 and
    more for one in 4), by a hash of id and sequence."""
    hashed = F.xxhash64("doc_id", "seq")
    h = F.pmod(hashed, F.lit(64))
    return rows.withColumns({"level": F.when(h < 1, 3).when(h < 4, 2).when(h < 16, 1).otherwise(0), "block": F.pmod(F.shiftright(hashed, 6), F.lit(BLOCKS)).cast("int")})


def first_models(prior: np.ndarray, states: int, starts: int) -> list[Model]:
    """Where Baum-Welch begins: disturbed unigrams, states that tend to stay."""
    out = []
    for seed in range(starts):
        e = prior[:, None] * (np.random.default_rng(seed).exponential(1.0, (len(prior), states)) + 0.02)
        move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        out.append(Model(np.full(states, 1 / states), move, e / e.sum(0)))
    return out


def trained(rows: DataFrame, tables: Tables, states: int, starts: int, rounds: int, weight: float, gain: float) -> Model:
    """Baum-Welch over all of ``rows`` (seq, level, block): a first pass for each start, rounds for the likeliest."""
    models = first_models(tables.prior, states, starts)
    if not tables.total:
        return models[0]
    for level, times in SHARES:
        while level and tables.total < FLOOR * 4**level:
            level -= 1
        for _ in range(times):
            made = _round(rows.where(F.col("level") >= level), models, tables.prior, weight)
            models = [m for m, _ in made]
        models = [max(made, key=lambda x: x[1])[0]]
    model, last = models[0] if SHARES else first_pass(rows, models, tables, weight), -np.inf
    for _ in range(rounds):
        [(model, now)] = _round(rows, [model], tables.prior, weight)
        if now - last < gain:
            break
        last = now
    return model


def first_pass(rows: DataFrame, models: list[Model], tables: Tables, weight: float) -> Model:
    """Every model over all ``rows`` (seq, block), part by part: after each, the next one comes of the newest counts of all
    parts so far. The one under which the texts were likeliest when they were last taken."""
    parts = BLOCKS
    while parts > 1 and tables.total < LEAST * parts:
        parts //= 2
    sums: dict[int, np.ndarray] = {}
    for i in range(BLOCKS):
        sums[i % parts] = _sums(rows.where(F.col("block") % parts == i % parts), models)
        total = sum(sums.values())
        models = [model_of(t, tables.prior, weight) for t in total]
    return models[int(np.argmax(total[:, -1, 0]))]


def model_of(t: np.ndarray, prior: np.ndarray, weight: float) -> Model:
    """The next model, of one model's rows of ``_sums``."""
    n = len(prior)
    return normalised(t[n], t[n + 1 : -1], t[:n], prior, weight)


def _round(rows: DataFrame, models: list[Model], prior: np.ndarray, weight: float) -> list[tuple[Model, float]]:
    """One pass of Baum-Welch over all rows (seq), for each model: the next one, and the log10 likelihood of a token under
    the given one."""
    return [(model_of(t, prior, weight), t[-1, 0] / max(1.0, t[: len(prior)].sum())) for t in _sums(rows, models)]


def _sums(rows: DataFrame, models: list[Model]) -> np.ndarray:
    """Expected counts of all rows (seq) under each model: its rows are emissions, starts, moves and (in the first column)
    the log10 likelihood."""
    n, k = models[0].emit.shape
    size = n + 2 + k
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(sent.value), size, k))
        for batch in batches:
            for _, own in _seqs(batch.column(0), 800_000):
                for t, model in zip(total, sent.value, strict=True):
                    s, m, e, likelihood = model.expected_and_likelihood(own)
                    t[:n] += e
                    t[n] += s
                    t[n + 1 : -1] += m
                    t[-1, 0] += likelihood
        total = total.reshape(-1, k)
        at = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(total[at, j]) for j in range(k))], ["row", *(f"s{j}" for j in range(k))])

    made = rows.select("seq").mapInArrow(run, "row int, " + ", ".join(f"s{j} double" for j in range(k)))
    got = made.groupBy("row").agg(*(F.sum(f"s{j}").alias(f"s{j}") for j in range(k))).toPandas()
    sent.unpersist()
    total = np.zeros((len(models) * size, k))
    total[got["row"]] = got[[f"s{j}" for j in range(k)]].to_numpy()
    return total.reshape(len(models), size, k)


class Fitted:
    """A trained model with what turns texts into its classes. ``rows``: class sequences of all rows, a scratch table;
    ``counts``: training counts of all tokens (h, c), of which ``tables`` have those of ``least`` and more."""

    def __init__(self, model: Model, tables: Tables, rows: DataFrame, counts: DataFrame, least: int):
        self.model, self.tables, self.rows, self.counts, self.least = model, tables, rows, counts, least


def fit(
    docs: DataFrame, train: Column, *, states: int = 8, starts: int = 4, emit: int = 8192, known: int = 1 << 19, rounds: int = 3, gain: float = 1e-3,
    weight: float = 0.02, text_col: str = "text", id_col: str = "doc_id",
) -> Fitted:
    """``train``: a boolean column of ``docs``, the rows to learn from."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), train.alias("train"), F.col(text_col).alias("text"))
    counted = own.where("train").select("text").mapInArrow(_count, "h long, c long")
    counts = saved(counted.groupBy("h").agg(F.sum("c").alias("c")), "token-counts")
    tables, least = tables_of(counts, emit, known)
    rows = saved(with_parts(_classes(own, docs.sparkSession.sparkContext.broadcast(tables))), "class-sequences", by="block")
    model = trained(rows.where("train"), tables, states, starts, rounds, weight, gain)
    return Fitted(model, tables, rows, counts, least)


def score(docs: DataFrame, train: Column, **params) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score (smoothed unigram), score: one row per row of
    ``docs``. ``train``: a boolean column of ``docs``, the rows to learn from; other parameters as of ``fit``."""
    return scored(fit(docs, train, **params))


def scored(fitted: Fitted) -> DataFrame:
    """The scores of the rows that ``fitted`` was made from."""
    rows, counts, tables, least = fitted.rows, fitted.counts, fitted.tables, fitted.least
    sent = rows.sparkSession.sparkContext.broadcast(fitted.model)

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0), *(sent.value.log10_likelihood(own) for _, own in _seqs(batch.column(batch.num_columns - 1), 1_000_000))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(out))], [*batch.schema.names[:-1], "path"])

    paths = rows.select("uid", "doc_id", "train", "n_tokens", "n_known", "base", "share", "seq").mapInArrow(
        likelihood, "uid long, doc_id long, train boolean, n_tokens long, n_known long, base double, share double, path double"
    )
    # tokens that the tables lack but training has: counted as unseen above, mended here
    lost = rows.select("uid", F.explode("rare").alias("r")).select("uid", F.col("r.h").alias("h"), F.col("r.n").alias("n"))
    gain = F.col("n") * (F.log10(F.col("c") + 0.5) - F.log10(F.lit(0.5)))
    mended = lost.join(counts.where(F.col("c") < least), "h").groupBy("uid").agg(F.sum("n").alias("more"), F.sum(gain).alias("gain"))
    both = paths.join(mended, "uid", "left").withColumns({"more": F.coalesce("more", F.lit(0).cast("long")), "gain": F.coalesce("gain", F.lit(0.0))})
    return both.select(
        "doc_id", "train", "n_tokens", (F.col("n_known") + F.col("more")).alias("n_known"), F.lit(tables.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("gain")).alias("base_score"), (F.col("path") + F.col("share") + F.col("gain")).alias("score"),
    )
