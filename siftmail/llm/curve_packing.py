"""Packing along a space-filling curve: hashed document vectors, projected to few dimensions, ordered by Hilbert key,
and cut into sequences of a fixed number of tokens.

1. Each text is tokenised once; its ids, with the end id after them, go to a scratch table. Its vector is the square
   root of the counts of its hashed ids, of length 1; a fixed random projection takes it to ``dims`` numbers, each
   mapped through the normal distribution to ``bits`` bits; the Hilbert index of that cell is its key. No statistic of
   the corpus enters, so a document has the same key in any run.
2. Only (row, key, number of tokens) are range-sorted, by key, id and row: equal keys, as of copies, are dealt over
   ranges by the rest. Running sums within a range, and the sums of the ranges before it (one number a range), give
   each document its place in one long stream of tokens.
3. The stream is cut every ``length`` tokens; a document lies in as many pieces as it crosses cuts. Only the last
   sequence is not full, so padding is less than one sequence for the whole corpus.

Null text counts as empty: it is the end id alone. Repeated rows are packed each. Other columns are ignored. An
empty table gives no pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, segments

HASHED = 4096


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of ``cells`` (n x dims, each below 2**bits), by Skilling's transform to the transposed
    index, whose bits are then interleaved."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[dims - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def projection(dims: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((HASHED, dims))


def curve_keys(ids: list[np.ndarray], proj: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of documents given by their ids."""
    if not ids:
        return np.zeros(0, np.int64)
    at = np.empty((len(ids), proj.shape[1]))
    for k, x in enumerate(ids):
        n = np.bincount(((x.astype(np.uint64) * np.uint64(2654435761)) >> np.uint64(7)) % np.uint64(HASHED))
        hit = np.flatnonzero(n)
        w = np.sqrt(n[hit])
        at[k] = (w @ proj[hit]) / max(1e-9, math.sqrt(float(w @ w)))
    erf = np.vectorize(math.erf)
    cells = np.clip((0.5 * (1 + erf(at / math.sqrt(2))) * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1)
    return hilbert(cells, bits)


def _ids(e: tiktoken.Encoding, text: str, end_id: int, kind: str) -> np.ndarray:
    return np.concatenate([*(np.array(e.encode_ordinary(s), kind) for s in segments(text)), np.array([end_id], kind)])


def tokenised(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, end_id: int, dims: int, bits: int, text_col: str, id_col: str) -> DataFrame:
    """doc_id, key, n, ids (little-endian, 16 bits each if the vocabulary allows, else 32)."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = "<u2" if max([end_id, *ranks.values()]) < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=sent.value, special_tokens={})
        proj = projection(dims)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [_ids(e, t.as_py() or "", end_id, kind) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(curve_keys(ids, proj, bits)), pa.array([len(x) for x in ids], pa.int64()), pa.array((x.tobytes() for x in ids), pa.binary())],
                    ["doc_id", "key", "n", "ids"],
                )

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "doc_id long, key long, n long, ids binary")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """uid, part, before (tokens before the row in its range) of a sorted range; batches are passed on as they come."""
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(1).to_numpy()
        sums = np.cumsum(n) + before
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part, np.int64)), pa.array(sums - n), batch.column(1)], ["uid", "part", "before", "n"])
        before = int(sums[-1]) if len(n) else before


def pack(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, end_id: int = 0, length: int = 1024, dims: int = 3, bits: int = 10, text_col: str = "text", id_col: str = "doc_id",
) -> DataFrame:
    """One row per piece: doc_id, start (its document's ids before it), length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset (in the sequence). Sequences are numbered along the curve; all but the last are full."""
    made = tokenised(docs, ranks, pattern, end_id=end_id, dims=dims, bits=bits, text_col=text_col, id_col=id_col)
    tokens = saved(made.withColumn("uid", F.monotonically_increasing_id()), "tokens")
    order = ["key", "doc_id", "uid"]
    ranged = tokens.select("uid", "n", *order[:2]).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = saved(ranged.select("uid", "n").mapInArrow(_running, "uid long, part long, before long, n long"), "places")
    # one row a range: as many as shuffle partitions
    totals = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    base, at = [], 0
    for part in sorted(totals):
        base.append((part, at))
        at += totals[part]
    spark = docs.sparkSession
    bases = spark.createDataFrame(base, "part long, base long")
    places = placed.join(F.broadcast(bases), "part").select("uid", (F.col("base") + F.col("before")).alias("place"))
    kind = "<u2" if max([end_id, *ranks.values()]) < 1 << 16 else "<u4"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            for doc_id, place, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = np.frombuffer(raw.as_py(), kind).astype("<u4")
                a = 0
                while a < len(ids):
                    b = min(len(ids), a + length - (place + a) % length)
                    for c, v in zip(out, (doc_id, a, b - a, ids[a:b].tobytes(), len(ids), (place + a) // length, (place + a) % length), strict=True):
                        out[c].append(v)
                    a = b
                if len(out["doc_id"]) > 4000:
                    yield pa.RecordBatch.from_pydict(out, PIECES)
                    out = {c: [] for c in out}
            if out["doc_id"]:
                yield pa.RecordBatch.from_pydict(out, PIECES)

    return tokens.select("uid", "doc_id", "ids").join(places, "uid").select("doc_id", "place", "ids").mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
