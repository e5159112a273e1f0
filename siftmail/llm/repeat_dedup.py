"""Removal of repeated substrings: every byte covered by a ``width``-byte string that also starts anywhere else.

Which strings can be equal. Each window of ``width`` bytes has an anchor: of the GRAM-byte strings in it, the one with
the least hash, the first of equals. Equal windows have equal anchors at equal places. Consecutive windows with one
anchor form a fragment of at most 2 * width - GRAM bytes; fragments are dealt by their anchor's hash, so every window
meets all its equals. (A text's fragments are some 24 bytes of numbers for 85 bytes of text; their bytes stay put.)
1. An anchor that occurs once has no repeated window: its fragment is done.
2. A fragment whose whole content occurs twice is repeated as a whole: one aggregation by content.
3. The other fragments of anchors with several contents: their bytes are fetched, one copy of each content, and the
   contents of an anchor, aligned at it, go through the column-wise construction of their Burrows-Wheeler transform
   and common prefixes (``column_bwt``): a round for each column, a symbol for each content; a window is repeated if
   its suffix shares ``width`` bytes with a neighbour. This is the named method restricted to where it decides and to
   suffixes of equal columns; over whole texts it would need a pass over all text for each byte of the longest one.
4. Anchors with more than ``most`` contents (a passage amid as many different surroundings) are split by content first,
   and steps 2 to 4 repeat on the parts. A part has the windows that begin in one band of columns, and the bytes that
   all windows of the band have in common name its group, so equal windows still meet. Bands grow narrower (SPANS) until
   one is a single window, whose group has one content. So no task gathers more than ``most`` contents of a group, at
   any size, and every group goes the same way.
Texts are then joined with their repeated runs by key and cut.

Null text counts as empty. Texts under ``width`` bytes lose nothing. Repeated rows and equal texts are all removed
from, as the rule says, each giving the same result. Other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .column_bwt import repeated_windows
from .common import drop, saved

GRAM = 32
#: Columns of the bands by which large groups are split, one after the other.
SPANS = (43, 11, 3, 1)
_PIECE = 1_000_000  # bytes of text that are hashed together


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place of a buffer."""
    h = buf.astype(np.uint64) + np.uint64(1)
    step = 1
    while step < GRAM:
        h = _mixed(h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:])
        step *= 2
    return h


def _sliding_first_min(key: np.ndarray, span: int) -> np.ndarray:
    """Least of each ``span`` consecutive keys: least of a block's end and the next block's beginning."""
    n = len(key)
    full = np.append(key, np.full(-n % span + span, ~np.uint64(0))).reshape(-1, span)
    left = np.minimum.accumulate(full, 1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - span + 1], left[span - 1 : n])


def fragments(texts: list[bytes], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For texts of at least ``width`` bytes: number, starts, lengths, places of the anchor, anchor hashes and
    content hashes of the fragments."""
    todo: list[tuple[int, int, bytes]] = []
    size = 0

    def run():
        buf = np.frombuffer(b"".join(x for _, _, x in todo), np.uint8)
        h = gram_hashes(buf)
        where = np.arange(len(h), dtype=np.uint64)
        least = _sliding_first_min((h & ~np.uint64((1 << 24) - 1)) | where, width - GRAM + 1)
        anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        ends = np.cumsum([len(x) for _, _, x in todo])
        text = np.searchsorted(ends, np.arange(len(anchor)), side="right")
        good = np.arange(len(anchor)) + width <= ends[text]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new & good)
        stop = np.append(np.flatnonzero(new)[1:], len(anchor))
        stop = stop[good[np.flatnonzero(new)]]
        stop = np.minimum(stop, ends[text[first]] - width + 1)  # windows [first, stop)
        raw = buf.tobytes()
        content = np.fromiter((xxhash.xxh3_64_intdigest(raw[a : b + width - 1]) for a, b in zip(first.tolist(), stop.tolist(), strict=True)), np.uint64, len(first)).view(np.int64)
        hashes = h[anchor[first]].view(np.int64)
        cuts = np.searchsorted(text[first], np.arange(len(todo) + 1))
        for (number, offset, _), a, b, end, x in zip(todo, cuts[:-1], cuts[1:], ends, (x for _, _, x in todo), strict=True):
            start = first[a:b] - (end - len(x))
            yield number, start + offset, stop[a:b] - first[a:b] + width - 1, anchor[first[a:b]] - first[a:b], hashes[a:b], content[a:b]

    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - width + 1), _PIECE):
            piece = text[at : at + _PIECE + width - 1]
            if len(piece) < width:
                continue
            if todo and size + len(piece) > 1_000_000:
                yield from run()
                todo, size = [], 0
            todo.append((i, at, piece))
            size += len(piece)
    if todo:
        yield from run()


def _key(id_col: Column, text: Column) -> list[Column]:
    return [F.coalesce(id_col.cast("long"), F.lit(-(1 << 63)).cast("long")).alias("id"), F.xxhash64(text).alias("x")]


def _fragments_of(docs: DataFrame, width: int) -> DataFrame:
    """id, x, start, length, place (of the anchor), m (anchor), k (content) of the rows (id, x, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, xs = part.column(0).to_numpy(), part.column(1).to_numpy()
                texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in part.column(2)]
                for number, start, length, place, m, k in fragments(texts, width):
                    n = len(start)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, ids[number])), pa.array(np.full(n, xs[number])), pa.array(start, pa.int64()), pa.array(length.astype(np.int32)), pa.array(place.astype(np.int16)), pa.array(m), pa.array(k)],
                        ["id", "x", "start", "length", "place", "m", "k"],
                    )

    return docs.mapInArrow(_joined(run), "id long, x long, start long, length int, place short, m long, k long")


def _joined(run, rows: int = 20_000):
    """The same task with its small output batches put together."""

    def wrapped(batches):
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return wrapped


def _runs(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of bytes under the windows at the sorted ``starts``."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > width) + 1
    return list(zip(starts[np.append(0, cut)].tolist(), (starts[np.append(cut - 1, len(starts) - 1)] + width).tolist(), strict=True))


def _by_construction(contents: DataFrame, width: int, batch: int) -> DataFrame:
    """g, h, runs (a, b) of repeated bytes of contents (g, h, place, bytes) dealt and sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []

        def solved():
            out: dict[str, list] = {"g": [], "h": [], "a": [], "b": []}
            g = np.array([x[0] for x in held], np.int64)
            groups = np.cumsum(np.append(0, g[1:] != g[:-1]))
            found = repeated_windows([x[3] for x in held], -np.array([x[2] for x in held], np.int64), groups, width)
            for (g, h, _, _), starts in zip(held, found, strict=True):
                for a, b in _runs(starts, width):
                    for c, v in zip(out, (g, h, a, b), strict=True):
                        out[c].append(v)
            return pa.RecordBatch.from_pydict(out, pa.schema([(c, pa.int64()) for c in out]))

        for got in batches:
            for g, h, place, raw in zip(*(got.column(i).to_pylist() for i in range(3)), got.column(3), strict=True):
                if len(held) >= batch and held[-1][0] != g:  # a group's contents stay together
                    yield solved()
                    held = []
                held.append((g, h, place, raw.as_py()))
        if held:
            yield solved()

    dealt = contents.select("g", "h", "place", "bytes").repartition("g").sortWithinPartitions("g", "h")
    return dealt.mapInArrow(run, "g long, h long, a long, b long")


def _parts(rows: DataFrame, width: int, span: int) -> DataFrame:
    """Rows (m, k, at, g, place, bytes) cut by bands of ``span`` columns: one part for each band that has a window."""
    low, high = -F.col("place"), F.octet_length("bytes") - width - F.col("place")  # columns of the first and last window
    begin = F.col("band") * span
    cut = rows.withColumn("band", F.explode(F.sequence(F.floor(low / span).cast("int"), F.floor(high / span).cast("int"))))
    cut = cut.withColumns({"a": F.greatest(low, begin), "b": F.least(high, begin + span - 1), "core": F.expr(f"substring(bytes, band * {span} + {span} + place, {width - span + 1})")})
    part = F.expr(f"substring(bytes, a + place + 1, b - a + {width})")
    return cut.select(
        "m", "k", (F.col("at") + F.col("a") + F.col("place")).alias("at"), F.xxhash64("g", "band", "core").alias("g"), F.xxhash64(part).alias("h"), (-F.col("a")).alias("place"), part.alias("bytes")
    )


def _repeats_of(contents: DataFrame, *, width: int, batch: int, most: int) -> DataFrame:
    """Repeated runs (m, k, a, b) of distinct contents (m, k, n, place, bytes), n the times a content occurs. Those of
    n > 1 are repeated as a whole, which is not told again."""
    rows = contents.select("m", "k", F.lit(0).alias("at"), F.col("m").alias("g"), F.col("k").alias("h"), F.col("place").cast("int").alias("place"), "bytes", "n")
    closed, whole = [], []
    for span in (*SPANS, None):
        groups = saved(rows.groupBy("g").agg(F.count(F.lit(1)).alias("contents"), F.min("n").alias("least")).where("least = 1 AND contents > 1"), "groups")
        closed.append(rows.join(groups.where(F.col("contents") <= most), "g").select("m", "k", "at", "g", "h", "place", "bytes", "n"))
        large = groups.where(F.col("contents") > most)
        if span is None or large.isEmpty():
            break
        parts = saved(_parts(rows.join(large, "g", "left_semi"), width, span), "parts")
        seen = saved(parts.groupBy("g", "h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("m", "k", "at")).alias("one")), "parts-seen")
        again = parts.join(seen.where("n > 1").select("g", "h"), ["g", "h"])
        whole.append(again.select("m", "k", F.col("at").cast("long").alias("a"), (F.col("at") + F.octet_length("bytes")).cast("long").alias("b")))
        first = seen.select("g", "h", "n", F.col("one.m").alias("m"), F.col("one.k").alias("k"), F.col("one.at").alias("at"))
        rows = saved(parts.join(first, ["g", "h", "m", "k", "at"]), "parts")
    ready = functools.reduce(DataFrame.unionByName, closed)
    found = _by_construction(ready, width, batch).join(ready.where("n = 1").select("g", "h", "m", "k", "at"), ["g", "h"])
    told = found.select("m", "k", (F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b")).alias("b"))
    return functools.reduce(DataFrame.unionByName, whole, told)


def repeated_runs(docs: DataFrame, *, width: int, batch: int, most: int) -> tuple[DataFrame, DataFrame]:
    """From rows (id, x, text): repeated runs (id, x, a, b), not merged, and the texts (id, x, text) that may have any."""
    frags = saved(_fragments_of(docs, width), "fragments")
    anchors = saved(frags.groupBy("m").agg(F.count(F.lit(1)).alias("n"), (F.min("k") != F.max("k")).alias("several")).where("n > 1").select("m", "several"), "anchors")
    maybe = saved(frags.join(anchors, "m"), "candidates")
    drop(frags, anchors)
    contents = saved(
        maybe.groupBy("m", "k").agg(F.count(F.lit(1)).alias("n"), F.first("several").alias("several"), F.min(F.struct("id", "x", "start")).alias("at"), F.min("length").alias("length"), F.min("place").alias("place")), "contents"
    )
    groups = saved(contents.where("several").groupBy("m").agg(F.min("n").alias("least")).where("least = 1").select("m"), "groups")
    texts = saved(docs.join(maybe.select("id", "x").distinct(), ["id", "x"], "left_semi").dropDuplicates(["id", "x"]), "texts")

    open_ = contents.join(groups, "m").select("m", "k", "n", F.col("at.id").alias("id"), F.col("at.x").alias("x"), F.col("at.start").alias("start"), "length", "place")
    raw = F.expr("substring(cast(text AS binary), int(start + 1), length)")
    fetched = saved(open_.join(texts, ["id", "x"]).select("m", "k", "n", "place", raw.alias("bytes")), "contents-bytes")
    whole = contents.where("n > 1").select("m", "k", F.lit(0).cast("long").alias("a"), F.col("length").cast("long").alias("b"))
    marks = saved(whole.unionByName(_repeats_of(fetched, width=width, batch=batch, most=most)), "marks")
    runs = maybe.join(marks, ["m", "k"]).select("id", "x", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))
    return runs, texts


def remove_repeats(
    docs: DataFrame, *, width: int = 200, batch: int = 2000, most: int = 256, text_col: str = "text", id_col: str = "doc_id",
) -> DataFrame:
    """One row per text that loses anything: id and x (its key: ``text_key``), n_bytes, n_removed, n_spans, spans (start,
    end), kept (the remaining bytes) and kept_text (the characters that kept all their bytes)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*_key(F.col(id_col), text), text.alias("text"))
    runs, texts = repeated_runs(rows, width=width, batch=batch, most=most)
    gathered = runs.groupBy("id", "x").agg(F.collect_list(F.struct("a", "b")).alias("runs"))  # of one text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_text")}
            for text, own in zip(batch.column(2), batch.column(3), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                a, b = np.asarray(own.values.field(0)), np.asarray(own.values.field(1))
                edge = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edge, a, 1)
                np.add.at(edge, b, -1)
                gone = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(int(gone.sum()))
                out["n_spans"].append(len(turn) // 2)
                out["spans"].append([{"start": int(s), "end": int(e)} for s, e in turn.reshape(-1, 2)])
                data = np.frombuffer(raw, np.uint8)
                out["kept"].append(data[~gone].tobytes())
                begins = (data & 0xC0) != 0x80
                whole = ~np.logical_or.reduceat(gone, np.flatnonzero(begins))
                out["kept_text"].append(data[whole[np.cumsum(begins) - 1]].tobytes().decode("utf-8", "ignore"))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), span, pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], ["id", "x", *out])

    return texts.join(gathered, ["id", "x"]).select("id", "x", "text", "runs").mapInArrow(
        cut, "id long, x long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary, kept_text string"
    )


def text_key(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> list[Column]:
    """Columns id and x that name a row's text in ``remove_repeats``."""
    return _key(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
