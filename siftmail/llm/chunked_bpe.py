"""Byte-level BPE of whole texts by overlapping chunks, and its inverse.

A text longer than ``chunk`` characters is cut into chunks that overlap by ``overlap`` characters, dealt over all
tasks. Each chunk is pre-tokenised from its own start, which may lie inside a pre-token. Where a boundary of a chunk's
pre-tokens is also one of its predecessor's, both go on alike: the pattern looks only forward. The first such place
in the overlap (after a character that isn't blank, so that no look-ahead reaches over it) is where the two are stitched;
the pieces between stitches are encoded in parallel and a text's ids concatenated in order. A text in which two
neighbours never meet in an overlap (say, a word longer than it) is encoded in one piece. Shorter texts are one piece.

Decoding concatenates the bytes of the ids; a text's UTF-8 bytes come back exactly.

Null text counts as empty: no ids. Repeated rows are encoded each. Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved


def ranks_from_tiktoken(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def ranks_from_json(path: str) -> dict[bytes, int]:
    """Ranks of a byte-level BPE in the json form of ``tokenizers``, whose ids are ranks; special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"] for t in spec["added_tokens"]}
    return {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}


def encoder(ranks: dict[bytes, int], pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def boundaries(text: str, pattern: regex.Pattern, first: int, last: int) -> list[int]:
    """Starts of pre-tokens in [first, last), after a character that isn't blank; the text is pre-tokenised from its start."""
    return [m.start() for m in pattern.finditer(text) if first <= m.start() < last and m.start() and not text[m.start() - 1].isspace()]


def _zones(texts: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """uid, k, text, left, right (boundaries in the overlap with the chunk before and after, from the text's start)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = regex.compile(pattern)
        for batch in batches:
            left, right = [], []
            for k, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                at = boundaries(text.as_py(), p, 0, chunk + overlap)
                left.append([k * chunk + x for x in at if x < overlap])
                right.append([k * chunk + x for x in at if x >= chunk])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(left, pa.list_(pa.int64())), pa.array(right, pa.list_(pa.int64()))], ["uid", "k", "text", "left", "right"])

    n = F.ceil(F.greatest(F.length("text") - overlap, F.lit(1)) / chunk)
    chunks = texts.select("uid", "text", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k"))
    chunks = chunks.select("uid", "k", F.substring("text", (F.col("k") * chunk + 1).cast("int"), F.lit(chunk + overlap)).alias("text"))
    return chunks.repartition("uid", "k").mapInArrow(find, "uid long, k long, text string, left array<long>, right array<long>")


def _encoded(rows: DataFrame, ranks, pattern: str, keys: str) -> DataFrame:
    """``keys`` and ids (little-endian unsigned 32-bit) of rows (keys, text)."""
    sent = rows.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(sent.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = pa.array((np.array(e.encode_ordinary(t.as_py() or ""), "<u4").tobytes() for t in part.column(part.num_columns - 1)), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], [*part.schema.names[:-1], "ids"])

    return rows.mapInArrow(run, f"{keys}, ids binary")


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, chunk: int = 32_768, overlap: int = 2_048, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit), one row per row of ``docs``. ``ranks`` is a tokenizer's
    vocabulary, of fixed size."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    short = _encoded(own.where(F.length("text") <= chunk + overlap), ranks, pattern, "doc_id long")
    long = saved(own.where(F.length("text") > chunk + overlap).withColumn("uid", F.monotonically_increasing_id()), "long-texts")

    order = Window.partitionBy("uid").orderBy("k")
    met = F.array_min(F.array_intersect(F.lag("right").over(order), F.col("left")))
    stitched = _zones(long, pattern, chunk, overlap).select("uid", "k", "text", F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(met).alias("begin"))
    stitched = stitched.select(
        "uid", "k", "text", "begin", F.lead("begin").over(order).alias("end"),
        F.max(F.col("begin").isNull()).over(Window.partitionBy("uid")).alias("lost"),
    )
    cut = F.expr(f"substring(text, int(begin - k * {chunk} + 1), int(coalesce(end, k * {chunk} + length(text)) - begin))")
    pieces = stitched.where("NOT lost").select("uid", "k", cut.alias("text"))
    whole = long.join(stitched.where("lost AND k = 0").select("uid"), "uid", "left_semi").select("uid", F.lit(0).cast("long").alias("k"), "text")
    parts = _encoded(pieces.unionByName(whole), ranks, pattern, "uid long, k long")
    # ids of one text only: no longer than the text
    joined = parts.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("p"))
    joined = joined.select("uid", F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")).alias("ids"))
    return short.unionByName(long.select("uid", "doc_id").join(joined, "uid").select("doc_id", "ids"))


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The rows of ``encoded`` with ``decoded``: the concatenated bytes of their ids."""
    sent = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {i: b for b, i in sent.value.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = pa.array((b"".join(map(bytes_of.__getitem__, np.frombuffer(x.as_py(), "<u4").tolist())) for x in part.column("ids")), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, out], [*part.schema.names, "decoded"])

    from pyspark.sql.types import BinaryType, StructField, StructType

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", BinaryType())]))
