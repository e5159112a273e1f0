"""Media columns: binary payloads as FLAC, and FLAC columns as PCM blocks with seekable sample offsets (see ``flac``).

Both steps are scans without a shuffle; a task holds a few MB of streams at a time, or one longer stream. Null
payloads give null media; an empty payload can't be stored and gives null media too (callers pad). A broken stream
gives null blocks and its fault in ``error``; the job goes on. Repeated rows are stored each, equal payloads alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from . import flac

BLOCKS = ArrayType(StructType([StructField("sample_offset", LongType()), StructField("n_samples", LongType()), StructField("pcm", BinaryType())]))
DECODED = [("rate", IntegerType()), ("channels", IntegerType()), ("bits", IntegerType()), ("blocks", BLOCKS), ("feature", StringType()), ("error", StringType())]
_ARROW = {
    "rate": pa.int32(), "channels": pa.int32(), "bits": pa.int32(),
    "blocks": pa.list_(pa.struct([("sample_offset", pa.int64()), ("n_samples", pa.int64()), ("pcm", pa.binary())])),
    "feature": pa.string(), "error": pa.string(),
}


def _small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def with_flac(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """``df`` with the column ``payload`` replaced by ``media``: its bytes as 8-bit FLAC."""
    fields = [f for f in df.schema.fields if f.name != payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            data = batch.column(payload).to_pylist()
            out: list = [None] * len(data)
            some = [i for i, x in enumerate(data) if x]
            for own in flac.batches_of([data[i] for i in some]):
                for i, x in zip(own, flac.encode([data[some[i]] for i in own]), strict=True):
                    out[some[i]] = x
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(out, pa.binary())], [*(f.name for f in fields), media])

    return df.mapInArrow(run, StructType([*fields, StructField(media, BinaryType())]))


def _unsigned(x: np.ndarray, bits: int) -> bytes:
    """PCM as in a WAV file: up to 8 bits unsigned, else signed little-endian."""
    return (x.T.reshape(-1) + 128).astype(np.uint8).tobytes() if bits <= 8 else flac.pcm(x, bits)


def _feature(frames: list[np.ndarray]) -> str:
    """Whole numbers of the first channel: frames, samples, lowest, highest, sum, sum of squares, changes of sign."""
    x = np.concatenate([f[0] for f in frames]) if frames else np.zeros(0, np.int32)
    if not len(x):
        return "frames=0;samples=0"
    cross = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    energy = sum(int((f[0].astype(np.int64) ** 2).sum()) for f in frames)
    return f"frames={len(frames)};samples={len(x)};min={x.min()};max={x.max()};sum={x.sum(dtype=np.int64)};energy={energy};crossings={cross}"


def _row(s: flac.Stream, frames: list[np.ndarray]) -> dict:
    blocks = [{"sample_offset": f.first_sample, "n_samples": f.n, "pcm": _unsigned(x, s.bits)} for f, x in zip(s.frames, frames, strict=True)]
    return {"rate": s.rate, "channels": s.channels, "bits": s.bits, "blocks": blocks, "feature": _feature(frames), "error": None}


def _decoded(streams: list[bytes]) -> list[dict]:
    try:
        return [_row(s, frames) for s, frames in flac.decode(streams)]
    except (flac.Broken, IndexError, ValueError) as e:
        if len(streams) == 1:
            return [dict.fromkeys(_ARROW) | {"error": str(e) or type(e).__name__}]
    return [_decoded([x])[0] for x in streams]  # one of them is broken: each alone


def with_pcm(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with rate, channels, bits, blocks (sample_offset, n_samples, pcm), feature and error of its FLAC column;
    columns of ``df`` with these names are replaced."""
    fields = [f for f in df.schema.fields if f.name not in _ARROW]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            data = batch.column(media).to_pylist()
            out: list[dict] = [dict.fromkeys(_ARROW)] * len(data)
            some = [i for i, x in enumerate(data) if x is not None]
            for own in flac.batches_of([data[i] for i in some]):
                for i, x in zip(own, _decoded([data[some[i]] for i in own]), strict=True):
                    out[some[i]] = x
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), *(pa.array([r[c] for r in out], t) for c, t in _ARROW.items())], [*(f.name for f in fields), *_ARROW])

    return df.mapInArrow(run, StructType([*fields, *(StructField(c, t) for c, t in DECODED)]))
