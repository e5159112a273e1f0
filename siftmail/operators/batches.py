"""Arrow batches in pieces of bounded size: what a message grows to in Python is held for a piece, not for a batch, whose
ten thousand rows may be anything long."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What a piece holds at most: values, and bytes of these (a longer value is a piece of its own).
ROWS, BYTES = 256, 2 << 20


def pieces(values: pa.Array) -> Iterator[pa.Array]:
    """``values`` (strings or bytes) in order, without a copy, in pieces of ``ROWS`` and ``BYTES`` at most."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(values):
        held = ends[at - 1] if at else 0
        end = max(at + 1, min(at + ROWS, int(np.searchsorted(ends, held + BYTES, side="right"))))
        yield values.slice(at, end - at)
        at = end
