"""Filters of bounded size that tell most rows that aren't needed from those that are, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Most bits of a filter: 16 MB. Beyond, it lets more through and no result changes.
MOST_BITS = 1 << 27
SLICES = 512


def gathered(parts: DataFrame, join: Callable[[pd.DataFrame], pd.DataFrame], size: int) -> np.ndarray:
    """A table of `size` bytes from slices (slice, counts) of every task; `join` makes one (slice, ranks) of those of one number."""
    out = np.zeros(size, dtype=np.uint8)
    for r in parts.groupBy("slice").applyInPandas(lambda part: join(part), "slice int, ranks binary").collect():
        out[r["slice"] * (size // SLICES) :][: size // SLICES] = np.frombuffer(r["ranks"], dtype=np.uint8)
    return out


def _slots(digests: list[bytes], bits: int) -> list[np.ndarray]:
    halves = np.frombuffer(b"".join(digests), dtype=np.uint64).reshape(-1, 2)
    return [(halves[:, i] & np.uint64(bits - 1)).astype(np.int64) for i in (0, 1)]


def _marked(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    marks = np.zeros(bits // 8, dtype=np.uint8)
    for batch in batches:
        for at in _slots(batch.column(0).to_pylist(), bits):
            np.bitwise_or.at(marks, at >> 3, (1 << (at & 7)).astype(np.uint8))
    for i, x in enumerate(marks.reshape(SLICES, -1)):
        if x.any():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["slice", "counts"])


def _united(part: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"slice": part["slice"][:1], "ranks": [np.bitwise_or.reduce([np.frombuffer(x, dtype=np.uint8) for x in part["counts"]]).tobytes()]})


def filter_of(digests: DataFrame) -> np.ndarray:
    """The filter of a column of digests of 16 bytes."""
    bits = min(MOST_BITS, 1 << max(16, (16 * digests.count()).bit_length()))
    return gathered(digests.mapInArrow(partial(_marked, bits), "slice int, counts binary"), _united, bits // 8)


def may_hold(marks: np.ndarray, digests: list[bytes]) -> np.ndarray:
    """For each digest whether the filter may have it; one that was put in always passes."""
    ok = np.ones(len(digests), bool)
    for at in _slots(digests, len(marks) * 8):
        ok &= (marks[at >> 3] >> (at & 7).astype(np.uint8) & 1) == 1
    return ok
