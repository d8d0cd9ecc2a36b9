"""Bit filters over 64-bit hashes, built by the tasks and merged by ranges of bits.

Each hash sets two slots. `counts` tells of each slot whether any row and whether more than one row set it, so
"both slots were set more than once" holds for every repeated hash, and for few others while the filter is sparse.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: slots in one piece of the filter; offsets inside it fit 16 bits
PIECE = 1 << 16
SLOTS_PER_ROW = 16
#: the largest filter: 64 MiB on the driver and in each Python worker. With more than 2**25 rows it fills up: more rows
#: than need be then count as possible, which costs time and changes no result.
MAX_SLOTS = 1 << 29
_FLUSH = 1 << 21
_MIX = 0x9E3779B97F4A7C15


def slots_for(rows: int, most: int = MAX_SLOTS) -> int:
    return min(most, max(PIECE, 1 << max(rows * SLOTS_PER_ROW - 1, 1).bit_length()))


def _slots(hashes: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    h = hashes.astype(np.int64, copy=False).view(np.uint64)
    shift = np.uint64(64 - (slots.bit_length() - 1))
    return h & np.uint64(slots - 1), (h * np.uint64(_MIX)) >> shift


def _pieces(found: list[np.ndarray]):
    """One row for each piece of the filter that the slots touch."""
    slot, n = np.unique(np.concatenate(found), return_counts=True)
    piece, offset = (slot // PIECE).astype(np.int32), (slot % PIECE).astype(np.uint16)
    cuts = np.flatnonzero(np.diff(piece)) + 1
    rows = [
        (int(p[0]), o[k == 1].tobytes(), o[k > 1].tobytes())
        for p, o, k in zip(np.split(piece, cuts), np.split(offset, cuts), np.split(n, cuts), strict=True)
    ]
    kinds = (pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["piece", "once", "more"]
    )


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    n = np.zeros(PIECE, dtype=np.int64)
    for column, weight in (("once", 1), ("more", 2)):
        for part in rows[column]:
            n[np.frombuffer(part, dtype=np.uint16)] += weight
    packed = [np.packbits(n >= least, bitorder="little").tobytes() for least in (1, 2)]
    return pd.DataFrame({"piece": [int(rows["piece"].iloc[0])], "seen": packed[:1], "again": packed[1:]})


def build(hashes: DataFrame, slots: int, column: str = "seen") -> np.ndarray:
    """The filter over the one bigint column of `hashes`: `seen`, or `again` for slots set by more than one row.

    Null hashes set nothing. What comes to the driver is `slots` / 8 bytes.
    """

    def count(batches):
        found, size = [], 0
        for batch in batches:
            h = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            if len(h):
                found += _slots(h, slots)
                size += 2 * len(h)
            if size > _FLUSH:
                yield _pieces(found)
                found, size = [], 0
        if size:
            yield _pieces(found)

    pieces = hashes.mapInArrow(count, "piece int, once binary, more binary")
    merged = pieces.groupBy("piece").applyInPandas(_merge, "piece int, seen binary, again binary")
    bits = np.zeros(slots // 8, dtype=np.uint8)
    for row in merged.select("piece", column).toLocalIterator():
        bits[row[0] * (PIECE // 8) : (row[0] + 1) * (PIECE // 8)] = np.frombuffer(row[1], dtype=np.uint8)
    return bits


def held_in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each 64-bit hash may be in the filter."""
    a, b = _slots(hashes, len(bits) * 8)
    bit = lambda s: (bits[(s >> np.uint64(3)).astype(np.int64)] >> (s & np.uint64(7)).astype(np.uint8)) & 1
    return (bit(a) & bit(b)).astype(bool)


def probe(df: DataFrame, bits: np.ndarray, col: Column) -> Column:
    """Whether a bigint hash may be in the filter; false for null."""
    held = df.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def may_hold(h: pd.Series) -> pd.Series:
        return pd.Series(held_in(held.value, h.fillna(0).to_numpy(dtype=np.int64)) & h.notna().to_numpy())

    return may_hold(col)
