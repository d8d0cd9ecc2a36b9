"""Words of a text, over its UTF-8 bytes.

Both word rules exclude ASCII characters only, so cutting the bytes and cutting the characters give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: bytes of text that a task works on, and hands back, at a time
PART_BYTES = 1 << 20

#: ASCII letters lower-cased; every byte outside 0-9, A-Z, a-z and the non-ASCII ones becomes a space
ALNUM_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def spaced_words(data: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`."""
    return data.split()


def alnum_words(data: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z."""
    return data.translate(ALNUM_TABLE).split()


def text_bytes(col: str | Column) -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.cast("string"), F.lit("")).cast("binary")


def string_bytes(scalar) -> bytes:
    """The UTF-8 bytes of an Arrow string; null counts as empty."""
    return scalar.as_buffer().to_pybytes() if scalar.is_valid else b""


def slices(batch: pa.RecordBatch, text_at: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows in slices of at most `most` bytes of text, or one row: what is made of the texts is never held for a whole
    batch, which has as many rows as the session says, however long."""
    most = PART_BYTES if most is None else most
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = done = 0
    while start < batch.num_rows:
        stop = max(int(np.searchsorted(ends, done + most, "right")), start + 1)
        yield batch.slice(start, stop - start)
        start, done = stop, int(ends[stop - 1])


def merged(spans) -> list[tuple[int, int]]:
    """Sorted, disjoint spans that cover the same positions; ends are exclusive."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out
