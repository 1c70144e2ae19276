"""What operators share: texts as bytes, hashed byte n-gram counts of whole texts, and names for columns of their own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Multiplier of Fibonacci hashing.
GOLDEN = np.uint32(2654435769)
#: Bytes of text that a task works on at a time, but for one longer text.
AT_ONCE = 4 << 20


def gram_counts(data: bytes, bits: int, n: int = 3) -> np.ndarray:
    """Counts of ``data``'s byte ``n``-grams (n up to 4) in ``2**bits`` buckets, as float32; all zero if it is shorter."""
    size = 1 << bits
    out = np.zeros(size, np.float32)
    for at in range(0, max(0, len(data) - n + 1), 1 << 18):
        part = np.frombuffer(data[at : at + (1 << 18) + n - 1], np.uint8).astype(np.uint32)
        code = part[: len(part) - n + 1]
        for j in range(1, n):
            code = (code << np.uint32(8)) | part[j : len(part) - n + 1 + j]
        out += np.bincount(((code * GOLDEN) >> np.uint32(32 - bits)).view(np.int32), minlength=size)
    return out


def packed_counts(counts: np.ndarray) -> bytes:
    """The counts that aren't zero, as places and values."""
    at = np.flatnonzero(counts).astype("<u4")
    return at.tobytes() + counts[at].astype("<f4").tobytes()


def unpacked_counts(packed: list[bytes], size: int) -> np.ndarray:
    """Rows of :func:`packed_counts`, dense."""
    out = np.zeros((len(packed), size), np.float32)
    for row, data in zip(out, packed):
        half = len(data) // 2
        row[np.frombuffer(data[:half], "<u4")] = np.frombuffer(data[half:], "<f4")
    return out


def text_blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, ends)`` of the texts of a column, about ``AT_ONCE`` bytes at a time; nulls are empty."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_string()).fill_null("")
    _, offsets, values = column.buffers()
    edges = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(edges, edges[row] + AT_ONCE, "right")) - 1)
        yield row, data[edges[row] : edges[to]], edges[row + 1 : to + 1] - edges[row]
        row = to


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
