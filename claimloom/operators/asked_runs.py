"""Texts that hold asked strings, met by the runs of characters that the strings begin with.

A string stands for its first run of one of ``LENGTHS``, the longest that it has. A bitmap
of fixed size, the only thing that the driver holds, marks the runs that are asked for;
each text gives the marked runs that it holds and no others, so what moves grows with
the runs that are asked for and found, not with the characters of all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a run.
LENGTHS = (*range(1, 17), 24, 32, 48, 64, 96, 128, 192, 256)
#: Bits of the bitmap, as a power of two, of which a run takes two; of one row of it; characters that are hashed at a time.
BITS, ROW_BITS, BLOCK = 25, 15, 1 << 20
_BASE, _MIXER = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def first_run(text: Column) -> Column:
    """The run that stands for a text of one character or more."""
    return F.substring(text, F.lit(1), F.array_max(F.filter(F.array(*map(F.lit, LENGTHS)), lambda k: k <= F.char_length(text))))


class _Hashed:
    """Hashes of all runs of some texts, apart by a number that goes with each."""

    def __init__(self, texts: list[str], apart: np.ndarray):
        self.all = "".join(texts)
        points = np.frombuffer(self.all.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        n, sizes = len(points), np.array([len(t) for t in texts], np.int64)
        self.whose = np.repeat(np.arange(len(texts)), sizes)
        self.left = np.cumsum(sizes)[self.whose] - np.arange(n)
        self.apart = apart.view(np.uint64)[self.whose]
        powers, back = (np.cumprod(np.append(np.uint64(1), np.full(max(0, n - 1), x, np.uint64)))[:n] for x in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))))
        self.sums, self.back = np.append(np.uint64(0), np.cumsum(points * powers)), back

    def of(self, length: int) -> np.ndarray:
        """The hash of the run that begins at each character, some of which end in the next text."""
        h = (self.sums[length:] - self.sums[:-length]) * self.back[: max(0, len(self.back) - length + 1)]
        h ^= self.apart[: len(h)] + np.uint64(length)
        for _ in range(2):
            h ^= h >> np.uint64(32)
            h *= np.uint64(_MIXER)
        return h ^ (h >> np.uint64(32))


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    return (h >> np.uint64(64 - BITS)).astype(np.int64), (h & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _marked(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _blocks(texts: list[str | None]) -> Iterator[slice]:
    """Texts of about ``BLOCK`` characters at a time."""
    from_ = held = 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= BLOCK:
            yield slice(from_, k + 1)
            from_, held = k + 1, 0
    if from_ < len(texts):
        yield slice(from_, len(texts))


def runs_in(texts: list[str | None], apart: np.ndarray, lengths: list[int], marks: np.ndarray) -> Iterator[tuple[int, list[str]]]:
    """Each text's place and the distinct marked runs of ``lengths`` that it holds."""
    for some in _blocks(texts):
        h = _Hashed([t or "" for t in texts[some]], apart[some])
        found: dict[int, list[str]] = {}
        for length in lengths:
            if length > len(h.all):
                continue
            own = h.of(length)
            first, second = _places(own)
            at = np.flatnonzero(_marked(marks, first) & (h.left[: len(own)] >= length))
            at = at[_marked(marks, second[at])]
            # one of equal ones of a text
            order = np.lexsort((own[at], h.whose[at]))
            at = at[order]
            once = np.append(True, (np.diff(h.whose[at]) != 0) | (own[at][1:] != own[at][:-1]))[: len(at)]
            for k in at[once].tolist():
                found.setdefault(int(h.whose[k]), []).append(h.all[k : k + length])
        yield from ((some.start + k, runs) for k, runs in found.items())


def marked_runs(asked: DataFrame, on: str) -> tuple[list[int], np.ndarray]:
    """The lengths of the runs of ``asked`` (``on``, run), and the bitmap that marks them; at most 4 MB reach the driver."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, apart = batch.column(1).to_pylist(), batch.column(0).to_numpy(zero_copy_only=False)
            for some in _blocks(runs):
                h, sizes = _Hashed(runs[some], apart[some]), np.array([len(r) for r in runs[some]], np.int64)
                starts = np.cumsum(sizes) - sizes
                own = np.concatenate([h.of(n)[starts[sizes == n]] for n in np.unique(sizes).tolist()])
                at = np.unique(np.concatenate(_places(own)))
                yield pa.RecordBatch.from_arrays([pa.array(at >> ROW_BITS), pa.array(at & ((1 << ROW_BITS) - 1))], ["row", "at"])

    lengths = sorted(r[0] for r in asked.select(F.char_length("run")).distinct().collect())
    rows = asked.select(F.xxhash64(on).alias("apart"), "run").mapInArrow(bits, "row long, at long").groupBy("row").agg(F.bitmap_construct_agg("at").alias("bits"))
    marks = np.zeros((1 << (BITS - ROW_BITS), 1 << (ROW_BITS - 3)), np.uint8)
    for row, held in rows.collect():
        marks[row] = np.frombuffer(held, np.uint8)
    return lengths, marks.reshape(-1)


def asked_runs(texts: DataFrame, text: str, on: str, asked: DataFrame) -> DataFrame:
    """``texts`` without ``text``, a row for each distinct run that the text holds and that ``asked`` (``on``, run) may have; joining the two leaves those that it has."""
    lengths, marks = marked_runs(asked, on)
    told = texts.sparkSession.sparkContext.broadcast(marks)
    others = [c for c in texts.columns if c != text]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whose, held = [], []
            for k, some in runs_in(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False), lengths, told.value):
                whose += [k] * len(some)
                held += some
            if whose:
                rest = pa.Table.from_batches([batch.select(others)]).take(pa.array(whose))
                for part in rest.append_column("run", pa.array(held, pa.string())).to_batches():
                    yield part

    kinds = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in others)
    return texts.select(text, F.xxhash64(on).alias("apart_"), *others).mapInArrow(runs, f"{kinds}, run string")
