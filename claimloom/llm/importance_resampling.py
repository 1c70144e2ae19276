"""Resampling of documents towards a target distribution, by hashed n-gram importance.

Features are all runs of one to three consecutive words. A first pass over the
documents and one over the target texts count features a bucket: each task adds its
batches' ``np.bincount`` vectors, and ``treeReduce`` merges the tasks' vectors. A
bucket's gain is the logarithm of how much likelier it is in the target. A second pass
gathers the broadcast gains (one vector of ``buckets`` numbers) and sums them a
document by ``np.bincount`` with weights. With a Gumbel draw added, the highest scores
are a sample without replacement in proportion to the documents' importance.

Texts are read as Arrow buffers: a word is a stretch of bytes, and the CRC of a run
follows from those of its words, as a CRC is linear, so nothing runs a word at a time.

Ranks are places in one order of all eligible documents: ranges of it are sorted and
written, counted, and each range starts where those before it end.

Defined results: a null text has no words, weight 0 and isn't eligible; a null id
draws as an empty one and is last among ties. Repeated rows are scored alike, and each
takes a rank of its own. Without target texts all counts of the target are 0. An empty
table stays empty. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.features import text_blocks
from claimloom.plans.staging import stage

BUCKETS = 10_000
#: Words up to so many bytes are hashed side by side, longer ones each by itself.
SHORT = 40
DRAWN = "doc_id long, n_features long, weight long, score long, eligible boolean"


def _word_bytes() -> np.ndarray:
    """What each byte becomes: 0 between words, A-Z in lower case, else itself."""
    out = np.zeros(256, np.uint8)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        out[low : high + 1] = np.arange(low, high + 1)
    out[0x41:0x5B] = out[0x61:0x7B]
    return out


def _crc_steps() -> np.ndarray:
    """What the CRC's lowest byte becomes as eight bits leave it."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> np.uint32(1)) ^ np.where(out & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return out


def _shift_tables(bits: int = 31) -> np.ndarray:
    """``[k, byte, value]``: what ``2**k`` zero bytes make of a CRC's byte; the parts of its four bytes are added by xor."""
    out = np.zeros((bits, 4, 256), np.uint32)
    for byte in range(4):
        state = np.arange(256, dtype=np.uint32) << np.uint32(8 * byte)
        out[0, byte] = STEPS[state & 255] ^ (state >> np.uint32(8))
    for k in range(1, bits):
        for byte in range(4):
            out[k, byte] = _apply(out[k - 1], out[k - 1, byte])
    return out


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0, crc & 255] ^ table[1, (crc >> np.uint32(8)) & 255] ^ table[2, (crc >> np.uint32(16)) & 255] ^ table[3, crc >> np.uint32(24)]


WORD_BYTES = _word_bytes()
STEPS = _crc_steps()
SHIFTS = _shift_tables()


def crc_before(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What CRCs add to that of ``lengths`` bytes after them: the CRC of a joined text is this xor the second part's."""
    out, most = crc.copy(), int(lengths.max(initial=0))
    for k in range(most.bit_length()):
        rows = np.flatnonzero(lengths >> k & 1)
        out[rows] = _apply(SHIFTS[k], out[rows])
    return out


def word_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC-32 of each word of ``data``."""
    order = np.argsort(-lengths, kind="stable")
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    begins, sizes = starts[order], lengths[order]
    long = int(np.count_nonzero(sizes > SHORT))
    # the words still running at byte j are the first ones of this order
    running = np.searchsorted(-sizes, -np.arange(SHORT), "left")
    for j in range(SHORT):
        if running[j] == long:
            break
        rows = slice(long, running[j])
        state[rows] = STEPS[(state[rows] ^ data[begins[rows] + j]) & 255] ^ (state[rows] >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        state[i] = zlib.crc32(data[begins[i] : begins[i] + sizes[i]])
    out = np.empty_like(state)
    out[order] = state
    return out


def features(data: np.ndarray, ends: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, bucket, words)``: each feature's text and bucket, and how many words each text has; ``data`` are the texts' bytes, ``ends`` where each ends."""
    data = WORD_BYTES[data]
    is_word = data > 0
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    at_text = begin[begin < len(data)]
    first[at_text] = is_word[at_text]
    starts = np.flatnonzero(first)
    # a word ends where the next byte is none, or begins a text
    last = is_word.copy()
    last[:-1] &= ~is_word[1:] | first[1:]
    lengths = np.flatnonzero(last) + 1 - starts
    text = np.searchsorted(ends, starts, "right")
    words = np.bincount(text, minlength=len(ends))
    one = word_crcs(data, starts, lengths)
    spaced = crc_before(np.full(len(one), zlib.crc32(b" "), np.uint32), lengths) ^ one
    found, run = [(text, one)], one
    for n in (2, 3):
        if len(text) < n:
            break
        run = crc_before(run[:-1], lengths[n - 1 :] + 1) ^ spaced[n - 1 :]
        same = text[n - 1 :] == text[: len(text) - n + 1]
        found.append((text[n - 1 :][same], run[same]))
    return np.concatenate([t for t, _ in found]), (np.concatenate([c for _, c in found]) % np.uint32(buckets)).astype(np.int64), words


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all ``texts`` fall into each bucket: one vector a task, merged as a tree."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, ends in text_blocks(batch.column(0)):
                total += np.bincount(features(data, ends, buckets)[1], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = texts.select(text_col).mapInArrow(count, "counts binary").rdd
    if not vectors.getNumPartitions():
        return np.zeros(buckets, np.int64)
    return vectors.map(lambda row: np.frombuffer(row.counts, np.int64)).treeReduce(np.add)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain, in thousandths, rounded down."""
    buckets, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    """A document's draw, in thousandths, rounded down; it depends on its id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = 42, min_words: int = 20) -> DataFrame:
    """``(doc_id, n_features, weight, score, eligible)`` of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    names = [c.split()[0] for c in DRAWN.split(", ")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            n, weight, words = (np.zeros(len(ids), np.int64) for _ in range(3))
            for row, data, ends in text_blocks(batch.column(1)):
                text, bucket, has = features(data, ends, len(gain))
                rows = slice(row, row + len(ends))
                n[rows] = np.bincount(text, minlength=len(ends))
                # sums of whole numbers are exact in doubles below 2**53
                weight[rows] = np.bincount(text, weights=gain[bucket], minlength=len(ends)).astype(np.int64)
                words[rows] = has
            drawn = weight + np.array([gumbel(i, seed) for i in ids], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n), pa.array(weight), pa.array(drawn), pa.array(words >= min_words)], names)

    return docs.select("doc_id", "text").mapInArrow(score, DRAWN)


def resampled(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), seed: int = 42, min_words: int = 20, buckets: int = BUCKETS) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every row of ``docs``.

    ``share`` (a fraction, rounded down) of the documents of at least ``min_words`` words
    are drawn: those of the highest scores, ranked from 1, ties by id; other ranks are null.
    """
    gain = gains(bucket_counts(docs, buckets=buckets), bucket_counts(target, buckets=buckets))
    rows = stage(scored(docs, gain, seed, min_words).withColumn("place", F.monotonically_increasing_id()), "scored").df
    order = [F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place")]
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # an id of Spark's own counts rows within a partition in its low 33 bits
    at = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = stage(placed.withColumn("range", F.shiftright(at, 33)).withColumn("at", at.bitwiseAND((1 << 33) - 1)), "ranked").df
    # one row a range
    sizes = sorted((r["range"], r["n"], r["m"]) for r in placed.groupBy("range").agg(F.count("*").alias("n"), F.count_if("eligible").alias("m")).collect())
    starts = dict(zip([s[0] for s in sizes], accumulate([s[1] for s in sizes], initial=0)))
    drawn = sum(s[2] for s in sizes) * share[0] // share[1]
    start = F.get(F.lit([starts.get(i, 0) for i in range(max(starts) + 1)]), F.col("range")) if starts else F.lit(0)
    rank = (start + F.col("at") + 1).cast("long")
    return placed.select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
with steps as (select list(c::bigint order by i) as t from (select i, list_reduce(list_prepend(i::bigint, range(8)::bigint[]), lambda c, k: xor(c >> 1, case when c & 1 = 1 then 3988292384::bigint else 0::bigint end)) as c from range(256) r(i))),
w as (select false as target, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as ws from documents
      union all select true, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') from benchmark),
f as (select target, doc_id, array_to_string(ws[i : i + n - 1], ' ') as f from w, range(1, 4) ns(n), unnest(range(1, len(ws) - n + 2)) as t(i)),
h as (select f, hex(encode(f)) as h from (select distinct f from f)),
b as (select f, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len(h) + 1, 2), lambda i: (16 * (instr('0123456789ABCDEF', h[i]) - 1) + instr('0123456789ABCDEF', h[i + 1]) - 1)::bigint)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 as b from h, steps),
n as (select b, count(*) filter (not target) as s, count(*) filter (target) as t from f join b using (f) group by b),
g as (select b, cast(floor(1000 * ln((t + 1)::double * (s_all + 10000) / ((s + 1)::double * (t_all + 10000)))) as bigint) as gain from n, (select sum(s) as s_all, sum(t) as t_all from n)),
d as (select doc_id, count(*) as n_features, cast(sum(gain) as bigint) as weight from f join b using (f) join g using (b) where not target group by doc_id),
scored as (select doc_id, len(ws) >= 20 as eligible, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
                  coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || doc_id), 8))::bigint + 0.5) / 4294967296))) as bigint) as score
           from w left join d using (doc_id) where not target),
ranked as (select *, row_number() over (partition by eligible order by score desc, doc_id) as r, (count(*) filter (eligible) over ()) * 5 // 100 as drawn from scored)
select doc_id, n_features, weight, score, case when eligible and r <= drawn then r end as rank from ranked
"""
