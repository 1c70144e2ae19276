"""SimHash near-duplicates through vantage-point trees.

Fingerprints are 64-bit SimHashes of word shingles. Two fingerprints within
``radius`` bits agree within ``radius // 4`` bits on at least one of their four
16-bit blocks (pigeonhole). For each block a vantage-point tree is built over the
block's value counts, which cover all fingerprints and are at most 65,536 rows a
block, so what reaches the driver is bounded by that, whatever the input. A value
goes to its home shard; one that lies within the block radius outside a vantage
ball also goes into the ball, so the triangle inequality guarantees that each close
pair meets in some shard. Inside a shard the tree goes on: every fingerprint is a query
that takes only the branches its triangle bounds leave open, and exact 64-bit distances
decide in the leaves.

A shard above ``shard_rows`` (one hot block value) is dealt in chunks; every pair of
chunks is one bounded task, so no group is ever collected whole, and nothing is
dropped. Copies share one fingerprint and are never expanded into pairs.

Defined results: null or empty text, or text of white space only, has fingerprint
zero, which is linked like any other. Repeated rows each appear in the output with
the same component. An empty table gives an empty result. Columns other than the
two that are named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.plans.components import connected_components
from claimloom.plans.staging import stage

BLOCKS, BLOCK_BITS = 4, 16


def simhash(text: str | None, shingle_words: int = 4) -> int:
    """Unsigned 64-bit SimHash: a bit is set if over half of the shingles' XXH64 (seed 42) set it."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    if n <= shingle_words:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = [0, *(ends[: n - shingle_words] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    grams = n - shingle_words + 1
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle_words - 1 :].tolist())), "<u8", grams)
    ones = np.zeros(64, np.int64)
    for at in range(0, grams, 8192):
        part = hashes[at : at + 8192].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > grams, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, more: tuple[Column, ...] = ()) -> DataFrame:
    """``(doc_id, fp)``: each row's fingerprint as a signed long, with the columns ``more`` after it."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        out = np.fromiter((simhash(t, shingle_words) for t in texts), np.uint64, len(texts))
        return pd.Series(out.view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), of(F.col(text_col)).alias("fp"), *more)


def vantage_shards(values: np.ndarray, counts: np.ndarray, radius: int, shard_rows: int) -> list[np.ndarray]:
    """Shards of a vantage-point tree over block ``values``; each holds indices into ``values``.

    Values inside the ball of the vantage point go inward, the others outward, and
    those within ``radius`` beyond its edge go inward too.
    """
    shards: list[np.ndarray] = []
    todo = [np.arange(len(values))]
    while todo:
        at = todo.pop()
        weight = counts[at].sum()
        if weight <= shard_rows or len(at) == 1:
            shards.append(at)
            continue
        vantage = values[at[np.argmax(counts[at])]]
        away = np.bitwise_count(values[at] ^ vantage)
        by = np.bincount(away, weights=counts[at], minlength=BLOCK_BITS + 2)
        inside = np.cumsum(by)
        # the edge that leaves the smaller greater child: ball of distance < edge, with its rim, or the rest
        edges = np.arange(1, BLOCK_BITS + 1)
        larger = np.maximum(inside[np.minimum(edges + radius - 1, BLOCK_BITS)], weight - inside[edges - 1])
        best = int(np.argmin(larger))
        if larger[best] >= 0.95 * weight:
            shards.append(at)
            continue
        edge = edges[best]
        todo += [at[away < edge + radius], at[away >= edge]]
    return shards


def near_pairs(fps: np.ndarray, block: int, radius: int, leaf: int = 48) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in ``fps`` within ``radius`` bits that agree within ``radius // 4`` bits on ``block``, some twice.

    A vantage-point tree over the block's values: the points of a node lie inside or
    outside the median ball of its vantage value, and queries, which are all points, go
    only where the triangle inequality lets a point near them be. Leaves compare all 64
    bits. Points that share one value are searched by their other blocks instead, of
    which one must agree as closely.
    """
    reach = radius // BLOCKS
    every = np.arange(len(fps))
    todo = [(every, every, block, True)]
    while todo:
        points, queries, of, whole = todo.pop()
        if not len(queries) or not len(points):
            continue
        if len(points) > leaf:
            values = (fps >> np.uint64(BLOCK_BITS * of)) & np.uint64(0xFFFF)
            vantage = values[points[len(points) // 2]]
            mine, theirs = np.bitwise_count(values[points] ^ vantage), np.bitwise_count(values[queries] ^ vantage)
            edge = max(1, int(np.median(mine)))
            inner = mine < edge
            if 0 < inner.sum() < len(points):
                todo.append((points[inner], queries[theirs < edge + reach], of, whole))
                todo.append((points[~inner], queries[theirs >= max(edge - reach, 0)], of, whole))
                continue
            if whole:
                todo += [(points, queries, other, False) for other in range(BLOCKS) if other != of]
                continue
        for at in range(0, len(points), 512):
            some = points[at : at + 512]
            i, j = np.nonzero(np.bitwise_count(fps[queries][:, None] ^ fps[some][None, :]) <= radius)
            i, j = queries[i], some[j]
            yield i[i < j], j[i < j]


def _link_within(fps: np.ndarray, block: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect exactly those of ``fps`` (distinct) that ``near_pairs`` joins: from each to the first of its component."""
    root = np.arange(len(fps))
    for i, j in near_pairs(fps, block, radius):
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if len(i):
                np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                while (root != root[root]).any():
                    root = root[root]
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return fps[moved], fps[root[moved]]


def shard_map(values: np.ndarray, counts: np.ndarray, blocks: np.ndarray, reach: int, shard_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which shards each block value goes to, as rows of a compressed matrix, and how many chunks each shard has.

    Row ``block * 65,536 + value`` lists the value's shards, its home among them.
    """
    rows, shards, chunks = [], [], []
    for block in range(BLOCKS):
        mine = blocks == block
        of_block, weight = values[mine], counts[mine]
        for at in vantage_shards(of_block, weight, reach, shard_rows) if len(of_block) else []:
            rows.append(of_block[at].astype(np.int64) + (block << BLOCK_BITS))
            shards.append(np.full(len(at), len(chunks), np.int32))
            chunks.append(-(-int(weight[at].sum()) // shard_rows))
    if not rows:
        return np.zeros((BLOCKS << BLOCK_BITS) + 1, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
    row, shard = np.concatenate(rows), np.concatenate(shards)
    order = np.argsort(row, kind="stable")
    starts = np.searchsorted(row[order], np.arange((BLOCKS << BLOCK_BITS) + 1))
    return starts, shard[order], np.array(chunks, np.int32)


def links(distinct: DataFrame, radius: int = 4, shard_rows: int = 4096) -> DataFrame:
    """``(src, dst)`` edges that connect exactly the fingerprints (column ``fp``, distinct) within ``radius`` of each other."""
    blocks = F.array(*[F.shiftrightunsigned("fp", BLOCK_BITS * b).bitwiseAND(0xFFFF).cast("int") for b in range(BLOCKS)])
    # at most 4 x 65,536 counts, whatever the input
    counted = distinct.select(F.posexplode(blocks).alias("block", "value")).groupBy("block", "value").count().toArrow()
    block, value, count = (counted.column(c).to_numpy() for c in ("block", "value", "count"))
    places = distinct.sparkSession.sparkContext.broadcast(shard_map(value.astype(np.uint16), count, block, radius // BLOCKS, shard_rows))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, shards, chunks = places.value
        for batch in batches:
            fps, mixed = batch.column("fp").to_numpy(), batch.column("mixed").to_numpy()
            for b in range(BLOCKS):
                row = ((fps.view(np.uint64) >> np.uint64(BLOCK_BITS * b)) & np.uint64(0xFFFF)).astype(np.int64) + (b << BLOCK_BITS)
                times = starts[row + 1] - starts[row]
                of = np.repeat(np.arange(len(fps)), times)
                shard = shards[np.repeat(starts[row] - np.cumsum(times) + times, times) + np.arange(len(of))]
                # every pair of a shard's chunks is a task; a row goes to all pairs with its own
                n = chunks[shard]
                own = np.mod(mixed[of], n)
                wide = np.repeat(np.arange(len(of)), n)
                other = np.arange(len(wide)) - np.repeat(np.cumsum(n) - n, n)
                own = own[wide]
                columns = (fps[of][wide], np.full(len(wide), b, np.int32), shard[wide], np.minimum(own, other).astype(np.int32), np.maximum(own, other).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["fp", "block", "shard", "lo", "hi"])

    sent = distinct.select("fp", F.xxhash64("fp").alias("mixed")).mapInArrow(deal, "fp long, block int, shard int, lo int, hi int")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        src, dst = _link_within(np.unique(pdf["fp"].to_numpy()).view(np.uint64), int(pdf["block"].iloc[0]), radius)
        return pd.DataFrame({"src": src.view(np.int64), "dst": dst.view(np.int64)})

    return sent.groupBy("shard", "lo", "hi").applyInPandas(link, "src long, dst long").distinct()


def _rooted(heads: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """``heads`` (fp, head; one row a fingerprint) with ``root``, which the fingerprints of a component share."""
    roots = connected_components(links(heads.select("fp"), radius, shard_rows))
    return heads.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "head", F.coalesce("component", "fp").alias("root"))


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle_words: int = 4, shard_rows: int = 4096) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row: the smallest id reachable over links of at most ``radius`` bits."""
    prints = stage(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints").df
    heads = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("head")), "fingerprint-heads").df
    rooted = _rooted(heads, radius, shard_rows)
    least = rooted.groupBy("root").agg(F.min("head").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame, radius: int = 4, shard_rows: int = 4096) -> DataFrame:
    """One row of ``docs`` of each near-duplicate class: that of the smallest id, nulls last.

    Of several under that id, or of none with an id, the one of the least hash of its text,
    then of the row, stays. Rows equal in all columns are kept or dropped alike.
    """
    key, row = F.xxhash64("text"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    prints = stage(fingerprints(docs, more=(key.alias("key"), row.alias("row"))), "fingerprints").df
    place = F.struct(F.col("doc_id").isNull().alias("unnumbered"), "doc_id", "key", "row")
    heads = stage(prints.groupBy("fp").agg(F.min(place).alias("head")), "fingerprint-heads").df
    first = _rooted(heads, radius, shard_rows).groupBy("root").agg(F.min("head").alias("head"))
    kept = first.select("head.doc_id", "head.key", "head.row")
    row = F.xxhash64(*[F.col(f"all.`{c}`") for c in docs.columns])
    same = F.col("all.doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.xxhash64("all.text") == F.col("kept.key")) & (row == F.col("kept.row"))
    return docs.alias("all").join(kept.alias("kept"), same, "left_semi")


def op10_simhash_vptree(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
