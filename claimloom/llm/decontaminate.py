"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Benchmark texts are cut into windows of ``window`` consecutive words (an item of
fewer words is one window). A window's set is its shingles of up to five words. A first
pass over the documents counts the benchmark's shingles there, hashes alone, so all are
ordered by their exact corpus frequency. At a containment of one the necessary prefix of
a window is its single rarest shingle; in a second pass only prefixes join. A prefix's
place in the window gives the window's place in the document, the length bound drops
windows that would pass an end, and the words are compared in the document's own row, so
nothing but true occurrences leaves the task. What is broadcast are blocks of about
``block_rows`` shingles or windows; a larger benchmark takes more passes. Which items a
window belongs to joins what was found, so items that share a window aren't broadcast.

Defined results: a null text has no words and is never contaminated; an item without
words is ignored; equal windows of several items count for each of them; repeated
rows each get the same result; empty tables give zero counts. Words are compared
after lower-casing A-Z only. Other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.plans.staging import stage

#: Fixed by the contract: what stands between words, once A-Z are lower-case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE_WORDS = 5


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def words_of(text: Column) -> Column:
    """The words of a text: what stands between other characters, which is read several times faster than a pattern for words."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN, -1), "")


def _shingle(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(words, at + j) for j in range(length)])


def _shingles(words: Column, length: int) -> Column:
    """Hashes of all runs of ``length`` words, in order; empty if there are fewer words."""
    every = F.transform(F.sequence(F.lit(0), F.size(words) - length), lambda at: _shingle(words, at, length))
    return F.when(F.size(words) >= length, every).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(bench: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item_id, win, words, len)``: each item's windows; ``win`` is the words joined by a space."""
    items = bench.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("all")).where(F.size("all") > 0)
    return items.withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0))))).select(
        "item_id", F.slice("all", F.col("at") + 1, F.lit(window)).alias("words")
    ).select("item_id", F.array_join("words", " ").alias("win"), "words", F.size("words").alias("len"))


def _spots(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """``docs`` (with ``words``) by place: a row for each shingle of each size, with its place ``at`` and hash ``h``."""
    # an outer explode, since Spark evaluates the words of an inner one twice, to filter before it
    places = docs.withColumn("at", F.explode_outer(F.sequence(F.lit(0), F.size("words") - 1))).where("at is not null")
    hashes = [F.when(F.col("at") + n <= F.size("words"), _shingle(F.col("words"), F.col("at"), n)) for n in sizes]
    return places.withColumn("h", F.explode(F.array(*hashes)))


def _in_blocks(rows: DataFrame, key: str, block_rows: int) -> list[DataFrame]:
    """``rows`` in parts of about ``block_rows``, each of which may be broadcast."""
    blocks = max(1, -(-rows.count() // block_rows))
    return [rows.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == block) for block in range(blocks)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


class Benchmark(NamedTuple):
    """``windows`` (win_id, win, words, len), each of them once, and ``members`` (win_id, item_id)."""

    windows: DataFrame
    members: DataFrame


def staged_benchmark(bench: DataFrame, window: int = 13, id_col: str = "item_id", text_col: str = "text") -> Benchmark:
    each = stage(benchmark_windows(bench, window, id_col, text_col), "benchmark").df
    windows = stage(each.select("win", "words", "len").distinct().withColumn("win_id", F.monotonically_increasing_id()), "windows").df
    return Benchmark(windows, each.join(windows.select("win_id", "win"), "win").select("win_id", "item_id").distinct())


def window_hits(docs: DataFrame, windows: DataFrame, block_rows: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, key, start, len, win_id)``: every occurrence in a document of one of :class:`Benchmark`'s windows.

    ``key`` is a hash of the text, so that different texts under one id stay apart.
    """
    spark = docs.sparkSession
    size = F.least(F.col("len"), F.lit(SHINGLE_WORDS))
    sizes = sorted(n for (n,) in windows.select(size).distinct().collect())
    if not sizes:
        return spark.createDataFrame([], "doc_id long, key long, start int, len int, win_id long")
    tokens = _union([windows.where(size == n).select("win_id", F.posexplode(_shingles(F.col("words"), n)).alias("offset", "h")) for n in sizes])
    # first pass: how often each benchmark shingle stands in the documents
    words = docs.select(words_of(F.col(text_col)).alias("words"))
    wanted = stage(tokens.select("h").distinct(), "shingles").df
    often = stage(
        _union([_spots(words, sizes).select("h").join(F.broadcast(part), "h").groupBy("h").agg(F.count("*").alias("freq")) for part in _in_blocks(wanted, "h", block_rows)]),
        "shingle-counts",
    ).df
    # a shingle that no document has leaves its windows without candidates: the left join keeps it as the rarest
    ranked = tokens.join(often, "h", "left").groupBy("win_id").agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "offset", "h")).alias("p"))
    prefix = windows.join(ranked, "win_id").where("p.freq > 0").select("win_id", "win", "len", F.col("p.h").alias("h"), F.col("p.offset").alias("offset"))
    prefix = stage(prefix, "prefixes").df
    # second pass: the prefixes alone join, and what they find is compared where it stands
    text = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"), words_of(F.col(text_col)).alias("words"))
    start = F.col("at") - F.col("offset")
    fits = (start >= 0) & (start + F.col("len") <= F.size("words"))
    same = F.array_join(F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("len")), " ") == F.col("win")
    found = [_spots(text, sizes).join(F.broadcast(part), "h").where(fits & same) for part in _in_blocks(prefix, "win_id", block_rows)]
    return _union(found).select("doc_id", "key", start.alias("start"), "len", "win_id")


def _covered(spans: Column) -> Column:
    """How many words an array of ``(start, len)`` covers."""

    def step(done: Column, s: Column) -> Column:
        end = s["start"] + s["len"]
        return F.struct(F.greatest(done["end"], end).alias("end"), (done["n"] + F.greatest(F.lit(0), end - F.greatest(done["end"], s["start"]))).alias("n"))

    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step)["n"]


def _judged(docs: DataFrame, hits: DataFrame, min_share: tuple[int, int]) -> DataFrame:
    """``doc_id, key, n_words, n_hit, contaminated`` of every row of ``docs``; ``key`` is a hash of the text."""
    per_doc = (
        hits.groupBy(F.col("doc_id").alias("hit_id"), F.col("key").alias("hit_key"))
        .agg(F.collect_set(F.struct("start", "len")).alias("spans"))
        .select("hit_id", "hit_key", _covered(F.col("spans")).cast("long").alias("n_hit"))
    )
    n_words = F.size(words_of(F.col("text"))).cast("long")
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), n_words.alias("n_words"))
    part, whole = min_share
    joined = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select("doc_id", "key", "n_words", n_hit.alias("n_hit"), ((n_hit > 0) & (n_hit * whole >= F.col("n_words") * part)).alias("contaminated"))


def contamination(docs: DataFrame, bench: DataFrame, window: int = 13, min_share: tuple[int, int] = (1, 20)) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_hit, n_items, item_ids, contaminated``.

    A row is contaminated if hit words are at least ``min_share`` (a fraction) of its words.
    """
    known = staged_benchmark(bench, window)
    hits = stage(window_hits(docs, known.windows), "hits").df
    items = hits.select("doc_id", "key", "win_id").distinct().join(known.members, "win_id").groupBy(F.col("doc_id").alias("of_id"), F.col("key").alias("of_key")).agg(F.collect_set("item_id").alias("item_ids"))
    rows = _judged(docs, hits, min_share)
    told = rows.join(items, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key")), "left")
    item_ids = F.coalesce("item_ids", F.array().cast("array<bigint>"))
    return told.select("doc_id", "n_words", "n_hit", F.size(item_ids).cast("long").alias("n_items"), item_ids.alias("item_ids"), "contaminated")


def drop_contaminated(docs: DataFrame, bench: DataFrame, window: int = 13, min_share: tuple[int, int] = (1, 20)) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns; each text under an id, or under none, for itself."""
    hits = window_hits(docs, staged_benchmark(bench, window).windows)
    bad = _judged(docs, hits, min_share).where("contaminated").select("doc_id", "key").distinct()
    same = F.col("all.doc_id").eqNullSafe(F.col("bad.doc_id")) & (F.xxhash64("all.text") == F.col("bad.key"))
    return docs.alias("all").join(bad.alias("bad"), same, "left_anti")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return contamination(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(ids, 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as words from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as words from benchmark),
bw as (select distinct item_id, least(len(words), 13) as n, array_to_string(words[i + 1 : i + least(len(words), 13)], ' ') as win
       from b, unnest(range(0, greatest(len(words) - 13, 0) + 1)) as t(i) where len(words) > 0),
sizes as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(words[i + 1 : i + n], ' ') as win from w, sizes, unnest(range(0, greatest(len(words) - n, -1) + 1)) as t(i)),
hits as (select doc_id, i, n, item_id from dw join bw using (win, n)),
pos as (select doc_id, count(distinct p) as n_hit from (select distinct doc_id, i, n from hits), unnest(range(i, i + n)) as t(p) group by 1),
its as (select doc_id, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from (select distinct doc_id, item_id from hits) group by 1)
select w.doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from w left join pos using (doc_id) left join its using (doc_id)
"""
