"""Matching of found claims and edges to expected ones by the words they share, and what follows from it.

An episode's items are never gathered: pairs come from joins on words, and matches are
settled in rounds over all episodes at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.functions.text import word_set
from claimloom.operators.evaluation import rate
from claimloom.plans.staging import stage, stage_told


def split_words(text: Column) -> Column:
    """The distinct words of a lower-cased text, as white space parts them."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[\s\p{Z}]+")), "")


def overlapping(left: DataFrame, right: DataFrame, least: float, words=word_set, strictly: bool = False) -> DataFrame:
    """``(episode, left, right, score)`` of texts of one episode whose words have a Jaccard similarity of ``least`` or (``strictly``) more.

    Both tables have episode, place (an order of the episode's items, once each) and
    text. A prefix-filtered set join: two sets that are similar enough share one of the
    rarest words of each, of which a set leaves out as many as it must share less one.
    ``least`` is above 0. Null texts and texts without words match nothing.
    """

    def sets(rows: DataFrame) -> DataFrame:
        return rows.select("episode", "place", words(F.coalesce("text", F.lit(""))).alias("words")).where(F.size("words") > 0)

    a, b = stage(sets(left), "left-words").df, stage(sets(right), "right-words").df
    often = a.select("episode", "words").unionByName(b.select("episode", "words")).select("episode", F.explode("words").alias("word")).groupBy("episode", "word").agg(F.count("*").alias("freq"))

    def prefixes(rows: DataFrame) -> DataFrame:
        size = F.size("words")
        each = rows.select("episode", "place", size.alias("size"), F.explode("words").alias("word")).join(often, ["episode", "word"])
        nth = F.row_number().over(Window.partitionBy("episode", "place").orderBy("freq", "word"))
        return each.withColumn("nth", nth).where(F.col("nth") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1).select("episode", "place", "size", "word")

    near = prefixes(a).withColumnsRenamed({"place": "left", "size": "n"}).join(prefixes(b).withColumnsRenamed({"place": "right", "size": "m"}), ["episode", "word"])
    # sets whose sizes are too far apart can't be that similar
    near = near.where((F.col("n") >= F.col("m") * least - 1e-9) & (F.col("m") >= F.col("n") * least - 1e-9)).select("episode", "left", "right").distinct()
    both = near.join(a.withColumnsRenamed({"place": "left", "words": "x"}), ["episode", "left"]).join(b.withColumnsRenamed({"place": "right", "words": "y"}), ["episode", "right"])
    shared = F.size(F.array_intersect("x", "y"))
    score = shared / (F.size("x") + F.size("y") - shared)
    return both.select("episode", "left", "right", score.alias("score")).where(F.col("score") > least if strictly else F.col("score") >= least)


def best_claims(scores: DataFrame) -> DataFrame:
    """``(episode, left, right, score)``: each left item's best right one, the first of equal ones, where no earlier item wants the same.

    An item whose best is gone gets none.
    """
    best = scores.groupBy("episode", "left").agg(F.max_by(F.struct("right", "score"), F.struct("score", (-F.col("right")).alias("first"))).alias("b")).select("episode", "left", "b.right", "b.score")
    return best.groupBy("episode", "right").agg(F.min(F.struct("left", "score")).alias("f")).select("episode", "f.left", "right", "f.score")


def _walked(scores: DataFrame) -> DataFrame:
    """Greedy matches by one walk over pairs sorted by episode, left item and falling score; a task holds an episode's taken items."""
    schema = scores.schema

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        episode, item, done, used = object(), None, False, set()
        for batch in batches:
            keep = []
            for i, (e, left, right) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("episode", "left", "right")])):
                if e != episode:
                    episode, item, used = e, object(), set()
                if left != item:
                    item, done = left, False
                if not done and right not in used:
                    used.add(right)
                    done = True
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    n = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scores.repartition(n, "episode").sortWithinPartitions("episode", "left", F.desc("score"), "right").mapInArrow(walk, schema)


def greedy_matches(scores: DataFrame, rounds: int = 6) -> DataFrame:
    """One-to-one matches: left items in order, each takes its best free right item, the first of equal ones.

    ``scores`` has episode, left, right (orders) and score, a pair once. A round settles
    every item that no earlier open item of its episode shares its best with; the first
    open item always is one. What ``rounds`` leave open is settled by one sorted walk.
    """
    scores = scores.select("episode", "left", "right", "score")
    open_, settled = stage(scores, "open-pairs").df, []
    for _ in range(rounds):
        best = open_.groupBy("episode", "left").agg(F.max_by(F.struct("right", "score"), F.struct("score", (-F.col("right")).alias("first"))).alias("b")).select("episode", "left", "b.right", "b.score")
        first = open_.groupBy("episode", "right").agg(F.min("left").alias("left"))
        won = stage(best.join(first, ["episode", "right", "left"]).select(*scores.columns), "settled-pairs").df
        settled.append(won)
        left = open_.join(won.select("episode", "left"), ["episode", "left"], "left_anti").join(won.select("episode", "right"), ["episode", "right"], "left_anti")
        staged, told = stage_told(left.select(*scores.columns), "open-pairs", n=F.count("*"))
        open_ = staged.df
        if not told["n"]:
            break
    else:
        settled.append(_walked(open_))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def relation_matches(matches: DataFrame, gold: DataFrame, found: DataFrame) -> DataFrame:
    """``gold`` relations (episode, place, from_place, to_place, relation) with ``found_relation`` and ``agrees``.

    A relation between two claims that are matched takes a found edge (episode, place,
    from_place, to_place, relation) between their matches, in either direction, the
    first that no earlier relation took; support and dependence agree.
    """
    to = matches.select("episode", F.col("left").alias("of"), F.col("right").alias("is"))
    ends = gold.join(to.withColumnsRenamed({"of": "from_place", "is": "f"}), ["episode", "from_place"], "left").join(to.withColumnsRenamed({"of": "to_place", "is": "t"}), ["episode", "to_place"], "left")
    pair = [F.least("f", "t").alias("a"), F.greatest("f", "t").alias("b")]
    nth = F.row_number().over(Window.partitionBy("episode", "a", "b").orderBy("place"))
    want = ends.where("f is not null and t is not null").select("episode", "place", "relation", *pair).withColumn("nth", nth)
    have = found.select("episode", "place", F.col("relation").alias("found_relation"), F.least("from_place", "to_place").alias("a"), F.greatest("from_place", "to_place").alias("b")).withColumn("nth", nth).drop("place")
    hit = want.join(have, ["episode", "a", "b", "nth"]).select("episode", "place", "found_relation")
    out = gold.join(hit, ["episode", "place"], "left")
    return out.withColumn("agrees", (F.col("relation") == "supports") == F.col("found_relation").isin("supports", "depends_on"))


def episode_evaluation(gold_claims: DataFrame, gold_relations: DataFrame, found_claims: DataFrame, found_edges: DataFrame, least: float = 0.25) -> DataFrame:
    """Per episode what ``match_rates`` sums: gold_claims, matched_claims, gold_edges, matched_edges, found_edges, right_relations.

    Claims have episode, place and text, relations and edges episode, place, from_place,
    to_place and relation; an edge counts if both of its ends are found claims.
    """
    matches = stage(best_claims(overlapping(gold_claims, found_claims, least)), "claim-matches").df
    known = found_claims.select("episode", "place")
    inner = found_edges.join(known.withColumnRenamed("place", "from_place"), ["episode", "from_place"], "left_semi").join(known.withColumnRenamed("place", "to_place"), ["episode", "to_place"], "left_semi")
    edges = relation_matches(matches, gold_relations, inner)
    count = lambda rows, name: rows.groupBy("episode").agg(F.count("*").alias(name))
    parts = [
        count(gold_claims, "gold_claims"),
        count(matches, "matched_claims"),
        edges.groupBy("episode").agg(F.count("*").alias("gold_edges"), F.count("found_relation").alias("matched_edges"), F.count_if("agrees").alias("right_relations")),
        count(inner, "found_edges"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "episode", "full")
    names = ("gold_claims", "matched_claims", "gold_edges", "matched_edges", "found_edges", "right_relations")
    return out.select("episode", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])


def basis_matches(samples: DataFrame, claims: DataFrame, least: float = 0.15) -> DataFrame:
    """``(episode, place, expected, got, score)`` of every sample: the basis of the claim that it was matched to, else null.

    Both have episode, place, text and basis; samples choose in order, each the best claim that is free.
    """
    matches = greedy_matches(overlapping(samples, claims, least, split_words, strictly=True))
    of = matches.join(claims.select("episode", F.col("place").alias("right"), F.col("basis").alias("got")), ["episode", "right"])
    rows = samples.select("episode", "place", F.col("basis").alias("expected"))
    return rows.join(of.select("episode", F.col("left").alias("place"), "got", "score"), ["episode", "place"], "left")


def basis_accuracy(matched: DataFrame) -> DataFrame:
    """Over all samples: how many are matched, how many of these have the expected basis, and both rates."""
    n, hit, right = F.count("*"), F.count("got"), F.count_if(F.col("got") == F.col("expected"))
    return matched.agg(n.alias("samples"), hit.alias("matched"), right.alias("correct"), rate(right, n).alias("accuracy"), rate(right, hit).alias("accuracy_of_matched"))
