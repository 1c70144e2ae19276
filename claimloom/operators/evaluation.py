"""Reports that grade findings, deliveries, matches and repeated runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 where there is no whole."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def substantive(grades: DataFrame, by: list[str]) -> DataFrame:
    """Per fixture: substantive and frivolous grades, and the share of the former among the gradable."""
    s, f = F.count_if(F.col("grade") == "substantive"), F.count_if(F.col("grade") == "frivolous")
    return grades.groupBy(*by).agg(s.alias("substantive"), f.alias("frivolous"), (s + f).alias("gradable"), rate(s, s + f).alias("rate"))


def validity(pos_n: Column, neg_n: Column, pos_rate: Column, neg_rate: Column, least_n: int = 20, pos_min: float = 0.7, neg_max: float = 0.3) -> Column:
    """The first of the checks that fails, in their order, else valid."""
    return (
        F.when(pos_n < least_n, "pos_small_n").when(neg_n < least_n, "neg_small_n").when(pos_rate < pos_min, "pos_low").when(neg_rate > neg_max, "neg_high").otherwise("valid")
    )


def band(share: Column) -> Column:
    """How a share of substantive findings reads."""
    return F.when(share >= 0.85, "strong").when(share >= 0.7, "good").when(share >= 0.5, "mixed").otherwise("weak")


def delivery_cells(samples: DataFrame, by: list[str]) -> DataFrame:
    """Per cell: verdicts and the act-on rate, in which an ambiguous reply counts as not acted on."""
    told = {v: F.count_if(F.col("verdict") == v) for v in ("ACTED_ON", "AMBIGUOUS", "IGNORED")}
    n = told["ACTED_ON"] + told["AMBIGUOUS"] + told["IGNORED"]
    return samples.groupBy(*by).agg(
        told["ACTED_ON"].alias("acted"), told["AMBIGUOUS"].alias("ambiguous"), told["IGNORED"].alias("ignored"), F.count_if(F.col("verdict").isNull()).alias("ungradable"), rate(told["ACTED_ON"], n).alias("rate")
    )


def delivery_gate(cells: DataFrame, pos_min: float = 0.7, neg_max: float = 0.3) -> DataFrame:
    """Whether the ceiling holds: the cell ``pos`` must exist and reach ``pos_min``; the negative cells only inform."""
    of = lambda name: F.max(F.when(F.col("cell") == name, F.col("rate")))
    rates = cells.agg(of("pos").alias("pos"), of("neg").alias("neg"), of("negLong").alias("neg_long"))
    verdict = F.when(F.col("pos").isNull(), "missing pos").when(F.col("pos") < pos_min, "pos low").otherwise("ceiling holds")
    return rates.select(
        "*", verdict.alias("reason"), (F.coalesce("pos", F.lit(0.0)) >= pos_min).alias("valid"),
        F.coalesce(F.col("neg") > neg_max, F.lit(False)).alias("neg_note"), F.coalesce(F.col("neg_long") > neg_max, F.lit(False)).alias("neg_long_note"),
    )


def arm_difference(cells: DataFrame) -> DataFrame:
    """Per length: the rate of arm B less that of arm A."""
    wide = cells.groupBy("length").pivot("arm", ["A", "B"]).agg(F.first("rate"))
    return wide.select("length", F.col("A").alias("rate_a"), F.col("B").alias("rate_b"), (F.col("B") - F.col("A")).alias("delta"))


def confusion(pairs: DataFrame, expected: str, got: str) -> DataFrame:
    """Counts of each expected and got value, with the share of the row."""
    rows = pairs.groupBy(expected, got).agg(F.count("*").alias("n"))
    totals = pairs.groupBy(expected).agg(F.count("*").alias("of"))
    return rows.join(totals, expected).withColumn("share", F.col("n") / F.col("of"))


def run_stats(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    v = F.col(value)
    return values.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("least"), F.max(v).alias("most"))


def stability(found: DataFrame, runs: int) -> DataFrame:
    """Per type: distinct findings over all runs, those of every run, and what their share says."""
    each = found.groupBy("type", "text").agg(F.countDistinct("run").alias("in_runs"))
    rows = each.groupBy("type").agg(F.count("*").alias("distinct_findings"), F.count_if(F.col("in_runs") == runs).alias("in_all"))
    share = rate(F.col("in_all"), F.col("distinct_findings"))
    return rows.withColumn("share", share).withColumn("verdict", F.when(F.col("share") > 0.7, "stable").when(F.col("share") > 0.3, "partial").otherwise("churns"))


def edge_matches(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Gold edges with the found edge between the same claims in either direction, and whether the relation agrees."""
    g = gold.select("episode", F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b"), F.col("relation").alias("want"))
    f = found.select("episode", F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b"), F.col("relation").alias("got"))
    same = f.groupBy("episode", "a", "b").agg(F.collect_set("got").alias("got"))
    return g.join(same, ["episode", "a", "b"], "left").select("episode", "a", "b", "want", F.col("got").isNotNull().alias("matched"), F.coalesce(F.array_contains("got", F.col("want")), F.lit(False)).alias("agrees"))


def match_rates(episodes: DataFrame) -> DataFrame:
    """Over all episodes, from their sums: recall of claims and edges, precision of edges, and how many matched edges have the right relation.

    ``episodes`` has gold_claims, matched_claims, gold_edges, matched_edges, found_edges and right_relations.
    """
    names = ("gold_claims", "matched_claims", "gold_edges", "matched_edges", "found_edges", "right_relations")
    s = {n: F.coalesce(F.sum(n), F.lit(0)) for n in names}
    return episodes.agg(
        rate(s["matched_claims"], s["gold_claims"]).alias("claim_recall"), rate(s["matched_edges"], s["gold_edges"]).alias("edge_recall"),
        rate(s["matched_edges"], s["found_edges"]).alias("edge_precision"), rate(s["right_relations"], s["matched_edges"]).alias("relation_accuracy"),
    )


def episode_counts(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Per episode what ``match_rates`` sums over edges: gold ones, those matched, those with the right relation, and all that were found."""
    each = edge_matches(gold, found).groupBy("episode").agg(F.count("*").alias("gold_edges"), F.count_if("matched").alias("matched_edges"), F.count_if("agrees").alias("right_relations"))
    all_found = found.groupBy("episode").agg(F.count("*").alias("found_edges"))
    none = F.lit(0).cast("long")
    return each.join(all_found, "episode", "full").select("episode", *[F.coalesce(c, none).alias(c) for c in ("gold_edges", "matched_edges", "right_relations", "found_edges")])
