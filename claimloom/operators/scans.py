"""Reads over claims and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.claims import is_weak
from claimloom.operators.asked_runs import asked_runs, first_run
from claimloom.operators.gram_index import GramIndex, N, grams
from claimloom.plans.claim_graph import ClaimGraph
from claimloom.plans.staging import stage

#: Characters of a window and of the run that stands for it.
WINDOW, RUN = 16, 12


def claims_of_project(claims: DataFrame, project: str, archived: bool = False) -> DataFrame:
    rows = claims.where(F.col("project") == project)
    return rows if archived else rows.where(~F.coalesce("archived", F.lit(False)))


def claims_of_session(claims: DataFrame, membership: DataFrame, session_id: str) -> DataFrame:
    """Active claims that the bridge table puts into a session."""
    inside = membership.where(F.col("session_id") == session_id).select(F.col("claim_id").alias("id"))
    return claims.where(~F.coalesce("archived", F.lit(False))).join(inside, "id", "left_semi")


def edges_of_claim(edges: DataFrame, claim_id: str) -> DataFrame:
    return edges.where((F.col("from_id") == claim_id) | (F.col("to_id") == claim_id))


def search_claims(claims: DataFrame, text: str, project: str | None = None, basis: str | None = None) -> DataFrame:
    """Active claims whose text holds ``text`` in any case; no character of it is a wildcard."""
    rows = claims.where(~F.coalesce("archived", F.lit(False)) & F.contains(F.lower("text"), F.lower(F.lit(text))))
    rows = rows if project is None else rows.where(F.col("project") == project)
    return rows if basis is None else rows.where(F.col("basis") == basis)


def window_runs(text: Column) -> Column:
    """Hashes of the runs that a text's windows pick: of each ``WINDOW`` characters the run of ``RUN`` with the least hash; none of a shorter text.

    What a text picks, every text that holds it picks, too, and picks are a third of all runs.
    """
    steps = WINDOW - RUN + 1
    every = F.transform(F.sequence(F.lit(1), F.char_length(text) - (RUN - 1)), lambda i: F.xxhash64(F.substring(text, i, F.lit(RUN))))
    least = F.transform(F.array(every), lambda h: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(h) - (steps - 1)), lambda j: F.array_min(F.slice(h, j, steps)))))
    return F.when(F.char_length(text) >= WINDOW, F.get(least, 0))


def _by_index(active: DataFrame, open_: DataFrame, index: GramIndex) -> DataFrame:
    """``(project, key, n, part)`` of texts that share a key's rarest run of four, which the index has, and hold the key."""
    spread = index.spread(active)
    often = spread.groupBy("project", "gram").agg(F.count("*").alias("freq"))
    rarest = (
        open_.select("project", "key", F.explode(grams(F.col("key"))).alias("gram"))
        .join(often.hint("merge"), ["project", "gram"], "left")
        .groupBy("project", "key")
        .agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "gram"))["gram"].alias("gram"))
    )
    return spread.join(rarest.hint("merge"), ["project", "gram"]).where(F.contains("low", "key")).select("project", "key", F.lit(1).alias("n"), F.col("id").alias("part"))


def _by_runs(texts: DataFrame, open_: DataFrame) -> DataFrame:
    """``(project, key, n, part)`` of texts that hold a key, met by the run that it begins with."""
    asked = open_.withColumn("run", first_run(F.col("key")))
    row = F.xxhash64("project", "low").alias("row")
    held = asked_runs(texts.select("project", "low", row, "n", "part"), "low", "project", asked.select("project", "run"))
    # a key that is its run is in all that hold the run
    whole = asked.where("key = run").select("project", "run")
    counted = held.groupBy("project", "run").agg(F.sum("n").alias("n"), F.min("part").alias("part"))
    whole = counted.join(whole.hint("merge"), ["project", "run"]).select("project", F.col("run").alias("key"), "n", "part")
    longer = held.join(asked.where("key <> run").hint("merge"), ["project", "run"]).select("row", "project", "key", "part")
    longer = longer.join(texts.select(row, "project", "low", "n", "part").hint("merge"), ["row", "project", "part"]).where(F.contains("low", "key"))
    return whole.unionByName(longer.select("project", "key", "n", "part"))


def resolve_text(probes: DataFrame, claims: DataFrame, index: GramIndex | None = None) -> DataFrame:
    """``(project, from_id, needle, claim_id)``: the active claim of the project that a text means, else null.

    The first claim of equal text, in any case and without white space around it, else
    the only one that holds it. A claim doesn't mean itself, and an empty text nothing.
    A text that no claim equals meets those that hold the run of characters which it
    begins with; with an ``index`` of the claims, one of four characters or more meets
    those that share its rarest run of four. Equal texts of a project are one. Runs of
    texts are many times their rows, so no join that they take is a broadcast: Spark
    sizes one by its input.
    """
    active = claims.where(~F.coalesce("archived", F.lit(False))).select("id", "project", F.lower("text").alias("low"), "created_at")
    asked = probes.select("project", "from_id", "needle", F.lower(F.trim("needle")).alias("key")).where("key <> ''")
    texts = active.groupBy("project", "low").agg(F.min(F.struct("created_at", "id"))["id"].alias("exact"), F.count("*").alias("n"), F.min("id").alias("part"))
    texts = stage(texts.where("low is not null and project is not null"), "claim-texts").df
    exact = texts.select("project", F.col("low").alias("key"), F.col("exact").alias("claim"))
    open_ = stage(asked.select("project", "key").distinct().join(exact.hint("merge"), ["project", "key"], "left_anti"), "open-texts").df
    inside = _by_runs(texts, open_ if index is None else open_.where(F.char_length("key") < N))
    if index:
        inside = inside.unionByName(_by_index(active, open_.where(F.char_length("key") >= N), index))
    only = inside.groupBy("project", "key").agg(F.sum("n").alias("n"), F.min("part").alias("claim")).where("n = 1").select("project", "key", "claim")
    found = asked.join(exact.unionByName(only).hint("merge"), ["project", "key"], "left")
    return found.select("project", "from_id", "needle", F.when(~F.col("claim").eqNullSafe(F.col("from_id")), F.col("claim")).alias("claim_id"))


def basis_map(claims: DataFrame) -> DataFrame:
    """``(project, bases)`` with a map from basis to count."""
    counted = claims.groupBy("project", "basis").agg(F.count("*").alias("n"))
    return counted.groupBy("project").agg(F.map_from_entries(F.collect_list(F.struct("basis", "n"))).alias("bases"))


def counts(g: ClaimGraph) -> DataFrame:
    sides = g.all_claims.agg(F.count_if(~F.coalesce("archived", F.lit(False))).alias("active_claims"), F.count("*").alias("claims"))
    return sides.join(F.broadcast(g.edges.agg(F.count("*").alias("edges"))))


def upstream(g: ClaimGraph) -> DataFrame:
    """``(id, upstream, hops)`` one and two steps up."""
    up = g.dependents.select(F.col("dep").alias("id"), F.col("anchor").alias("upstream")).distinct()
    further = up.select(F.col("id").alias("mid"), F.col("upstream").alias("above"))
    two = up.join(further, up["upstream"] == further["mid"]).select("id", F.col("above").alias("upstream")).distinct()
    return up.withColumn("hops", F.lit(1)).unionByName(two.withColumn("hops", F.lit(2)))


def topology(g: ClaimGraph) -> DataFrame:
    sizes = g.weighed.groupBy("project").agg(F.count("*").alias("claims"), F.count_if(F.col("degree") == 0).alias("orphans"))
    clusters = g.clusters.groupBy("project").agg(F.count("*").alias("clusters"))
    edges = g.edges.groupBy("project").agg(F.count("*").alias("edges"))
    out = sizes.join(clusters, "project", "left").join(edges, "project", "left")
    return out.select("project", "claims", "orphans", F.coalesce("clusters", F.lit(0)).alias("clusters"), F.coalesce("edges", F.lit(0)).alias("edges"))


def topology_whole(g: ClaimGraph) -> DataFrame:
    """``topology`` with each project's depth and its claims by basis."""
    return topology(g).join(g.depths(), "project").join(basis_map(g.claims), "project")


def session_eval(g: ClaimGraph) -> DataFrame:
    """Per session (a document's, where claims come from one): claims, edges from them, and bases."""
    sessions = g.claims.select(F.col("id").alias("from_id"), "session_id")
    edges = g.edges.join(sessions, "from_id").groupBy(F.col("session_id").alias("of_session")).agg(F.count("*").alias("edges"))
    bases = g.claims.groupBy("session_id").agg(F.count("*").alias("claims"), *[F.count_if(F.col("basis") == b).alias(b) for b in ("research", "vibes")])
    return bases.join(edges, F.col("session_id").eqNullSafe(F.col("of_session")), "left").select("session_id", "claims", F.coalesce("edges", F.lit(0)).alias("edges"), "research", "vibes")


def cross_speaker(g: ClaimGraph) -> DataFrame:
    """Per project with edges between speakers: how many there are, how many dispute, and the weak share of the user's claims (0 without any)."""
    speakers = g.claims.select("id", "speaker")
    rows = g.edges.join(speakers.withColumnsRenamed({"id": "from_id", "speaker": "a"}), "from_id").join(speakers.withColumnsRenamed({"id": "to_id", "speaker": "b"}), "to_id").where("a <> b")
    across = rows.groupBy("project").agg(F.count("*").alias("across"), F.count_if(F.col("relation").isin("contradicts", "questions")).alias("disputes"))
    user = F.col("speaker") == "user"
    weak = g.claims.groupBy(F.col("project").alias("of_project")).agg(F.count_if(user).alias("users"), F.count_if(user & is_weak()).alias("weak"))
    joined = across.join(weak, F.col("project").eqNullSafe(F.col("of_project")))
    return joined.select("project", "across", "disputes", F.when(F.col("users") > 0, F.col("weak") / F.col("users")).otherwise(0.0).alias("weak_rate"))
