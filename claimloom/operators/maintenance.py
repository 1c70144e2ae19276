"""Changes to claims and edges, and the reports that upkeep needs.

Changes are functions from tables to tables: the caller writes the result to a new
place and swaps it in. Every time-dependent function takes ``as_of``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.functions.claims import CEILINGS, RELATIONS, inventory_flagged, is_stop_class, is_weak, older_than, sycophancy, truncated
from claimloom.plans.claim_graph import ClaimGraph
from claimloom.plans.staging import stage_told

#: The tier in which a finding is shown; kinds without one are reported but not shown.
TIERS = {
    "load_bearing_vibes": 0, "fluency_trap": 0, "unchallenged_chain": 1, "echo_chamber": 1, "premature_closure": 1,
    "coverage_imbalance": 2, "bottleneck": 3, "legacy_load_bearer": 3, "abandoned_topic": 4,
}
#: The order in which a claim's edges are kept.
KEEP_ORDER = ("contradicts", "questions", "depends_on", "supports")


def _rank_of(column: str, order: tuple[str, ...]) -> Column:
    out = F.lit(len(order))
    for i, name in enumerate(order):
        out = F.when(F.col(column) == name, i).otherwise(out)
    return out


def severity_rollup(findings: DataFrame) -> DataFrame:
    strength = F.col("type").startswith("strength_")
    return findings.groupBy("project").agg(
        *[F.count_if((F.col("severity") == s) & ~strength).alias(s) for s in ("critical", "warning", "info")], F.count_if(strength).alias("strengths"), F.count("*").alias("total")
    )


def integrity(g: ClaimGraph) -> DataFrame:
    """Per project, whether too many claims are unconnected."""
    rows = g.weighed.groupBy("project").agg(F.count("*").alias("n"), F.count_if(F.col("degree") == 0).alias("orphans"))
    return rows.withColumn("under_connected", (F.col("n") > 3) & (F.col("orphans") / F.col("n") > 0.4))


def broken_edges(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges an end of which is no claim."""
    ids = claims.select("id")
    joined = edges.select("id", "from_id", "to_id").join(ids.select(F.col("id").alias("f")), F.col("from_id") == F.col("f"), "left").join(ids.select(F.col("id").alias("t")), F.col("to_id") == F.col("t"), "left")
    return joined.where("f is null or t is null").select("id", F.col("f").isNull().alias("from_missing"), F.col("t").isNull().alias("to_missing"))


def violations(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, problem)`` of every broken rule: confidence, basis, speaker, relation, missing or repeated ids."""
    rules = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence"),
            F.when(~F.coalesce(F.col("basis").isin(*CEILINGS), F.lit(False)), "basis"),
            F.when(~F.coalesce(F.col("speaker").isin("user", "assistant", "document", ""), F.lit(False)), "speaker"),
        )
    )
    bad = claims.select("id", F.explode(rules).alias("problem"))
    again = claims.groupBy("id").count().where("count > 1 or id is null").select("id", F.lit("id").alias("problem"))
    relation = edges.where(~F.coalesce(F.col("relation").isin(*RELATIONS), F.lit(False))).select("id", F.lit("relation").alias("problem"))
    return bad.unionByName(again).unionByName(relation)


def insert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with the new ones whose ends and relation aren't there yet; a strength of zero means one. Of equal new ones the least id enters."""
    key = ["from_id", "to_id", "relation"]
    first = new.groupBy(*key).agg(F.min(F.struct("id", "strength", "created_at")).alias("e"))
    fresh = first.join(edges.select(*key), key, "left_anti")
    fresh = fresh.select("e.id", *key, F.when(F.coalesce("e.strength", F.lit(0.0)) == 0, 1.0).otherwise(F.col("e.strength")).alias("strength"), "e.created_at")
    return edges.select("id", *key, "strength", "created_at").unionByName(fresh)


def touch(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """Claims whose ``last_referenced_at`` follows the latest of ``edges`` at either end."""
    latest = edges.select(F.explode(F.array("from_id", "to_id")).alias("id"), F.col("created_at").alias("at")).groupBy("id").agg(F.max("at").alias("at"))
    out = claims.join(latest, "id", "left").withColumn("last_referenced_at", F.greatest(F.coalesce("last_referenced_at", "created_at"), "at"))
    return out.select(*claims.columns)


def prune_edges(edges: DataFrame, most: int = 5) -> DataFrame:
    """At most ``most`` outgoing edges a claim: by relation, then strength."""
    order = Window.partitionBy("from_id").orderBy(_rank_of("relation", KEEP_ORDER), F.desc("strength"), "created_at", "id")
    place = own_name(edges, "place")
    return edges.withColumn(place, F.row_number().over(order)).where(F.col(place) <= most).drop(place)


def close_superseded(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """Claims that a strictly newer one of their project contradicts are closed."""
    ends = claims.select("id", F.col("project").alias("p"), F.col("created_at").alias("at"))
    newer = ends.select(F.col("id").alias("from_id"), F.col("p").alias("new_p"), F.col("at").alias("new_at"))
    hit = edges.where("relation = 'contradicts'").join(newer, "from_id").join(ends.withColumnRenamed("id", "to_id"), "to_id").where("p = new_p and new_at > at")
    return _marked(claims, hit.select(F.col("to_id").alias("id")), lambda hit: {"closed": F.col("closed") | hit})


def settled_merges(merges: DataFrame, max_rounds: int = 32) -> DataFrame:
    """``merges`` (absorb, keep) with every ``keep`` one that stays: chains are followed, in rounds that double their reach.

    Of several merges of one claim the least ``keep`` holds, and merges into oneself are
    none; merges in a circle raise.
    """
    one = merges.where("absorb <> keep").groupBy("absorb").agg(F.min("keep").alias("keep"))
    for _ in range(max_rounds):
        further = one.select(F.col("absorb").alias("keep"), F.col("keep").alias("beyond"))
        staged, told = stage_told(one.join(further, "keep", "left").select("absorb", F.coalesce("beyond", "keep").alias("keep"), F.col("beyond").isNotNull().alias("open")), "merges", n=F.count_if("open"))
        one = staged.df.select("absorb", "keep")
        if not told["n"]:
            return one
        if not one.where("absorb = keep").isEmpty():
            break
    raise ValueError("claims are merged in a circle")


def merge_claims(claims: DataFrame, edges: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims and edges after each ``absorb`` of ``merges`` has gone into its ``keep``, or into what that went into.

    Edges follow; loops go, and of edges that become equal one that was there stays.
    Membership of the absorbed claim goes with it.
    """
    to = settled_merges(merges.select("absorb", "keep"))
    moved = edges.join(to.withColumnsRenamed({"absorb": "from_id", "keep": "f"}), "from_id", "left").join(to.withColumnsRenamed({"absorb": "to_id", "keep": "t"}), "to_id", "left")
    moved = moved.select("id", F.coalesce("f", "from_id").alias("from_id"), F.coalesce("t", "to_id").alias("to_id"), "relation", "strength", "created_at", (F.col("f").isNotNull() | F.col("t").isNotNull()).alias("moved"))
    one = moved.where("from_id <> to_id").groupBy("from_id", "to_id", "relation").agg(F.min(F.struct("moved", "id", "strength", "created_at")).alias("e"))
    return claims.join(to.select(F.col("absorb").alias("id")), "id", "left_anti"), one.select("e.id", "from_id", "to_id", "relation", "e.strength", "e.created_at")


def own_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _marked(claims: DataFrame, ids: DataFrame, changes) -> DataFrame:
    """Claims with ``changes`` (of whether an id is among ``ids``) to some columns."""
    mark = own_name(claims, "marked")
    rows = claims.join(ids.select("id").distinct().withColumn(mark, F.lit(True)), "id", "left")
    return rows.withColumns(changes(F.coalesce(F.col(mark), F.lit(False)))).select(*claims.columns)


def set_archived(claims: DataFrame, ids: DataFrame, archived: bool, project: str | None = None, as_of: str | None = None) -> DataFrame:
    """Archives the claims of ``ids``, or takes them back, which counts as a reference at ``as_of``."""

    def changes(hit: Column) -> dict[str, Column]:
        hit = hit if project is None else hit & (F.col("project") == project)
        out = {"archived": F.when(hit, F.lit(archived)).otherwise(F.col("archived"))}
        if not archived and as_of is not None:
            out["last_referenced_at"] = F.when(hit, F.expr(f"timestamp_ntz '{as_of}'")).otherwise(F.col("last_referenced_at"))
        return out

    return _marked(claims, ids, changes)


def challenge(claims: DataFrame, changes: DataFrame) -> DataFrame:
    """Claims of ``changes`` (id, new_text, new_basis) are challenged, whether or not anything is revised.

    A new text or basis that is neither null nor empty takes effect; of several changes
    of one claim, the greatest such text and basis.
    """
    text, basis = own_name(claims, "new_text"), own_name(claims, "new_basis")
    one = changes.groupBy("id").agg(F.max(F.expr("nullif(new_text, '')")).alias(text), F.max(F.expr("nullif(new_basis, '')")).alias(basis))
    out = _marked(claims, one, lambda hit: {"challenged": F.col("challenged") | hit})
    return out.join(one, "id", "left").withColumns({"text": F.coalesce(text, "text"), "basis": F.coalesce(basis, "basis")}).select(*claims.columns)


def close_claims(claims: DataFrame, ids: DataFrame) -> DataFrame:
    return _marked(claims, ids, lambda hit: {"closed": F.col("closed") | hit})


def delete_project(claims: DataFrame, edges: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """Claims and edges without those of ``project``; an edge goes with either end."""
    gone = claims.where(F.col("project") == project).select("id")
    left = edges.join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(gone.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
    return claims.where(~F.col("project").eqNullSafe(F.lit(project))), left


def audits_of(g: ClaimGraph, findings: DataFrame, sessions: DataFrame, as_of: str) -> DataFrame:
    """An audit row for each of ``sessions`` (project, session_id): sizes of its project's graph, critical findings and how many of each type.

    ``(id, project, session_id, made_at, findings, claim_count, edge_count,
    critical_count)``; the id is a hash of project, session and time, so an audit that
    is made again is the same row. Findings are counted by type, in the order of types.
    """
    sizes = g.claims.groupBy("project").agg(F.count("*").alias("claim_count"))
    edges = g.edges.groupBy(F.col("project").alias("edge_project")).agg(F.count("*").alias("edge_count"))
    each = findings.groupBy(F.col("project").alias("found_project"), "type").agg(F.count("*").alias("n"), F.count_if((F.col("severity") == "critical") & ~F.col("type").startswith("strength_")).alias("critical"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "n"))), lambda t: F.concat(t["type"], F.lit("="), t["n"].cast("string"))), ", ")
    told = each.groupBy("found_project").agg(said.alias("findings"), F.sum("critical").alias("critical_count"))
    rows = sessions.select("project", "session_id").distinct().join(sizes, "project", "left")
    rows = rows.join(edges, rows["project"] == edges["edge_project"], "left").join(told, rows["project"] == told["found_project"], "left")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    key = F.concat_ws(":", "project", F.coalesce("session_id", F.lit("")), F.lit(as_of))
    return rows.select(
        F.concat(F.lit("a"), F.substring(F.sha2(key, 256), 1, 24)).alias("id"), "project", "session_id", F.expr(f"timestamp_ntz '{as_of}'").alias("made_at"),
        F.coalesce("findings", F.lit("")).alias("findings"), none("claim_count"), none("edge_count"), none("critical_count"),
    )


def append_audits(audits: DataFrame, new: DataFrame) -> DataFrame:
    """The audits with new ones; an id that is there stays as it is."""
    return audits.unionByName(new.dropDuplicates(["id"]).join(audits.select("id"), "id", "left_anti").select(*audits.columns))


def without_project(audits: DataFrame, project: str) -> DataFrame:
    """Audits without those of a project that is deleted."""
    return audits.where(~F.col("project").eqNullSafe(F.lit(project)))


#: What an extraction is kept under.
EXTRACTION_KEY = ["content_hash", "model", "prompt_version"]


def cached_extractions(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """``asked`` (content_hash, model, prompt_version, ...) with ``result`` of the latest cache row of all three, null where there is none.

    ``cache`` has the key, result and created_at. A result that is no JSON object is a
    torn write and counts as none; ``torn`` tells, so that its row can be deleted.
    """
    latest = latest_by_key(cache.select(*EXTRACTION_KEY, "result", "created_at"), EXTRACTION_KEY, "created_at")
    whole = F.try_parse_json(F.col("result")).isNotNull() & F.ltrim("result").startswith("{")
    rows = asked.join(latest.drop("created_at"), EXTRACTION_KEY, "left")
    return rows.withColumn("torn", F.col("result").isNotNull() & ~whole).withColumn("result", F.when(~F.col("torn"), F.col("result")))


def delete_extractions(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return cache.join(keys.select(*EXTRACTION_KEY).distinct(), EXTRACTION_KEY, "left_anti").select(*cache.columns)


def unarchive_project(claims: DataFrame, project: str, as_of: str) -> DataFrame:
    """All archived claims of a project taken back, which counts as a reference."""
    hit = F.coalesce("archived", F.lit(False)) & (F.col("project") == project)
    back = F.when(hit, F.expr(f"timestamp_ntz '{as_of}'")).otherwise(F.col("last_referenced_at"))
    return claims.withColumn("last_referenced_at", back).withColumn("archived", F.col("archived") & ~hit)


def delete_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select("id"), "id", "left_anti")


def without_closed(claims: DataFrame) -> DataFrame:
    """Claims that nobody retired; an unknown flag retires nothing."""
    return claims.where(~F.coalesce("closed", F.lit(False)))


def without_superseded(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """Claims of a set without those that a strictly newer one of the set contradicts, both times being known."""
    ends = claims.select("id", "created_at")
    newer = ends.select(F.col("id").alias("from_id"), F.col("created_at").alias("new_at"))
    older = ends.select(F.col("id").alias("to_id"), F.col("created_at").alias("old_at"))
    gone = edges.where("relation = 'contradicts'").join(newer, "from_id").join(older, "to_id").where("new_at > old_at")
    return claims.join(gone.select(F.col("to_id").alias("id")), "id", "left_anti")


def upsert(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``table`` with each key of ``new`` replaced or added; of several new rows of a key, the greatest by its other columns."""
    rest = [c for c in table.columns if c not in key]
    new = new.groupBy(*key).agg(F.max(F.struct(*rest)).alias("row")).select(*key, *[F.col("row")[c].alias(c) for c in rest]) if rest else new.select(*key).distinct()
    return table.join(new.select(*key), key, "left_anti").select(*table.columns).unionByName(new.select(*table.columns))


def log_fires(fires: DataFrame, picked: DataFrame, claims: DataFrame) -> DataFrame:
    """The notification log with what was ``picked`` (id, claim_id, type, fired_at, turn) now.

    Of a doubtful claim from a document the text and basis are kept, to see later
    whether it changed; of any other nothing is.
    """
    now = claims.select(F.col("id").alias("claim_id"), "text", "basis", is_stop_class().alias("stop_class"))
    rows = picked.join(now, "claim_id", "left").withColumn("stop_class", F.coalesce("stop_class", F.lit(False)))
    kept = lambda c, none: F.when(F.col("stop_class"), F.col(c)).otherwise(F.lit(none))
    rows = rows.select("id", "claim_id", "type", "fired_at", "stop_class", kept("text", "").alias("text_at_fire"), kept("basis", "").alias("basis_at_fire"), kept("turn", 0).cast("long").alias("turn_at_fire"))
    return fires.unionByName(rows.select(*fires.columns))


def sweep_stamps(last: DataFrame, swept: DataFrame, as_of: str, hours: float = 24) -> DataFrame:
    """``(project, swept_at)`` after sweeps of ``swept`` (project, overflow): now, or half the interval ago where candidates were left over."""
    now = F.expr(f"timestamp_ntz '{as_of}'")
    half = F.expr(f"timestamp_ntz '{as_of}' - make_dt_interval(0, 0, {int(hours * 30)}, 0)")
    return upsert(last, swept.select("project", F.when(F.col("overflow") > 0, half).otherwise(now).alias("swept_at")), ["project"])


def verified_now(lookups: DataFrame, cache: DataFrame, as_of: str, hit_days: int = 7, miss_hours: int = 1) -> DataFrame:
    """``lookups`` (key, ...) with the fresh outcome of each, if the cache (key, snippet, source, failed, fetched_at) has one.

    ``hit`` says that a search succeeded within ``hit_days``; a failure within
    ``miss_hours`` is ``resting``: not a hit, and not to be asked again yet.
    """
    ago = F.expr(f"timestamp_ntz '{as_of}' - fetched_at")
    latest = latest_by_key(cache.select("key", "snippet", "source", "failed", "fetched_at"), ["key"], "fetched_at")
    out = lookups.join(latest.withColumnRenamed("source", "checked_source"), "key", "left")
    good = F.coalesce(~F.col("failed") & (ago <= F.expr(f"interval '{hit_days}' day")), F.lit(False))
    rest = F.coalesce(F.col("failed") & (ago <= F.expr(f"interval '{miss_hours}' hour")), F.lit(False))
    out = out.withColumns({"hit": good, "resting": rest})
    return out.withColumns({c: F.when(F.col("hit"), F.col(c)) for c in ("snippet", "checked_source")}).drop("failed", "fetched_at")


def external_checks(chosen: DataFrame, claims: DataFrame, checks: DataFrame, secondary: int = 2) -> DataFrame:
    """``chosen`` (project, anchor_id, place) with ``check``, what a search said of its anchor.

    Only doubtful claims from documents are checked (``checks``: claim_id, snippet), the
    first finding of a project always, of the others ``secondary`` that have an answer.
    """
    stop = claims.where(is_stop_class()).select(F.col("id").alias("anchor_id"))
    told = checks.where("snippet <> ''").select(F.col("claim_id").alias("anchor_id"), "snippet").join(stop, "anchor_id", "left_semi")
    rows = chosen.join(told, "anchor_id", "left").withColumn("extra", F.col("snippet").isNotNull() & (F.col("place") > 1))
    nth = F.sum(F.col("extra").cast("int")).over(Window.partitionBy("project").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("check", F.when(~F.col("extra") | (nth <= secondary), truncated("snippet", 220))).drop("extra", "snippet")


def since_turn(marks: DataFrame, counted: DataFrame) -> DataFrame:
    """``(conv, since)``: the turn after which to read; a mark at or beyond the transcript's turns means a new session."""
    rows = counted.join(marks, "conv", "left")
    since = F.coalesce("last_turn", F.lit(0))
    return rows.select("conv", F.when((F.col("turns") > 0) & (since >= F.col("turns")), 0).otherwise(since).alias("since"))


def deliverable(pending: DataFrame, delivered: DataFrame, as_of: str, hours: int = 12) -> DataFrame:
    """The latest pending note of each session, once, unless it is older than ``hours``; ``pending`` has id, session_id, text, made_at."""
    fresh = pending.where(F.expr(f"timestamp_ntz '{as_of}' - made_at <= interval '{hours}' hour"))
    latest = fresh.groupBy("session_id").agg(F.max(F.struct("made_at", "id", "text")).alias("n")).select("session_id", "n.id", "n.text", "n.made_at")
    return latest.where("text <> ''").join(delivered.select("id"), "id", "left_anti")


def event_lines(events: DataFrame, extras: str, fixed: list[str], at: str, as_of: str) -> DataFrame:
    """A JSON line an event: its extras (a map of strings), over which the fixed fields win; a missing time is now."""
    said = F.create_map(*[x for c in fixed for x in (F.lit(c), F.col(c).cast("string"))])
    time = F.create_map(F.lit("ts"), F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(F.lit(as_of).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")))
    extra = F.coalesce(F.col(extras), F.create_map().cast("map<string,string>"))
    own = F.map_filter(extra, lambda k, v: ~k.isin(*fixed))
    has_time = F.map_contains_key(own, F.lit("ts"))
    return events.select(F.to_json(F.when(has_time, F.map_concat(own, said)).otherwise(F.map_concat(own, said, time))).alias("value"))


def latest_by_key(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """The latest row of each key, as an upsert leaves it."""
    rest = [c for c in rows.columns if c not in (*key, at)]
    return rows.groupBy(*key).agg(F.max(F.struct(at, *rest)).alias("_r")).select(*key, "_r.*").select(*rows.columns)


def sweep_candidates(g: ClaimGraph, days: int = 30) -> DataFrame:
    """Claims that nobody needs: old and idle, and closed, or weak with little on them."""
    stale = older_than(g.as_of, days, "created_at") & older_than(g.as_of, days, "last_referenced_at")
    rows = g.weighed.where(stale & (F.col("closed") | ((F.col("n_incoming") < 2) & is_weak())))
    return rows.withColumn("reason", F.when(F.col("closed"), "closed").otherwise("weak"))


def sweep_capped(g: ClaimGraph, cap: int = 1000, days: int = 30) -> DataFrame:
    """The oldest ``cap`` candidates of each project (below one: all), with how many are left over."""
    by = Window.partitionBy("project")
    rows = sweep_candidates(g, days).withColumns({"place": F.row_number().over(by.orderBy("created_at", "id")), "n": F.count("*").over(by)})
    if cap < 1:
        return rows.withColumn("overflow", F.lit(0).cast("long")).drop("n")
    return rows.where(F.col("place") <= cap).withColumn("overflow", F.greatest(F.col("n") - cap, F.lit(0))).drop("n")


def sweep_breakdown(g: ClaimGraph) -> DataFrame:
    """Candidates by basis, by speaker and by reason."""
    facets = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in ("basis", "speaker", "reason")]))
    return sweep_candidates(g).select("project", facets.alias("f")).groupBy("project", "f.facet", "f.value").agg(F.count("*").alias("n"))


def sweep_due(last: DataFrame, as_of: str, hours: float = 24) -> DataFrame:
    """``(project, due)`` of the last sweeps ``(project, swept_at)``: no stamp, one in the future, or one long enough ago."""
    ago = F.expr(f"timestamp_ntz '{as_of}' - swept_at")
    return last.select("project", (F.col("swept_at").isNull() | (ago < F.expr("interval '0' hour")) | (ago >= F.expr(f"make_dt_interval(0, 0, {int(hours * 60)}, 0)"))).alias("due"))


def fires_of_events(events: DataFrame, as_of: str) -> DataFrame:
    """The notification log that is derived from the events table."""
    kinds = F.when(F.col("event_type") == "click", "load_bearing_vibes").when(F.col("event_type") == "view", "fluency_trap").when(F.col("event_type") == "error", "legacy_load_bearer").otherwise("premature_closure")
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("c"), F.col("user_id") % 700).alias("claim_id"),
        kinds.alias("type"),
        F.expr(f"timestamp_ntz '{as_of}' - make_dt_interval(0, cast(event_id % 400 as int))").alias("fired_at"),
        (F.col("event_id") % 3 == 0).alias("stop_class"),
        F.when(F.col("event_id") % 4 == 0, "old").otherwise("").alias("text_at_fire"),
        F.when(F.col("event_id") % 5 == 0, "vibes").otherwise("").alias("basis_at_fire"),
        (F.col("event_id") % 40).alias("turn_at_fire"),
    )


def recent_fires(fires: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """The latest fire of each claim and kind within ``days``."""
    return fires.where(F.expr(f"fired_at >= timestamp_ntz '{as_of}' - interval '{days}' day")).groupBy("claim_id", "type").agg(F.max("fired_at").alias("fired_at"))


def purge_fires(fires: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return fires.where(F.expr(f"fired_at >= timestamp_ntz '{as_of}' - interval '{days}' day"))


def refresh_rate(fires: DataFrame, claims: DataFrame, min_turns: int = 0) -> DataFrame:
    """Per project: fires on doubtful documents, and after how many the claim was changed, by four signals."""
    now = claims.select(F.col("id").alias("claim_id"), "project", "text", "basis", "challenged", "closed")
    last = claims.groupBy("project").agg(F.max("turn_number").alias("last_turn"))
    rows = fires.where("stop_class").join(now, "claim_id").join(last, "project")
    if min_turns > 0:
        rows = rows.where(F.coalesce("last_turn", F.lit(0)) - F.col("turn_at_fire") >= min_turns)
    signals = {
        "challenged": F.col("challenged"),
        "closed": F.col("closed"),
        "text_changed": F.expr("text_at_fire <> '' and text <> text_at_fire"),
        "basis_changed": F.expr("basis_at_fire <> '' and basis <> basis_at_fire"),
    }
    any_of = signals["challenged"] | signals["closed"] | signals["text_changed"] | signals["basis_changed"]
    return rows.groupBy("project").agg(F.count("*").alias("total"), F.count_if(any_of).alias("refreshed"), *[F.count_if(s).alias(n) for n, s in signals.items()])


def eligible(g: ClaimGraph, findings: DataFrame, fires: DataFrame, least_claims: int = 6) -> DataFrame:
    """Findings that may be shown now.

    A kind without a tier isn't shown. A finding rests for a day after its last fire, a
    lasting one for seven; one that isn't lasting is too old once its anchor is seven
    days old. Findings without an anchor are always eligible.
    """
    tier = F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair])
    anchors = g.claims.select(F.col("id").alias("anchor_id"), "created_at", inventory_flagged().alias("flagged"))
    last = fires.groupBy(F.col("claim_id").alias("anchor_id"), "type").agg(F.max("fired_at").alias("fired_at"))
    large = g.claims.groupBy("project").agg(F.count("*").alias("n")).where(F.col("n") >= least_claims)
    rows = findings.where(~F.col("type").startswith("strength_")).withColumn("tier", F.element_at(tier, F.col("type"))).where("tier is not null").join(large, "project", "left_semi")
    rows = rows.join(anchors, "anchor_id", "left").join(last, ["anchor_id", "type"], "left")
    ago = f"timestamp_ntz '{g.as_of}' - fired_at"
    resting = F.when(F.col("persistent"), F.expr(f"{ago} < interval '7' day")).otherwise(F.expr(f"{ago} < interval '24' hour"))
    old = ~F.col("persistent") & F.expr(f"timestamp_ntz '{g.as_of}' - created_at > interval '7' day")
    skip = F.col("anchor_id").isNotNull() & (F.coalesce(resting, F.lit(False)) | F.coalesce(old, F.lit(False)))
    return rows.where(~skip).withColumn("flagged", F.coalesce("flagged", F.lit(False)))


def select_for_hook(g: ClaimGraph, findings: DataFrame, fires: DataFrame, most: int = 5) -> DataFrame:
    """The first ``most`` eligible findings of each project: by tier, flagged anchors first, then in the detectors' order."""
    order = Window.partitionBy("project").orderBy("tier", F.desc("flagged"), "seq", F.asc_nulls_last("anchor_id"))
    return eligible(g, findings, fires).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def fires_on_turn(turn: Column, every: int = 3) -> Column:
    """Whether a turn is one on which to look: the first and every ``every``-th."""
    return (turn == 1) | (turn % every == 0)


def calibration_sessions(g: ClaimGraph) -> DataFrame:
    """Per session: sizes, flags and the longest cascade; closed claims and the empty session count here."""
    bot = F.col("speaker") == "assistant"
    rows = g.claims.groupBy("project", "session_id").agg(
        F.count("*").alias("claims"),
        F.count_if(bot).alias("bots"),
        F.count_if(bot & sycophancy()).alias("flagged"),
        F.count_if((F.col("basis") == "vibes") & ~F.col("challenged") & ~F.col("closed")).alias("weak_claims"),
    )
    longest = g.cascades.groupBy("project", "session_id", "island").agg(F.count("*").alias("n")).groupBy("project", "session_id").agg(F.max("n").alias("longest_run"))
    out = rows.join(longest, ["project", "session_id"], "left")
    return out.withColumns({"flag_rate": F.when(F.col("bots") > 0, F.col("flagged") / F.col("bots")).otherwise(0.0), "longest_run": F.coalesce("longest_run", F.lit(0))})


def calibration_totals(g: ClaimGraph) -> DataFrame:
    user, bot = F.col("speaker") == "user", F.col("speaker") == "assistant"
    either = ("grand_significance", "sentience_claim", "relational_drift", "consequential_action")
    bots = ("unique_connection", "dismisses_counterevidence", "ability_overstatement")
    return g.claims.groupBy("project").agg(
        F.countDistinct(F.coalesce("session_id", F.lit(""))).alias("sessions"),
        F.count_if(bot).alias("bots"),
        F.count_if(user).alias("users"),
        *[F.count_if(F.col(c) & (user | bot)).alias(c) for c in either],
        *[F.count_if(F.col(c) & bot).alias(c) for c in bots],
    )


def threshold_sweep(sessions: DataFrame, thresholds: tuple[int, ...] = (10, 20, 30, 40, 50, 60, 70, 80)) -> DataFrame:
    """How many sessions would fire at each percentage."""
    gate = "claims >= 8 and bots >= 5 and weak_claims >= 2"
    wide = sessions.agg(*[F.count_if(F.expr(gate) & (F.col("flagged") / F.col("bots") * 100 >= t)).alias(str(t)) for t in thresholds])
    pairs = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"`{t}`").alias("sessions")) for t in thresholds])
    return wide.select(F.inline(pairs))
