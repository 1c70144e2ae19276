"""The detectors: each takes a :class:`ClaimGraph` and returns findings.

A finding is ``(project, type, severity, anchor_id, claim_ids, persistent, measure)``;
``claim_ids`` joins the claims by commas and ``measure`` is what the detector counts.
Every detector works on all projects at once. No rows give no findings.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.functions.claims import confidence_ceiling, is_ephemeral, is_recent, is_strong, is_weak, older_than, sycophancy
from claimloom.operators.maintenance import without_closed, without_superseded
from claimloom.plans.betweenness import betweenness
from claimloom.plans.claim_graph import ClaimGraph
from claimloom.plans.staging import stage, stage_told
from claimloom.plans.strong import strongly_connected

#: How many dependents are load, lately and in all, and how many sessions make a claim tested by use.
RECENT_LOAD, TOTAL_LOAD, TESTED_SESSIONS = 2, 8, 3


def _found(rows: DataFrame, kind: str, severity: Column | str, measure: Column | str, persistent: Column | bool = False, anchor: Column | None = None, ids: Column | None = None) -> DataFrame:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    anchor = F.col("id") if anchor is None else anchor
    return rows.select(
        "project",
        F.lit(kind).alias("type"),
        as_column(severity).alias("severity"),
        anchor.alias("anchor_id"),
        (anchor if ids is None else ids).alias("claim_ids"),
        as_column(persistent).alias("persistent"),
        (measure if isinstance(measure, Column) else F.col(measure)).cast("long").alias("measure"),
    )


def _tested_by_use() -> Column:
    return ~F.col("contradicted") & (F.col("sessions") >= TESTED_SESSIONS)


class Rule(NamedTuple):
    """A detector that a row of ``ClaimGraph.weighed`` alone decides."""

    kind: str
    where: Column
    severity: Column | str
    measure: Column | str
    persistent: Column | bool = False


def _detect(g: ClaimGraph, rule: Rule) -> DataFrame:
    return _found(g.weighed.where(rule.where), *rule[:1], *rule[2:])


def _load_bearing_vibes(as_of: str) -> Rule:
    recent = F.col("recent") >= RECENT_LOAD
    lasting = ~recent & (F.col("total") >= TOTAL_LOAD) & ~_tested_by_use()
    return Rule("load_bearing_vibes", is_weak() & (recent | lasting) & ~is_ephemeral(), "critical", F.when(recent, F.col("recent")).otherwise(F.col("total")), ~recent)


def _fluency_trap(as_of: str) -> Rule:
    recent = F.col("recent") >= 1
    lasting = ~recent & (F.col("total") >= TOTAL_LOAD) & ~_tested_by_use()
    hit = ~F.col("challenged") & (recent | lasting) & ~is_ephemeral() & (F.col("confidence") > confidence_ceiling())
    return Rule("fluency_trap", hit, "critical", F.when(recent, F.col("recent")).otherwise(F.col("total")), ~recent)


def _legacy_load_bearer(as_of: str) -> Rule:
    idle = ~older_than(as_of, 7, "last_referenced_at") | F.expr(f"timestamp_ntz '{as_of}' - last_referenced_at = interval '7' day")
    return Rule("legacy_load_bearer", older_than(as_of, 30, "created_at") & idle & ~F.col("closed") & (F.col("n_incoming") >= 2), "warning", "n_incoming", True)


def _ability_overstatement(as_of: str) -> Rule:
    return Rule("ability_overstatement", F.expr("not closed and not challenged and ability_overstatement and speaker = 'assistant'"), F.when(F.col("total") >= 2, "warning").otherwise("info"), "total")


def _sentience_drift(as_of: str) -> Rule:
    hit = F.expr("speaker = 'assistant' and not closed and not challenged and (sentience_claim or relational_drift)")
    return Rule("sentience_drift", hit, F.when((F.col("total") >= 2) | (F.col("drifting") >= 3), "warning").otherwise("info"), "drifting")


def _consequential_action(as_of: str) -> Rule:
    severity = F.when((F.col("flagged") >= 3) & ~F.col("grounded"), "critical").when(F.col("flagged") >= 2, "warning").otherwise("info")
    return Rule("consequential_action", F.expr("not closed and not challenged and consequential_action"), severity, "flagged")


def _well_sourced_load_bearer(as_of: str) -> Rule:
    return Rule("strength_well_sourced_load_bearer", is_strong() & (F.col("total") >= 2), "info", "total")


def _productive_stress_test(as_of: str) -> Rule:
    return Rule("strength_productive_stress_test", F.expr("(challenged or pushed_back) and has_in and has_out"), "info", "degree")


def _grounded_premise_adopted(as_of: str) -> Rule:
    return Rule("strength_grounded_premise_adopted", (F.col("speaker") == "user") & is_strong() & (F.col("adoptions") >= 2), "info", "adoptions")


def _orphan(as_of: str) -> Rule:
    return Rule("orphan", F.col("degree") == 0, "warning", F.lit(0))


def load_bearing_vibes(g: ClaimGraph) -> DataFrame:
    """Weak claims on which others rest, lately or by their number."""
    return _detect(g, _load_bearing_vibes(g.as_of))


def fluency_trap(g: ClaimGraph) -> DataFrame:
    """Unchallenged claims with dependents whose confidence passes what their basis supports."""
    return _detect(g, _fluency_trap(g.as_of))


def legacy_load_bearer(g: ClaimGraph) -> DataFrame:
    """Old open claims that are still referred to and carry structural edges."""
    return _detect(g, _legacy_load_bearer(g.as_of))


def ability_overstatement(g: ClaimGraph) -> DataFrame:
    return _detect(g, _ability_overstatement(g.as_of))


def sentience_drift(g: ClaimGraph) -> DataFrame:
    return _detect(g, _sentience_drift(g.as_of))


def consequential_action(g: ClaimGraph) -> DataFrame:
    """Announced actions, graded by their session's flags and whether anything there is grounded."""
    return _detect(g, _consequential_action(g.as_of))


def well_sourced_load_bearer(g: ClaimGraph) -> DataFrame:
    return _detect(g, _well_sourced_load_bearer(g.as_of))


def productive_stress_test(g: ClaimGraph) -> DataFrame:
    return _detect(g, _productive_stress_test(g.as_of))


def grounded_premise_adopted(g: ClaimGraph) -> DataFrame:
    return _detect(g, _grounded_premise_adopted(g.as_of))


def orphan(g: ClaimGraph) -> DataFrame:
    """Claims that no edge touches."""
    return _detect(g, _orphan(g.as_of))


def coverage_imbalance(g: ClaimGraph) -> DataFrame:
    """Clusters with much attention and little importance, or the reverse."""
    by = Window.partitionBy("project")
    rows = g.clusters.withColumns({"n": F.count("*").over(by), "most_imp": F.max("importance").over(by), "most_att": F.max("attention").over(by)})
    rows = rows.where("n >= 2 and most_imp > 0 and most_att > 0 and size >= 3")
    rows = rows.withColumns({"imp": F.col("importance") / F.col("most_imp"), "att": F.col("attention") / F.col("most_att")})
    rows = rows.where("(att > 0.7 and imp < 0.3) or (imp > 0.7 and att < 0.3)")
    return _found(rows, "coverage_imbalance", "warning", "size", anchor=F.get("members", 0), ids=F.array_join("members", ","))


def abandoned_topic(g: ClaimGraph) -> DataFrame:
    """Clusters without a claim of the session that began last."""
    first = g.claims.groupBy("project", "session_id").agg(F.min("created_at").alias("began"))
    latest = first.groupBy("project").agg(F.max_by("session_id", F.struct(F.col("began").isNotNull(), "began", "session_id")).alias("latest"), F.count("*").alias("sessions"))
    inside = g.claims.join(g.components, "id").join(latest.where("sessions >= 2"), "project")
    live = inside.groupBy("project", "component").agg(F.bool_or(F.col("session_id") == F.col("latest")).alias("live"))
    rows = g.clusters.join(live.where("not live"), ["project", "component"])
    return _found(rows, "abandoned_topic", "info", "size", anchor=F.get("members", 0), ids=F.array_join("members", ","))


def echo_chamber(g: ClaimGraph) -> DataFrame:
    """Projects without any disagreement between speakers, or with many weak user claims of which none was challenged."""
    user, bot = F.col("speaker") == "user", F.col("speaker") == "assistant"
    sides = g.claims.groupBy("project").agg(
        F.count("*").alias("n"),
        F.count_if(user).alias("users"),
        F.count_if(bot).alias("bots"),
        F.count_if(user & is_weak()).alias("weak"),
        F.count_if(user & F.col("challenged")).alias("challenged"),
        F.countDistinct(F.coalesce("session_id", F.lit(""))).alias("sessions"),
    )
    speakers = g.claims.select("id", "speaker")
    across = (
        g.edges.where("relation in ('contradicts', 'questions')")
        .join(speakers.withColumnsRenamed({"id": "from_id", "speaker": "a"}), "from_id")
        .join(speakers.withColumnsRenamed({"id": "to_id", "speaker": "b"}), "to_id")
        .where("a <> b")
        .groupBy("project")
        .agg(F.count("*").alias("disputes"))
    )
    rows = sides.where("n >= 10").join(across, "project", "left")
    silent = rows.where("disputes is null and users >= 10 and bots >= 10")
    unasked = rows.where("weak >= 3 and challenged = 0 and sessions >= 2 and weak / users > 0.5")
    none = F.lit(None).cast("string")
    return _found(silent, "echo_chamber", "warning", "users", anchor=none).unionByName(_found(unasked, "echo_chamber", "warning", "weak", anchor=none))


def premature_closure(g: ClaimGraph) -> DataFrame:
    """The first three leaves of a project that end a line of thought with weak claims one or two steps up."""
    up = g.dependents.select(F.col("dep").alias("id"), F.col("anchor").alias("up"))
    doubtful = g.claims.where(is_weak() & ~F.col("challenged")).select(F.col("id").alias("up"))
    near = up.join(doubtful, "up", "left_semi").select("id")
    far = up.join(up.select(F.col("id").alias("up"), F.col("up").alias("above")), "up").join(doubtful.withColumnRenamed("up", "above"), "above", "left_semi").select("id")
    caps = near.unionByName(far).distinct().withColumn("caps", F.lit(True))
    leaves = g.claims.join(g.dependents.select(F.col("anchor").alias("id")), "id", "left_anti").join(caps, "id", "left")
    leaves = leaves.withColumn("caps", F.coalesce("caps", F.lit(False))).where((is_weak() | F.col("terminates_inquiry")) & (F.col("terminates_inquiry") | F.col("caps")))
    order = Window.partitionBy("project").orderBy("created_at", "id")
    rows = leaves.withColumn("place", F.row_number().over(order)).join(g.claims.groupBy("project").agg(F.count("*").alias("claims")), "project").where("place <= 3 and claims >= 3")
    return _found(rows, "premature_closure", F.when(F.col("terminates_inquiry") & F.col("caps"), "warning").otherwise("info"), "place")


def sycophancy_saturation(g: ClaimGraph) -> DataFrame:
    """Sessions in which assistant claims are flagged at a high rate beside weak claims that stand."""
    flags = sum((F.col(c).cast("int") for c in ("grand_significance", "unique_connection", "dismisses_counterevidence")), F.lit(0))
    bot = (F.col("speaker") == "assistant") & ~F.col("closed")
    rows = (
        g.claims.where("session_id <> ''")
        .withColumns({"flags": flags, "bot": bot})
        .groupBy("project", "session_id")
        .agg(
            F.count("*").alias("n"),
            F.count_if("bot").alias("bots"),
            F.count_if(F.col("bot") & sycophancy()).alias("flagged"),
            F.count_if(~F.col("closed") & ~F.col("challenged") & (F.col("basis") == "vibes")).alias("weak"),
            F.min(F.when(F.col("bot") & sycophancy(), F.struct(-F.col("flags"), "created_at", "id"))).alias("top"),
        )
        .where("n >= 8 and bots >= 5 and flagged / bots >= 0.30 and weak >= 2")
    )
    return _found(rows, "sycophancy_saturation", "warning", "flagged", anchor=F.col("top.id"))


def amplification_cascade(g: ClaimGraph) -> DataFrame:
    """Runs of three or more flagged claims of a session, one of an assistant at least, that no pushback breaks."""
    runs = g.cascades.groupBy("project", "session_id", "island").agg(
        F.count("*").alias("n"),
        F.bool_or(F.col("speaker") == "assistant").alias("bot"),
        F.array_sort(F.collect_list(F.struct("turn_number", "created_at", "id"))).alias("run"),
    )
    rows = runs.where("n >= 3 and bot")
    return _found(rows, "amplification_cascade", "warning", "n", anchor=F.get("run.id", 0), ids=F.array_join("run.id", ","))


def recent_pairs(g: ClaimGraph) -> DataFrame:
    """``(project, a, b, ways)``: the pairs of claims that edges with a recent end join, and how many do."""
    recent = g.claims.where(is_recent(g.as_of)).select("id")
    touched = g.edges.join(recent.withColumnRenamed("id", "from_id"), "from_id", "left_semi").select("from_id", "to_id", "project")
    touched = touched.unionByName(g.edges.join(recent.withColumnRenamed("id", "to_id"), "to_id", "left_semi").join(recent.withColumnRenamed("id", "from_id"), "from_id", "left_anti").select("from_id", "to_id", "project"))
    return touched.groupBy("project", F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).agg(F.count("*").alias("ways")).where("a <> b")


def bottleneck(g: ClaimGraph, small: int = 200_000) -> DataFrame:
    """Claims through which unusually many shortest paths of the recent graph run.

    The recent graph keeps edges with a recent end, undirected, parallel edges
    multiplying paths. A project of at most ``small`` pairs is searched in tasks that
    hold its pairs; larger ones in rounds of joins. A score at least 1 and two
    population deviations above the mean of the claims that others reach is a finding.
    """
    pairs = stage(recent_pairs(g), "recent-pairs").df
    scores = betweenness(pairs, small)
    by = Window.partitionBy("project")
    bar = F.greatest(F.lit(1.0), F.avg("score").over(by) + 2 * F.stddev_pop("score").over(by))
    high = scores.withColumn("bar", bar).where("score >= bar").select("id", "score")
    sizes = g.claims.groupBy("project").agg(F.count("*").alias("n")).where("n >= 8")
    rows = g.claims.join(high, "id").join(sizes.select("project"), "project", "left_semi")
    return _found(rows, "bottleneck", F.when(F.col("challenged"), "info").otherwise("warning"), F.round("score"))


def _heights(steps: DataFrame, known: DataFrame, at_once: int, max_length: int) -> tuple[DataFrame, int]:
    """``known`` (id, height, next) with every claim all of whose heads have a height, and how many rows that is.

    A height says how many claims a longest chain has; of equally high heads the one of
    the least id is next. ``at_once`` rounds are one job, over the claims still open.
    """
    staged, totals = stage_told(known, "chain-heights", n=F.count("*"))
    for _ in range(0, max_length, at_once):
        known, before = staged.df, totals["n"]
        open_ = steps.join(known.select(F.col("id").alias("from_id")), "from_id", "left_anti")
        now = known
        for _ in range(at_once):
            heads = now.select(F.col("id").alias("to_id"), F.col("height").alias("h"))
            tails = open_.join(heads, "to_id", "left").groupBy(F.col("from_id").alias("id")).agg(F.bool_and(F.col("h").isNotNull()).alias("ready"), F.min(F.struct(-F.col("h"), "to_id")).alias("best"))
            now = known.unionByName(tails.where("ready").select("id", (1 - F.col("best.col1")).cast("int").alias("height"), F.col("best.to_id").alias("next")))
        staged, totals = stage_told(now, "chain-heights", n=F.count("*"))
        if totals["n"] == before:
            return staged.df, before
    raise RuntimeError(f"chains of more than {max_length} claims; raise max_length to find them")


def _through_cycles(members: DataFrame, steps: DataFrame, known: DataFrame, max_paths: int) -> DataFrame:
    """``(id, height, path, over)`` of the claims ``members`` (id, component), all of whose other heads are known.

    From each, every simple path within its component is walked, a step a round; it may
    end anywhere, or go over to the highest head outside. Of equally long chains the
    one with the least ids is kept.
    """
    of = members.select("id", "component")
    ends = steps.join(of.select(F.col("id").alias("from_id"), F.col("component").alias("c")), "from_id").join(of.select(F.col("id").alias("to_id"), F.col("component").alias("d")), "to_id", "left")
    inner = stage(ends.where("c = d").select("from_id", "to_id"), "cycle-steps").df
    beyond = ends.where("d is null or c <> d").join(known.select(F.col("id").alias("to_id"), "height"), "to_id").groupBy(F.col("from_id").alias("end")).agg(F.min(F.struct(-F.col("height"), "to_id")).alias("b"))
    beyond = stage(beyond.select("end", (-F.col("b.col1")).alias("h"), F.col("b.to_id").alias("over")), "cycle-ends").df
    staged, totals = stage_told(members.select("id", F.array("id").alias("path"), F.col("id").alias("end")), "cycle-paths", n=F.count("*"))
    best = None
    while totals["n"]:
        if totals["n"] > max_paths:
            raise RuntimeError(f"{totals['n']} open paths through cycles; raise max_paths to search them all")
        paths = staged.df
        here = paths.join(beyond, "end", "left").select("id", (F.size("path") + F.coalesce("h", F.lit(0))).alias("height"), "path", "over")
        both = here if best is None else best.unionByName(here)
        rank = F.struct(-F.col("height"), F.concat("path", F.array_compact(F.array("over"))), "path", "over")
        best = stage(both.groupBy("id").agg(F.min(rank).alias("b")).select("id", (-F.col("b.col1")).cast("int").alias("height"), "b.path", "b.over"), "cycle-best").df
        longer = paths.join(inner, F.col("end") == F.col("from_id")).where("not array_contains(path, to_id)")
        staged, totals = stage_told(longer.select("id", F.concat("path", F.array("to_id")).alias("path"), F.col("to_id").alias("end")), "cycle-paths", n=F.count("*"))
    return best


def _followed(starts: DataFrame, known: DataFrame) -> DataFrame:
    """``(project, ids)``: the chain of each start ``(project, id, length)`` along ``next``, by jumps of powers of two."""
    longest = starts.agg(F.max("length")).first()[0] or 0
    rows = starts.select("project", "id", F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("place"))
    jump = known.where("next is not null").select(F.col("id").alias("was"), F.col("next").alias("to"))
    for bit in range(max(0, longest - 1).bit_length()):
        rows = rows.join(jump, (F.col("id") == F.col("was")) & (F.col("place").bitwiseAND(1 << bit) > 0), "left").select("project", F.coalesce("to", "id").alias("id"), "place")
        further = jump.select(F.col("was").alias("mid"), F.col("to").alias("end"))
        jump = stage(jump.join(further, F.col("to") == F.col("mid")).select("was", F.col("end").alias("to")), "chain-jumps").df
    return rows.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("place", "id")))["id"].alias("ids"))


def unchallenged_chain(g: ClaimGraph, max_length: int = 2000, max_paths: int = 5_000_000, at_once: int = 6) -> DataFrame:
    """The longest chain of each project, of three claims or more, that nobody challenged or pushed back on.

    Chains follow structural edges from tail to head. Claims get the height of their
    longest chain by rounds of joins. Where cycles hold claims back, paths are searched
    within a strong component alone, once what lies below it is known, and heights go on
    above it; so a long way above a cycle costs rounds, not paths. More than
    ``max_paths`` open paths at a time, or rounds beyond ``max_length``, raise. Only the
    winning chains are followed. Of equal chains the one with the least ids, from its
    start, is returned.
    """
    good = g.claims.where("not challenged").select("id", "project").join(g.marks.where("pushed_back").select("id"), "id", "left_anti")
    # an id that is there twice counts once, or what is known never comes up to what there is
    staged, totals = stage_told(good.groupBy("id").agg(F.min("project").alias("project")), "chain-claims", n=F.count("*"))
    good = staged.df
    steps = g.edges.where("relation in ('supports', 'depends_on') and from_id <> to_id").select("from_id", "to_id").distinct()
    steps = stage(steps.join(good.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(good.select(F.col("id").alias("to_id")), "to_id", "left_semi"), "chain-steps").df
    leaves = good.join(steps.select(F.col("from_id").alias("id")), "id", "left_anti").select("id", F.lit(1).alias("height"), F.lit(None).cast("string").alias("next"))
    known, n = _heights(steps, leaves, at_once, max_length)
    # the further claims of a path through a cycle stand under ids of their own, so that every claim has one next
    stands = None
    if n < totals["n"]:
        held = steps.join(known.select(F.col("id").alias("from_id")), "from_id", "left_anti")
        cycles = strongly_connected(held, "from_id", "to_id").select(F.col("node").alias("id"), "component")
        cycles = stage(cycles, "chain-cycles").df
        virtual = 0
        while n - virtual < totals["n"]:
            heads = steps.join(cycles.withColumnRenamed("id", "from_id"), "from_id").join(cycles.select(F.col("id").alias("to_id"), F.col("component").alias("d")), "to_id", "left")
            waits = heads.where("d is null or d <> component").join(known.select(F.col("id").alias("to_id")), "to_id", "left_anti").select("component").distinct()
            ready = cycles.join(waits, "component", "left_anti").join(known.select("id"), "id", "left_anti")
            through = stage(_through_cycles(stage(ready, "chain-ready").df, steps, known, max_paths), "chain-through").df
            place = lambda i: F.when(i == 0, F.col("id")).otherwise(F.concat("id", F.lit("\0"), i.cast("string")))
            rows = through.select("id", "height", "over", F.size("path").alias("n"), F.posexplode("path").alias("i", "claim"))
            after = F.when(F.col("i") + 1 < F.col("n"), place(F.col("i") + 1)).otherwise(F.col("over"))
            rows = stage(rows.select(place(F.col("i")).alias("id"), (F.col("height") - F.col("i")).cast("int").alias("height"), after.alias("next"), "claim", (F.col("i") > 0).alias("virtual")), "chain-stands").df
            stands = rows.select("id", "claim") if stands is None else stands.unionByName(rows.select("id", "claim"))
            virtual += rows.where("virtual").count()
            known, n = _heights(steps, known.unionByName(rows.select("id", "height", "next")), at_once, max_length)
    best = known.where("height >= 3").join(good, "id").groupBy("project").agg(F.min(F.struct(-F.col("height"), "id")).alias("b"))
    starts = stage(best.select("project", (-F.col("b.col1")).alias("length"), "b.id"), "chain-winners").df
    if stands is None:
        chains = _followed(starts, known)
    else:
        ids = _followed(starts, known).select("project", F.posexplode("ids").alias("place", "id")).join(stands, "id", "left")
        chains = ids.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("claim", "id").alias("id"))))["id"].alias("ids"))
    whole = starts.select("project", "length").join(chains.withColumnRenamed("project", "its_project"), F.col("project").eqNullSafe(F.col("its_project")))
    return _found(whole, "unchallenged_chain", "warning", "length", anchor=F.get("ids", 0), ids=F.array_join("ids", ","))


#: In the order in which findings are listed.
DETECTORS = {
    f.__name__: f
    for f in (
        load_bearing_vibes, bottleneck, unchallenged_chain, fluency_trap, coverage_imbalance, abandoned_topic, echo_chamber, premature_closure,
        legacy_load_bearer, sycophancy_saturation, ability_overstatement, sentience_drift, amplification_cascade, consequential_action,
        well_sourced_load_bearer, productive_stress_test, grounded_premise_adopted, orphan,
    )
}


#: Those of them that rows of ``weighed`` decide.
RULES = {
    f.__name__[1:]: f
    for f in (
        _load_bearing_vibes, _fluency_trap, _legacy_load_bearer, _ability_overstatement, _sentience_drift, _consequential_action,
        _well_sourced_load_bearer, _productive_stress_test, _grounded_premise_adopted, _orphan,
    )
}


def _by_row(g: ClaimGraph, names: list[str]) -> DataFrame:
    """Findings of all rules that ``names`` lists, in one pass over the claims."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    found = []
    for seq, name in enumerate(DETECTORS):
        if name in names:
            rule = RULES[name](g.as_of)
            measure = rule.measure if isinstance(rule.measure, Column) else F.col(rule.measure)
            finding = F.struct(
                F.lit(rule.kind).alias("type"), as_column(rule.severity).alias("severity"), as_column(rule.persistent).alias("persistent"), measure.cast("long").alias("measure"), F.lit(seq).alias("seq")
            )
            found.append(F.when(rule.where, finding))
    rows = g.weighed.select("project", "id", F.explode(F.array_compact(F.array(*found))).alias("f"))
    return rows.select("project", "f.type", "f.severity", F.col("id").alias("anchor_id"), F.col("id").alias("claim_ids"), "f.persistent", "f.measure", "f.seq")


def findings(g: ClaimGraph, names: tuple[str, ...] | None = None) -> DataFrame:
    """All findings, each with its detector's place as ``seq``; they and the frames that detectors share are written once.

    Components, centrality and chains go round by round and don't need each other, so
    each is started on a thread of its own; their jobs share the cluster.
    """
    wanted = [n for n in DETECTORS if names is None or n in names]
    fresh, g = not g.is_staged, g.partly_staged()
    with ThreadPoolExecutor(3) as pool:
        start = lambda f, *args: pool.submit(copy_context().run, inheritable_thread_target(g.claims.sparkSession)(f), *args)
        clusters = start(g.stage_clusters) if fresh else None
        slow = {name: start(DETECTORS[name], g) for name in (unchallenged_chain.__name__, bottleneck.__name__) if name in wanted}
        if clusters:
            clusters.result()
        slow = {name: job.result() for name, job in slow.items()}
    out = _by_row(g, [n for n in wanted if n in RULES]) if any(n in RULES for n in wanted) else None
    for seq, (name, detect) in enumerate(DETECTORS.items()):
        if name in wanted and name not in RULES:
            part = (slow[name] if name in slow else detect(g)).withColumn("seq", F.lit(seq))
            out = part if out is None else out.unionByName(part)
    return out if out is None else stage(out, "findings").df


def session_findings(claims: DataFrame, edges: DataFrame, bridge: DataFrame, session_id: str, as_of: str) -> DataFrame:
    """All findings over one session's own claims, those that are closed or that a newer one of them contradicts left out.

    Claims are those that ``bridge`` (session_id, claim_id) gives the session and that
    aren't archived; edges are those between them. A session of which nothing is left
    has no findings.
    """
    mine = bridge.where(F.col("session_id") == session_id).select(F.col("claim_id").alias("id")).distinct()
    active = claims.where(~F.coalesce("archived", F.lit(False))).join(mine, "id", "left_semi")
    inner = edges.join(active.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(active.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    live = without_superseded(without_closed(active), inner)
    return findings(ClaimGraph(live.select(*claims.columns), inner.select(*edges.columns), as_of))
