"""Queries over the derived claim graph, each with the SQL that it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.functions.claims import STATUS_PATTERNS
from claimloom.operators import detectors as D
from claimloom.operators import maintenance as M
from claimloom.operators import scans as S
from claimloom.plans.claim_graph import ClaimGraph
from claimloom.sources import derived

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_STATUS = " or ".join(f"regexp_matches(text, '{p}')" for p in STATUS_PATTERNS)
#: What most oracles build on.
BASE = (
    "with recursive "
    + derived.ORACLE
    + f""",
pe as (select e.*, c.project from edges e join claims c on c.id = e.from_id),
dep as (select case when relation = 'supports' then from_id else to_id end as anchor, case when relation = 'supports' then to_id else from_id end as dep, project
    from pe where relation in ('supports', 'depends_on')),
dc as (select anchor as id, count(*) as total, count_if(c.created_at is null or as_of - c.created_at <= interval 6 hour) as recent,
    count(distinct nullif(c.session_id, '')) as sessions from dep left join claims c on c.id = dep.dep cross join now_ group by 1),
inc as (select to_id as id, count(*) as n_incoming from edges where relation in ('supports', 'depends_on') group by 1),
ends as (select from_id as id, false as head, relation from edges union all select to_id, true, relation from edges),
mk as (select id, bool_or(head and relation in ('contradicts', 'questions')) as pushed_back, bool_or(relation = 'contradicts') as contradicted,
    bool_or(head and relation in ('supports', 'depends_on')) as has_in, bool_or(not head and relation in ('supports', 'depends_on')) as has_out, count(*) as degree from ends group by 1),
w as (select c.*, coalesce(total, 0) as total, coalesce(recent, 0) as recent, coalesce(sessions, 0) as sessions, coalesce(n_incoming, 0) as n_incoming,
    coalesce(pushed_back, false) as pushed_back, coalesce(contradicted, false) as contradicted, coalesce(has_in, false) as has_in, coalesce(has_out, false) as has_out,
    coalesce(degree, 0) as degree, basis in ('vibes', 'assumption', 'llm_output') as weak, basis in ('research', 'empirical', 'deduction', 'definition', 'convention') as strong,
    grand_significance or unique_connection or dismisses_counterevidence as syc,
    grand_significance or unique_connection or dismisses_counterevidence or ability_overstatement or sentience_claim or relational_drift as moore,
    {_STATUS} as status
    from claims c left join dc using (id) left join inc using (id) left join mk using (id))
"""
)
_PAIRS = "both_ as (select from_id as a, to_id as b from edges union select to_id, from_id from edges), reach as (select id as a, id as b from claims union select r.a, e.b from reach r join both_ e on r.b = e.a), comp as (select a as id, min(b) as component from reach group by 1 having count(*) > 1)"
_CLUSTERS = (
    _PAIRS
    + """,
cl as (select c.project, component, count(*) as size, coalesce(sum(total), 0) as importance, list_sort(list(c.id)) as members from w c join comp using (id) group by 1, 2),
ce as (select component, count(*) as n_edges from edges e join comp on comp.id = e.from_id group by 1),
clu as (select cl.*, n_edges, size + n_edges as attention from cl join ce using (component))
"""
)


def _detector(name: str, kind: str, select: str, more: str = "") -> str:
    """Registers a detector; ``select`` gives severity, anchor_id, claim_ids, persistent, measure and what follows FROM."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return D.DETECTORS[name](graph(spark, sf_dir))

    QUERIES[f"detect_{name}"] = run
    body = f"select project, '{kind}' as type, {select}"
    ORACLES[f"detect_{name}"] = BASE + (", " + more if more else "") + body
    return body


def graph(spark: SparkSession, sf_dir: str) -> ClaimGraph:
    return ClaimGraph(derived.claims(spark, sf_dir), derived.edges(spark, sf_dir), derived.AS_OF)


def query(name: str, sql: str | None, base: bool = True):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = (BASE if base else "") + sql
        return f

    return add


_ONE = "id as anchor_id, id as claim_ids"
_TESTED = "(not contradicted and sessions >= 3)"
_BODIES = {
    "load_bearing_vibes": (_detector(
        "load_bearing_vibes", "load_bearing_vibes",
        f"'critical' as severity, {_ONE}, recent < 2 as persistent, cast(case when recent >= 2 then recent else total end as bigint) as measure from w where weak and not status and (recent >= 2 or (total >= 8 and not {_TESTED}))"), ""),
    "fluency_trap": (_detector(
        "fluency_trap", "fluency_trap",
        f"'critical' as severity, {_ONE}, recent < 1 as persistent, cast(case when recent >= 1 then recent else total end as bigint) as measure from w where not challenged and not status and (recent >= 1 or (total >= 8 and not {_TESTED})) and confidence > case when basis in ('research', 'empirical', 'deduction') then 0.95 when basis in ('definition', 'convention') then 1.0 when basis = 'analogy' then 0.7 else 0.5 end"), ""),
    "legacy_load_bearer": (_detector(
        "legacy_load_bearer", "legacy_load_bearer",
        f"'warning' as severity, {_ONE}, true as persistent, n_incoming as measure from w, now_ where not closed and as_of - created_at >= interval 30 day and as_of - last_referenced_at <= interval 7 day and n_incoming >= 2"), ""),
    "ability_overstatement": (_detector(
        "ability_overstatement", "ability_overstatement",
        f"case when total >= 2 then 'warning' else 'info' end as severity, {_ONE}, false as persistent, cast(total as bigint) as measure from w where not closed and not challenged and ability_overstatement and speaker = 'assistant'"), ""),
    "sentience_drift": (_detector(
        "sentience_drift", "sentience_drift",
        f"case when total >= 2 or k >= 3 then 'warning' else 'info' end as severity, {_ONE}, false as persistent, k as measure from (select *, count(*) over (partition by project, session_id) as k from w where speaker = 'assistant' and not closed and (sentience_claim or relational_drift)) where not challenged"), ""),
    "consequential_action": (_detector(
        "consequential_action", "consequential_action",
        f"case when k >= 3 and not r then 'critical' when k >= 2 then 'warning' else 'info' end as severity, {_ONE}, false as persistent, cast(k as bigint) as measure from (select *, count_if(moore) over (partition by project, session_id) as k, bool_or(basis in ('research', 'empirical')) over (partition by project, session_id) as r from w where not closed and not challenged) where consequential_action"), ""),
    "well_sourced_load_bearer": (_detector(
        "well_sourced_load_bearer", "strength_well_sourced_load_bearer",
        f"'info' as severity, {_ONE}, false as persistent, total as measure from w where strong and total >= 2"), ""),
    "productive_stress_test": (_detector(
        "productive_stress_test", "strength_productive_stress_test",
        f"'info' as severity, {_ONE}, false as persistent, degree as measure from w where (challenged or pushed_back) and has_in and has_out"), ""),
    "grounded_premise_adopted": (_detector(
        "grounded_premise_adopted", "strength_grounded_premise_adopted",
        f"'info' as severity, {_ONE}, false as persistent, k as measure from w join (select to_id, count(*) as k from edges e join claims f on f.id = e.from_id where relation in ('supports', 'depends_on') and f.speaker = 'assistant' group by 1) on to_id = id where speaker = 'user' and strong and k >= 2"), ""),
    "orphan": (_detector(
        "orphan", "orphan", f"'warning' as severity, {_ONE}, false as persistent, cast(0 as bigint) as measure from w where degree = 0"), ""),
    "echo_chamber": (_detector(
        "echo_chamber", "echo_chamber",
        "'warning' as severity, cast(null as varchar) as anchor_id, cast(null as varchar) as claim_ids, false as persistent, measure from ("
        "select s.project, users as measure from sides s where n >= 10 and users >= 10 and bots >= 10 and project not in (select project from across) "
        "union all select project, wk from sides where n >= 10 and wk >= 3 and ch = 0 and ses >= 2 and wk / users > 0.5)",
        more := "sides as (select project, count(*) as n, count_if(speaker = 'user') as users, count_if(speaker = 'assistant') as bots, count_if(speaker = 'user' and weak) as wk, count_if(speaker = 'user' and challenged) as ch, count(distinct session_id) as ses from w group by 1), "
        "across as (select distinct pe.project from pe join claims a on a.id = from_id join claims b on b.id = to_id where relation in ('contradicts', 'questions') and a.speaker <> b.speaker) "), more),
    "premature_closure": (_detector(
        "premature_closure", "premature_closure",
        f"case when terminates_inquiry and caps then 'warning' else 'info' end as severity, {_ONE}, false as persistent, place as measure from closing join (select project, count(*) as k from claims group by 1) using (project) where place <= 3 and k >= 3",
        more := "doubt as (select id from w where weak and not challenged), capped as (select dep as id from dep where anchor in (from doubt) union select x.dep from dep x join dep y on y.dep = x.anchor where y.anchor in (from doubt)), "
        "closing as (select *, row_number() over (partition by project order by created_at, id) as place from (select w.*, id in (from capped) as caps from w where total = 0) where (weak or terminates_inquiry) and (terminates_inquiry or caps)) "), more),
    "sycophancy_saturation": (_detector(
        "sycophancy_saturation", "sycophancy_saturation",
        "'warning' as severity, top as anchor_id, top as claim_ids, false as persistent, fl as measure from sat where n >= 8 and bots >= 5 and fl / bots >= 0.30 and wk >= 2",
        more := "sat as (select project, session_id, count(*) as n, count_if(speaker = 'assistant' and not closed) as bots, count_if(speaker = 'assistant' and not closed and syc) as fl, count_if(not closed and not challenged and basis = 'vibes') as wk, "
        "first(id order by grand_significance::int + unique_connection::int + dismisses_counterevidence::int desc, created_at, id) filter (speaker = 'assistant' and not closed and syc) as top from w where session_id <> '' group by 1, 2) "), more),
    "amplification_cascade": (_detector(
        "amplification_cascade", "amplification_cascade",
        "'warning' as severity, run[1] as anchor_id, array_to_string(run, ',') as claim_ids, false as persistent, n as measure from runs where n >= 3 and bot",
        more := "fits as (select *, not closed and not challenged and not pushed_back and case speaker when 'assistant' then moore when 'user' then grand_significance or sentience_claim or relational_drift else false end as fit from w), "
        "isl as (select *, sum((not fit)::int) over (partition by project, session_id order by turn_number, created_at, id rows unbounded preceding) as island from fits), "
        "runs as (select project, session_id, island, count(*) as n, bool_or(speaker = 'assistant') as bot, list(id order by turn_number, created_at, id) as run from isl where fit group by 1, 2, 3) "), more),
    "coverage_imbalance": (_detector(
        "coverage_imbalance", "coverage_imbalance",
        "'warning' as severity, members[1] as anchor_id, array_to_string(members, ',') as claim_ids, false as persistent, size as measure from (select *, importance / max(importance) over (partition by project) as imp, attention / max(attention) over (partition by project) as att, count(*) over (partition by project) as k, max(importance) over (partition by project) as mi from clu) where k >= 2 and mi > 0 and size >= 3 and ((att > 0.7 and imp < 0.3) or (imp > 0.7 and att < 0.3))",
        _CLUSTERS), _CLUSTERS),
    "abandoned_topic": (_detector(
        "abandoned_topic", "abandoned_topic",
        "'info' as severity, members[1] as anchor_id, array_to_string(members, ',') as claim_ids, false as persistent, size as measure from clu join latest using (project) where k >= 2 and not exists (select 1 from claims c where c.session_id = latest.session_id and list_contains(members, c.id))",
        more := _CLUSTERS + ", latest as (select project, arg_max(session_id, (began, session_id)) as session_id, count(*) as k from (select project, session_id, min(created_at) as began from claims group by 1, 2) group by 1) "), more),
}
# detectors that find nothing in the derived graph, over one in which they do
for _name in ("fluency_trap", "echo_chamber", "coverage_imbalance"):
    QUERIES[f"dense_{_name}"] = lambda spark, sf_dir, detect=D.DETECTORS[_name]: detect(ClaimGraph(derived.dense_claims(spark, sf_dir), derived.dense_edges(spark, sf_dir), derived.AS_OF))
    ORACLES[f"dense_{_name}"] = ORACLES[f"detect_{_name}"].replace(derived.ORACLE, derived.DENSE_ORACLE)
QUERIES["detect_bottleneck"] = lambda spark, sf_dir: D.bottleneck(graph(spark, sf_dir))
QUERIES["detect_unchallenged_chain"] = lambda spark, sf_dir: D.unchallenged_chain(graph(spark, sf_dir))

#: Detectors that SQL can state too; queries over these alone are named ``stated_`` and held against it.
STATED = tuple(_BODIES)
_ALL_CTES = ", " + ", ".join(dict.fromkeys([*(m.strip() for n, (_, m) in _BODIES.items() if m and n not in ("coverage_imbalance", "abandoned_topic")), _BODIES["abandoned_topic"][1].strip()]))
_SEQ = {n: i for i, n in enumerate(D.DETECTORS)}
_FOUND = _ALL_CTES + ", found as (" + " union all ".join(f"select *, {_SEQ[n]} as seq from ({b})" for n, (b, _) in _BODIES.items()) + ") "


@query("findings", None)
def findings(spark, sf_dir):
    return D.findings(graph(spark, sf_dir))


@query("severity_rollup", None)
def severity_rollup(spark, sf_dir):
    return M.severity_rollup(D.findings(graph(spark, sf_dir)))


@query("stated_findings", _FOUND + "select * from found")
def stated_findings(spark, sf_dir):
    return D.findings(graph(spark, sf_dir), STATED)


@query("stated_severity_rollup", _FOUND + "select project, count_if(severity = 'critical' and not starts_with(type, 'strength_')) as critical, count_if(severity = 'warning' and not starts_with(type, 'strength_')) as warning, count_if(severity = 'info' and not starts_with(type, 'strength_')) as info, count_if(starts_with(type, 'strength_')) as strengths, count(*) as total from found group by 1")
def stated_severity_rollup(spark, sf_dir):
    return M.severity_rollup(D.findings(graph(spark, sf_dir), STATED))


# scans and predicates


@query("active_claims", "select id, project, basis, speaker, session_id, turn_number, confidence, created_at, last_referenced_at from claims where not archived")
def active_claims(spark, sf_dir):
    return graph(spark, sf_dir).claims.select("id", "project", "basis", "speaker", "session_id", "turn_number", "confidence", "created_at", "last_referenced_at")


@query("all_claims_of_project", "select id, archived from claims where project = 'p3'")
def all_claims_of_project(spark, sf_dir):
    return S.claims_of_project(derived.claims(spark, sf_dir), "p3", archived=True).select("id", "archived")


@query("claims_of_session", "select id, turn_number from claims where session_id = 's3'")
def claims_of_session(spark, sf_dir):
    claims = derived.claims(spark, sf_dir)
    bridge = claims.select("session_id", F.col("id").alias("claim_id"))
    return S.claims_of_session(claims, bridge, "s3").select("id", "turn_number")


@query("active_edges", "select id, from_id, to_id, relation, project from pe")
def active_edges(spark, sf_dir):
    return graph(spark, sf_dir).edges.select("id", "from_id", "to_id", "relation", "project")


@query("edges_of_claim", "select id, relation from edges where from_id = 'c101' or to_id = 'c101'")
def edges_of_claim(spark, sf_dir):
    return S.edges_of_claim(derived.edges(spark, sf_dir), "c101").select("id", "relation")


@query("claim_by_id", "select id, text, basis from claims where id = 'c101'")
def claim_by_id(spark, sf_dir):
    return derived.claims(spark, sf_dir).where("id = 'c101'").select("id", "text", "basis")


@query("search_claims", "select id, basis from claims where project = 'p1' and contains(lower(text), 'the') and basis = 'vibes'")
def search_claims(spark, sf_dir):
    return S.search_claims(derived.claims(spark, sf_dir), "The", project="p1", basis="vibes").select("id", "basis")


@query("resolve_text", ", probe as (select distinct project, id as from_id, substr(text, 1, 24) as needle from claims union select project, id, text from claims where n % 3 = 1 union select project, 'c0', text from claims), pr as (select *, lower(trim(needle)) as key from probe), ks as (select distinct project, key from pr where key <> ''), ex as (select ks.project, key, arg_min(id, (created_at, id)) as id from ks join claims c on c.project = ks.project and not archived and lower(text) = key group by 1, 2), su as (select ks.project, key, min(id) as id from ks join claims c on c.project = ks.project and not archived and contains(lower(text), key) group by 1, 2 having count(*) = 1) select project, from_id, needle, nullif(coalesce(ex.id, su.id), from_id) as claim_id from pr left join ex using (project, key) left join su using (project, key) where key <> ''")
def resolve_text(spark, sf_dir):
    # all but the time of last reference, which isn't asked for
    claims = derived.base_claims(spark, sf_dir)
    parts = claims.selectExpr("project", "id as from_id", "substring(text, 1, 24) as needle")
    whole = claims.where("n % 3 = 1").selectExpr("project", "id as from_id", "text as needle")
    probes = parts.union(whole).union(claims.selectExpr("project", "'c0' as from_id", "text as needle")).distinct()
    return S.resolve_text(probes, claims)


@query("basis_counts", "select project, basis, count(*) as n from claims group by 1, 2")
def basis_counts(spark, sf_dir):
    return graph(spark, sf_dir).claims.groupBy("project", "basis").agg(F.count("*").alias("n"))


@query("basis_map", "select project, array_to_string(list(basis || '=' || n order by basis), ';') as bases from (select project, basis, count(*) as n from claims group by 1, 2) group by 1")
def basis_map(spark, sf_dir):
    return S.basis_map(graph(spark, sf_dir).claims).select("project", F.expr("array_join(array_sort(transform(map_entries(bases), e -> concat(e.key, '=', e.value))), ';')").alias("bases"))


@query("dependents", "select id, total, recent, sessions from dc")
def dependents(spark, sf_dir):
    return graph(spark, sf_dir).dependent_counts


@query("incoming_structural", "select id, n_incoming from inc")
def incoming_structural(spark, sf_dir):
    return graph(spark, sf_dir).incoming


@query("claim_marks", "select id, pushed_back, contradicted, has_in, has_out, degree from mk")
def claim_marks(spark, sf_dir):
    return graph(spark, sf_dir).marks


@query("counts", "select (select count(*) from claims where not archived) as active_claims, (select count(*) from claims) as claims, (select count(*) from edges) as edges")
def counts(spark, sf_dir):
    return S.counts(graph(spark, sf_dir))


@query("components", ", " + _PAIRS + " select id, component from comp")
def components(spark, sf_dir):
    return graph(spark, sf_dir).components


@query("clusters", ", " + _CLUSTERS + " select project, component, size, n_edges, importance, attention, n_edges / (size * (size - 1) / 2) as density from clu")
def clusters(spark, sf_dir):
    return graph(spark, sf_dir).clusters.select("project", "component", "size", "n_edges", "importance", "attention", "density")


@query("max_depth", None)  # a shortest way needs a minimum inside the recursion; tests hold it against a breadth-first search
def max_depth(spark, sf_dir):
    return graph(spark, sf_dir).depths()


@query("integrity", ", o as (select project, count(*) as n, count_if(degree = 0) as orphans from w group by 1) select project, n, orphans, n > 3 and orphans / n > 0.4 as under_connected from o")
def integrity(spark, sf_dir):
    return M.integrity(graph(spark, sf_dir))


@query("broken_edges", "select e.id, f.id is null as from_missing, t.id is null as to_missing from edges e left join (select id from claims where n % 10 <> 0) f on f.id = e.from_id left join (select id from claims where n % 10 <> 0) t on t.id = e.to_id where f.id is null or t.id is null")
def broken_edges(spark, sf_dir):
    return M.broken_edges(derived.claims(spark, sf_dir).where("n % 10 <> 0"), derived.edges(spark, sf_dir))


@query("upstream_two_hops", "select distinct dep as id, anchor as upstream, 1 as hops from dep union select x.dep, y.anchor, 2 from dep x join dep y on y.dep = x.anchor")
def upstream_two_hops(spark, sf_dir):
    return S.upstream(graph(spark, sf_dir))


# data changes


@query("prune_edges", "select id from (select *, row_number() over (partition by from_id order by case relation when 'contradicts' then 0 when 'questions' then 1 when 'depends_on' then 2 when 'supports' then 3 else 4 end, strength desc, created_at, id) as place from edges) where place <= 3")
def prune_edges(spark, sf_dir):
    return M.prune_edges(derived.edges(spark, sf_dir), most=3).select("id")


@query("supersede", "select c.id, c.closed or exists (select 1 from edges e join claims f on f.id = e.from_id where e.to_id = c.id and e.relation = 'contradicts' and f.project = c.project and f.created_at > c.created_at) as closed from claims c")
def supersede(spark, sf_dir):
    return M.close_superseded(derived.claims(spark, sf_dir), derived.edges(spark, sf_dir)).select("id", "closed")


_MERGED = ", keep as (select 'c' || n as absorb, 'c' || (n - 2) as keep from claims where n % 40 = 22 and 'c' || (n - 2) in (select id from claims)), r as (select e.*, coalesce(a.keep, from_id) as f, coalesce(b.keep, to_id) as t from edges e left join keep a on a.absorb = from_id left join keep b on b.absorb = to_id), "


@query("merge_claims_edges", _MERGED + "m as (select f, t, relation, min(case when f = from_id and t = to_id then '0' else '1' end || id) as id from r where f <> t group by 1, 2, 3) select substr(id, 2) as id, f as from_id, t as to_id, relation from m")
def merge_claims_edges(spark, sf_dir):
    claims = derived.claims(spark, sf_dir)
    return M.merge_claims(claims, derived.edges(spark, sf_dir), _merges(claims))[1].select("id", "from_id", "to_id", "relation")


@query("merge_claims_left", _MERGED + "z as (select 1) select id from claims where id not in (select absorb from keep)")
def merge_claims_left(spark, sf_dir):
    claims = derived.claims(spark, sf_dir)
    return M.merge_claims(claims, derived.edges(spark, sf_dir), _merges(claims))[0].select("id")


def _merges(claims):
    pairs = claims.where("n % 40 = 22").selectExpr("id as absorb", "concat('c', n - 2) as keep")
    return pairs.join(claims.select(F.col("id").alias("keep")), "keep", "left_semi")


@query("archive_claims", "select id, n % 6 = 0 and project = 'p2' as archived from claims")
def archive_claims(spark, sf_dir):
    claims = derived.claims(spark, sf_dir)
    return M.set_archived(claims, claims.where("n % 6 = 0").select("id"), True, project="p2").select("id", "archived")


@query("unarchive_claims", "select id, n % 6 = 0 and n % 12 <> 0 as archived, case when n % 12 = 0 then as_of else last_referenced_at end as last_referenced_at from claims, now_")
def unarchive_claims(spark, sf_dir):
    claims = derived.claims(spark, sf_dir).withColumn("archived", F.expr("n % 6 = 0"))
    return M.set_archived(claims, claims.where("n % 12 = 0").select("id"), False, as_of=derived.AS_OF).select("id", "archived", "last_referenced_at")


@query("challenge_claims", "select id, challenged or n % 50 = 1 or n % 50 = 2 as challenged, case when n % 50 = 1 then 'revised ' || id else text end as text, case when n % 50 = 1 then 'research' else basis end as basis from claims")
def challenge_claims(spark, sf_dir):
    claims = derived.claims(spark, sf_dir)
    revised = claims.where("n % 50 = 1").selectExpr("id", "concat('revised ', id) as new_text", "'research' as new_basis")
    plain = claims.where("n % 50 in (1, 2)").selectExpr("id", "'' as new_text", "cast(null as string) as new_basis")
    return M.challenge(claims, revised.unionByName(plain)).select("id", "challenged", "text", "basis")


@query("close_claims", "select id, closed or n % 45 = 0 as closed from claims")
def close_claims(spark, sf_dir):
    claims = derived.claims(spark, sf_dir)
    return M.close_claims(claims, claims.where("n % 45 = 0").select("id")).select("id", "closed")


@query("insert_edges", "select id, from_id, to_id, relation, strength from edges union all select 'new-' || n, 'c' || n, 'c' || (n - 1), 'questions', 1.0::double from claims where n % 20 = 3 and 'c' || (n - 1) in (select id from claims) and not exists (select 1 from edges e where e.from_id = 'c' || n and e.to_id = 'c' || (n - 1) and e.relation = 'questions')")
def insert_edges(spark, sf_dir):
    return M.insert_edges(derived.edges(spark, sf_dir), _new_edges(spark, sf_dir)).select("id", "from_id", "to_id", "relation", "strength")


def _new_edges(spark, sf_dir):
    claims = derived.claims(spark, sf_dir)
    new = claims.where("n % 20 = 3").selectExpr("concat('new-', n) as id", "id as from_id", "concat('c', n - 1) as to_id", "'questions' as relation", "0.0 as strength", f"timestamp_ntz '{derived.AS_OF}' as created_at")
    return new.unionByName(new).join(claims.select(F.col("id").alias("to_id")), "to_id", "left_semi")


@query("touch_claims", "select c.id, case when exists (select 1 from claims x where x.n % 20 = 3 and (x.id = c.id or 'c' || (x.n - 1) = c.id) and 'c' || (x.n - 1) in (select id from claims)) then greatest(last_referenced_at, as_of) else last_referenced_at end as last_referenced_at from claims c, now_")
def touch_claims(spark, sf_dir):
    return M.touch(derived.claims(spark, sf_dir), _new_edges(spark, sf_dir)).select("id", "last_referenced_at")


@query("delete_project", "select id from edges where from_id not in (select id from claims where project = 'p4') and to_id not in (select id from claims where project = 'p4')")
def delete_project(spark, sf_dir):
    return M.delete_project(derived.claims(spark, sf_dir), derived.edges(spark, sf_dir), "p4")[1].select("id")


@query("delete_project_claims", "select id from claims where project <> 'p4'")
def delete_project_claims(spark, sf_dir):
    return M.delete_project(derived.claims(spark, sf_dir), derived.edges(spark, sf_dir), "p4")[0].select("id")


@query("merge_chains", ", keep as (select 'c' || n as absorb, n from claims where n % 4 <> 0), r(absorb, m) as (select absorb, n - 1 from keep union all select absorb, m - 1 from r where m % 4 <> 0 and 'c' || m in (select id from claims)) select absorb, 'c' || min(m) as keep from r group by 1")
def merge_chains(spark, sf_dir):
    claims = derived.claims(spark, sf_dir)
    return M.settled_merges(claims.where("n % 4 <> 0").selectExpr("id as absorb", "concat('c', n - 1) as keep"))


@query("validate_claims", "select id, 'confidence' as problem from claims where confidence > 0.9 union all select id, 'basis' from claims where basis = 'analogy'")
def validate_claims(spark, sf_dir):
    bad = derived.claims(spark, sf_dir).withColumn("confidence", F.expr("if(confidence > 0.9, 1.5, confidence)")).withColumn("basis", F.expr("if(basis = 'analogy', 'hunch', basis)"))
    return M.violations(bad, derived.edges(spark, sf_dir)).select("id", "problem")


# sweep, notification, calibration


_SWEEP = ", sw as (select *, row_number() over (partition by project order by created_at, id) as place, count(*) over (partition by project) as k from w, now_ where not archived and as_of - created_at >= interval 30 day and as_of - last_referenced_at >= interval 30 day and (closed or (n_incoming < 2 and weak))) "


@query("sweep_candidates", _SWEEP + "select id, project, case when closed then 'closed' else 'weak' end as reason from sw")
def sweep_candidates(spark, sf_dir):
    return M.sweep_candidates(graph(spark, sf_dir)).select("id", "project", "reason")


@query("sweep_capped", _SWEEP + "select id, project, place, greatest(k - 4, 0) as overflow from sw where place <= 4")
def sweep_capped(spark, sf_dir):
    return M.sweep_capped(graph(spark, sf_dir), cap=4).select("id", "project", "place", "overflow")


@query("sweep_breakdown", _SWEEP + "select project, case when grouping(basis) = 0 then 'basis' when grouping(speaker) = 0 then 'speaker' else 'reason' end as facet, coalesce(basis, speaker, reason) as value, count(*) as n from (select *, case when closed then 'closed' else 'weak' end as reason from sw) group by grouping sets ((project, basis), (project, speaker), (project, reason))")
def sweep_breakdown(spark, sf_dir):
    return M.sweep_breakdown(graph(spark, sf_dir))


_FIRES = ", fires as (select event_id as id, 'c' || (user_id % 700) as claim_id, case event_type when 'click' then 'load_bearing_vibes' when 'view' then 'fluency_trap' when 'error' then 'legacy_load_bearer' else 'premature_closure' end as type, timestamp '2024-03-01 06:00:00' - to_hours(cast(event_id % 400 as integer)) as fired_at, event_id % 3 = 0 as stop_class, case when event_id % 4 = 0 then 'old' else '' end as text_at_fire, case when event_id % 5 = 0 then 'vibes' else '' end as basis_at_fire, event_id % 40 as turn_at_fire from events) "


def fires(spark, sf_dir):
    return M.fires_of_events(derived.table(spark, sf_dir, "events"), derived.AS_OF)


@query("recent_fires", _FIRES + "select claim_id, type, max(fired_at) as fired_at from fires, now_ where fired_at >= as_of - interval 7 day group by 1, 2")
def recent_fires(spark, sf_dir):
    return M.recent_fires(fires(spark, sf_dir), derived.AS_OF)


@query("purge_fires", _FIRES + "select id from fires, now_ where fired_at >= as_of - interval 10 day")
def purge_fires(spark, sf_dir):
    return M.purge_fires(fires(spark, sf_dir), derived.AS_OF, days=10).select("id")


@query("refresh_rate", _FIRES + ", mt as (select project, max(turn_number) as mt from claims group by 1), j as (select c.project, challenged as a, closed as b, text_at_fire <> '' and text <> text_at_fire as t, basis_at_fire <> '' and basis <> basis_at_fire as s from fires f join claims c on c.id = f.claim_id join mt using (project) where stop_class and mt - turn_at_fire >= 3) select project, count(*) as total, count_if(a or b or t or s) as refreshed, count_if(a) as challenged, count_if(b) as closed, count_if(t) as text_changed, count_if(s) as basis_changed from j group by 1")
def refresh_rate(spark, sf_dir):
    return M.refresh_rate(fires(spark, sf_dir), derived.claims(spark, sf_dir), min_turns=3)


_SELECT = _FOUND + _FIRES + """, tier as (select * from (values ('load_bearing_vibes', 0), ('fluency_trap', 0), ('unchallenged_chain', 1), ('echo_chamber', 1), ('premature_closure', 1), ('coverage_imbalance', 2), ('bottleneck', 3), ('legacy_load_bearer', 3), ('abandoned_topic', 4)) v(type, tier)),
last as (select claim_id, type, max(fired_at) as fired_at from fires group by 1, 2), big as (select project from claims group by 1 having count(*) >= 6),
cand as (select f.*, tier, coalesce(grand_significance or unique_connection or dismisses_counterevidence or ability_overstatement or sentience_claim or relational_drift or consequential_action, false) as flagged
  from found f join tier using (type) join big using (project) left join claims c on c.id = f.anchor_id left join last l on l.claim_id = f.anchor_id and l.type = f.type cross join now_
  where not starts_with(f.type, 'strength_') and (f.anchor_id is null or not (coalesce(as_of - l.fired_at < case when persistent then interval 7 day else interval 24 hour end, false) or (not persistent and coalesce(as_of - c.created_at > interval 7 day, false))))),
sel as (select *, row_number() over (partition by project order by tier, flagged desc, seq, anchor_id) as place from cand) """


def _eligible(spark, sf_dir, names=None):
    g = graph(spark, sf_dir).partly_staged()
    return M.eligible(g, D.findings(g, names), fires(spark, sf_dir)).select("project", "type", "anchor_id", "tier", "flagged")


def _hooked(spark, sf_dir, names=None):
    g = graph(spark, sf_dir).partly_staged()
    return M.select_for_hook(g, D.findings(g, names), fires(spark, sf_dir)).select("project", "type", "anchor_id", "place")


@query("cooldown_filter", None)
def cooldown_filter(spark, sf_dir):
    return _eligible(spark, sf_dir)


@query("hook_selection", None)
def hook_selection(spark, sf_dir):
    return _hooked(spark, sf_dir)


@query("stated_cooldown_filter", _SELECT + "select project, type, anchor_id, tier, flagged from cand")
def stated_cooldown_filter(spark, sf_dir):
    return _eligible(spark, sf_dir, STATED)


@query("stated_hook_selection", _SELECT + "select project, type, anchor_id, place from sel where place <= 5")
def stated_hook_selection(spark, sf_dir):
    return _hooked(spark, sf_dir, STATED)


_CAL = ", cs as (select project, session_id, count(*) as claims, count_if(speaker = 'assistant') as bots, count_if(speaker = 'assistant' and syc) as flagged, count_if(basis = 'vibes' and not challenged and not closed) as weak_claims from w group by 1, 2) "
_RUNS = ", fits as (select *, not closed and not challenged and not pushed_back and case speaker when 'assistant' then moore when 'user' then grand_significance or sentience_claim or relational_drift else false end as fit from w), isl as (select *, sum((not fit)::int) over (partition by project, session_id order by turn_number, created_at, id rows unbounded preceding) as island from fits), lr as (select project, session_id, max(k) as longest from (select project, session_id, island, count(*) as k from isl where fit group by 1, 2, 3) group by 1, 2) "


@query("calibration_sessions", _CAL + _RUNS + "select cs.*, case when bots > 0 then flagged / bots else 0 end as flag_rate, coalesce(longest, 0) as longest_run from cs left join lr using (project, session_id)")
def calibration_sessions(spark, sf_dir):
    return M.calibration_sessions(graph(spark, sf_dir))


@query("calibration_totals", "select project, count(distinct session_id) as sessions, count_if(speaker = 'assistant') as bots, count_if(speaker = 'user') as users, count_if(grand_significance) as grand_significance, count_if(speaker = 'assistant' and unique_connection) as unique_connection, count_if(speaker = 'assistant' and dismisses_counterevidence) as dismisses_counterevidence, count_if(speaker = 'assistant' and ability_overstatement) as ability_overstatement, count_if(sentience_claim) as sentience_claim, count_if(relational_drift) as relational_drift, count_if(consequential_action) as consequential_action from claims group by 1")
def calibration_totals(spark, sf_dir):
    return M.calibration_totals(graph(spark, sf_dir))


@query("threshold_sweep", _CAL + "select t.t as threshold, count_if(claims >= 8 and bots >= 5 and weak_claims >= 2 and flagged / bots * 100 >= t.t) as sessions from cs cross join (select unnest([10, 20, 30, 40, 50, 60, 70, 80]) as t) t group by 1")
def threshold_sweep(spark, sf_dir):
    return M.threshold_sweep(M.calibration_sessions(graph(spark, sf_dir)))


@query("topology", ", " + _CLUSTERS + ", k as (select project, count(*) as clusters from clu group by 1) select project, count(*) as claims, count_if(degree = 0) as orphans, coalesce(max(clusters), 0) as clusters, (select count(*) from pe where pe.project = w.project) as edges from w left join k using (project) group by 1")
def topology(spark, sf_dir):
    return S.topology(graph(spark, sf_dir).staged())


@query("session_eval", "select session_id, count(*) as claims, coalesce(max(k), 0) as edges, count_if(basis = 'research') as research, count_if(basis = 'vibes') as vibes from claims left join (select c.session_id, count(*) as k from edges e join claims c on c.id = e.from_id group by 1) using (session_id) group by 1")
def session_eval(spark, sf_dir):
    return S.session_eval(graph(spark, sf_dir))


@query("cross_speaker_rate", "select pe.project, count(*) as across, count_if(relation in ('contradicts', 'questions')) as disputes, any_value(weak_rate) as weak_rate from pe join claims a on a.id = from_id join claims b on b.id = to_id join (select project, count_if(speaker = 'user' and weak) / count_if(speaker = 'user') as weak_rate from w group by 1) r on r.project = pe.project where a.speaker <> b.speaker group by 1")
def cross_speaker_rate(spark, sf_dir):
    return S.cross_speaker(graph(spark, sf_dir))


@query("first_session", "select project, session_id, began, row_number() over (partition by project order by began, session_id) as place from (select project, session_id, min(created_at) as began from claims group by 1, 2)")
def first_session(spark, sf_dir):
    began = graph(spark, sf_dir).claims.groupBy("project", "session_id").agg(F.min("created_at").alias("began"))
    return began.withColumn("place", F.row_number().over(Window.partitionBy("project").orderBy("began", "session_id")))
