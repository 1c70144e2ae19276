"""Queries over batches of extracted claims, their upkeep and delivery, with the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import claims as C
from claimloom.functions import text as T
from claimloom.operators import detectors as D
from claimloom.operators import evaluation as E
from claimloom.operators import ingest as I
from claimloom.operators import maintenance as M
from claimloom.operators import matching as X
from claimloom.operators import scans as S
from claimloom.operators.gram_index import GramIndex
from claimloom.plans.catalogue_graph import BASE, fires, graph
from claimloom.plans.catalogue_text import GRAMS
from claimloom.plans.staging import new_path
from claimloom.sources import derived
from claimloom.streaming import events as V

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None, base: bool = True):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = (BASE if base else "") + sql
        return f

    return add


# a batch: every claim of a session once more, naming its neighbours by turn and two claims by id


def extracted(spark, sf_dir):
    rows = derived.claims(spark, sf_dir)
    return rows.selectExpr(
        "session_id as batch", "cast(turn_number as bigint) as index", "text", "case n % 5 when 0 then ' Vibes ' when 1 then 'document' else basis end as basis", "confidence", "cast(null as string) as source", "speaker",
        "grand_significance", "terminates_inquiry",
        "array(cast(turn_number - 1 as bigint), cast(turn_number as bigint), 9999L) as depends_on", "if(n % 2 = 0, array(cast(turn_number - 2 as bigint), cast(turn_number - 2 as bigint)), null) as supports",
        "if(n % 7 = 0, array(cast(turn_number + 1 as bigint)), cast(array() as array<bigint>)) as contradicts", "cast(null as array<bigint>) as questions",
        "cast(null as array<string>) as depends_on_existing", "cast(null as array<string>) as supports_existing", "cast(null as array<string>) as contradicts_existing", "array('c101', 'nowhere') as questions_existing",
    )


_ID = "'x' || substr(sha256(session_id || ':' || turn_number), 1, 24)"
_BATCH = f", xt as (select *, {_ID} as xid from claims)"


@query("extracted_claims", _BATCH + " select xid as id, session_id, case when n % 5 = 0 then 'vibes' when n % 5 = 1 then case when speaker = 'assistant' then 'llm_output' else 'vibes' end else basis end as basis, '' as source, 0 as turn_number, grand_significance, false as sentience_claim, as_of as last_referenced_at from xt, now_")
def extracted_claims(spark, sf_dir):
    out = I.claims_from_extracted(extracted(spark, sf_dir), F.lit("p0"), derived.AS_OF)
    return out.select("id", "session_id", "basis", "source", "turn_number", "grand_significance", "sentience_claim", "last_referenced_at")


@query("batch_edges", _BATCH + """, l as (select session_id, xid, 'depends_on' as relation, turn_number - 1 as t from xt union all select session_id, xid, 'supports', turn_number - 2 from xt where n % 2 = 0 union all select session_id, xid, 'contradicts', turn_number + 1 from xt where n % 7 = 0)
select distinct l.xid as from_id, h.xid as to_id, l.relation from l join xt h on h.session_id = l.session_id and h.turn_number = l.t where l.xid <> h.xid
union all select distinct xid, 'c101', 'questions' from xt where 'c101' in (select id from claims)""")
def batch_edges(spark, sf_dir):
    rows = extracted(spark, sf_dir)
    ids = I.claims_from_extracted(rows, F.lit("p0"), derived.AS_OF).select("batch", "index", "id")
    return I.edges_of_batch(rows, ids, derived.claims(spark, sf_dir), derived.AS_OF).select("from_id", "to_id", "relation")


@query("insert_claims", " select id, project, last_referenced_at from claims union all select 'n' || n, case when n % 2 = 0 then 'p9' else 'given' end, as_of from claims, now_ where n % 30 = 1")
def insert_claims(spark, sf_dir):
    claims = derived.claims(spark, sf_dir)
    new = claims.where("n % 30 in (1, 2)").selectExpr("if(n % 30 = 1, concat('n', n), id) as id", "text", "session_id", "if(n % 2 = 0, '', 'given') as project", "cast(null as timestamp_ntz) as created_at", "cast(null as timestamp_ntz) as last_referenced_at")
    return I.insert_claims(claims, new, "p9", derived.AS_OF).select("id", "project", "last_referenced_at")


@query("membership", " select session_id, id as claim_id from claims union select 's0', id from claims where n % 9 = 0")
def membership(spark, sf_dir):
    claims = derived.claims(spark, sf_dir)
    bridge = claims.select("session_id", F.col("id").alias("claim_id"))
    new = claims.where("n % 9 = 0").select(F.lit("s0").alias("session_id"), F.col("id").alias("claim_id"))
    return I.record_membership(bridge, new.unionByName(bridge))


# a batch of its own for every second claim of one project, one that repeats a claim or one that is new, beside a project of which some is archived


def _ingested(spark, sf_dir):
    claims = derived.claims(spark, sf_dir).withColumn("archived", F.expr("n % 6 = 0"))
    none = "cast(null as array<{}>)"
    rows = claims.where("project = 'p3' and n % 2 = 0").selectExpr(
        "concat('b', n) as batch", "0L as index", "if(n % 4 = 0, text, concat('quite another remark, numbered ', n)) as text", "if(n % 8 = 2, 'nonsense', basis) as basis", "confidence", "'' as source", "speaker",
        *[none.format("bigint") + f" as {r}" for r in I.LISTS], none.format("string") + " as depends_on_existing",
        "transform(sequence(1, 4), i -> concat('c', n - i)) as supports_existing", "array(concat('c', n - 1), 'nowhere') as contradicts_existing", "array(concat('c', n + 1), concat('c', n + 1)) as questions_existing",
    )
    bridge = claims.where("n % 3 = 0").select("session_id", F.col("id").alias("claim_id"))
    return I.ingest_batch(claims.drop("n", "sess"), derived.edges(spark, sf_dir), bridge, rows, "p3", derived.AS_OF)


_INGESTED = f""", ac as (select c.* replace (n % 6 = 0 as archived) from claims c),
nw as (select n, 'b' || n as batch, 'x' || substr(sha256('b' || n || ':0'), 1, 24) as nid, case when n % 4 = 0 then text else 'quite another remark, numbered ' || n end as text, case when n % 8 = 2 then case when speaker = 'assistant' then 'llm_output' else 'vibes' end else basis end as basis, speaker from ac where project = 'p3' and n % 2 = 0),
eg as (select id, speaker, created_at, archived, {GRAMS} as g from ac where project = 'p3'), ng as (select n, speaker, {GRAMS} as g from nw),
mt as (select n, id as mid, archived as back from ng join eg using (speaker) where len(ng.g) > 0 and len(eg.g) > 0 and 2 * len(list_intersect(ng.g, eg.g)) > len(list_distinct(list_concat(ng.g, eg.g))) qualify row_number() over (partition by n order by created_at, id) = 1),
rs as (select nw.*, mid, back, coalesce(mid, nid) as id from nw left join mt using (n)),
c1 as (select id, project, session_id, text, basis, created_at, closed, archived and id not in (select mid from mt where back) as archived, case when id in (select mid from mt where back) then as_of else last_referenced_at end as last_ref from ac, now_
       union all select nid, 'p3', batch, text, basis, as_of, false, false, as_of from rs, now_ where mid is null),
ad as (select distinct id as from_id, to_id, relation from (select id, unnest(list_transform(range(1, 5), lambda i: 'c' || (n - i))) as to_id, 'supports' as relation from rs union all select id, 'c' || (n - 1), 'contradicts' from rs union all select id, 'c' || (n + 1), 'questions' from rs) where id <> to_id and to_id in (select id from c1)),
fe as (select from_id || '-' || to_id || '-' || relation as id, ad.*, 1.0::double as strength, as_of as created_at from ad anti join edges e on e.from_id = ad.from_id and e.to_id = ad.to_id and e.relation = ad.relation, now_),
ae as (select id, from_id, to_id, relation, strength, created_at from edges union all select id, from_id, to_id, relation, strength, created_at from fe),
act as (select ae.* from ae semi join c1 f on f.id = ae.from_id and f.project = 'p3' and not f.archived semi join c1 t on t.id = ae.to_id and t.project = 'p3' and not t.archived),
keep as (select id from act qualify row_number() over (partition by from_id order by case relation when 'contradicts' then 0 when 'questions' then 1 when 'depends_on' then 2 when 'supports' then 3 else 4 end, strength desc, created_at, id) <= 5),
le as (select * from ae where id in (select id from keep) or id not in (select id from act)),
tc as (select unnest([from_id, to_id]) as id, created_at as at_ from fe), c2 as (select c1.* replace (greatest(coalesce(last_ref, created_at), (select max(at_) from tc where tc.id = c1.id)) as last_ref) from c1),
sup as (select distinct e.to_id as id from le e join c1 f on f.id = e.from_id join c1 t on t.id = e.to_id where e.relation = 'contradicts' and f.project = 'p3' and t.project = 'p3' and f.created_at > t.created_at)"""


@query("ingested_claims", _INGESTED + " select id, project, session_id, basis, closed or id in (select id from sup) as closed, archived, last_ref as last_referenced_at from c2")
def ingested_claims(spark, sf_dir):
    """All claims after the batches: which are new, taken back, referenced now and closed."""
    return _ingested(spark, sf_dir).claims.select("id", "project", "session_id", "basis", "closed", "archived", "last_referenced_at")


@query("ingested_edges", _INGESTED + " select from_id, to_id, relation, strength, created_at from le")
def ingested_edges(spark, sf_dir):
    """All edges after the batches, pruned."""
    return _ingested(spark, sf_dir).edges.select("from_id", "to_id", "relation", "strength", "created_at")


@query("ingested_members", _INGESTED + " select session_id, id as claim_id from ac where n % 3 = 0 union select batch, id from rs where mid is null or back")
def ingested_members(spark, sf_dir):
    return _ingested(spark, sf_dir).bridge


@query("ingested_batch", None)
def ingested_batch(spark, sf_dir):
    """All claims after every session has been extracted once more, near-duplicates and all; tests hold the operator against literal rows."""
    claims, edges = derived.claims(spark, sf_dir), derived.edges(spark, sf_dir)
    bridge = claims.select("session_id", F.col("id").alias("claim_id"))
    return I.ingest_batch(claims.drop("n", "sess"), edges, bridge, extracted(spark, sf_dir), "p3", derived.AS_OF).claims.select("id", "project", "session_id", "basis")


@query("export_rows", " select project, 'claim' as kind, id from claims union all select project, 'edge', e.id from edges e join claims c on c.id = e.from_id")
def export_rows(spark, sf_dir):
    """Rows of the export; the JSON itself is parsed back, so the engines' ways of writing it don't matter."""
    out = I.export_rows(derived.claims(spark, sf_dir), derived.edges(spark, sf_dir))
    return out.select("project", "kind", F.get_json_object("json", "$.id").alias("id"))


@query("dot_edges", """ select c.project, '"' || from_id || '" -> "' || to_id || '" [label="' || relation || '", style=' || case when relation = 'contradicts' then 'dashed' else 'solid' end || '];' as line from edges e join claims c on c.id = e.from_id""")
def dot_edges(spark, sf_dir):
    return I.dot_lines(derived.claims(spark, sf_dir), derived.edges(spark, sf_dir)).where("part = 1").select("project", "line")


@query("dot_lines", """, l as (select *, case when length(text) > 40 then substr(text, 1, 37) || '...' else text end as cut from claims) select project, 0 as part, id, '"' || id || '" [label="' || replace(regexp_replace(cut, '(["\\\\])', '\\\\\\1', 'g'), chr(10), '\\n') || '\\n[' || basis || ']"];' as line from l
union all select c.project, 1, e.id, '"' || from_id || '" -> "' || to_id || '" [label="' || relation || '", style=' || case when relation = 'contradicts' then 'dashed' else 'solid' end || '];' from edges e join claims c on c.id = e.from_id""")
def dot_lines(spark, sf_dir):
    """Node and edge lines of every project's drawing."""
    return I.dot_lines(derived.claims(spark, sf_dir), derived.edges(spark, sf_dir))


@query("export_objects", " select project, 'claim' as kind, id, text, basis, speaker, cast(null as varchar) as relation from claims union all select c.project, 'edge', e.id, null, null, null, relation from edges e join claims c on c.id = e.from_id")
def export_objects(spark, sf_dir):
    """All fields of the export's JSON objects, parsed back."""
    out = I.export_rows(derived.claims(spark, sf_dir), derived.edges(spark, sf_dir))
    return out.select("project", "kind", *[F.get_json_object("json", f"$.{c}").alias(c) for c in ("id", "text", "basis", "speaker", "relation")])


# filters and upkeep


@query("live_claims", " select id from claims c where not closed and not exists (select 1 from edges e join claims f on f.id = e.from_id where e.to_id = c.id and e.relation = 'contradicts' and not f.closed and f.created_at > c.created_at)")
def live_claims(spark, sf_dir):
    return M.without_superseded(M.without_closed(derived.claims(spark, sf_dir)), derived.edges(spark, sf_dir)).select("id")


@query("unarchive_project", " select id, n % 6 = 0 and project <> 'p2' as archived, case when n % 6 = 0 and project = 'p2' then as_of else last_referenced_at end as last_referenced_at from claims, now_")
def unarchive_project(spark, sf_dir):
    claims = derived.claims(spark, sf_dir).withColumn("archived", F.expr("n % 6 = 0"))
    return M.unarchive_project(claims, "p2", derived.AS_OF).select("id", "archived", "last_referenced_at")


@query("delete_edges", " select id from edges where from_id not in (select id from claims where n % 8 = 0)")
def delete_edges(spark, sf_dir):
    edges, claims = derived.edges(spark, sf_dir), derived.claims(spark, sf_dir)
    gone = edges.join(claims.where("n % 8 = 0").select(F.col("id").alias("from_id")), "from_id", "left_semi")
    return M.delete_edges(edges, gone).select("id")


@query("upsert_meta", "select c_custkey as key, case when c_custkey % 3 = 0 then 'new' else c_name end as value from customer union all select -1, 'added'", base=False)
def upsert_meta(spark, sf_dir):
    rows = derived.table(spark, sf_dir, "customer").selectExpr("c_custkey as key", "c_name as value")
    new = rows.where("key % 3 = 0").selectExpr("key", "'new' as value").union(spark.createDataFrame([(-1, "added")], "key long, value string"))
    return M.upsert(rows, new, ["key"])


@query("fires_with_snapshot", " select 'f' || n as id, 'c' || n as claim_id, n % 3 = 0 and basis in ('vibes', 'assumption', 'llm_output') as stop_class, case when n % 3 = 0 and basis in ('vibes', 'assumption', 'llm_output') then text else '' end as text_at_fire, case when n % 3 = 0 and basis in ('vibes', 'assumption', 'llm_output') then turn_number + 5 else 0 end as turn_at_fire from claims")
def fires_with_snapshot(spark, sf_dir):
    claims = derived.claims(spark, sf_dir).withColumn("session_id", F.expr("if(n % 3 = 0, concat('doc:', session_id), session_id)"))
    picked = claims.selectExpr("concat('f', n) as id", "id as claim_id", "'bottleneck' as type", f"timestamp_ntz '{derived.AS_OF}' as fired_at", "turn_number + 5 as turn")
    log = fires(spark, sf_dir).withColumn("id", F.col("id").cast("string")).limit(0)
    return M.log_fires(log, picked, claims).select("id", "claim_id", "stop_class", "text_at_fire", "turn_at_fire")


@query("document_origin", " select id, n % 3 = 0 as from_document, n % 3 = 0 and basis in ('vibes', 'assumption', 'llm_output') as doubtful_document from claims")
def document_origin(spark, sf_dir):
    claims = derived.claims(spark, sf_dir).withColumn("session_id", F.expr("if(n % 3 = 0, concat('doc:', session_id), session_id)"))
    return claims.select("id", C.is_doc_origin().alias("from_document"), C.is_stop_class().alias("doubtful_document"))


@query("sweep_debounce", "with l as (select c_custkey as project, case when c_custkey % 4 = 0 then null else timestamp '2024-03-01 06:00:00' - to_hours(cast(c_custkey % 60 - 10 as integer)) end as swept from customer) select project, swept is null or swept > timestamp '2024-03-01 06:00:00' or timestamp '2024-03-01 06:00:00' - swept >= interval 24 hour as due, timestamp '2024-03-01 06:00:00' - case when project % 5 = 0 then interval 12 hour else interval 0 hour end as stamp from l", base=False)
def sweep_debounce(spark, sf_dir):
    at = f"timestamp_ntz '{derived.AS_OF}'"
    last = derived.table(spark, sf_dir, "customer").selectExpr("c_custkey as project", f"if(c_custkey % 4 = 0, null, {at} - make_dt_interval(0, cast(c_custkey % 60 - 10 as int))) as swept_at")
    swept = last.selectExpr("project", "if(project % 5 = 0, 3, 0) as overflow")
    stamps = M.sweep_stamps(last, swept, derived.AS_OF).withColumnRenamed("swept_at", "stamp")
    return M.sweep_due(last, derived.AS_OF).join(stamps, "project")


# delivery


@query("since_turn", "with c as (select conv_id as conv, count(*) as turns, conv_id % 7 as mark from conversations group by 1) select conv, case when conv % 3 = 0 then 0 when mark >= turns then 0 else mark end as since from c", base=False)
def since_turn(spark, sf_dir):
    counted = derived.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("conv")).agg(F.count("*").alias("turns"))
    return M.since_turn(counted.where("conv % 3 <> 0").select("conv", (F.col("conv") % 7).alias("last_turn")), counted)


@query("deliverable", "with p as (select user_id as session_id, event_id as id, event_type as text, timestamp '2024-03-01 06:00:00' - to_minutes(cast(event_id % 2000 as integer)) as made_at from events), f as (select session_id, arg_max(id, (made_at, id)) as id, max(made_at) as made_at from p where timestamp '2024-03-01 06:00:00' - made_at <= interval 12 hour group by 1) select session_id, id from f where id % 4 <> 0", base=False)
def deliverable(spark, sf_dir):
    pending = derived.table(spark, sf_dir, "events").selectExpr("user_id as session_id", "event_id as id", "event_type as text", f"timestamp_ntz '{derived.AS_OF}' - make_dt_interval(0, 0, cast(event_id % 2000 as int)) as made_at")
    return M.deliverable(pending, pending.where("id % 4 = 0"), derived.AS_OF).select("session_id", "id")


@query("event_lines", "select event_id::varchar as id, case when event_id % 2 = 0 then 'extra' else event_type end as kind, event_type as project, case when event_id % 3 = 0 then '2024-03-01T06:00:00' else strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') end as ts from events", base=False)
def event_lines(spark, sf_dir):
    rows = derived.table(spark, sf_dir, "events").selectExpr("cast(event_id as string) as id", "event_type as project", "map('kind', if(event_id % 2 = 0, 'extra', event_type), 'project', 'cannot win') as more", "if(event_id % 3 = 0, null, ts) as at")
    lines = M.event_lines(rows, "more", ["id", "project"], "at", derived.AS_OF)
    return lines.select(*[F.get_json_object("value", f"$.{c}").alias(c) for c in ("id", "kind", "project", "ts")])


@query("verified_now", "with k as (select event_id as key, event_type = 'error' as failed, case when event_type = 'error' then '' else 'snippet' end as snippet, timestamp '2024-03-01 06:00:00' - to_minutes(cast(event_id % 15000 as integer)) as fetched_at from events where event_id % 2 = 0) select e.event_id as key, coalesce(not failed and timestamp '2024-03-01 06:00:00' - fetched_at <= interval 7 day, false) as hit, coalesce(failed and timestamp '2024-03-01 06:00:00' - fetched_at <= interval 1 hour, false) as resting from events e left join k on k.key = e.event_id", base=False)
def verified_now(spark, sf_dir):
    events = derived.table(spark, sf_dir, "events")
    cache = events.where("event_id % 2 = 0").selectExpr("event_id as key", "if(event_type = 'error', '', 'snippet') as snippet", "'src' as source", "event_type = 'error' as failed", f"timestamp_ntz '{derived.AS_OF}' - make_dt_interval(0, 0, cast(event_id % 15000 as int)) as fetched_at")
    return M.verified_now(events.selectExpr("event_id as key"), cache, derived.AS_OF).select("key", "hit", "resting")


@query("external_checks", ", d as (select *, n % 3 = 0 and basis in ('vibes', 'assumption', 'llm_output') as stop, row_number() over (partition by project order by created_at, id) as place from claims), t as (select *, case when stop and n % 4 <> 1 then 'said ' || id end as told from d where place <= 12), x as (select *, sum((told is not null and place > 1)::int) over (partition by project order by place rows unbounded preceding) as nth from t) select project, id as anchor_id, cast(place as bigint) as place, case when place = 1 or nth <= 2 then told end as check from x")
def external_checks(spark, sf_dir):
    claims = derived.claims(spark, sf_dir).withColumn("session_id", F.expr("if(n % 3 = 0, concat('doc:', session_id), session_id)"))
    chosen = claims.selectExpr("project", "id as anchor_id", "row_number() over (partition by project order by created_at, id) as place").where("place <= 12").withColumn("place", F.col("place").cast("long"))
    checks = claims.selectExpr("id as claim_id", "if(n % 4 = 1, '', concat('said ', id)) as snippet")
    return M.external_checks(chosen, claims, checks)


@query("verify_texts", None)
def verify_texts(spark, sf_dir):
    """Keys and search texts of all documents' checks; tests hold both against Python's own functions."""
    t = F.col("text")
    return derived.table(spark, sf_dir, "documents").select("doc_id", T.verify_key(t).alias("key"), T.query_text(t).alias("query"))


@query("flattened_messages", "select conv_id, sha256(string_agg(role || ':' || chr(31) || text || chr(30), '' order by turn)) as digest from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations) group by 1", base=False)
def flattened_messages(spark, sf_dir):
    rows = derived.table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "coalesce(role, '') as role", "coalesce(text, '') as content")
    said = F.array_sort(F.collect_list(F.struct("turn", "role", "content")))
    return rows.groupBy("conv_id").agg(said.alias("m")).select("conv_id", F.sha2(T.flattened_messages(F.col("m")), 256).alias("digest"))


@query("quoted_texts", """select doc_id, case when not contains(text, '"') then text else regexp_replace(regexp_extract(text, '^[^"]*"([^"]*)', 1, 's'), case when length(text) - length(replace(text, '"', '')) > 1 then '\\.\\.\\.$' else '^$^' end, '') end as quoted from documents where text is not null""", base=False)
def quoted_texts(spark, sf_dir):
    return derived.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.quoted_text(F.col("text")).alias("quoted"))


@query("safe_projects", "select page_id, case when p = '' then 'default' else p end as project from (select page_id, regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '[^a-zA-Z0-9_-]', '', 'g') as p from pages)", base=False)
def safe_projects(spark, sf_dir):
    return derived.table(spark, sf_dir, "pages").select("page_id", T.safe_project(F.col("url")).alias("project"))


# evaluation


def _annotated(spark, sf_dir):
    """Sessions as episodes: their claims and inner edges as they are, and as a reader might have found them."""
    claims = derived.claims(spark, sf_dir).selectExpr("session_id as episode", "cast(turn_number as bigint) as place", "text", "basis", "n", "id")
    found = claims.where("n % 5 <> 0").selectExpr("episode", "1000 - place as place", "case when n % 3 = 0 then concat(text, ' and some further words') when n % 3 = 1 then concat_ws(' ', slice(split(text, ' '), 1, 12)) else text end as text", "if(n % 4 = 0, 'vibes', basis) as basis", "id")
    edges = derived.edges(spark, sf_dir)
    ends = claims.select("episode", "id", "place")
    inner = edges.join(ends.select("episode", F.col("id").alias("from_id"), F.col("place").alias("from_place")), "from_id").join(ends.select("episode", F.col("id").alias("to_id"), F.col("place").alias("to_place")), ["episode", "to_id"])
    relations = inner.selectExpr("episode", "from_place * 100 + to_place as place", "from_place", "to_place", "if(relation = 'contradicts', relation, 'supports') as relation")
    links = inner.where("from_place % 3 <> 0").selectExpr("episode", "to_place * 100 + from_place as place", "1000 - to_place as from_place", "1000 - from_place as to_place", "if(from_place % 4 = 0, 'questions', relation) as relation")
    return claims, relations, found, links


_WORDS = "list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))"
_EVALUATED = f""", g as (select session_id as episode, turn_number::bigint as place, text, n, id from claims),
f as (select episode, 1000 - place as place, case when n % 3 = 0 then text || ' and some further words' when n % 3 = 1 then array_to_string(string_split(text, ' ')[1:12], ' ') else text end as text from g where n % 5 <> 0),
gw as (select episode, place, {_WORDS} as w from g), fw as (select episode, place, {_WORDS} as w from f),
s as (select episode, gw.place as l, fw.place as r, len(list_intersect(gw.w, fw.w)) / (len(gw.w) + len(fw.w) - len(list_intersect(gw.w, fw.w))) as score from gw join fw using (episode) where len(gw.w) > 0 and len(fw.w) > 0),
b as (select * from s where score >= 0.25 qualify row_number() over (partition by episode, l order by score desc, r) = 1),
m as (select episode, l, r from b qualify row_number() over (partition by episode, r order by l) = 1),
i as (select x.episode, x.place as fp, y.place as tp, relation from edges e join g x on x.id = e.from_id join g y on y.id = e.to_id and y.episode = x.episode),
gr as (select episode, fp * 100 + tp as place, fp, tp, case when relation = 'contradicts' then relation else 'supports' end as relation from i),
fe as (select i.episode, tp * 100 + fp as place, 1000 - tp as fp, 1000 - fp as tp, case when fp % 4 = 0 then 'questions' else relation end as relation from i where fp % 3 <> 0),
fk as (select fe.* from fe semi join f p on p.episode = fe.episode and p.place = fe.fp semi join f q on q.episode = fe.episode and q.place = fe.tp),
wp as (select gr.episode, gr.place, relation, least(x.r, y.r) as a, greatest(x.r, y.r) as b from gr join m x on x.episode = gr.episode and x.l = gr.fp join m y on y.episode = gr.episode and y.l = gr.tp),
hit as (select w.episode, w.relation as want, h.relation as got from (select *, row_number() over (partition by episode, a, b order by place) as nth from wp) w join (select episode, relation, least(fp, tp) as a, greatest(fp, tp) as b, row_number() over (partition by episode, least(fp, tp), greatest(fp, tp) order by place) as nth from fk) h using (episode, a, b, nth)),
ev as (select episode, (select count(*) from g where g.episode = e.episode) as gold_claims, (select count(*) from m where m.episode = e.episode) as matched_claims, (select count(*) from gr where gr.episode = e.episode) as gold_edges, (select count(*) from hit where hit.episode = e.episode) as matched_edges, (select count(*) from fk where fk.episode = e.episode) as found_edges, (select count(*) from hit where hit.episode = e.episode and (want = 'supports') = (got in ('supports', 'depends_on'))) as right_relations from (select distinct episode from g) e)"""


@query("episode_evaluation", _EVALUATED + " select * from ev")
def episode_evaluation(spark, sf_dir):
    """Every episode's claims matched by words, and its relations over the matches."""
    return X.episode_evaluation(*[t.drop("n", "id") for t in _annotated(spark, sf_dir)])


@query("match_rates", _EVALUATED + " select sum(matched_claims) / sum(gold_claims) as claim_recall, sum(matched_edges) / sum(gold_edges) as edge_recall, sum(matched_edges) / sum(found_edges) as edge_precision, sum(right_relations) / sum(matched_edges) as relation_accuracy from ev")
def match_rates(spark, sf_dir):
    return E.match_rates(episode_evaluation(spark, sf_dir))


@query("basis_matches", None)
def basis_matches(spark, sf_dir):
    """Samples take their best free claim in order; tests hold the rounds against a plain loop."""
    samples, _, found, _ = _annotated(spark, sf_dir)
    return X.basis_matches(samples, found)


@query("basis_accuracy", None)
def basis_accuracy(spark, sf_dir):
    return X.basis_accuracy(basis_matches(spark, sf_dir))


@query("topology_whole", None)
def topology_whole(spark, sf_dir):
    """The topology with depths, which SQL can't state; tests hold depths against a breadth-first search."""
    return S.topology_whole(graph(spark, sf_dir).staged()).withColumn("bases", F.expr("array_join(array_sort(transform(map_entries(bases), e -> concat(e.key, '=', e.value))), ';')"))


# caches, audits, index and sessions


_CACHE = "with c as (select o_custkey as h, o_orderpriority as m, o_orderkey % 3 as v, o_orderdate as at_, o_orderkey as k, case when o_orderkey % 5 = 0 then '{\"torn' else '{\"o\": ' || o_orderkey || '}' end as result from orders), l as (select h, m, v, arg_max(result, (at_, result)) as result from c group by all)"


@query("cached_extractions", _CACHE + " select h as content_hash, m as model, v as prompt_version, case when contains(result, 'torn') then null else result end as result, contains(result, 'torn') as torn from l union all select c_custkey, 'no model', 0, null, false from customer", base=False)
def cached_extractions(spark, sf_dir):
    """Lookups by content, model and prompt version; a torn result counts as none."""
    orders = derived.table(spark, sf_dir, "orders")
    cache = orders.selectExpr("o_custkey as content_hash", "o_orderpriority as model", "o_orderkey % 3 as prompt_version", "o_orderdate as created_at", """if(o_orderkey % 5 = 0, '{"torn', concat('{"o": ', o_orderkey, '}')) as result""")
    asked = cache.select(*M.EXTRACTION_KEY).distinct().unionByName(derived.table(spark, sf_dir, "customer").selectExpr("c_custkey as content_hash", "'no model' as model", "0L as prompt_version"))
    return M.cached_extractions(asked, cache)


@query("audits", None)
def audits(spark, sf_dir):
    """An audit a session, with all findings of its project counted; tests hold it against literal rows."""
    g = graph(spark, sf_dir).partly_staged()
    return M.audits_of(g, D.findings(g), g.claims.select("project", "session_id"), derived.AS_OF).select("id", "project", "session_id", "findings", "claim_count", "edge_count", "critical_count")


def _index(spark, sf_dir):
    """Claims of which some are archived, and an index of them that was appended to once."""
    claims = derived.claims(spark, sf_dir).withColumn("archived", F.expr("n % 6 = 0"))
    index = GramIndex(spark, new_path(spark, "gram-index"))
    index.append(claims.where("n % 3 <> 0"))
    index.append(claims.where("n % 3 = 0"))
    return claims, index


@query("indexed_search", " select id from claims where n % 6 <> 0 and contains(lower(text), 'tion') union all select id from claims where n % 6 <> 0 and project = 'p3' and contains(lower(text), 'an')")
def indexed_search(spark, sf_dir):
    claims, index = _index(spark, sf_dir)
    return index.search(claims, "TION").select("id").unionByName(index.search(claims, "an", "p3").select("id"))


@query("session_findings", None)
def session_findings(spark, sf_dir):
    """Findings over what is live of one session's claims; tests hold it against findings over just those."""
    claims = derived.claims(spark, sf_dir)
    return D.session_findings(claims, derived.edges(spark, sf_dir), claims.select("session_id", F.col("id").alias("claim_id")), "s3", derived.AS_OF)


@query("kind_percentiles", None)
def kind_percentiles(spark, sf_dir):
    """Percentiles by kind from sketches by kind and day; tests hold them against exact ranks."""
    daily = V.quantile_sketches(derived.table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), ["event_type", "day"])
    return V.merged_quantiles(daily, ["event_type"])
