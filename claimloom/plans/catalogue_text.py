"""Queries over texts, transcripts, triples, evaluations and events, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import chunking, text
from claimloom.functions.claims import STATUS_PATTERNS
from claimloom.operators import evaluation as E
from claimloom.operators import knowledge_base as K
from claimloom.operators import maintenance as M
from claimloom.operators import matching as X
from claimloom.operators import similarity as S
from claimloom.plans.catalogue_graph import BASE, graph
from claimloom.plans.staging import new_path
from claimloom.sources import derived, line_files, transcripts
from claimloom.streaming import events as V
from claimloom.streaming import timers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
table = derived.table


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# transcripts


def lines(spark, sf_dir):
    """JSON lines of the conversations: flat and nested by turn, strings and blocks, with some that don't parse."""
    rows = table(spark, sf_dir, "conversations")
    flat = F.to_json(F.struct("role", F.col("text").alias("content")))
    blocks = F.array(F.struct(F.lit("text").alias("type"), "text"), F.struct(F.lit("tool_use").alias("type"), F.lit("ignored").alias("text")))
    nested = F.to_json(F.struct(F.struct("role", blocks.alias("content")).alias("message")))
    value = F.when(F.col("turn") % 2 == 0, flat).otherwise(nested)
    good = rows.select("conv_id", (F.col("turn") * 2).alias("line_no"), value.alias("value"))
    bad = rows.select("conv_id", (F.col("turn") * 2 + 1).alias("line_no"), F.lit('{"role": "user", "content').alias("value"))
    return good.unionByName(bad)


def turns(spark, sf_dir):
    return transcripts.parse_lines(lines(spark, sf_dir), ["conv_id"])


_TURNS = "with t as (select conv_id, row_number() over (partition by conv_id order by turn) as turn, role, trim(text) as text from conversations where role in ('user', 'assistant')) "


@query("transcript_turns", _TURNS + "select conv_id, turn, role, text from t")
def transcript_turns(spark, sf_dir):
    return turns(spark, sf_dir)


def _line_files(spark, sf_dir):
    """The conversations' rows as lines of files that Spark writes, one a bucket of conversations, and the folder that holds them."""
    rows = table(spark, sf_dir, "conversations")
    said = F.concat_ws(":", "conv_id", "turn", F.coalesce("role", F.lit("")), F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]", " "))
    folder = new_path(spark, "line-files")
    dealt = rows.select((F.col("conv_id") % 4).alias("bucket"), "conv_id", "turn", said.alias("value")).repartition("bucket").sortWithinPartitions("bucket", "conv_id", "turn", "value")
    dealt.select("bucket", "value").write.partitionBy("bucket").text(folder)
    return folder


def _bucket():
    return F.regexp_extract("path", r"bucket=(\d+)", 1).cast("int").alias("bucket")


_LINES = "with l as (select conv_id % 4 as bucket, conv_id, turn, conv_id || ':' || turn || ':' || coalesce(role, '') || ':' || regexp_replace(coalesce(text, ''), '[\\r\\n]', ' ', 'g') as value from conversations), p as (select cast(bucket as int) as bucket, value, sum(strlen(value) + 1) over (partition by bucket order by conv_id, turn, value rows unbounded preceding) - strlen(value) - 1 as pos, sum(strlen(value) + 1) over (partition by bucket) as size from l)"


@query("tail_lines", _LINES + " select bucket, cast(pos as bigint) as pos, value from p where size <= 20000 or pos > size - 20000")
def tail_lines(spark, sf_dir):
    """The whole lines of the last 20,000 bytes of each file, read from its end."""
    return line_files.last_bytes(spark, _line_files(spark, sf_dir), 20_000, ".txt").select(_bucket(), F.col("at").alias("pos"), "value")


@query("last_lines", _LINES + ", w as (select *, row_number() over (partition by bucket order by pos desc) as k from p where size <= 32768 or pos > size - 32768) select bucket, cast(pos as bigint) as pos, value from w where k <= 5")
def last_lines(spark, sf_dir):
    return line_files.last_lines(spark, _line_files(spark, sf_dir), 5, suffix=".txt").select(_bucket(), F.col("at").alias("pos"), "value")


@query("appended_lines", _LINES + " select bucket, cast(pos as bigint) as pos, value from p")
def appended_lines(spark, sf_dir):
    """The lines of all files as a stream of what was appended since its last offsets, which at first is all."""
    stream = line_files.appended_lines(spark, _line_files(spark, sf_dir), ".txt", stretch=1 << 20)
    return V.run_to_table(stream, "appended-lines").select(_bucket(), F.col("at").alias("pos"), "value")


@query("transcript_last", _TURNS + "select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as k from t where text <> '') where k <= 3")
def transcript_last(spark, sf_dir):
    return transcripts.window_of(turns(spark, sf_dir), ["conv_id"], most=3).select("conv_id", "turn", "role")


@query("transcript_since", _TURNS + "select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn) as k from t where text <> '' and turn > 2) where k <= 2")
def transcript_since(spark, sf_dir):
    return transcripts.window_of(turns(spark, sf_dir), ["conv_id"], since=2, most=2).select("conv_id", "turn", "role")


@query("turn_counts", _TURNS + "select conv_id, count(*) as turns, count_if(role = 'user') as users from t group by 1")
def turn_counts(spark, sf_dir):
    return turns(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("users"))


@query("transcript_text", _TURNS + "select conv_id, string_agg(upper(role) || ': ' || text, chr(10) || chr(10) order by turn) as transcript from t group by 1")
def transcript_text(spark, sf_dir):
    return transcripts.transcript_text(turns(spark, sf_dir), ["conv_id"])


@query("merged_turns", "with r as (select conv_id, turn, case when (conv_id + turn) % 3 = 0 then 'user' else role end as role, text from conversations where role in ('user', 'assistant')), x as (select *, case when role = lag(role) over (partition by conv_id order by turn) then 0 else 1 end as ch from r), i as (select *, sum(ch) over (partition by conv_id order by turn) as island from x), m as (select conv_id, island, first(role order by turn) as role, string_agg(text, chr(10) || chr(10) order by turn) as text from i group by 1, 2), e as (select *, min(case when role = 'user' then island end) over (partition by conv_id) as a, max(case when role = 'assistant' then island end) over (partition by conv_id) as b from m) select conv_id, island, role, text from e where island between a and b")
def merged_turns(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')").withColumn("role", F.expr("if((conv_id + turn) % 3 = 0, 'user', role)"))
    return transcripts.merged_turns(rows.select("conv_id", "turn", "role", "text"), ["conv_id"])


@query("token_budget", _TURNS + "select conv_id, turn, tokens from (select *, cast(ceil(strlen(text) / 4.0) as bigint) as own, sum(cast(ceil(strlen(text) / 4.0) as bigint)) over (partition by conv_id order by turn) as tokens from t) where tokens - own < 150")
def token_budget(spark, sf_dir):
    return transcripts.token_budget(turns(spark, sf_dir), ["conv_id"], 150).select("conv_id", "turn", "tokens")


# texts

GRAMS = "list_distinct(flatten(list_transform(list_filter(list_transform(string_split_regex(lower(text), '\\s+'), lambda w: trim(w, '.,;:!?\"''()-[]{}…–—')), lambda w: len(w) >= 4), lambda w: list_transform(range(1, len(w) - 2), lambda i: substring(w, i, 4)))))"


@query("ngrams", BASE + f"select id, len({GRAMS}) as n, array_to_string(list_sort({GRAMS})[1:3], '|') as head from claims")
def ngrams(spark, sf_dir):
    rows = derived.claims(spark, sf_dir).select("id", text.ngrams(F.col("text")).alias("g"))
    return rows.select("id", F.size("g").alias("n"), F.array_join(F.slice(F.array_sort("g"), 1, 3), "|").alias("head"))


def _texts(spark, sf_dir):
    """Claims, and edited copies of some of them."""
    rows = derived.claims(spark, sf_dir).select("id", "project", "speaker", "text", "n")
    same = rows.where("n % 8 = 0").select(F.concat("id", F.lit("x")).alias("id"), "project", "speaker", "text", "n")
    near = rows.where("n % 5 = 0").select(F.concat("id", F.lit("y")).alias("id"), "project", "speaker", F.concat("text", F.lit(" additional words follow")).alias("text"), "n")
    return rows.unionByName(same).unionByName(near)


_TEXTS = BASE + f", tx as (select id, project, speaker, text from claims union all select id || 'x', project, speaker, text from claims where n % 8 = 0 union all select id || 'y', project, speaker, text || ' additional words follow' from claims where n % 5 = 0), g as (select id, project, speaker, list_sort({GRAMS}) as g from tx), h as (select project, speaker, g, min(id) as head from g where len(g) > 0 group by 1, 2, 3)"


@query("jaccard_pairs", _TEXTS + " select a.head as a, b.head as b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 9) as sim from h a join h b on a.project = b.project and a.speaker = b.speaker and a.head < b.head where 2 * len(list_intersect(a.g, b.g)) > len(list_distinct(list_concat(a.g, b.g)))")
def jaccard_pairs(spark, sf_dir):
    return S.similar_pairs(_texts(spark, sf_dir), block=("project", "speaker"))[0].withColumn("sim", F.round("sim", 9))


@query("jaccard_members", _TEXTS + " select h.head, g.id from g join h on g.project = h.project and g.speaker = h.speaker and g.g = h.g")
def jaccard_members(spark, sf_dir):
    """Whose set each head of ``jaccard_pairs`` stands for."""
    return S.similar_pairs(_texts(spark, sf_dir), block=("project", "speaker"))[1]


@query("cross_dedup", BASE + f", ex as (select id, project, speaker, created_at, list_sort({GRAMS}) as g from claims), nw as (select n as index, project, speaker, list_sort({GRAMS}) as g from (select n, project, speaker, text || ' additional words follow' as text from claims)) select index, first(id order by created_at, id) as id from nw join ex using (project, speaker) where len(nw.g) > 0 and len(ex.g) > 0 and 2 * len(list_intersect(nw.g, ex.g)) > len(list_distinct(list_concat(nw.g, ex.g))) group by 1")
def cross_dedup(spark, sf_dir):
    # all but the time of last reference, which isn't asked for
    claims = derived.base_claims(spark, sf_dir)
    new = claims.select(F.col("n").alias("index"), "project", "speaker", F.concat("text", F.lit(" additional words follow")).alias("text"))
    return S.match_existing(new, claims)


@query("batch_dedup")
def batch_dedup(spark, sf_dir):
    rows = _texts(spark, sf_dir).withColumn("index", F.xxhash64("id"))
    # every claim names its edited copies: its near one as its support, its equal one, now and then, as what it contradicts
    other = lambda mark, every: F.when(F.col("n") % every == 0, F.array(F.xxhash64(F.concat("id", F.lit(mark))))).otherwise(F.array().cast("array<long>"))
    lists = {"depends_on": other("x", 8), "supports": other("y", 5), "contradicts": other("x", 16), "questions": other("y", 35)}
    batch = rows.select("index", "text", F.element_at(F.array(*map(F.lit, derived.BASES)), (F.col("n") % 9 + 1).cast("int")).alias("basis"), F.lit("").alias("source"), "speaker", *[v.alias(c) for c, v in lists.items()])
    return S.deduplicate_batch(batch)


_CTX = BASE + f", heard as (select project, {GRAMS.replace('text', 'chunk')} as hg from (select project, string_agg(text, ' ' order by id) as chunk from claims where turn_number = 1 group by 1)), r as (select c.*, total, count(*) over (partition by project) as k, row_number() over (partition by project order by created_at desc, c.id desc) as late, len(list_intersect({GRAMS}, coalesce(hg, []))) as score from claims c left join dc using (id) left join heard using (project)), q as (select *, case when k <= 20 then 'all' when late <= 10 then 'recent' when total >= 3 then 'hub' end as reason from r), o as (select *, count(reason) over (partition by project) as taken, row_number() over (partition by project, reason is null and score >= 3 order by score desc, created_at, id) as place from q) select project, id, coalesce(reason, 'similar') as reason from o where reason is not null or (score >= 3 and place <= 20 - taken)"


@query("context_selection", _CTX)
def context_selection(spark, sf_dir):
    g = graph(spark, sf_dir)
    said = F.array_sort(F.collect_list(F.struct("id", "text")))
    chunks = g.claims.where("turn_number = 1").groupBy("project").agg(F.array_join(said["text"], " ").alias("chunk"))
    return S.select_context(g.claims, g.dependent_counts, chunks, most=20, recent=10)


def _marked(spark, sf_dir):
    return derived.claims(spark, sf_dir).selectExpr(
        "id", "n", "case when n % 2 = 0 then concat('We ran it because ', text) when n % 3 = 0 then concat(text, ' thus agents must wait') else text end as text",
        "case when n % 4 = 0 then 'convention' else basis end as basis", "case when n % 7 = 0 then 'The Handbook (2020)' when n % 5 = 0 then 'Nobody, nowhere' else '' end as source", "speaker",
    )


_MARKED = BASE + ", mk2 as (select id, n, case when n % 2 = 0 then 'We ran it because ' || text when n % 3 = 0 then text || ' thus agents must wait' else text end as text, case when n % 4 = 0 then 'convention' else basis end as basis, case when n % 7 = 0 then 'The Handbook (2020)' when n % 5 = 0 then 'Nobody, nowhere' else '' end as source from claims), low as (select *, lower(text) as l, 'they said the handbook is old' as heard from mk2)"
_PHRASE = {b: "(" + " or ".join(f"contains(l, '{p}')" for p in ps) + ")" for b, ps in text.MARKERS.items()}


@query("basis_validation", _MARKED + ", gr as (select *, len(list_filter(list_transform(string_split_regex(lower(source), '\\s+'), lambda w: trim(w, '.,;:!?\"''()-[]')), lambda w: strlen(w) > 3 and contains(heard, w))) > 0 as grounded from low) select id, case when basis = 'research' and (source = '' or not grounded) then 'llm_output' " + " ".join(f"when basis = '{b}' and not {p} then 'vibes'" for b, p in _PHRASE.items()) + " else basis end as basis, case when basis = 'research' and source <> '' and not grounded then '' else source end as source from gr")
def basis_validation(spark, sf_dir):
    v = text.validated_basis(F.col("basis"), F.col("source"), F.col("text"), F.lit("They said the Handbook is old"))
    return _marked(spark, sf_dir).select("id", v.alias("v")).select("id", "v.basis", "v.source")


@query("basis_coercion", BASE + "select id, case when n % 3 = 0 then case when speaker = 'assistant' then 'llm_output' else 'vibes' end else basis end as basis from claims")
def basis_coercion(spark, sf_dir):
    rows = derived.claims(spark, sf_dir).withColumn("told", F.expr("if(n % 3 = 0, 'hunch', basis)"))
    return rows.select("id", text.coerced_basis(F.col("told"), F.col("speaker")).alias("basis"))


_TAILS = (" All tests now pass", " It was  pushed.", " CI is green", " contests compass", " Works end-to-end", " lint: clean", " came back green", " tagged and pushed", " Smoke test passes", " process completed", "")


@query("ephemeral_status", BASE + "select id, text || " + str(list(_TAILS)) + "[n % 11 + 1] as said, " + " or ".join(f"regexp_matches(said, '{p}')" for p in STATUS_PATTERNS) + " as ephemeral from claims")
def ephemeral_status(spark, sf_dir):
    from claimloom.functions.claims import is_ephemeral

    tail = F.element_at(F.array(*map(F.lit, _TAILS)), (F.col("n") % 11 + 1).cast("int"))
    return derived.claims(spark, sf_dir).select("id", F.concat("text", tail).alias("said")).withColumn("ephemeral", is_ephemeral("said"))


@query("document_sessions", "select doc_id, 'doc:' || sha256('/docs/' || doc_id || '.md')[1:12] as session_id, sha256(text) as content_hash, strlen(text) as bytes, cast(ceil(strlen(text) / 4.0) as bigint) as tokens, doc_id || '.md' as source from documents")
def document_sessions(spark, sf_dir):
    path = F.concat(F.lit("/docs/"), "doc_id", F.lit(".md"))
    none = F.array().cast("array<string>")
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.document_session(path).alias("session_id"), text.content_hash(t).alias("content_hash"), F.octet_length(t).alias("bytes"), text.token_estimate(t).alias("tokens"), text.document_source(path, none).alias("source"))


@query("template_pick", "select doc_id, cast(concat('0x', sha256(text)[1:16])::ubigint % 7 as integer) as pick from documents")
def template_pick(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.template_index(F.col("text"), 7).alias("pick"))


@query("text_shapes", r"""select doc_id, trim(regexp_replace(text, '[ \n\t]+', ' ', 'g')) as collapsed, case when len(text) > 60 then substring(text, 1, 57) || '...' else text end as cut, regexp_replace(text, '[\x00-\x1f\x7f]', '', 'g') as printable from documents""")
def text_shapes(spark, sf_dir):
    from claimloom.functions.claims import truncated

    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.trim(F.regexp_replace(t, r"[ \n\t]+", " ")).alias("collapsed"), truncated("text", 60).alias("cut"), text.without_controls(t).alias("printable"))


@query("sentences", r"select doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')) as n, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')[1] as head from documents")
def sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").alias("n"), F.get("s", 0).alias("head"))


@query("verdicts", "with r as (select event_id, case event_id % 5 when 0 then 'ACTED_ON.' when 1 then 'maybe ignored' when 2 then 'Ambiguous or IGNORED' when 3 then 'xACTED_ON' else 'none' end as reply from events), v as (select event_id, regexp_extract_all(reply, '(?i)\\b(ACTED_ON|AMBIGUOUS|IGNORED)\\b') as f from r) select event_id, case when len(f) = 1 then upper(f[1]) end as verdict from v")
def verdicts(spark, sf_dir):
    return _replies(spark, sf_dir).select("event_id", "verdict")


def _replies(spark, sf_dir):
    said = F.array(*map(F.lit, ("ACTED_ON.", "maybe ignored", "Ambiguous or IGNORED", "xACTED_ON", "none")))
    rows = table(spark, sf_dir, "events").withColumn("reply", F.element_at(said, (F.col("event_id") % 5 + 1).cast("int")))
    return rows.withColumn("verdict", text.verdict(F.col("reply")))


@query("source_names", "select page_id, case when len(u) > 60 then substring(u, 1, 57) || '...' else u end as source from (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^https://', ''), '^http://', ''), '/$', ''), '\\?.*$', '') as u from pages)")
def source_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.compact_source(F.col("url")).alias("source"))


@query("chunks")
def chunks(spark, sf_dir):
    return chunking.chunk_documents(table(spark, sf_dir, "documents"), "doc_id", "text", 2000)


# triples


def triples(spark, sf_dir):
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    rows = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).join(region, nation["n_regionkey"] == region["r_regionkey"])
    kinds = F.element_at(F.array(*map(F.lit, ("Supports", "Disputes", "DependsOn", "IsPolyvalentTerm", "Unknown"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    at = F.concat(F.lit("k"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0"))
    return rows.select(at.alias("var_name"), kinds.alias("predicate"), F.col("n_name").alias("subject"), F.when(F.col("s_suppkey") % 11 == 0, "").otherwise(F.col("r_name")).alias("object"), F.expr("case when s_suppkey % 3 = 0 then '' when s_suppkey % 3 = 1 then concat('r', s_suppkey % 8) else 'missing' end").alias("prov_ref"))


def provenance(spark, sf_dir):
    return table(spark, sf_dir, "region").selectExpr("concat('r', r_regionkey) as var_name", "if(r_regionkey % 2 = 0, 'quoted', '') as quote", "concat('http://', r_name) as origin")


_KB = "with t as (select 'k' || lpad(s_suppkey::varchar, 8, '0') as id, ['Supports', 'Disputes', 'DependsOn', 'IsPolyvalentTerm', 'Unknown'][s_suppkey % 5 + 1] as p, n_name as s, r_name as o, case when s_suppkey % 3 = 0 then '' when s_suppkey % 3 = 1 then 'r' || (s_suppkey % 8) else 'missing' end as ref from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where s_suppkey % 11 <> 0), r as (select 'r' || r_regionkey as ref, r_regionkey % 2 = 0 as quoted, 'http://' || r_name as origin from region), k as (select t.*, case when t.ref = '' then false when r.ref is null then true else quoted end as q, coalesce(origin, '') as origin from t left join r using (ref))"


def _kb(spark, sf_dir):
    return K.with_provenance(triples(spark, sf_dir), provenance(spark, sf_dir))


@query("kb_claims", _KB + " select id, s || ' --' || p || '--> ' || o as text, case when q then 'research' else 'assumption' end as basis, case when q then 0.8 else 0.7 end::double as confidence, origin as source, case p when 'Disputes' then 'contradicts' when 'DependsOn' then 'depends_on' when 'IsPolyvalentTerm' then 'questions' else 'supports' end as mapped_relation from k")
def kb_claims(spark, sf_dir):
    return K.kb_claims(_kb(spark, sf_dir)).select("id", "text", "basis", "confidence", "source", "mapped_relation")


@query("kb_edges", _KB + ", e as (select id, s as x from k union select id, o from k), st as (select distinct id as from_id, to_id from (select id, lead(id) over (partition by x order by id) as to_id from e) where to_id is not null) select 'kb-' || from_id || '-' || to_id as id, from_id, to_id, case when a.p = 'Disputes' or b.p = 'Disputes' then 'contradicts' else 'supports' end as relation from st join k a on a.id = from_id join k b on b.id = to_id")
def kb_edges(spark, sf_dir):
    return K.kb_edges(_kb(spark, sf_dir)).select("id", "from_id", "to_id", "relation")


# evaluation

_GRADES = "with g as (select doc_id % 4 as fixture, case when quality is null then 'ungradable' when quality = 1 and toxic = 0 then 'substantive' when toxic = 1 and quality = 1 then 'ambiguous' else 'frivolous' end as grade from labels), s as (select fixture, count_if(grade = 'substantive') as s, count_if(grade = 'frivolous') as f from g group by 1)"


def _substantive(spark, sf_dir):
    grade = F.expr("case when quality is null then 'ungradable' when quality = 1 and toxic = 0 then 'substantive' when toxic = 1 and quality = 1 then 'ambiguous' else 'frivolous' end")
    return E.substantive(table(spark, sf_dir, "labels").select((F.col("doc_id") % 4).alias("fixture"), grade.alias("grade")), ["fixture"])


@query("substantive_rates", _GRADES + " select fixture, s as substantive, f as frivolous, s + f as gradable, case when s + f > 0 then s / (s + f) else 0 end as rate, case when s / (s + f) >= 0.85 then 'strong' when s / (s + f) >= 0.7 then 'good' when s / (s + f) >= 0.5 then 'mixed' else 'weak' end as band from s")
def substantive_rates(spark, sf_dir):
    return _substantive(spark, sf_dir).withColumn("band", E.band(F.col("rate")))


@query("validity_gate", _GRADES + " select case when p.s + p.f < 20 then 'pos_small_n' when n.s + n.f < 20 then 'neg_small_n' when p.s / (p.s + p.f) < 0.7 then 'pos_low' when n.s / (n.s + n.f) > 0.3 then 'neg_high' else 'valid' end as kind from s p, s n where p.fixture = 0 and n.fixture = 1")
def validity_gate(spark, sf_dir):
    rates = _substantive(spark, sf_dir)
    of = lambda fixture, c: F.max(F.when(F.col("fixture") == fixture, F.col(c)))
    return rates.agg(of(0, "gradable").alias("pn"), of(1, "gradable").alias("nn"), of(0, "rate").alias("pr"), of(1, "rate").alias("nr")).select(E.validity(F.col("pn"), F.col("nn"), F.col("pr"), F.col("nr")).alias("kind"))


_CELLS = "with r as (select case event_id % 4 when 0 then 'pos' when 1 then 'neg' when 2 then 'negLong' else 'main' end as cell, case when event_id % 5 = 0 then 'ACTED_ON' when event_id % 5 = 1 then 'IGNORED' end as verdict from events), c as (select cell, count_if(verdict = 'ACTED_ON') as acted, 0::bigint as ambiguous, count_if(verdict = 'IGNORED') as ignored, count_if(verdict is null) as ungradable from r group by 1), d as (select *, case when acted + ignored > 0 then acted / (acted + ignored) else 0 end as rate from c)"


def _cells(spark, sf_dir):
    cell = F.element_at(F.array(*map(F.lit, ("pos", "neg", "negLong", "main"))), (F.col("event_id") % 4 + 1).cast("int"))
    return E.delivery_cells(_replies(spark, sf_dir).withColumn("cell", cell), ["cell"])


@query("delivery_cells", _CELLS + " select * from d")
def delivery_cells(spark, sf_dir):
    return _cells(spark, sf_dir)


@query("delivery_gate", _CELLS + ", g as (select max(rate) filter (cell = 'pos') as pos, max(rate) filter (cell = 'neg') as neg, max(rate) filter (cell = 'negLong') as neg_long from d) select *, case when pos is null then 'missing pos' when pos < 0.7 then 'pos low' else 'ceiling holds' end as reason, pos >= 0.7 as valid, neg > 0.3 as neg_note, neg_long > 0.3 as neg_long_note from g")
def delivery_gate(spark, sf_dir):
    return E.delivery_gate(_cells(spark, sf_dir))


@query("arm_difference", "with r as (select event_id % 3 as length, case when event_id % 2 = 0 then 'A' else 'B' end as arm, event_id % 5 as v from events), c as (select length, arm, count_if(v = 0) / count_if(v < 2) as rate from r group by 1, 2) select length, max(rate) filter (arm = 'A') as rate_a, max(rate) filter (arm = 'B') as rate_b, max(rate) filter (arm = 'B') - max(rate) filter (arm = 'A') as delta from c group by 1")
def arm_difference(spark, sf_dir):
    rows = _replies(spark, sf_dir).withColumns({"length": F.col("event_id") % 3, "arm": F.expr("if(event_id % 2 = 0, 'A', 'B')")})
    return E.arm_difference(E.delivery_cells(rows, ["length", "arm"]))


@query("basis_confusion", BASE + ", p as (select basis as expected, case when n % 4 = 0 then 'vibes' else basis end as got from claims) select expected, got, count(*) as n, sum(count(*)) over (partition by expected) as of, count(*) / sum(count(*)) over (partition by expected) as share from p group by 1, 2")
def basis_confusion(spark, sf_dir):
    return E.confusion(derived.claims(spark, sf_dir).selectExpr("basis as expected", "if(n % 4 = 0, 'vibes', basis) as got"), "expected", "got")


@query("run_stats", "select event_type, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as sd, min(value) as least, max(value) as most from events group by 1")
def run_stats(spark, sf_dir):
    return E.run_stats(table(spark, sf_dir, "events"), ["event_type"]).withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


@query("stability", "with f as (select event_type as type, (user_id % 200)::varchar as text, event_id % 5 as run from events), e as (select type, text, count(distinct run) as k from f group by 1, 2), s as (select type, count(*) as distinct_findings, count_if(k = 5) as in_all from e group by 1) select *, in_all / distinct_findings as share, case when in_all / distinct_findings > 0.7 then 'stable' when in_all / distinct_findings > 0.3 then 'partial' else 'churns' end as verdict from s")
def stability(spark, sf_dir):
    return E.stability(table(spark, sf_dir, "events").selectExpr("event_type as type", "cast(user_id % 200 as string) as text", "event_id % 5 as run"), 5)


@query("edge_matches", BASE + ", gold as (select from_id, to_id, relation from edges), fnd as (select to_id as from_id, from_id as to_id, case when substr(id, length(id), 1) in ('1', '3') then 'supports' else relation end as relation from edges where substr(from_id, length(from_id), 1) in ('1', '3', '5')) select least(g.from_id, g.to_id) as a, greatest(g.from_id, g.to_id) as b, g.relation as want, f.from_id is not null as matched, coalesce(f.relation = g.relation, false) as agrees from gold g left join fnd f on f.from_id = g.to_id and f.to_id = g.from_id")
def edge_matches(spark, sf_dir):
    edges = derived.edges(spark, sf_dir).withColumn("episode", F.lit(0))
    found = edges.where("right(from_id, 1) in ('1', '3', '5')").selectExpr("episode", "to_id as from_id", "from_id as to_id", "if(right(id, 1) in ('1', '3'), 'supports', relation) as relation")
    return E.edge_matches(edges, found).select("a", "b", "want", "matched", "agrees")


@query("gold_matches")
def gold_matches(spark, sf_dir):
    """The claims of a session's user matched greedily to those of its assistant."""
    rows = derived.claims(spark, sf_dir).select(F.col("session_id").alias("episode"), F.col("n").alias("place"), "text", "speaker")
    return X.greedy_matches(X.overlapping(rows.where("speaker = 'user'"), rows.where("speaker = 'assistant'"), 0.05))


# logs, caches, events


@query("latest_extraction", "select o_custkey as content_hash, max(o_orderdate) as created_at, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as result from orders group by 1")
def latest_extraction(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey as content_hash", "o_orderdate as created_at", "o_orderkey as result")
    return M.latest_by_key(rows, ["content_hash"], "created_at")


@query("fresh_cache", "with r as (select event_id, event_type = 'error' as failed, timestamp '2024-03-01 06:00:00' - to_hours(cast(event_id % 300 as integer)) as fetched_at from events) select event_id from r where timestamp '2024-03-01 06:00:00' - fetched_at <= case when failed then interval 1 hour else interval 7 day end")
def fresh_cache(spark, sf_dir):
    age = F.expr("make_dt_interval(0, cast(event_id % 300 as int))")
    keep = F.when(F.col("event_type") == "error", age <= F.expr("interval '1' hour")).otherwise(age <= F.expr("interval '7' day"))
    return table(spark, sf_dir, "events").where(keep).select("event_id")


@query("turns_to_look", "select conv_id, turn from conversations where turn = 1 or turn % 3 = 0")
def turns_to_look(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(M.fires_on_turn(F.col("turn"))).select("conv_id", "turn")


@query("kind_stats", "select event_type, count(*) as n, round(avg(value), 6) as mean_value, max(value) as most, count(distinct user_id) as users from events group by 1")
def kind_stats(spark, sf_dir):
    return V.kind_stats(table(spark, sf_dir, "events")).withColumn("mean_value", F.round("mean_value", 6))


_NTZ = "to_timestamp_ntz(date_format({0}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')) as {0}"


@query("tumbling", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def tumbling(spark, sf_dir):
    return V.tumbling(table(spark, sf_dir, "events")).selectExpr(_NTZ.format("start"), "event_type", "n", "round(total, 4) as total")


@query("sliding", "select start, event_type, count(*) as n from (select unnest([time_bucket(interval 1 hour, ts), time_bucket(interval 1 hour, ts) - interval 1 hour]) as start, event_type from events) group by 1, 2")
def sliding(spark, sf_dir):
    return V.sliding(table(spark, sf_dir, "events")).selectExpr(_NTZ.format("start"), "event_type", "n")


@query("sessionized", "with x as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events), i as (select *, sum(fresh) over (partition by user_id order by ts, fresh desc rows unbounded preceding) as s from x) select user_id, min(ts) as start, max(ts) + interval 30 minute as stop, count(*) as n from i group by user_id, s")
def sessionized(spark, sf_dir):
    return V.sessions(table(spark, sf_dir, "events")).selectExpr("user_id", _NTZ.format("start"), _NTZ.format("stop"), "n")


@query("stream_first_fires", "select distinct user_id, event_type from events")
def stream_first_fires(spark, sf_dir):
    stream = V.event_stream(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema)
    return V.run_to_table(V.first_of_key(stream, ["user_id", "event_type"]).select("user_id", "event_type"), "first-fires")


@query("stream_cooldown")
def stream_cooldown(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    stream = V.event_stream(spark, f"{sf_dir}/events.parquet*", events.schema)
    return V.run_to_table(V.cooldown(_candidates(stream)), "cooldown")


def _candidates(events):
    return events.selectExpr("concat('c', user_id % 50) as claim_id", "event_type as type", "ts as fired_at", "event_id % 3 = 0 as persistent")


@query("batch_cooldown")
def batch_cooldown(spark, sf_dir):
    return V.cooldown(_candidates(table(spark, sf_dir, "events")))


@query("stream_sweeps")
def stream_sweeps(spark, sf_dir):
    """Debounced sweeps of the events' users, with timers for what is left; tests hold them against a plain walk through time."""
    events = table(spark, sf_dir, "events")
    rows = V.event_stream(spark, f"{sf_dir}/events.parquet*", events.schema).selectExpr("concat('u', user_id % 50) as project", "cast(ts as timestamp) as at", "event_id % 2500 as pending", "cast(null as timestamp) as stamp")
    before = spark.conf.get(timers.STORE[0])
    spark.conf.set(*timers.STORE)
    try:
        swept = V.run_to_table(timers.debounced_sweeps(rows), "sweeps")
    finally:
        spark.conf.set(timers.STORE[0], before)
    return swept.selectExpr("project", _NTZ.format("at"), "archived", "overflow", "cause")
