"""From a batch of extracted claims to claims, edges and memberships, and what goes out again.

An extracted batch has ``batch`` (a session or document), ``index``, ``text``, ``basis``,
``confidence``, ``source``, ``speaker``, flags, four lists of indices and four of ids of
claims that exist. Many batches go at once. Ids are hashes of batch and index, so a task
that runs again gives the same ones.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.claims import truncated
from claimloom.functions.text import coerced_basis, validated_basis
from claimloom.operators.maintenance import close_superseded, insert_edges, prune_edges, set_archived, sweep_capped, touch
from claimloom.operators.similarity import deduplicate_batch, match_existing
from claimloom.plans.claim_graph import ClaimGraph
from claimloom.plans.staging import stage

LISTS = ("depends_on", "supports", "contradicts", "questions")
FLAGS = (
    "terminates_inquiry", "grand_significance", "unique_connection", "dismisses_counterevidence", "ability_overstatement",
    "sentience_claim", "relational_drift", "consequential_action",
)
#: Flags that an extraction never sets.
UNSET = ("challenged", "verified", "closed", "archived")


def batch_id(batch: Column, index: Column) -> Column:
    return F.concat(F.lit("x"), F.substring(F.sha2(F.concat_ws(":", batch.cast("string"), index.cast("string")), 256), 1, 24))


def claims_from_extracted(extracted: DataFrame, project: Column, as_of: str) -> DataFrame:
    """Claims of extracted rows, with ``batch`` and ``index``; the turn is not known, and a basis outside the list gives way."""
    now = F.expr(f"timestamp_ntz '{as_of}'")
    flags = [(F.coalesce(c, F.lit(False)) if c in extracted.columns else F.lit(False)).alias(c) for c in FLAGS]
    return extracted.select(
        "batch", "index", batch_id(F.col("batch"), F.col("index")).alias("id"), "text",
        coerced_basis(F.col("basis"), F.col("speaker")).alias("basis"), "confidence", F.coalesce("source", F.lit("")).alias("source"),
        F.col("batch").alias("session_id"), project.alias("project"), F.lit(0).alias("turn_number"), "speaker", now.alias("created_at"), now.alias("last_referenced_at"),
        *flags, *[F.lit(False).alias(c) for c in UNSET],
    )


def insert_claims(claims: DataFrame, new: DataFrame, project: str, as_of: str) -> DataFrame:
    """Claims with the new ones, whose missing id, project and times are filled in; an id that is there stays as it is.

    A missing id is a hash of session and text. Of new rows of one id, given or made,
    the least row enters.
    """
    given = lambda c: F.expr(f"nullif({c}, '')")
    filled = new.withColumns({
        "id": F.coalesce(given("id"), batch_id(F.coalesce("session_id", F.lit("")), F.col("text"))),
        "project": F.coalesce(given("project"), F.lit(project)),
        "created_at": F.coalesce("created_at", F.expr(f"timestamp_ntz '{as_of}'")),
    }).withColumn("last_referenced_at", F.coalesce("last_referenced_at", "created_at"))
    shared = [c for c in claims.columns if c in filled.columns]
    fresh = filled.select(*shared).join(claims.select("id"), "id", "left_anti")
    rest = [c for c in shared if c != "id"]
    once = fresh.groupBy("id").agg(F.min(F.struct(*rest)).alias("row")).select("id", *[F.col("row")[c].alias(c) for c in rest])
    return claims.unionByName(once.select(*shared), allowMissingColumns=True)


def record_membership(bridge: DataFrame, new: DataFrame) -> DataFrame:
    """``(session_id, claim_id)`` with the new pairs, each once."""
    return bridge.select("session_id", "claim_id").unionByName(new.select("session_id", "claim_id")).distinct()


def edges_of_batch(extracted: DataFrame, ids: DataFrame, existing: DataFrame, as_of: str) -> DataFrame:
    """New edges that the lists name: by index within the batch, and to claims that exist.

    ``ids`` (batch, index, id) tells what each index has become. Edges to oneself and to
    what isn't there are left out, and of equal ones one is kept.
    """
    named = lambda lists, kind: F.array(*[F.struct(F.lit(r).alias("relation"), F.coalesce(c, F.array().cast(f"array<{kind}>")).alias("heads")) for r, c in lists])
    tails = extracted.join(ids, ["batch", "index"]).withColumnRenamed("id", "from_id")
    inner = tails.select("batch", "from_id", F.explode(named([(r, r) for r in LISTS], "long")).alias("l")).select("batch", "from_id", "l.relation", F.explode("l.heads").alias("index"))
    inner = inner.join(ids.withColumnRenamed("id", "to_id"), ["batch", "index"]).select("from_id", "to_id", "relation")
    outer = tails.select("from_id", F.explode(named([(r, f"{r}_existing") for r in LISTS], "string")).alias("l")).select("from_id", "l.relation", F.explode("l.heads").alias("to_id"))
    outer = outer.join(existing.select(F.col("id").alias("to_id")), "to_id", "left_semi").select("from_id", "to_id", "relation")
    pairs = inner.unionByName(outer).where("from_id <> to_id").distinct()
    return pairs.select(F.concat_ws("-", "from_id", "to_id", "relation").alias("id"), "from_id", "to_id", "relation", F.lit(1.0).alias("strength"), F.expr(f"timestamp_ntz '{as_of}'").alias("created_at"))


def validated_batch(extracted: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Extracted rows whose basis holds against the transcript (batch, transcript) that their batch was extracted from.

    A batch without one, or with an empty one, is left as it is.
    """
    heard = transcripts.groupBy("batch").agg(F.max("transcript").alias("heard_text")).where("heard_text <> ''")
    checked = validated_basis(F.col("basis"), F.col("source"), F.col("text"), F.col("heard_text"))
    rows = extracted.join(heard, "batch", "left").withColumn("checked_basis", checked)
    told = {c: F.when(F.col("heard_text").isNotNull(), F.col("checked_basis")[c]).otherwise(F.col(c)) for c in ("basis", "source")}
    return rows.withColumns(told).select(*extracted.columns)


def deduplicated_batches(extracted: DataFrame) -> DataFrame:
    """Extracted rows after near-duplicates within each batch have become one.

    What represents a class keeps its own further columns and takes the indices, the ids
    of existing claims and the strongest basis of all.
    """
    # places of all batches at once: a batch and an index give one number, and back
    key = F.xxhash64("batch", "index")
    own = [f"{r}_existing" for r in LISTS]
    none = F.array().cast("array<long>")
    place = lambda r: F.transform(F.coalesce(r, none), lambda i: F.xxhash64(F.col("batch"), i)).alias(r)
    rows = stage(extracted.select(key.alias("key"), *extracted.columns), "batch-rows").df
    numbered = rows.select(F.col("key").alias("index"), "batch", "text", "basis", "source", "speaker", *[place(r) for r in LISTS])
    kept = deduplicate_batch(numbered, block=("batch", "speaker"), members=True)
    back = rows.select("key", "index")
    out = kept.select(F.col("index").alias("key"), "basis", "source", "members", *LISTS)
    for r in LISTS:
        named = out.select("key", F.explode(r).alias("to")).join(back.select(F.col("key").alias("to"), "index"), "to").groupBy("key").agg(F.array_sort(F.collect_set("index")).alias("named"))
        out = out.drop(r).join(named, "key", "left").withColumn(r, F.coalesce("named", none)).drop("named")
    said = out.select("key", F.explode("members").alias("was")).join(rows.select(F.col("key").alias("was"), *own), "was")
    ids = said.groupBy("key").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>")))))).alias(c) for c in own])
    rest = [c for c in extracted.columns if c not in ("basis", "source", *LISTS, *own)]
    whole = rows.select("key", *rest).join(out.drop("members"), "key").join(ids, "key")
    return whole.select(*extracted.columns)


class Ingested(NamedTuple):
    claims: DataFrame
    edges: DataFrame
    bridge: DataFrame


def ingest_batch(
    claims: DataFrame, edges: DataFrame, bridge: DataFrame, extracted: DataFrame, project: str, as_of: str,
    transcripts: DataFrame | None = None, documents: bool = False, most_edges: int = 5, sweep_cap: int | None = None,
) -> Ingested:
    """Claims, edges and memberships after batches of one project have come in.

    Bases are checked against ``transcripts`` (batch, transcript), if given, and
    near-duplicates of a batch become one. What is like an existing claim of its project
    and speaker becomes that one; if it was archived it is taken back, which is a
    reference at ``as_of``, and is a member of the session. One that wasn't archived
    stays in the sessions that it is in, except where the batches are ``documents``,
    whose sessions hold all that they say. All else is new and a member. Edges are added
    and touch their ends, of the project's edges between unarchived claims each claim keeps ``most_edges`` outgoing ones,
    and claims of the project that a newer one contradicts are closed. With
    ``sweep_cap`` (below one: all) its stale claims are archived at the end.

    Rows of one batch and index are one (the least). An empty batch only prunes, closes
    and sweeps. A batch or index that is null has no lists and is named by no other.
    """
    now = F.expr(f"timestamp_ntz '{as_of}'")
    rest = [c for c in extracted.columns if c not in ("batch", "index")]
    rows = extracted.groupBy("batch", "index").agg(F.min(F.struct(*rest)).alias("row")).select("batch", "index", *[F.col("row")[c].alias(c) for c in rest])
    rows = rows if transcripts is None else validated_batch(rows, transcripts)
    rows = stage(deduplicated_batches(rows), "ingest-rows").df
    probes = rows.select(F.struct("batch", "index").alias("index"), F.lit(project).alias("project"), "speaker", "text")
    was = claims.select(F.col("id").alias("known"), F.coalesce("archived", F.lit(False)).alias("was_archived"))
    known = match_existing(probes, claims).select("index.batch", "index.index", F.col("id").alias("known")).join(was, "known")
    known = stage(known.select("batch", "index", "known", "was_archived"), "ingest-known").df
    fresh = claims_from_extracted(rows, F.lit(project), as_of)
    ids = stage(fresh.select("batch", "index", "id").join(known, ["batch", "index"], "left").select("batch", "index", F.coalesce("known", "id").alias("id"), "known", "was_archived"), "ingest-ids").df
    new = fresh.join(known, ["batch", "index"], "left_anti").drop("batch", "index")
    back = known.where("was_archived").select(F.col("known").alias("id"))
    out = stage(insert_claims(set_archived(claims, back, False, as_of=as_of), new, project, as_of), "ingest-claims").df
    added = edges_of_batch(rows, ids.select("batch", "index", "id"), out, as_of)
    fresh_edges = stage(insert_edges(edges, added).join(edges.select("id"), "id", "left_anti"), "ingest-edges").df
    links = edges.select(*fresh_edges.columns).unionByName(fresh_edges)
    mine = out.where(F.col("project") == project).select("id")
    active = ClaimGraph(out.where(F.col("project") == project), links, as_of).edges.select(*links.columns)
    other = links.join(active.select("id"), "id", "left_anti").select(*links.columns)
    links = stage(prune_edges(active, most_edges).unionByName(other), "ingest-links").df
    closed = close_superseded(touch(out, fresh_edges), links.join(mine.withColumnRenamed("id", "from_id"), "from_id", "left_semi"))
    member = ids.where(F.lit(documents) | F.col("known").isNull() | F.col("was_archived"))
    bridge = record_membership(bridge, member.select(F.col("batch").alias("session_id"), F.col("id").alias("claim_id")))
    if sweep_cap is not None:
        closed = stage(closed, "ingest-closed").df
        stale = sweep_capped(ClaimGraph(closed.where(F.col("project") == project), links, as_of), sweep_cap)
        closed = set_archived(closed, stale.select("id"), True)
    return Ingested(closed, links, bridge)


def export_rows(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """``(project, kind, id, json)``: a JSON object a claim and an edge."""
    of = claims.select("project", F.lit("claim").alias("kind"), "id", F.to_json(F.struct("id", "text", "basis", "confidence", "speaker", "session_id")).alias("json"))
    tails = claims.select(F.col("id").alias("from_id"), "project")
    lines = edges.join(tails, "from_id").select("project", F.lit("edge").alias("kind"), "id", F.to_json(F.struct("id", "from_id", "to_id", "relation", "strength")).alias("json"))
    return of.unionByName(lines)


def dot_lines(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """``(project, part, id, line)``: the Graphviz lines of each project's nodes (part 0) and edges (part 1)."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))
    label = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(truncated("text", 40), r'(["\\])', r"\\$1"), r"\n", r"\\n"), F.lit("\\n["), F.col("basis"), F.lit(']"'))
    nodes = claims.select("project", F.lit(0).alias("part"), "id", F.concat(quoted(F.col("id")), F.lit(" [label="), label, F.lit("];")).alias("line"))
    tails = claims.select(F.col("id").alias("from_id"), "project")
    style = F.when(F.col("relation") == "contradicts", "dashed").otherwise("solid")
    line = F.concat(quoted(F.col("from_id")), F.lit(" -> "), quoted(F.col("to_id")), F.lit(" [label="), quoted(F.col("relation")), F.lit(", style="), style, F.lit("];"))
    return nodes.unionByName(edges.join(tails, "from_id").select("project", F.lit(1).alias("part"), "id", line.alias("line")))
