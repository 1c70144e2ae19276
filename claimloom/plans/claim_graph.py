"""Frames that the graph operators share, over all projects at once.

A dependent rests on its anchor: ``a supports b`` makes b a dependent of a, and
``a depends_on b`` makes a one of b. The other count, of incoming structural edges,
takes the head of either relation.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.functions.claims import PUSHBACK, STRUCTURAL, is_recent, moore_flagged
from claimloom.plans.components import connected_components
from claimloom.plans.staging import stage, stage_told


class ClaimGraph:
    """Active claims and edges, and what is derived from them once."""

    def __init__(self, claims: DataFrame, edges: DataFrame, as_of: str):
        self.as_of = as_of
        self.all_claims, self.all_edges = claims, edges
        self.is_staged = self.is_partly_staged = False

    @cached_property
    def claims(self) -> DataFrame:
        return self.all_claims.where(~F.coalesce("archived", F.lit(False)))

    @cached_property
    def edges(self) -> DataFrame:
        """Edges both of whose ends are active claims of one project, with that project."""
        ids = self.claims.select("id", F.coalesce("project", F.lit("")).alias("of"), "project")
        tails = ids.select(F.col("id").alias("from_id"), "of", "project")
        return self.all_edges.join(tails, "from_id").join(ids.select(F.col("id").alias("to_id"), "of"), ["to_id", "of"], "left_semi").drop("of")

    def staged(self) -> ClaimGraph:
        """The same graph with the frames that many operators share written once, each from those before it."""
        out = self.partly_staged()
        if not out.is_staged:
            out.stage_clusters()
        return out

    def partly_staged(self) -> ClaimGraph:
        """:meth:`staged` but for components and clusters, which ``stage_clusters`` adds."""
        if self.is_partly_staged:
            return self
        out = ClaimGraph(self.all_claims, self.all_edges, self.as_of)
        out.claims = stage(self.claims, "claims").df
        out.edges = stage(out.edges, "claim-edges").df
        out.weighed = stage(out.weighed, "claims-weighed").df
        out.marks = out.weighed.where("degree > 0").select("id", "pushed_back", "contradicted", "has_in", "has_out", "degree")
        out.dependent_counts = out.weighed.where("total > 0").select("id", "total", "recent", "sessions")
        out.is_partly_staged = True
        return out

    def stage_clusters(self) -> None:
        self.components = stage(self.components, "claim-components").df
        self.clusters = stage(self.clusters, "claim-clusters").df
        self.is_staged = True

    @cached_property
    def dependents(self) -> DataFrame:
        """``(anchor, dep)``, one row an edge."""
        return self.edges.where(F.col("relation").isin(*STRUCTURAL)).selectExpr(
            "if(relation = 'supports', from_id, to_id) as anchor", "if(relation = 'supports', to_id, from_id) as dep"
        )

    @cached_property
    def incoming(self) -> DataFrame:
        """``(id, n_incoming)`` structural edges into each claim that has any."""
        return self.edges.where(F.col("relation").isin(*STRUCTURAL)).groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("n_incoming"))

    @cached_property
    def dependent_counts(self) -> DataFrame:
        """``(id, total, recent, sessions)`` of each claim with dependents."""
        deps = self.claims.select(F.col("id").alias("dep"), is_recent(self.as_of).alias("recent"), F.expr("nullif(session_id, '')").alias("session"))
        return (
            self.dependents.join(deps, "dep", "left")
            .groupBy(F.col("anchor").alias("id"))
            .agg(F.count("*").alias("total"), F.count_if("recent").alias("recent"), F.countDistinct("session").alias("sessions"))
        )

    @cached_property
    def marks(self) -> DataFrame:
        """``(id, pushed_back, contradicted, has_in, has_out, degree)`` of each claim that an edge touches."""
        structural = F.col("relation").isin(*STRUCTURAL)
        ends = self.edges.select(
            F.explode(
                F.array(
                    F.struct(F.col("from_id").alias("id"), F.lit(False).alias("head")),
                    F.struct(F.col("to_id").alias("id"), F.lit(True).alias("head")),
                )
            ).alias("end"),
            "relation",
        )
        return ends.groupBy("end.id").agg(
            F.bool_or(F.col("end.head") & F.col("relation").isin(*PUSHBACK)).alias("pushed_back"),
            F.bool_or(F.col("relation") == "contradicts").alias("contradicted"),
            F.bool_or(F.col("end.head") & structural).alias("has_in"),
            F.bool_or(~F.col("end.head") & structural).alias("has_out"),
            F.count("*").alias("degree"),
        )

    @cached_property
    def adoptions(self) -> DataFrame:
        """``(id, adoptions)``: structural edges from an assistant's claims into each."""
        bots = self.claims.where("speaker = 'assistant'").select(F.col("id").alias("from_id"))
        return self.edges.where(F.col("relation").isin(*STRUCTURAL)).join(bots, "from_id", "left_semi").groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("adoptions"))

    @cached_property
    def session_marks(self) -> DataFrame:
        """Per session: drifting assistant claims, flagged live claims, and whether a live one is grounded."""
        live = ~F.col("closed") & ~F.col("challenged")
        drift = (F.col("speaker") == "assistant") & ~F.col("closed") & (F.col("sentience_claim") | F.col("relational_drift"))
        return self.claims.groupBy("project", "session_id").agg(
            F.count_if(drift).alias("drifting"),
            F.count_if(live & moore_flagged()).alias("flagged"),
            F.coalesce(F.bool_or(live & F.col("basis").isin("research", "empirical")), F.lit(False)).alias("grounded"),
        )

    @cached_property
    def weighed(self) -> DataFrame:
        """Claims with their dependents' counts, marks, adoptions and what their session is like; zeros and false where there are none."""
        out = self.claims.join(self.dependent_counts, "id", "left").join(self.incoming, "id", "left").join(self.marks, "id", "left").join(self.adoptions, "id", "left")
        session = self.session_marks.withColumnsRenamed({"project": "its_project", "session_id": "its_session"})
        out = out.join(session, F.col("project").eqNullSafe(F.col("its_project")) & F.col("session_id").eqNullSafe(F.col("its_session")), "left").drop("its_project", "its_session")
        zero = {c: F.coalesce(c, F.lit(0)) for c in ("total", "recent", "sessions", "n_incoming", "degree", "adoptions")}
        return out.withColumns(zero | {c: F.coalesce(c, F.lit(False)) for c in ("pushed_back", "contradicted", "has_in", "has_out")})

    @cached_property
    def components(self) -> DataFrame:
        """``(id, component)`` of each claim that an edge joins to another."""
        found = connected_components(self.edges.select("from_id", "to_id"), "from_id", "to_id")
        return found.select(F.col("node").alias("id"), "component")

    @cached_property
    def clusters(self) -> DataFrame:
        """One row a cluster of two claims or more: sizes, edges, density, importance and attention."""
        members = self.claims.join(self.components, "id").join(self.dependent_counts.select("id", "total"), "id", "left")
        sizes = members.groupBy("project", "component").agg(
            F.count("*").alias("size"),
            F.coalesce(F.sum("total"), F.lit(0)).alias("importance"),
            F.sort_array(F.collect_set("id")).alias("members"),
            F.min_by("text", F.struct("created_at", "id")).alias("first_text"),
        )
        inside = self.edges.join(self.components.withColumnRenamed("id", "from_id"), "from_id").groupBy("component").agg(F.count("*").alias("n_edges"))
        return (
            sizes.join(inside, "component")
            .withColumn("density", F.col("n_edges") / (F.col("size") * (F.col("size") - 1) / 2))
            .withColumn("attention", F.col("size") + F.col("n_edges"))
            .withColumn("label", F.array_join(F.slice(F.split(F.trim("first_text"), r"\s+"), 1, 4), " "))
        )

    @cached_property
    def cascades(self) -> DataFrame:
        """Claims that fit a cascade, with the run of their session that they belong to."""
        from claimloom.functions.claims import fits_cascade

        pushed = self.marks.where("pushed_back").select("id", F.lit(True).alias("stops"))
        rows = self.claims.join(pushed, "id", "left").withColumn("fits", fits_cascade() & F.col("stops").isNull())
        order = Window.partitionBy("project", "session_id").orderBy("turn_number", "created_at", "id")
        return rows.withColumn("island", F.sum((~F.col("fits")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("fits")

    def depths(self, max_rounds: int = 10_000, bucket: int = 1 << 16) -> DataFrame:
        """``(project, max_depth)``: the longest shortest way from a claim without parents; one claim alone has depth 1.

        Roots are numbered, 64 to a word, and a breadth-first search carries words of
        bits: a frontier row is a claim and the roots of one word that have come to it
        just now. A round adds the bits of a claim's tails and takes off those that it
        had; words without new bits are done, and what they have seen isn't read again.
        Numbers are given in buckets of about ``bucket`` roots, so no task holds all
        roots of a project. A project that has cycles only has depth 0.
        """
        inner = stage(self.edges.select("from_id", "to_id").distinct(), "depth-edges").df
        roots, told = stage_told(self.claims.select("id", "project").join(inner.select(F.col("to_id").alias("id")), "id", "left_anti"), "depth-roots", n=F.count("*"))
        dealt = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-told["n"] // bucket))))
        nth = F.row_number().over(Window.partitionBy("project", "deal").orderBy("id")) - 1
        word = F.struct("project", "deal", F.shiftright("nth", 6).alias("w"))
        numbered = roots.df.withColumn("deal", dealt).withColumn("nth", nth)
        front, told = stage_told(numbered.select(word.alias("word"), "id", F.expr("shiftleft(1L, cast(nth % 64 as int))").alias("bits")), "depth-front", n=F.count("*"))
        seen, front, last = [front.path], front.df, 0
        found = roots.df.select("project", F.lit(0).alias("depth")).limit(0)
        while told["n"]:
            last += 1
            if last > max_rounds:
                raise RuntimeError(f"ways of more than {max_rounds} claims; raise max_rounds")
            found = found.unionByName(front.select("word.project", F.lit(last).alias("depth")).distinct())
            new = front.join(inner, front["id"] == inner["from_id"]).groupBy("word", F.col("to_id").alias("id")).agg(F.bit_or("bits").alias("bits"))
            before = front.sparkSession.read.schema(front.schema).parquet(*seen)
            before = before.join(front.select("word").distinct(), "word", "left_semi").groupBy("word", "id").agg(F.bit_or("bits").alias("had"))
            fresh = new.join(before, ["word", "id"], "left").select("word", "id", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0)))).alias("bits")).where("bits <> 0")
            staged, told = stage_told(fresh, "depth-front", n=F.count("*"))
            front = staged.df
            seen.append(staged.path)
        deepest = found.groupBy("project").agg(F.max("depth").alias("depth"))
        return self.claims.select("project").distinct().join(deepest, "project", "left").select("project", F.coalesce("depth", F.lit(0)).alias("max_depth"))
