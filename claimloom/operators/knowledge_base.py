"""Knowledge-base triples as claims and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The relation that each predicate stands for.
PREDICATES = {
    "Disputes": "contradicts", "DisputesOrg": "contradicts",
    "DependsOn": "depends_on", "Requires": "depends_on", "BelongsTo": "depends_on", "DerivedFrom": "depends_on", "HypothesisExplains": "depends_on",
    "Proposes": "supports", "ProposesOrg": "supports", "Accepts": "supports", "EarlyFormulationOf": "supports", "TheoryOf": "supports", "Supports": "supports",
    "Extends": "supports", "InfluencedBy": "supports", "Predicts": "supports", "CommentaryOn": "supports", "Credence": "supports", "ResolvedAs": "supports",
    "IsPolyvalentTerm": "questions",
}
DISPUTES = ("Disputes", "DisputesOrg")


def predicate_relation(predicate: Column) -> Column:
    """The mapped relation; ``supports`` where there is none."""
    mapped = F.element_at(F.create_map(*[F.lit(x) for pair in PREDICATES.items() for x in pair]), predicate)
    return F.coalesce(mapped, F.lit("supports"))


def with_provenance(claims: DataFrame, provenance: DataFrame) -> DataFrame:
    """Triples with quote and origin of their record; a reference without a record counts as a quote."""
    records = provenance.groupBy(F.col("var_name").alias("prov_ref")).agg(F.max(F.struct("quote", "origin")).alias("r"))
    rows = claims.where("subject <> '' and object <> ''").join(records, "prov_ref", "left")
    named = F.coalesce("prov_ref", F.lit("")) != ""
    quoted = F.when(~named, False).when(F.col("r").isNull(), True).otherwise(F.coalesce(F.col("r.quote"), F.lit("")) != "")
    return rows.select(F.col("var_name").alias("id"), F.col("predicate").alias("predicate_type"), "subject", "object", F.lit(None).cast("string").alias("basis"), quoted.alias("has_quote"), F.coalesce("r.origin", F.lit("")).alias("provenance_url"))


def kb_claims(triples: DataFrame) -> DataFrame:
    """One claim an id (the first by content), with its basis and confidence."""
    rest = [c for c in triples.columns if c != "id"]
    one = triples.groupBy("id").agg(F.min(F.struct(*rest)).alias("t")).select("id", "t.*")
    basis = F.when(F.coalesce("basis", F.lit("")) != "", F.col("basis")).when(F.col("has_quote"), "research").otherwise("assumption")
    told = F.when(basis == "research", 0.8).otherwise(0.7)
    return one.select(
        "id",
        F.concat("subject", F.lit(" --"), "predicate_type", F.lit("--> "), "object").alias("text"),
        basis.alias("basis"),
        told.alias("confidence"),
        F.col("provenance_url").alias("source"),
        F.lit("kb-import").alias("session_id"),
        F.lit("").alias("speaker"),
        predicate_relation(F.col("predicate_type")).alias("mapped_relation"),
    )


def kb_edges(triples: DataFrame) -> DataFrame:
    """A chain through the claims of each entity, in the order of their ids; disputed ends contradict."""
    entities = triples.select("id", F.explode(F.array_distinct(F.array("subject", "object"))).alias("entity")).distinct()
    steps = entities.withColumn("to_id", F.lead("id").over(Window.partitionBy("entity").orderBy("id"))).where("to_id is not null").select(F.col("id").alias("from_id"), "to_id").distinct()
    disputed = triples.groupBy("id").agg(F.min_by("predicate_type", F.struct("predicate_type", "subject", "object")).isin(*DISPUTES).alias("d"))
    rows = steps.join(disputed.withColumnsRenamed({"id": "from_id", "d": "a"}), "from_id").join(disputed.withColumnsRenamed({"id": "to_id", "d": "b"}), "to_id")
    return rows.select(F.concat_ws("-", F.lit("kb"), "from_id", "to_id").alias("id"), "from_id", "to_id", F.when(F.col("a") | F.col("b"), "contradicts").otherwise("supports").alias("relation"), F.lit(0.5).alias("strength"))
