"""JSON files that count as a whole: a file that doesn't parse gives nothing, and is named.

Files are read whole, a file a row, and parsed once against a schema. Both results come
from the same parse: the entries of good files, and which files were corrupt. An empty
file is no corrupt one; Spark doesn't list it, and one of white space alone has no
entries. What follows a complete document in a file makes it corrupt.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERIFIED = "map<string, struct<snippet:string, source:string, failed:boolean, fetched_at:timestamp>>"
RELATION = "struct<from_id:string, to_id:string, relation:string>"
SAMPLES = f"array<struct<source_file:string, transcript:array<struct<role:string, content:string>>, gold_claims:map<string,string>, gold_relations:array<{RELATION}>>>"


class WholeFiles(NamedTuple):
    """``parsed`` (path, content) of good files with entries, and ``files`` (path, corrupt) of all."""

    parsed: DataFrame
    files: DataFrame


def read_whole(spark: SparkSession, path: str, schema: str) -> WholeFiles:
    """Files at ``path`` parsed as one document each; a root of another kind than the schema's is corrupt."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    text = F.btrim("value", F.lit("\ufeff \t\r\n"))
    # a parser stops behind the first document; between brackets, what follows it is no JSON or a second element
    among = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    whole = among.isNotNull() & F.try_variant_get(among, "$[1]", "variant").isNull() & text.startswith("[" if schema.startswith("array") else "{")
    content = F.when(whole, F.from_json(text, schema, {"mode": "PERMISSIVE"}))
    told = rows.select("path", content.alias("content"), (text == "").alias("empty"))
    files = told.select("path", (F.col("content").isNull() & ~F.col("empty")).alias("corrupt"))
    return WholeFiles(told.where("content is not null").select("path", "content"), files)


def verify_caches(spark: SparkSession, path: str) -> WholeFiles:
    """Caches of external checks, a file a project: ``parsed`` has path, key, snippet, source, failed and fetched_at."""
    read = read_whole(spark, path, VERIFIED)
    rows = read.parsed.select("path", F.explode("content").alias("key", "entry")).select("path", "key", "entry.*")
    return WholeFiles(rows, read.files)


class Samples(NamedTuple):
    """Episodes of sample files; ``place`` follows the order of a file."""

    transcripts: DataFrame
    claims: DataFrame
    relations: DataFrame
    files: DataFrame


def evaluation_samples(spark: SparkSession, path: str) -> Samples:
    """Sample files as the tables that an evaluation takes: turns, expected claims and relations of each episode.

    A claim's ``id`` is its name in the file; ``place`` is its rank among the episode's names.
    """
    read = read_whole(spark, path, SAMPLES)
    each = read.parsed.select(F.inline("content")).withColumnRenamed("source_file", "episode")

    def numbered(column: Column) -> Column:
        return F.posexplode(column)

    turns = each.select("episode", numbered(F.col("transcript")).alias("place", "t")).select("episode", F.col("place").cast("long").alias("place"), "t.role", "t.content")
    names = each.select("episode", numbered(F.array_sort(F.map_entries("gold_claims"))).alias("place", "c"))
    claims = names.select("episode", F.col("place").cast("long").alias("place"), F.col("c.key").alias("id"), F.col("c.value").alias("text"))
    of = claims.select("episode", "id", "place")
    links = each.select("episode", numbered(F.col("gold_relations")).alias("at", "r")).select("episode", F.col("at").cast("long").alias("place"), "r.*")
    relations = links.join(of.select("episode", F.col("id").alias("from_id"), F.col("place").alias("from_place")), ["episode", "from_id"]).join(of.select("episode", F.col("id").alias("to_id"), F.col("place").alias("to_place")), ["episode", "to_id"])
    return Samples(turns, claims, relations.select("episode", "place", "from_place", "to_place", "relation"), read.files)
