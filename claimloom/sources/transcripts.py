"""Transcripts and knowledge-base exports as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.sources.line_files import last_bytes


def _text_of(content: Column) -> Column:
    """A message's text: a JSON string itself, or the text blocks of an array by line feeds."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>", {"mode": "PERMISSIVE"})
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    return F.when(content.startswith("["), F.array_join(texts, "\n")).otherwise(content)


def parse_lines(lines: DataFrame, by: list[str], line: str = "value", at: str = "line_no") -> DataFrame:
    """``(*by, turn, role, text)`` of the user and assistant messages of JSON lines, flat or nested.

    Lines that don't parse, other roles and empty texts are left out of the text but a
    message without text still takes its turn. Only keys decide the order.
    """
    c = F.col(line)
    field = lambda name: F.coalesce(F.get_json_object(c, f"$.message.{name}"), F.get_json_object(c, f"$.{name}"))
    rows = lines.select(*by, at, field("role").alias("role"), field("content").alias("content")).where("role in ('user', 'assistant')")
    turn = F.row_number().over(Window.partitionBy(*by).orderBy(at))
    return rows.select(*by, turn.alias("turn"), "role", F.trim(_text_of(F.col("content"))).alias("text"))


def window_of(turns: DataFrame, by: list[str], since: int = 0, most: int = 50) -> DataFrame:
    """The messages to read next: the last ``most`` of a first read, else the first ``most`` after turn ``since``."""
    rows = turns.where((F.col("turn") > since) & (F.col("text") != ""))
    order = F.col("turn") if since > 0 else F.desc("turn")
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_place") <= most).drop("_place")


def transcript_text(turns: DataFrame, by: list[str]) -> DataFrame:
    """Each transcript as one text: role, colon, text, with a blank line between."""
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.upper("role"), F.lit(": "), "text").alias("said"))))
    return turns.groupBy(*by).agg(F.array_join(lines["said"], "\n\n").alias("transcript"))


def merged_turns(turns: DataFrame, by: list[str]) -> DataFrame:
    """Neighbouring turns of one role as one; from the first user turn to the last assistant one."""
    order = Window.partitionBy(*by).orderBy("turn")
    changed = F.when(F.col("role") == F.lag("role").over(order), 0).otherwise(1)
    rows = turns.withColumn("change", changed).withColumn("island", F.sum("change").over(order))
    said = F.array_sort(F.collect_list(F.struct("turn", "text")))
    merged = rows.groupBy(*by, "island").agg(F.first("role").alias("role"), F.array_join(said["text"], "\n\n").alias("text"))
    whole = Window.partitionBy(*by)
    ends = {"start": F.min(F.when(F.col("role") == "user", F.col("island"))).over(whole), "stop": F.max(F.when(F.col("role") == "assistant", F.col("island"))).over(whole)}
    return merged.withColumns(ends).where("island between start and stop").drop("start", "stop")


def token_budget(turns: DataFrame, by: list[str], budget: int, headroom: float = 0.0) -> DataFrame:
    """The leading turns up to and with the one that crosses ``budget`` tokens and a share of ``headroom`` beyond; ``tokens`` runs on."""
    budget = budget + int(budget * headroom)
    from claimloom.functions.text import token_estimate

    order = Window.partitionBy(*by).orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.withColumn("own", token_estimate(F.col("text"))).withColumn("tokens", F.sum("own").over(order))
    return rows.where(F.col("tokens") - F.col("own") < budget).drop("own")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """``(path, line_no, value)`` of JSON-lines files; the number follows the lines of a file."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"), "value")
    return rows.withColumn("line_no", F.row_number().over(Window.partitionBy("path").orderBy("at"))).drop("at")


def recent_messages(spark: SparkSession, path: str, most: int = 50, tail: int = 2 << 20) -> DataFrame:
    """``(path, turn, role, text)`` of a first read of transcripts: the last ``most`` messages in each file's last ``tail`` bytes.

    Turns are counted within what is read.
    """
    return window_of(parse_lines(last_bytes(spark, path, tail), ["path"], at="at"), ["path"], most=most)


def read_documents(spark: SparkSession, path: str, most: int = 10 << 20) -> DataFrame:
    """``(path, text, too_long)`` of whole files; a file above ``most`` bytes is listed without being read."""
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= most).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.lit(False).alias("too_long"))
    return small.unionByName(files.where(F.col("length") > most).select("path", F.lit(None).cast("string").alias("text"), F.lit(True).alias("too_long")))


def argument_maps(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Propositions ``(episode, id, text)`` and relations ``(episode, from_id, to_id, relation)`` of argument-map files, one an episode.

    A relation goes from a proposition over an inference (supports) or conflict
    (contradicts) node to another.
    """
    node, edge = "struct<nodeID:string,type:string,text:string>", "struct<fromID:string,toID:string>"
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("episode"), F.from_json("value", f"struct<nodes:array<{node}>,edges:array<{edge}>>").alias("m"))
    nodes = whole.select("episode", F.inline("m.nodes")).withColumnRenamed("nodeID", "id")
    edges = whole.select("episode", F.inline("m.edges"))
    said = nodes.where("type = 'I'").select("episode", "id", "text")
    links = nodes.where("type in ('RA', 'CA')").select("episode", F.col("id").alias("by"), F.when(F.col("type") == "RA", "supports").otherwise("contradicts").alias("relation"))
    ends = said.select("episode", "id")
    into = edges.withColumnsRenamed({"fromID": "from_id", "toID": "by"}).join(ends.withColumnRenamed("id", "from_id"), ["episode", "from_id"], "left_semi")
    out = edges.withColumnsRenamed({"fromID": "by", "toID": "to_id"}).join(ends.withColumnRenamed("id", "to_id"), ["episode", "to_id"], "left_semi")
    return said, into.join(links, ["episode", "by"]).join(out, ["episode", "by"]).select("episode", "from_id", "to_id", "relation")


def read_kb(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Claims and provenance of knowledge-base exports: an array of claims, or an object with both."""
    text = spark.read.text(path, wholetext=True).select(F.ltrim(F.regexp_replace("value", "^﻿", "")).alias("value"))
    claim = "struct<var_name:string,predicate:string,subject:string,object:string,prov_ref:string,file:string>"
    record = "struct<var_name:string,origin:string,quote:string,file:string>"
    wrapped = F.from_json("value", f"struct<claims:array<{claim}>,provenance:array<{record}>>")
    bare = F.from_json("value", f"array<{claim}>")
    parsed = text.select(F.when(F.col("value").startswith("["), bare).otherwise(wrapped["claims"]).alias("claims"), F.when(~F.col("value").startswith("["), wrapped["provenance"]).alias("provenance"))
    return parsed.select(F.inline("claims")), parsed.select(F.inline("provenance"))
