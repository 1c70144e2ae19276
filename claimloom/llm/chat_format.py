"""Chat formatting with typed content parts.

A message's content is an array of parts ``(type, text, ref, tokens)``. A visitor
walks the parts in order: text is escaped, image, audio and document parts become
placeholders ``<|kind:n|>`` numbered in their turn, with the attachment's reference
and its expanded token count recorded. A turn is ``<s>[role]``, a line feed, the
content and ``</s>``. The escape puts a backslash before every ``<``, ``[``, ``]`` and
backslash of a text, so that no control string survives inside one and the original
comes back exactly. The loss mask covers the content of assistant turns.

Turns are formatted row by row in column expressions. What needs a conversation's
order runs over rows sorted by conversation and turn within a partition and keeps a
running hash and counters alone, so a conversation of any length is never collected.
A digest follows its conversation's order, so one conversation is one task's stream.

Defined results: null text is empty text, a null role an empty role, a null part is
skipped, a part of unknown type raises. Rows of one turn number are ordered by role,
then content, so repeated rows are formatted each. A conversation with a null id is a
conversation. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of parts that become placeholders, and the tokens that one stands for where a part doesn't say.
ATTACHMENTS = {"image": 576, "audio": 750, "document": 1024}
PART = "struct<type:string,text:string,ref:string,tokens:long>"
#: Runs are taken whole and never given back, so reading a turn holds no state a character.
_TURN = re.compile(r"<s>\[((?:[^\\\]]++|\\[\\<\[\]])*+)\]\n((?:[^\\<]++|\\[\\<\[\]]|<\|[a-z]+:\d+\|>)*+)</s>", re.S)
#: No text from Spark holds it: half of a pair of code units, alone.
_ALONE = "\ud800"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[\]])", r"\\$1")


def unescape(text: str) -> str:
    # pairs of backslashes first, from the left, as they were written
    text = text.replace("\\\\", _ALONE)
    for sign in "<[]":
        text = text.replace(f"\\{sign}", sign)
    return text.replace(_ALONE, "\\")


def text_part(text: Column) -> Column:
    """Content of one text part."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens"))
    return F.array(part.cast(PART))


def _visit(parts: Column, plain: bool = False) -> Column:
    """The content of a message: each part by its type, in order; placeholders are numbered by their place among the parts.

    With ``plain``, texts stand as they were.
    """

    def shown(part: Column, at: Column) -> Column:
        placeholder = F.concat(F.lit("<|"), part["type"], F.lit(":"), at.cast("string"), F.lit("|>"))
        return (
            F.when(part["type"] == "text", F.coalesce(part["text"], F.lit("")) if plain else escape(F.coalesce(part["text"], F.lit(""))))
            .when(part["type"].isin(*ATTACHMENTS), placeholder)
            .otherwise(F.raise_error(F.concat(F.lit("unknown part type: "), F.coalesce(part["type"], F.lit("null")))))
        )

    return F.array_join(F.transform(parts, shown), "")


def _attachments(parts: Column) -> Column:
    def record(part: Column, at: Column) -> Column:
        usual = F.coalesce(*[F.when(part["type"] == kind, F.lit(n)) for kind, n in ATTACHMENTS.items()])
        return F.struct(at.alias("place"), part["type"].alias("type"), part["ref"].alias("ref"), F.coalesce(part["tokens"], usual).cast("long").alias("tokens"))

    return F.filter(F.transform(parts, record), lambda a: a["type"] != "text")


def format_turns(messages: DataFrame, content: str = "content", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Per row of ``messages`` (conv_id, turn, role and an array of parts): its formatted turn.

    Columns: ``conv_id, turn, role, formatted, loss_start, loss_end`` (code points in
    the formatted turn, null outside the mask), ``attachments``, ``attachment_tokens``
    and ``tie``, the content as it was, which orders rows of one turn and role.
    """
    parts = F.filter(F.coalesce(F.col(content), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    role = F.coalesce("role", F.lit(""))
    rows = messages.select("conv_id", "turn", role.alias("role"), F.concat(F.lit("<s>["), escape(role), F.lit("]\n")).alias("head"), _visit(parts).alias("body"), _attachments(parts).alias("attachments"), _visit(parts, plain=True).alias("tie"))
    masked = F.col("role").isin(*loss_roles)
    return rows.select(
        "conv_id",
        "turn",
        "role",
        F.concat("head", "body", F.lit("</s>")).alias("formatted"),
        F.when(masked, F.char_length("head")).alias("loss_start"),
        F.when(masked, F.char_length("head") + F.char_length("body")).alias("loss_end"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"),
        "tie",
    )


def read_turn(formatted: str) -> tuple[str, str]:
    """The role and text of a formatted turn, unescaped; placeholders stay."""
    m = _TURN.fullmatch(formatted)
    if not m:
        raise ValueError(f"not a formatted turn: {formatted[:60]!r}")
    return unescape(m[1]), unescape(m[2])


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Per conversation what can be read back from its formatted turns: ``DIGESTS``."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        now, state, out = none, None, []

        def close() -> None:
            if now is not none:
                n, turns_hash, chars, loss_hash, size = state
                out.append((now, n, turns_hash.hexdigest(), chars, loss_hash.hexdigest(), size))

        def rows() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = list(zip(*out)) if out else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [c.split()[0] for c in DIGESTS.split(", ")])

        for batch in batches:
            out = []
            for conv_id, formatted, start, end in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")]):
                if now is none or conv_id != now:
                    close()
                    now, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_turn(formatted)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if start is not None:
                    under = unescape(formatted[start:end])
                    state[2] += len(under)
                    state[3].update(under.encode("utf-8", "surrogatepass"))
                state[4] += len(formatted)
            yield rows()
        out = []
        close()
        yield rows()

    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = turns.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "tie")
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(digest, DIGESTS)


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", trap), (-1, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    messages = rows.unionByName(own).withColumn("content", text_part(F.col("text")))
    return conversation_digests(format_turns(messages))


ORACLE_SQL = r"""
with r as (select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(10 + length(role) + length(text) + length(regexp_replace(text, '[^\\<\[\]]', '', 'g'))) as bigint) as formatted_chars
from r group by 1
"""
