"""The claim graph that is derived from the conversations table.

Integer arithmetic alone decides every field, so that any SQL engine can repeat it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every time-dependent operator takes this instant, never the clock.
AS_OF = "2024-03-01 06:00:00"
#: Sessions this far apart belong to one project, and only they are linked.
PROJECTS = 11
BASES = ("research", "vibes", "llm_output", "deduction", "assumption", "definition", "vibes", "empirical", "analogy")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims as written first: ``last_referenced_at`` is the creation time until edges touch it."""
    rows = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    rows = rows.selectExpr("conv_id * 100 + turn as n", "conv_id div 4 as sess", "cast(conv_id % 4 * 10 + turn as int) as turn_number", "role", "text")
    bot = F.col("role") == "assistant"

    def every(k: int, also=None):
        hit = F.col("n") % k == 0
        return hit if also is None else hit & also

    return rows.select(
        F.concat(F.lit("c"), "n").alias("id"),
        "text",
        F.element_at(F.array(*map(F.lit, BASES)), (F.col("n") % 9 + 1).cast("int")).alias("basis"),
        (F.col("n") * 37 % 100 / 100).alias("confidence"),
        F.lit("").alias("source"),
        F.concat(F.lit("s"), "sess").alias("session_id"),
        F.concat(F.lit("p"), F.col("sess") % PROJECTS).alias("project"),
        "turn_number",
        F.col("role").alias("speaker"),
        F.expr("timestamp_ntz '2024-03-01 00:00:00' - make_interval(0, 0, 0, cast(sess * 3 % 90 as int)) + make_interval(0, 0, 0, 0, 0, turn_number)").alias("created_at"),
        every(31).alias("challenged"),
        F.lit(False).alias("verified"),
        every(29).alias("terminates_inquiry"),
        every(37).alias("closed"),
        every(5).alias("grand_significance"),
        every(17, bot).alias("unique_connection"),
        every(13, bot).alias("dismisses_counterevidence"),
        every(11, bot).alias("ability_overstatement"),
        every(7).alias("sentience_claim"),
        every(19).alias("relational_drift"),
        every(23).alias("consequential_action"),
        F.lit(False).alias("archived"),
        "n",
        "sess",
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from later claims to earlier ones of a session, and to the session eleven on."""
    claims = base_claims(spark, sf_dir)
    a = claims.select(F.col("id").alias("from_id"), F.col("n").alias("a_n"), F.col("sess").alias("a_sess"), F.col("turn_number").alias("a_turn"), "created_at")
    b = claims.select(F.col("id").alias("to_id"), F.col("n").alias("b_n"), F.col("sess").alias("b_sess"), F.col("turn_number").alias("b_turn"))
    gap = F.col("a_turn") - F.col("b_turn")
    near = a.join(b, (F.col("a_sess") == F.col("b_sess")) & (gap > 0) & ((gap <= 2) | ((F.col("b_turn") % 10 == 1) & (gap <= 9))))
    far = a.where("a_n % 7 = 3").join(b.where("b_turn = 1"), F.col("b_sess") == F.col("a_sess") + PROJECTS)
    relation = F.expr("case when (a_n + b_n) % 13 = 0 then 'contradicts' when (a_n + b_n) % 17 = 0 then 'questions' when a_n % 3 = 0 then 'supports' else 'depends_on' end")
    return near.unionByName(far).select(F.concat_ws("-", "from_id", "to_id").alias("id"), "from_id", "to_id", relation.alias("relation"), F.lit(1.0).alias("strength"), "created_at")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with ``last_referenced_at``, the latest of their own time and their edges'."""
    touched = edges(spark, sf_dir).select(F.explode(F.array("from_id", "to_id")).alias("id"), F.col("created_at").alias("at")).groupBy("id").agg(F.max("at").alias("at"))
    out = base_claims(spark, sf_dir).join(touched, "id", "left")
    return out.withColumn("last_referenced_at", F.greatest("created_at", F.coalesce("at", "created_at"))).drop("at")


#: The same derivation for the oracle.
ORACLE = """
c0 as (select conv_id * 100 + turn as n, conv_id // 4 as sess, conv_id % 4 * 10 + turn as turn_number, role, text from conversations where role in ('user', 'assistant')),
bc as (select 'c' || n as id, text, ['research', 'vibes', 'llm_output', 'deduction', 'assumption', 'definition', 'vibes', 'empirical', 'analogy'][n % 9 + 1] as basis,
    (n * 37 % 100) / 100 as confidence, '' as source, 's' || sess as session_id, 'p' || (sess % 11) as project, turn_number, role as speaker,
    timestamp '2024-03-01 00:00:00' - to_days(cast(sess * 3 % 90 as integer)) + to_minutes(turn_number) as created_at,
    n % 31 = 0 as challenged, n % 29 = 0 as terminates_inquiry, n % 37 = 0 as closed, n % 5 = 0 as grand_significance,
    n % 17 = 0 and role = 'assistant' as unique_connection, n % 13 = 0 and role = 'assistant' as dismisses_counterevidence,
    n % 11 = 0 and role = 'assistant' as ability_overstatement, n % 7 = 0 as sentience_claim, n % 19 = 0 as relational_drift,
    n % 23 = 0 as consequential_action, false as archived, n, sess from c0),
edges as (select a.id || '-' || b.id as id, a.id as from_id, b.id as to_id,
    case when (a.n + b.n) % 13 = 0 then 'contradicts' when (a.n + b.n) % 17 = 0 then 'questions' when a.n % 3 = 0 then 'supports' else 'depends_on' end as relation,
    1.0::double as strength, a.created_at as created_at
    from bc a join bc b on (a.sess = b.sess and b.turn_number < a.turn_number and (a.turn_number - b.turn_number <= 2 or (b.turn_number % 10 = 1 and a.turn_number - b.turn_number <= 9)))
        or (b.sess = a.sess + 11 and a.n % 7 = 3 and b.turn_number = 1)),
touch as (select id, max(created_at) as seen from (select from_id as id, created_at from edges union all select to_id, created_at from edges) group by 1),
claims as (select bc.*, greatest(bc.created_at, coalesce(seen, bc.created_at)) as last_referenced_at from bc left join touch using (id)),
now_ as (select timestamp '2024-03-01 06:00:00' as as_of)
"""


def dense_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims as sure of themselves as only few are in :func:`claims`."""
    return claims(spark, sf_dir).withColumn("confidence", F.expr("(50 + n * 37 % 50) / 100"))


def dense_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges without disputes in one project, without links between the sessions of another, and one of its sessions all questions."""
    sess = lambda c: F.expr(f"cast(substr({c}, 2) as bigint) div 400")
    rows = edges(spark, sf_dir).withColumns({"a_sess": sess("from_id"), "b_sess": sess("to_id")}).where("a_sess % 11 <> 2 or a_sess = b_sess")
    relation = F.expr("case when a_sess = 13 then 'questions' when a_sess % 11 = 1 and relation in ('contradicts', 'questions') then 'supports' else relation end")
    return rows.withColumn("relation", relation).drop("a_sess", "b_sess")


#: The same for the oracle.
DENSE_ORACLE = ORACLE.replace("\nedges as (", "\nall_edges as (").replace("\ntouch as (", """
edges as (select * replace (case when a = 13 then 'questions' when a % 11 = 1 and relation in ('contradicts', 'questions') then 'supports' else relation end as relation)
    from (select *, cast(substr(from_id, 2) as bigint) // 400 as a, cast(substr(to_id, 2) as bigint) // 400 as b from all_edges) where a % 11 <> 2 or a = b),
touch as (""").replace("select bc.*, greatest", "select bc.* replace ((50 + n * 37 % 50) / 100 as confidence), greatest")
