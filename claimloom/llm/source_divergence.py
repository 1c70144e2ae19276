"""Audit of how far sources diverge in their terms, counted in DuckDB shard by shard.

Tasks over the documents split whole texts and count terms in DuckDB, a block of text
at a time; so each sends one row for a (language, source, term). These are hashed into
shards by language and term and sorted there, and DuckDB sums them, decides which terms
a language keeps and writes a row a kept term with its sources and their counts.

A group's share of a term is exact integer arithmetic on its count and on totals that
Spark sums over all shards. A pair's divergence is a sum over all kept terms, of which
most groups have few. With f0 for the value that a term has which neither has, the sum
is V * f0, plus for each of the two what its own terms change if the other had none of
them, plus a correction for terms that both have. A shard sums the last two: the first
by how many terms have each count, the other by joining a term's sources. Spark adds
up the shards' sums and ranks, and so it does with each shard's leading terms.

The totals of groups are broadcast. There may be ``max_groups`` of them, more raise:
the result has a row for every two sources of a language, so it is larger than that.

Defined results: null text, language and source are empty strings. Every row counts as
a document, repeated rows too. Ties are ranked by item. A language of one source has no
pairs; one without kept terms has pairs of value 0 and no terms. An empty table gives an
empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.llm.features import text_blocks
from claimloom.plans.staging import stage

COUNTS = "lang string, source string, term string, n long, docs long"
TERMS = "lang string, term string, sources array<string>, counts array<long>"
PARTS = "part string, lang string, source string, item string, value long"
#: Rows that a task holds before it sums them or sends them on.
HELD = 1_000_000
#: What shares are whole multiples of, and what is added to each count.
SCALE, ADDED = 1_000_000_000, 2


def _term_bytes() -> np.ndarray:
    """What each byte becomes: a space between terms, A-Z in lower case, else itself."""
    out = np.full(256, 0x20, np.uint8)
    for low, high in ((0x61, 0x7A), (0x80, 0xFF)):
        out[low : high + 1] = np.arange(low, high + 1)
    out[0x41:0x5B] = out[0x61:0x7B]
    return out


TERM_BYTES = _term_bytes()


def _duck():
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})


def _batches(table: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from table.cast(schema).to_batches(max_chunksize=10_000)


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_TERMS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_PARTS = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and documents of a task's terms; a term of a group comes once in about ``HELD`` rows."""
    duck, groups = _duck(), {}
    duck.execute("create table held (g int, term varchar, n bigint, docs bigint)")
    count = """
        insert into held select g, term, sum(n), count(*) from (
            select row, g, term, count(*) as n from (select row, g, unnest(string_split(text, ' ')) as term from block) where term <> '' group by all
        ) group by all"""

    def held() -> Iterator[pa.RecordBatch]:
        names = pa.table({"g": pa.array(range(len(groups)), pa.int32()), "lang": pa.array([k[0] for k in groups], pa.string()), "source": pa.array([k[1] for k in groups], pa.string())})
        duck.register("names", names)
        out = duck.sql("select lang, source, term, sum(n)::bigint as n, sum(docs)::bigint as docs from held join names using (g) group by all").to_arrow_table()
        duck.execute("truncate held")
        yield from _batches(out, _COUNTS)

    for batch in batches:
        named = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for row, data, ends in text_blocks(batch.column(2)):
            # numbers are given anew after rows were sent on, which may be within a batch
            of = np.array([groups.setdefault(k, len(groups)) for k in named[row : row + len(ends)]], np.int32)
            offsets = np.concatenate([[0], ends]).astype(np.int64)
            text = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(TERM_BYTES[data]))
            duck.register("block", pa.table({"row": pa.array(np.arange(len(ends))), "g": pa.array(of), "text": text}))
            duck.execute(count)
            if duck.execute("select count(*) from held").fetchall()[0][0] > HELD:
                duck.execute("create or replace table summed as select g, term, sum(n)::bigint as n, sum(docs)::bigint as docs from held group by all")
                duck.execute("truncate held")
                duck.execute("insert into held from summed")
                duck.execute("drop table summed")
                if duck.execute("select count(*) from held").fetchall()[0][0] > HELD // 2:
                    yield from held()
                    groups.clear()
    yield from held()


def keep_terms(min_docs: int):
    """Sums a shard's counts, which come by language and term, and gives the terms in at least ``min_docs`` documents with their sources."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        duck, rest = _duck(), None

        def kept(table: pa.Table) -> pa.Table:
            duck.register("summed", table)
            return duck.sql(
                "select lang, term, list(source order by source) as sources, list(n order by source) as counts from summed group by lang, term having sum(docs) >= ?", params=[min_docs]
            ).to_arrow_table()

        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            duck.register("new", new if rest is None else pa.concat_tables([rest, new]))
            summed = duck.sql("select lang, source, term, sum(n)::bigint as n, sum(docs)::bigint as docs from new group by all").to_arrow_table().cast(_COUNTS)
            # the last term may go on in the next batch
            last = [batch.column(0)[-1].as_py(), batch.column(2)[-1].as_py()]
            duck.register("summed", summed)
            rest = duck.sql("from summed where lang = ? and term = ?", params=last).to_arrow_table().cast(_COUNTS)
            whole = duck.sql("from summed where lang <> ? or term <> ?", params=last).to_arrow_table()
            yield from _batches(kept(whole), _TERMS)
        if rest is not None:
            yield from _batches(kept(rest), _TERMS)

    return reduce


def _groups_table(groups: list[tuple]) -> pa.Table:
    """``(g, lang, source, total, terms)``, ``g`` in the order of language and source."""
    lang, source, total, terms = map(list, zip(*sorted(groups)))
    return pa.table({"g": pa.array(range(len(lang)), pa.int32()), "lang": pa.array(lang, pa.string()), "source": pa.array(source, pa.string()), "total": pa.array(total, pa.int64()), "terms": pa.array(terms, pa.int64())})


def part_sums(groups, top: int):
    """Partial sums of pairs and leading terms of the kept terms that a task reads; ``groups`` is a broadcast table."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        duck = _duck()
        duck.execute(f"create macro share(n, total, terms) as (1 + ({SCALE}::hugeint * (n + {ADDED})) // (total + {ADDED}::hugeint * terms))::bigint")
        duck.execute("create macro apart(p, q) as ((p - q) * (p - q)) // (p + q)")
        duck.register("told", groups.value)
        duck.execute("create table groups as select *, share(0, total, terms) as p0 from told where terms > 0")
        duck.execute("create table langs as select lang, sum(total)::bigint as total, any_value(terms) as terms from groups group by lang")
        duck.execute("create table pairs (a int, b int, value bigint)")
        duck.execute("create table ahead (g int, term varchar, value bigint)")

        def paired() -> Iterator[pa.RecordBatch]:
            out = duck.sql("""
                select 'pair' as part, x.lang, x.source, y.source as item, sum(value)::bigint as value
                from pairs join groups x on x.g = a join groups y on y.g = b group by all""").to_arrow_table()
            duck.execute("truncate pairs")
            yield from _batches(out, _PARTS)

        for batch in batches:
            duck.register("read", pa.Table.from_batches([batch]))
            duck.execute("""
                create or replace table counts as
                select i, term, g, groups.lang, n, p0, share(n, groups.total, groups.terms) as p from (
                    select row_number() over () as i, lang, term, unnest(sources) as source, unnest(counts) as n from read
                ) join groups using (lang, source)""")
            # what a group's own terms change in its sums with each of the others, by how many terms have a count
            duck.execute("""
                insert into pairs select least(c.g, o.g), greatest(c.g, o.g), sum(m * (apart(p, o.p0) - apart(c.p0, o.p0)))
                from (select g, lang, p0, p, count(*) as m from counts group by all) c join groups o on o.lang = c.lang and o.g <> c.g group by all""")
            # and what is different where both have a term
            duck.execute("""
                insert into pairs select x.g, y.g, sum(apart(x.p, y.p) - apart(x.p, y.p0) - apart(x.p0, y.p) + apart(x.p0, y.p0))
                from counts x join counts y on x.i = y.i and x.g < y.g group by all""")
            duck.execute(
                """
                create or replace table best as
                with q as (select i, share(sum(n), any_value(l.total), any_value(l.terms)) as q from counts join langs l using (lang) group by i),
                seen as (select g, term, apart(p, q) as value from counts join q using (i) where p > q union all select * from ahead)
                from seen qualify row_number() over (partition by g order by value desc, term) <= ?""",
                [top],
            )
            duck.execute("truncate ahead")
            duck.execute("insert into ahead from best")
            if duck.execute("select count(*) from pairs").fetchall()[0][0] > HELD:
                yield from paired()
        yield from paired()
        yield from _batches(duck.sql("select 'term' as part, lang, source, term as item, value from ahead join groups using (g)").to_arrow_table(), _PARTS)

    return sums


def kept_terms(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """``(lang, term, sources, counts)``: the terms in at least ``min_docs`` documents of a language, and how often each source has them."""
    texts = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    shards = texts.mapInArrow(count_terms, COUNTS).repartition("lang", "term").sortWithinPartitions("lang", "term")
    return shards.mapInArrow(keep_terms(min_docs), TERMS)


def divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, max_groups: int = 1_000_000) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of every language and source of ``docs``.

    Part ``pair`` has a source's divergence from each other source of its language, part
    ``term`` the ``top`` terms in which it exceeds its language most.
    """
    spark = docs.sparkSession
    terms = stage(kept_terms(docs, min_docs), "kept-terms").df
    each = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("total"))
    kept = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    zero = F.lit(0).cast("long")
    groups = named.join(each, ["lang", "source"], "left").join(kept, "lang", "left").select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("terms", zero).alias("terms"))
    told = [tuple(r) for r in groups.limit(max_groups + 1).collect()]
    if len(told) > max_groups:
        raise ValueError(f"more than {max_groups} pairs of language and source; raise max_groups")
    if not told:
        return spark.createDataFrame([], "lang string, source string, part string, item string, value long, rank int")
    shared = spark.sparkContext.broadcast(_groups_table(told))
    parts = terms.mapInArrow(part_sums(shared, top), PARTS)
    # what two groups would differ by if neither had a term
    few = spark.createDataFrame(told, "lang string, source string, total long, terms long").withColumn(
        "p0", F.when(F.col("terms") > 0, F.expr(f"1 + {SCALE * ADDED} div (total + {ADDED} * terms)")).otherwise(F.lit(1).cast("long"))
    )
    other = few.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    none = few.join(other, "lang").where("source < item").select(F.lit("pair").alias("part"), "lang", "source", "item", F.expr("terms * ((p0 - q0) * (p0 - q0) div (p0 + q0))").alias("value"))
    pairs = parts.where("part = 'pair'").unionByName(none).groupBy("part", "lang", "source", "item").agg(F.sum("value").alias("value"))
    both = pairs.withColumn("ends", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))))
    both = both.select("part", "lang", F.col("ends.source").alias("source"), F.col("ends.item").alias("item"), "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = both.unionByName(parts.where("part = 'term'")).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') as ws from documents),
t as (select r, lang, source, unnest(ws) as term from d),
kept as (select lang, term from t group by all having count(distinct r) >= 10),
v as (select lang, count(*) as v from kept group by lang),
groups as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from t join kept using (lang, term) group by all),
cells as (select g.lang, g.source, k.term, coalesce(n, 0) as n from groups g join kept k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
p as (select lang, source, term, n, 1 + (1000000000::hugeint * (n + 2)) // ((sum(n) over (partition by lang, source)) + 2 * v) as p from cells join v using (lang)),
lt as (select lang, term, sum(n) as n from cells group by all),
q as (select lang, term, 1 + (1000000000::hugeint * (n + 2)) // ((sum(n) over (partition by lang)) + 2 * v) as q from lt join v using (lang)),
pair as (select a.lang, a.source, b.source as item, coalesce(s, 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source
         left join (select x.lang, x.source as s1, y.source as s2, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) as s from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) z
         on z.lang = a.lang and z.s1 = a.source and z.s2 = b.source),
parts as (select lang, source, 'pair' as part, item, cast(value as bigint) as value from pair
          union all select lang, source, 'term', term, cast(((p - q) * (p - q)) // (p + q) as bigint) from p join q using (lang, term) where n > 0 and p > q),
ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from parts)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 10
"""
