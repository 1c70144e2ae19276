from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from claimloom.operators import detectors as D
from claimloom.plans import staging
from tests.graphs import Graphs

BOUND = "spark.sql.autoBroadcastJoinThreshold"


def chain():
    g = Graphs()
    for i in range(9):
        g.claim("p", f"c{i}", "research", age_days=0)
    for i in range(8):
        g.edge("p", f"c{i}", "depends_on", f"c{i + 1}")
    return g


def test_findings_are_made_with_few_broadcasts(spark, monkeypatch):
    write, bounds = DataFrameWriter.parquet, []

    def told(self, *args, **named):
        bounds.append(int(spark.conf.get(BOUND)))
        return write(self, *args, **named)

    monkeypatch.setattr(DataFrameWriter, "parquet", told)
    before = spark.conf.get(BOUND)
    found = D.findings(chain().graph(spark))
    # every write of every thread, and none of the joins is left for the caller's settings
    assert len(bounds) > 20 and set(bounds) == {staging.BROADCAST_BYTES}
    assert spark.conf.get(BOUND) == before and spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert "unchallenged_chain" in {r["type"] for r in found.collect()}


def test_a_lower_bound_of_the_session_stays(spark, monkeypatch):
    monkeypatch.setattr(staging, "BROADCAST_BYTES", 1 << 20)
    before = spark.conf.get(BOUND)
    spark.conf.set(BOUND, "-1")
    try:
        with staging.few_broadcast(spark), staging.few_broadcast(spark):
            assert spark.conf.get(BOUND) == "-1"
        assert spark.conf.get(BOUND) == "-1"
    finally:
        spark.conf.set(BOUND, before)


def test_a_claim_that_is_there_twice_holds_no_chain_back(spark):
    g = chain()
    g.claims.append(g.claims[0])
    # a cycle, so that paths through it are searched until all claims are known
    g.edge("p", "c2", "supports", "c0")
    got = D.unchallenged_chain(g.graph(spark)).select("claim_ids", F.size(F.split("claim_ids", ",")).alias("n")).collect()
    assert [(r["claim_ids"][:4], r["n"]) for r in got] == [("p.c0", 9)]


def test_a_partly_staged_graph_is_not_staged_again(spark):
    g = chain().graph(spark).partly_staged()
    assert g.partly_staged() is g and not g.is_staged
    assert D.findings(g, ("orphan",)).count() == 0 and g.is_staged and g.staged() is g
