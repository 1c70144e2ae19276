"""Literal claim graphs for tests: a scenario is a project."""

from __future__ import annotations

import datetime as dt

from claimloom.plans.claim_graph import ClaimGraph

AS_OF = "2024-03-01 06:00:00"
NOW = dt.datetime(2024, 3, 1, 6)
FLAGS = (
    "challenged", "verified", "terminates_inquiry", "closed", "grand_significance", "unique_connection", "dismisses_counterevidence",
    "ability_overstatement", "sentience_claim", "relational_drift", "consequential_action", "archived",
)
CLAIMS = "id string, text string, basis string, confidence double, source string, session_id string, project string, turn_number int, speaker string, created_at timestamp_ntz, last_referenced_at timestamp_ntz, " + ", ".join(f"{f} boolean" for f in FLAGS)
EDGES = "id string, from_id string, to_id string, relation string, strength double, created_at timestamp_ntz"


class Graphs:
    def __init__(self):
        self.claims, self.edges = [], []

    def claim(self, project, name, basis="vibes", *flags, text=None, confidence=0.0, session="", turn=0, speaker="user", age_days=None, idle_days=None):
        made = None if age_days is None else NOW - dt.timedelta(days=age_days)
        seen = made if idle_days is None else NOW - dt.timedelta(days=idle_days)
        self.claims.append((f"{project}.{name}", text or f"claim {name}", basis, confidence, "", session, project, turn, speaker, made, seen, *[f in flags for f in FLAGS]))
        return self

    def edge(self, project, a, relation, b, strength=1.0):
        self.edges.append((f"{project}.{a}-{relation}-{b}", f"{project}.{a}", f"{project}.{b}", relation, strength, NOW))
        return self

    def graph(self, spark):
        return ClaimGraph(spark.createDataFrame(self.claims, CLAIMS), spark.createDataFrame(self.edges, EDGES), AS_OF)


def by_project(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["project"], []).append(r)
    return out
