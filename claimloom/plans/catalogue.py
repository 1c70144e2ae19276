"""All queries of the claim graph and its texts, and their oracles."""

from __future__ import annotations

from claimloom.plans import catalogue_graph, catalogue_ingest, catalogue_text

QUERIES = {**catalogue_graph.QUERIES, **catalogue_ingest.QUERIES, **catalogue_text.QUERIES}
ORACLES = {**catalogue_graph.ORACLES, **catalogue_ingest.ORACLES, **catalogue_text.ORACLES}
