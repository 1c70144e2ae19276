"""Claim-graph analytics on Spark: operators, plans, sources, functions and streams."""
