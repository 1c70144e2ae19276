"""Shared plan fragments: staging tables, components, claim-graph frames."""
