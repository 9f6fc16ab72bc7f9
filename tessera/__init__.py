"""Auditable ledgers on Spark: overlays, reconciliation, exact money, cash positions and reports."""
