"""Named queries over the driver's tables and the DuckDB SQL that gives the same rows."""

from tessera.plans import cash, ingest, loads, overlays, reconciling, reports, scalars
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cash", "ingest", "loads", "overlays", "reconciling", "reports", "scalars"]
