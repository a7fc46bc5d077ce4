"""Named queries over the driver tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from panelweave.catalog import (  # noqa: F401  (importing registers the queries)
    aggregates,
    flows,
    joins,
    models,
    ordering,
    projections,
    scalars,
    scans,
    splits,
    statistics,
    windows,
)
from panelweave.catalog.base import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
