"""All queries of the engine by name, and their SQL.

The driver's tables stand in for rasters and products: a line item is a pixel
of two polarisations (l_discount as VV, l_tax as VH; l_quantity and
l_extendedprice as further bands), events are time series, embeddings are
signal lines.  Results are rounded, so that sums in another order compare.
"""

from __future__ import annotations

from . import queries_families, queries_rasters, queries_relational, queries_scalar, queries_signal
from .register import ORACLES, QUERIES

FLAGSHIP = "agg_looks"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "queries_families", "queries_rasters", "queries_relational", "queries_scalar", "queries_signal"]
