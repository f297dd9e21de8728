"""Every query by name, with the same query as SQL for an independent engine."""

from __future__ import annotations

from quietsignal.plans import alert_queries, density_queries, drift_queries, record_queries, reshape_queries, series_queries, stream_queries
from quietsignal.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "alert_queries", "density_queries", "drift_queries", "record_queries", "reshape_queries", "series_queries", "stream_queries"]
