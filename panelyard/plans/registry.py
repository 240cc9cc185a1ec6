"""All registered queries of the factor engine, and the SQL they are held against."""

from __future__ import annotations

from panelyard.plans import access, formulas, inference, lots, mining, portfolio, research, runs, signals, smooth, store, sweeps, timing_reports

_PARTS = (formulas, research, access, portfolio, signals, sweeps, mining, inference, smooth, lots, store, runs, timing_reports)

QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
FLAGSHIP = "alpha_101"
