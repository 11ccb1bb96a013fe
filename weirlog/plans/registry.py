"""Every named query of the library with its SQL."""

from __future__ import annotations

from weirlog.plans import fleet, hosts, ingest, limits, reconcile, records, signals, streams, views

_PLANS = (signals, hosts, ingest, views, fleet, reconcile, limits, records, streams)
QUERIES = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLE_SQL = {name: sql for plan in _PLANS for name, sql in plan.SQL.items()}
