"""All queries of the engine and the SQL that must give the same rows."""

from __future__ import annotations

from .plans import audits, games, logs, returns, scoring, statistics, trajectories

_ALL = {}
for _part in (statistics, audits, scoring, trajectories, returns, games, logs):
    _ALL |= _part.QUERIES

QUERIES = {name: query for name, (query, _) in _ALL.items()}
SQL = {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
