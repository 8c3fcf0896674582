"""Queries over the driver's tables: one for each operator, with its SQL where SQL can say it."""

from __future__ import annotations

from . import clusters, flows, graphs, paths


def queries() -> dict:
    out: dict = {}
    for part in (graphs, paths, flows, clusters):
        out |= {name: q for name, (q, _) in part.QUERIES.items()}
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for part in (graphs, paths, flows, clusters):
        out |= {name: sql for name, (_, sql) in part.QUERIES.items() if sql}
    return out
