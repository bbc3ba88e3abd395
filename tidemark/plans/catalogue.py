"""Queries of the engine's own operators with their DuckDB SQL."""

from __future__ import annotations

from tidemark.plans import live, live_changes, logs, ordered, outputs, records, relational, reports, searches, statistics, stores, temporal, workflows

ALL = records.QUERIES | temporal.QUERIES | relational.QUERIES | statistics.QUERIES | logs.QUERIES | live.QUERIES | live_changes.QUERIES | reports.QUERIES | stores.QUERIES | ordered.QUERIES | searches.QUERIES | outputs.QUERIES | workflows.QUERIES


def queries() -> dict:
    return {name: q[0] for name, q in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q[1] for name, q in ALL.items() if q[1]}
