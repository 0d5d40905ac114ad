"""Registry of queries and of their DuckDB twins."""

from __future__ import annotations

from . import cue_files, media, records, streams

_PARTS = [media, cue_files, records, streams]


def queries() -> dict:
    return {k: q for part in _PARTS for k, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for part in _PARTS for k, q in part.ORACLES.items()}
