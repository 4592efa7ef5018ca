"""All registered queries of the engine and the SQL that they are held against."""

from __future__ import annotations

from tesserae.queries import ranked, scalars, steps, tables

FLAGSHIP = "browse_scores"
EVERY = ranked.QUERIES | scalars.QUERIES | tables.QUERIES | steps.QUERIES


def queries():
    return {name: run for name, (run, _) in EVERY.items()}


def oracle_sql():
    return {name: text for name, (_, text) in EVERY.items() if text is not None}
