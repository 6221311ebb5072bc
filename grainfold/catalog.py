"""All registered queries over the count matrix, with their SQL."""

from __future__ import annotations

from . import catalog_matrix, catalog_models, catalog_reports

_PARTS = (catalog_matrix, catalog_reports, catalog_models)


def queries() -> dict:
    return {name: f for part in _PARTS for name, (f, _) in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for part in _PARTS for name, (_, sql) in part.QUERIES.items() if sql}
