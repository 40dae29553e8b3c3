"""Registered queries over the driver tables, with their SQL twins."""

from __future__ import annotations

from spanloom.plans import alignment, ambiguity, distributions, evaluation, graphs, parsed, phrases, relations, storage, texts  # noqa: F401  (they register)
from spanloom.plans.registry import QUERIES, SQL

FLAGSHIP = "label_imbalance_source"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
