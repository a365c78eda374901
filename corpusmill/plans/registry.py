"""All queries for the reference's own operators, and their SQL."""

from __future__ import annotations

from . import base, classifier_queries, feature_queries, file_queries, result_queries, split_queries, text_queries, weight_queries  # noqa: F401  importing them registers their queries


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict:
    return dict(base.ORACLES)
