"""Queries over the shared test tables."""

from tamiz.catalog import areas, cleaning, features, ingest, layered, models, reports  # noqa: F401  (importing registers)
from tamiz.catalog.base import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
