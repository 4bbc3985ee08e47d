"""Operators for training-data pipelines, and their queries over the shared tables."""

from tamiz.llm import queries as _queries  # noqa: F401  (importing registers)
from tamiz.llm.base import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
