"""Configurations evaluated one by one, each giving metrics or the reason why it has none."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import product

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from tamiz.operators.validate import K_RANGE, METHODS

EXPECTED = (PySparkException, ValueError, ArithmeticError)


def grid_results(
    spark: SparkSession, evaluate: Callable[[str, int], DataFrame], metrics: Mapping[str, str],
    methods: Sequence[str] = METHODS, ks: Sequence[int] = K_RANGE,
) -> DataFrame:
    """``method, k``, the metrics and ``error``, one row per configuration in order of method and k.

    ``evaluate(method, k)`` gives a table of exactly one row with the columns of ``metrics`` (name to type), so each
    configuration is a Spark job over all rows. One that cannot be planned or fails while it runs, or gives another number of
    rows, keeps its row: no metrics, and the first line of the reason as ``error``. Other faults of the program are raised.
    """
    rows = []
    for method, k in product(sorted(methods), sorted(ks)):
        try:
            found = evaluate(method, k).select(*metrics).take(2)
            if len(found) != 1:
                raise ValueError(f"{'no' if not found else 'more than one'} row of metrics")
            rows.append((method, k, *found[0], None))
        except EXPECTED as e:
            reason = e.getCondition() or str(e) if isinstance(e, PySparkException) else str(e)
            rows.append((method, k, *[None] * len(metrics), (reason or type(e).__name__).splitlines()[0]))
    columns = ", ".join(f"{c} {t}" for c, t in metrics.items())
    return spark.createDataFrame(rows, f"method string, k int, {columns}, error string")


def succeeded(results: DataFrame) -> DataFrame:
    """Metrics of the configurations that have them."""
    return results.where("error IS NULL").drop("error")


def failed(results: DataFrame) -> DataFrame:
    """``method, k, error`` of those that have none."""
    return results.where("error IS NOT NULL").select("method", "k", "error")
