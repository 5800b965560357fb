"""Parameter sweeps: the grids as tables, what is done left out by an anti-join, results summarised."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.evaluate import mean_std
from ..operators.relational import grid, pending

# The grids of the published experiments.
GRIDS = {
    "graph2vec": {"depth": [2], "dim": [8, 16, 32, 64, 128], "batch": [512, 1024, 2048, 10000], "epochs": [25, 50, 100], "rate": [0.1], "run": list(range(10))},
    "awe_dd": {"length": [10], "dim": [128], "batch": [100, 500, 1000, 5000, 10000], "window": [4, 8, 16], "run": list(range(10))},
    "dgk_graphlet": {"n": [7], "samples": [2, 5, 10, 25, 50], "dim": [2, 5, 10, 25, 50], "run": list(range(10))},
    "dgk_sp": {"dim": [2, 5, 10, 25, 50], "batch": [10000, 1000], "epochs": [5, 100], "rate": [0.1, 0.01], "run": list(range(10))},
    "dgk_wl": {"depth": [2], "dim": [2, 5, 10, 25, 50], "batch": [10000, 1000], "epochs": [5, 100], "rate": [0.1, 0.01], "run": list(range(10))},
}


def work(spark: SparkSession, name: str, done: DataFrame | None = None) -> DataFrame:
    """The settings of a sweep that have no result yet."""
    settings = grid(spark, **GRIDS[name])
    return settings if done is None else pending(settings, done, list(GRIDS[name]))


def run_sweep(settings: DataFrame, one: Callable[..., float]) -> DataFrame:
    """Results of ``one(**setting)`` for each setting: parameters and accuracy. Settings are a few hundred rows by construction."""
    rows = [{**r.asDict(), "accuracy": float(one(**r.asDict()))} for r in settings.collect()]
    return settings.sparkSession.createDataFrame(rows)


def summary(results: DataFrame, by: list[str]) -> DataFrame:
    """Mean, deviation and number of runs of each setting, best first."""
    return mean_std(results, by)
