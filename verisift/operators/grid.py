"""M9: a grid of settings measured over one scan, with a marker per run, going on where it stopped, and one table as summary."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESULTS = "settings string, figures map<string,double>, run string"


def expanded(grid: dict[str, list]) -> dict[str, dict]:
    """Every combination of the settings' values by its run's name, in the order of the grid. No settings make one run."""
    runs = [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]
    named = {",".join(f"{k}={v}" for k, v in r.items()) or "only": r for r in runs}
    if len(named) != len(runs):
        raise ValueError("values of a setting must differ in writing")
    return named


def finished_runs(spark: SparkSession, path: str) -> DataFrame:
    """(settings, figures, run) of the runs that have ended."""
    try:
        return spark.read.schema(RESULTS).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RESULTS)


def run_grid(df: DataFrame, grid: dict[str, list], measure: Callable[..., dict[str, Column]], path: str, at_once: int = 50) -> DataFrame:
    """Measures every combination of the grid on df: measure(**settings) gives aggregates by name. Returns the summary.

    Up to `at_once` runs share one scan, as columns of one aggregate; their results are then written by run, all or none, and mark
    the runs as done. Run again, it goes on with those that are missing; results of other grids in `path` stay."""
    spark, runs = df.sparkSession, expanded(grid)
    done = {r["run"] for r in finished_runs(spark, path).select("run").distinct().collect()}
    todo = [n for n in runs if n not in done]
    for i in range(0, len(todo), at_once):
        some = {n: measure(**runs[n]) for n in todo[i : i + at_once]}
        columns = [c.cast("double").alias(f"r{j}_{k}") for j, figures in enumerate(some.values()) for k, c in enumerate(figures.values())]
        row = df.agg(*columns).first()
        rows = [(json.dumps(runs[n]), {name: row[f"r{j}_{k}"] for k, name in enumerate(figures)}, n) for j, (n, figures) in enumerate(some.items())]
        spark.createDataFrame(rows, RESULTS).coalesce(1).write.mode("append").partitionBy("run").parquet(path)
    return grid_summary(spark, path, list(runs))


def grid_summary(spark: SparkSession, path: str, runs: list[str] | None = None) -> DataFrame:
    """One table: run, its settings, and a row for each figure."""
    there = finished_runs(spark, path)
    there = there if runs is None else there.where(F.col("run").isin(*runs))
    return there.select("run", "settings", F.explode_outer("figures").alias("figure", "value"))
