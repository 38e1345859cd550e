"""Verifiability of whole texts by patterns, and its statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed

FLAGS = ("has_numeric", "has_entity_metric", "has_comparison", "has_trend", "is_qualitative_only")


def classified(df: DataFrame, text: str) -> DataFrame:
    """The five flags of a whole text, and `layer`: 0 numeric with a metric, else 1 comparison or trend, else 2. A null text has no flag."""
    t = F.coalesce(F.col(text), F.lit(""))
    flags = {
        "has_numeric": t.rlike(fixed.CLASSIFIER_NUMERIC),
        "has_entity_metric": t.rlike(fixed.CLASSIFIER_METRIC) | t.rlike(fixed.CLASSIFIER_METRIC_BIO),
        "has_comparison": t.rlike(fixed.CLASSIFIER_COMPARISON),
        "has_trend": t.rlike(fixed.CLASSIFIER_TREND),
        "_qualitative": t.rlike(fixed.CLASSIFIER_QUALITATIVE),
    }
    found = df.withColumns(flags)
    only = ~F.col("has_numeric") & ~F.col("has_comparison") & ~F.col("has_trend") & F.col("_qualitative")
    layer = F.when(F.col("has_numeric") & F.col("has_entity_metric"), 0).when(F.col("has_comparison") | F.col("has_trend"), 1).otherwise(2)
    return found.withColumn("is_qualitative_only", only).withColumn("layer", layer).drop("_qualitative")


def _percent(condition: Column) -> Column:
    return F.round(F.count_if(condition) * 100.0 / F.greatest(F.count("*"), F.lit(1)), 1)


def coverage_statistics(found: DataFrame, by: list[str]) -> DataFrame:
    """Per group of `by`, and for all (`whole` 1), counts and percentages (one place) by layer, and a count per flag."""
    layers = [x for k in (0, 1, 2) for x in (F.count_if(F.col("layer") == k).alias(f"layer{k}"), _percent(F.col("layer") == k).alias(f"layer{k}_pct"))]
    return found.groupingSets([by, []], *by).agg(F.grouping(by[0]).cast("int").alias("whole"), F.count("*").alias("n"), *layers, _percent(F.col("layer") < 2).alias("layer01_pct"), *[F.count_if(f).alias(f) for f in FLAGS])


def by_size(statistics: DataFrame, *key: str) -> DataFrame:
    """Groups by falling size, ties by key."""
    return statistics.orderBy(F.desc("n"), *key)


def layer_distribution(claims: DataFrame) -> DataFrame:
    """Per cent of claims that have each layer (a claim may have several) and of those with layer 0 or 1, which is null without claims."""
    has = lambda *k: F.arrays_overlap("layers", F.array(*map(F.lit, k))).cast("double")
    share = lambda name, *k: F.coalesce(F.avg(has(*k)) * 100.0, F.lit(0.0)).alias(name)
    return claims.agg(F.count("*").alias("n"), share("layer0", 0), share("layer1", 1), share("layer2", 2), (F.avg(has(0, 1)) * 100.0).alias("layer01"))
