"""File sources and sinks: JSON lines, one JSON object per file, CSV, reports, sharded blobs, a cache. Paths are Spark paths."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """IO1: one object per line; blank lines give no row, bad ones a row with `_corrupt` and nulls elsewhere."""
    return spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """IO2: (name, doc): one object per file, `name` without folder and ending; a bad file has a null `doc`, so that it can be counted."""
    files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.json$", "")
    return files.select(name.alias("name"), F.when(F.get_json_object("value", "$").isNotNull(), F.from_json("value", schema)).alias("doc"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """IO10: CSV with a header, in its order or another; byte-order marks and outer blanks go, cells that do not fit are null."""
    raw = spark.read.option("header", True).csv(path)
    named = {c.replace("\ufeff", "").strip(): c for c in raw.columns}
    wanted = spark.createDataFrame([], schema).schema
    return raw.select(*[(F.trim(F.col(f"`{named[f.name]}`")).try_cast(f.dataType) if f.name in named else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted])


def first_accepted(df: DataFrame, accept: str, order: str, n: int) -> DataFrame:
    """IO3: the first n rows that `accept` lets through, by an ordinal column; a top-k, so no full sort."""
    return df.where(F.expr(accept)).orderBy(order).limit(n)


def within_first(df: DataFrame, ordinal: str, n: int, accept: str) -> DataFrame:
    """IO4: of the first n raw rows (ordinals from 0) those that `accept` lets through; n of 0 means all."""
    return (df.where(F.col(ordinal) < n) if n else df).where(F.expr(accept))


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """IO5: what lies at `path`, or else what `build` makes, written there first. Other read errors are raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        build().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def read_features(spark: SparkSession, path: str, split: str) -> DataFrame:
    """IO6: visual, text, label and perturbation_ratio of a split; a missing ratio column, or null, is 0. Unused columns are not read."""
    rows = spark.read.parquet(path).where(F.col("split") == split)
    ratio = F.coalesce(F.col("perturbation_ratio").cast("double"), F.lit(0.0)) if "perturbation_ratio" in rows.columns else F.lit(0.0)
    return rows.select("visual", "text", F.col("label").cast("int").alias("label"), ratio.alias("perturbation_ratio"))


def write_features(df: DataFrame, path: str) -> None:
    """IO7: visual, text, label and perturbation_ratio, one folder per split."""
    write_splits(df.select("split", "visual", "text", "label", "perturbation_ratio"), "split", path)


def finished(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """IO9, ST5: the results appended so far; a torn line counts as not done. An absent folder has none."""
    try:
        return read_json_lines(spark, path, schema).where("_corrupt is null").drop("_corrupt")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_results(work: DataFrame, key: str, process: Callable[[DataFrame], DataFrame], path: str, schema: str) -> None:
    """IO9: what process makes of the rows that `path` doesn't hold yet, appended to it. Run again, it goes on where it stopped."""
    done = finished(work.sparkSession, path, schema).select(key).distinct()
    process(work.join(done, key, "left_anti")).write.mode("append").json(path)


def write_three_way(df: DataFrame, usable: str, path: str) -> None:
    """IO11: usable rows to `manifest`, others to `missing`, their counts to `meta`. A null counts as not usable."""
    marked = df.withColumn("_ok", F.coalesce(F.expr(usable), F.lit(False))).persist()
    for name, keep in (("manifest", F.col("_ok")), ("missing", ~F.col("_ok"))):
        marked.where(keep).drop("_ok").write.mode("overwrite").json(f"{path}/{name}")
    write_report(marked.agg(F.count("*").alias("rows"), F.count_if("_ok").alias("usable"), F.count_if(~F.col("_ok")).alias("missing")), f"{path}/meta")
    marked.unpersist()


def write_weights(spark: SparkSession, weights: dict, path: str) -> None:
    """IO18: named matrices as rows (name, row, values)."""
    rows = [(k, i, [float(x) for x in r]) for k, w in weights.items() for i, r in enumerate(w)]
    spark.createDataFrame(rows, "name string, row int, values array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def read_weights(spark: SparkSession, path: str) -> dict:
    """IO18: what write_weights wrote; small by design, so it comes to the driver."""
    import numpy as np

    out: dict = {}
    for r in spark.read.parquet(path).orderBy("name", "row").collect():
        out.setdefault(r["name"], []).append(r["values"])
    return {k: np.array(v) for k, v in out.items()}


def write_checkpoint(spark: SparkSession, weights: dict, config: dict, path: str) -> None:
    """IO18: weights and the configuration they were made with (numbers, texts, lists), in two folders; the configuration comes last,
    so that a checkpoint with one is whole."""
    write_weights(spark, weights, f"{path}/weights")
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def read_checkpoint(spark: SparkSession, path: str) -> tuple[dict, dict] | None:
    """IO18: (weights, config) of write_checkpoint, None where there is no whole one."""
    try:
        config = spark.read.text(f"{path}/config").first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return (read_weights(spark, f"{path}/weights"), json.loads(config["value"])) if config else None


@dataclass(frozen=True)
class Settings:
    """IO17: what a run is built from; dotted overrides make a changed copy."""

    split: str = "all"
    seed: str = "42"
    gate: float = 0.7
    limit: int = 0
    clip: bool = True

    def overridden(self, *overrides: str) -> Settings:
        """`name=value` each, with the type of the field; a prefix with dots is ignored. Unknown names raise."""
        kinds = {f.name: type(f.default) for f in fields(self)}
        new = {}
        for o in overrides:
            name, _, value = o.partition("=")
            name = name.rpartition(".")[2].lstrip("-").replace("-", "_")
            if name not in kinds:
                raise ValueError(f"unknown setting {name}")
            new[name] = value.lower() in ("1", "true", "yes") if kinds[name] is bool else kinds[name](value)
        return replace(self, **new)


def write_json_lines(df: DataFrame, path: str) -> None:
    """IO8."""
    df.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """IO12: a report of a few rows (an aggregate) as one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_splits(df: DataFrame, split: str, path: str) -> None:
    """IO7: one folder per split."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def write_shards(df: DataFrame, index: str, path: str, every: int = 10_000) -> None:
    """ST2: a folder per `every` indices."""
    shard = F.floor(F.col(index) / every)
    df.withColumn("shard", shard).repartitionByRange(F.col(index)).write.mode("overwrite").partitionBy("shard").parquet(path)
