"""M5: labels without the prompt, and batches of like length, padded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hashed_rank, let

#: What a label is where no loss is taken, and the share of a sequence without a marker that counts as prompt.
IGNORED, PROMPT_SHARE = -100, 0.8
#: The hash of a length falls into so many intervals, so that a frequent length is ranked in parts.
PARTS = 16


def prompt_length(ids: Column, marker: list[int], share: float = PROMPT_SHARE) -> Column:
    """How many ids belong to the prompt: up to the end of the last `marker`, or, where there is none, int(n * share)."""
    found = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ids) - len(marker) + 1)), lambda i: F.slice(ids, i, len(marker)) == F.array(*[F.lit(m).cast("int") for m in marker]))
    return let(F.array_max(found), lambda at: F.when(at.isNotNull(), at + len(marker) - 1).otherwise(F.floor(F.size(ids) * share)).cast("int"))


def masked_labels(ids: Column, marker: list[int], share: float = PROMPT_SHARE) -> Column:
    """The ids as labels, the prompt's ones IGNORED."""
    return let(prompt_length(ids, marker, share), lambda n: F.transform(ids, lambda x, i: F.when(i < n, IGNORED).otherwise(x)))


def length_batches(df: DataFrame, key: str, ids: str, size: int, longest: int, salt: str = "42") -> DataFrame:
    """df with `batch`: `size` rows each in the order of their length (ids beyond `longest` are cut first), then of the key's hash.

    Lengths are at most `longest`, so counts by length and hash interval, and their running sum, are bounded; rows are ranked
    within one length and interval. Null ids are an empty sequence."""
    own = F.slice(F.coalesce(ids, F.array().cast(df.schema[ids].dataType)), 1, longest)
    rows = df.withColumn(ids, own).withColumn("_n", F.size(ids)).withColumn("_h", F.coalesce(hashed_rank(F.col(key), salt), F.lit(0)))
    rows = rows.withColumn("_part", F.floor(F.col("_h") / ((1 << 32) // PARTS)).cast("int"))
    sizes = rows.groupBy("_n", "_part").agg(F.count("*").alias("_c"))  # (longest + 1) * PARTS rows at most
    base = sizes.select("_n", "_part", F.coalesce(F.sum("_c").over(Window.orderBy("_n", "_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    placed = rows.join(base, ["_n", "_part"]).withColumn("_i", F.row_number().over(Window.partitionBy("_n", "_part").orderBy("_h", key)))
    return placed.withColumn("batch", F.floor((F.col("_base") + F.col("_i") - 1) / size)).select(*[f"`{c}`" for c in df.columns], "batch")


def padded(df: DataFrame, ids: str, labels: str, pad: int = 0) -> DataFrame:
    """Rows of length_batches with ids, labels and `attention` padded to their batch's longest: by pad, IGNORED and 0. A batch is
    bounded, so its window is."""
    width = F.max(F.size(ids)).over(Window.partitionBy("batch"))
    fill = lambda c, value: F.concat(F.col(c), F.array_repeat(F.lit(value).cast("int"), F.col("_width") - F.size(c)))
    rows = df.withColumn("_width", width).withColumn("attention", F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.col("_width") - F.size(ids))))
    return rows.withColumn(labels, fill(labels, IGNORED)).withColumn(ids, fill(ids, pad)).drop("_width")
