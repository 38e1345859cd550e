"""Evaluation metrics, agreement, rewards over labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed


def confusion(df: DataFrame, truth: str, predicted: str, labels) -> DataFrame:
    """Every cell of the fixed label domain, zero where empty."""
    spark = df.sparkSession
    domain = spark.createDataFrame([(x,) for x in labels], f"truth {df.schema[truth].dataType.simpleString()}")
    cells = domain.crossJoin(domain.select(F.col("truth").alias("predicted")))
    seen = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return cells.join(seen, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def precision_recall(df: DataFrame, truth: str, predicted: str, labels) -> DataFrame:
    """Per label of the domain; a zero division gives 0."""
    cells = confusion(df, truth, predicted, labels)
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    by = lambda c: cells.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias(f"{c}_n"), F.sum(hit).alias(f"{c}_hit"))
    both = by("truth").join(by("predicted"), "label")
    p, r = F.coalesce(F.try_divide("predicted_hit", "predicted_n"), F.lit(0.0)), F.coalesce(F.try_divide("truth_hit", "truth_n"), F.lit(0.0))
    return both.select("label", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa; 1 where chance agreement is 1, 0 without rows."""
    both = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = both.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left, right = (both.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias(c)) for c in ("a", "b"))
    chance = left.join(right, "label").agg(F.sum(F.col("a") * F.col("b")).alias("c"))
    po, pe = F.col("same") / F.col("t"), F.coalesce("c", F.lit(0)) / (F.col("t") * F.col("t"))
    value = F.when(F.coalesce("t", F.lit(0)) == 0, 0.0).when(pe == 1, 1.0).otherwise(F.try_divide(po - pe, 1 - pe))
    return total.crossJoin(chance).select(value.alias("kappa"))


def agreement(df: DataFrame, a: str, b: str, positive) -> DataFrame:
    """E5: share of equal labels (a missing one disagrees) and of equal signs."""
    sign = lambda c: F.coalesce(F.col(c).isin(*positive), F.lit(False))
    return df.agg(F.count("*").alias("n"), F.avg(F.col(a).eqNullSafe(F.col(b)).cast("double")).alias("exact"), F.avg((sign(a) == sign(b)).cast("double")).alias("binary"))


def reward_label(reward: Column) -> Column:
    """E6."""
    return F.when(reward > 0.3, "CORRECT").when(reward > 0, "PARTIALLY_CORRECT").when(reward == 0, "UNVERIFIABLE").when(reward > -0.3, "PARTIALLY_CORRECT").otherwise("WRONG")


def error_rates(df: DataFrame, human: str, judged: str) -> DataFrame:
    """How many WRONG rows are caught, strictly and loosely, and how many CORRECT rows are killed."""
    rate = lambda when, hit: F.coalesce(F.try_divide(F.count_if(when & hit), F.count_if(when)), F.lit(0.0))
    wrong, right, j = F.col(human) == "WRONG", F.col(human) == "CORRECT", F.col(judged)
    return df.agg(rate(wrong, j == "WRONG").alias("catch_strict"), rate(wrong, j.isin("WRONG", "PARTIALLY_CORRECT")).alias("catch_loose"), rate(right, j == "WRONG").alias("kill"))


def level_bands(df: DataFrame, ratio: str) -> DataFrame:
    """A row per level whose band holds the ratio; bands overlap. Six literal levels, so an array per row and no join."""
    near = lambda level: F.abs(F.col(ratio) - level) < F.when(level > 0.02, level * 0.3).otherwise(0.005)
    return df.withColumn("level", F.explode(F.filter(F.array(*map(F.lit, fixed.LEVELS)), near)))


def sensitivity(df: DataFrame, ratio: str, predicted: str, least: int = 5, prob2: str | None = None) -> DataFrame:
    """Detection rate (and mean probability of class 2) per level of at least `least` rows, and whether the 5 % level reaches 0.6."""
    more = [F.avg(prob2).alias("mean_prob")] if prob2 else []
    per = level_bands(df, ratio).groupBy("level").agg(F.count("*").alias("n"), F.avg((F.col(predicted) == 2).cast("double")).alias("rate"), *more).where(F.col("n") >= least)
    return per.withColumn("meets", F.when(F.col("level") == 0.05, F.col("rate") >= 0.6))


def sensitivity_target(per_level: DataFrame, level: float = 0.05, least: float = 0.6) -> DataFrame:
    """Whether the level's rate reaches the target; false where the level is missing."""
    return per_level.agg(F.coalesce(F.bool_or((F.col("level") == level) & (F.col("rate") >= least)), F.lit(False)).alias("meets"))


def policy_sensitivity(df: DataFrame, ratio: str, found: str, synthetic: DataFrame | None = None) -> DataFrame:
    """Rate per ratio rounded to two places, of changed rows (ratio above 0); of `synthetic` rows where there is none of them.
    The flag `synthetic_used` says which: it is true for synthetic rows alone."""
    per = lambda d, flag: d.where(F.col(ratio) > 0).groupBy(F.bround(F.col(ratio) * 100).cast("int").alias("percent")).agg(F.count("*").alias("n"), F.avg(F.col(found).cast("double")).alias("rate")).withColumn("synthetic_used", F.lit(flag))
    own = per(df, False)
    return own if synthetic is None or not df.where(F.col(ratio) > 0).isEmpty() else per(synthetic, True)


def noisy(vector: str, key: Column, scale: float = 0.05) -> Column:
    """The vector with noise of about a normal distribution: per entry the sum of four uniform numbers from one hash."""
    def noise(i):
        h = F.md5(F.concat(key.cast("string"), F.lit("#"), i.cast("string")))
        total = sum((F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("double") for k in range(4)), F.lit(0.0))
        return (total / float(1 << 32) - 2.0) * (3.0**0.5)

    return F.transform(vector, lambda x, i: x.cast("double") + scale * noise(i))


def robustness(df: DataFrame, predicted: Column) -> DataFrame:
    """The share of rows that aren't called class 2; 0 without rows."""
    return df.agg(F.count("*").alias("n"), F.coalesce(F.avg((predicted != 2).cast("double")), F.lit(0.0)).alias("share"))


def label_distribution(df: DataFrame, by: str, label: str) -> DataFrame:
    """Rows and share of each label within each group."""
    per = df.groupBy(by, label).agg(F.count("*").alias("n"))
    return per.join(df.groupBy(by).agg(F.count("*").alias("of")), by).select(by, label, "n", (F.col("n") / F.col("of")).alias("share"))


def go_summary(checks: DataFrame) -> DataFrame:
    """checks(name, passed): go if all pass, how many do, and the names of those that fail (a null doesn't pass)."""
    ok = F.coalesce("passed", F.lit(False))
    return checks.agg(F.coalesce(F.bool_and(ok), F.lit(False)).alias("go"), F.count_if(ok).alias("passed"), F.array_sort(F.collect_list(F.when(~ok, F.col("name")))).alias("failed"))


def report_lines(figures: DataFrame, name: str, value: str, width: int = 24) -> DataFrame:
    """One line of text per figure."""
    return figures.select(F.format_string(f"%-{width}s %10.4f", F.col(name), F.col(value).cast("double")).alias("line"))


def epoch_rollup(df: DataFrame, step: str, every: int, value: str, layers: list[str]) -> DataFrame:
    """Per epoch the steps, mean and best of value, and per layer the values of its steps in order."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(step, c))), lambda x: x[c]).alias(f"{c}_path")
    return df.groupBy(F.floor(F.col(step) / every).alias("epoch")).agg(F.count("*").alias("steps"), F.avg(value).alias("mean"), F.max(value).alias("best"), *[ordered(c) for c in layers])


def best_checkpoint(df: DataFrame, run: str, epoch: str, score: Column) -> DataFrame:
    """Per run the epoch of the highest score, the first on ties."""
    return df.withColumn("_s", score).groupBy(run).agg(F.max_by(epoch, F.struct("_s", -F.col(epoch))).alias("best_epoch"), F.max("_s").alias("score"))


def checkpoint_scores(reward: Column, p1: Column, p2: Column, p3: Column, ratio: Column) -> dict[str, Column]:
    """The three selection scores."""
    return {"reward": reward, "gates": p1 + F.when(p2, 0.05).otherwise(0.0) + p3 * 0.05, "mixed": reward + ratio * 0.3}


def sample_averages(df: DataFrame, by: str, images: str, answer: str, thought: str) -> DataFrame:
    """Per group the mean number of images, the mean answer length, and the percentage of rows with a chain of thought."""
    has = F.coalesce(F.trim(F.col(thought)) != "", F.lit(False)).cast("double")
    return df.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.coalesce(F.array_size(images), F.lit(0))).alias("mean_images"), F.avg(F.length(F.coalesce(answer, F.lit("")))).alias("mean_answer"), (F.avg(has) * 100.0).alias("thought_pct"))


def majority(df: DataFrame, key: str, label: str) -> DataFrame:
    """The most frequent label, the smallest on ties."""
    return df.groupBy(key, label).agg(F.count("*").alias("n")).groupBy(key).agg(F.max_by(label, F.struct("n", -F.col(label))).alias("label"))


def trajectory_reward(df: DataFrame, key: str, label: str, matched: str, reported: str, cross: float = 0.3, conflict: float = 0.2, info: float = 1.0) -> DataFrame:
    """Mean label reward, match bonus, conflict bonus or penalty, and the penalty for few entailed claims."""
    value = F.when(F.col(label) == 0, 1.0).when(F.col(label) == 1, -0.1).otherwise(-0.5)
    a = df.groupBy(key).agg(F.avg(value).alias("base"), F.avg(F.col(matched).cast("double")).alias("match"), F.max(F.col(reported).cast("int")).alias("said"), F.max((F.col(label) == 2).cast("int")).alias("real"), F.avg((F.col(label) == 0).cast("double")).alias("entailed"))
    found = F.when(F.col("said") == 1, F.when(F.col("real") == 1, 1.5).otherwise(-1.0)).otherwise(0.0)
    return a.select(key, (F.col("base") + cross * F.col("match") * 0.5 + conflict * found + info * F.when(F.col("entailed") < 0.3, -0.5).otherwise(0.0)).alias("reward"))


#: Ranks of the sketch that brackets a median are off by one in ACCURACY at most; the bracket is wider than that on both sides.
ACCURACY, BRACKET = 10_000, 3e-4


def exact_medians(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median) of the values that aren't null, exact; of an even number the mean of the middle two. NaN is the largest value.

    A key may hold a third of all rows, all different. A sketch gives two values that enclose the middle; the values below are
    counted, and those between, a few of ten thousand and ties, are ranked as distinct values with counts."""
    v, same = F.col("_v"), F.col("_key").eqNullSafe(F.col("_of"))
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("_key"), F.col(value).cast("double").alias("_v"))
    ends = rows.groupBy(F.col("_key").alias("_of")).agg(F.percentile_approx("_v", [0.5 - BRACKET, 0.5 + BRACKET], ACCURACY).alias("e"), F.count("*").alias("n"))
    near = rows.join(ends.select("_of", "n", F.get("e", 0).alias("a"), F.get("e", 1).alias("z")), same).where(v <= F.col("z"))
    # one row stands for all values below the bracket
    counts = near.groupBy("_key", "n", F.when(v >= F.col("a"), v).alias("x")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("_key").orderBy(F.col("x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.withColumn("upto", upto)
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("x")))
    lower, upper = at(F.floor((F.col("n") - 1) / 2)), at(F.floor(F.col("n") / 2))
    return placed.where("x is not null").groupBy("_key").agg(((lower + upper) / 2).alias("median")).withColumnRenamed("_key", key)


def reward_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """Population and sample deviation, range and exact median per key; keys without a value have nulls."""
    v = F.col(value)
    figures = df.groupBy(F.col(key).alias("_of")).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std_pop"), F.stddev_samp(v).alias("std_samp"), F.min(v).alias("low"), F.max(v).alias("high"))
    medians = exact_medians(df, key, value)
    return figures.join(medians, F.col("_of").eqNullSafe(F.col(key)), "left").select(F.col("_of").alias(key), "n", "mean", "std_pop", "std_samp", "low", "high", "median")


def paired_comparison(df: DataFrame, a: str, b: str) -> DataFrame:
    """How many rows change between two settings, and by how much."""
    d = F.col(b) - F.col(a)
    return df.agg(F.count("*").alias("n"), F.count_if(F.abs(d) > 1e-8).alias("changed"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg(d).alias("mean_delta"), F.avg(F.abs(d)).alias("mean_abs"), F.max(F.abs(d)).alias("max_abs"))
