"""The relational and the lexical layer, their fusion with the exact one, and baselines over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import text as t
from ..sources.shared import kept
from . import claims as c

#: Values that a sequence without a matching column has at most.
FALLBACK_VALUES = 10


def trend_sequences(claims: DataFrame, records: DataFrame, by_column: bool = False) -> DataFrame:
    """(paper_id, claim_ord, values) of claims with a trend. by_column: the first column (table, then place) whose metric
    contains the claim's first metric, any without one, with two values or more. Without such a column, and always otherwise
    (a stored index has no columns): the first ten values of the first table with two."""
    asked = claims.where("trend is not null").select("paper_id", "claim_ord", t.record_name(F.coalesce(F.get("metrics", 0), F.lit(""))).alias("_m"))
    known = records.where("value is not null")
    ordered = lambda: F.transform(F.array_sort(F.collect_list(F.struct("rec_ord", "value"))), lambda x: x["value"])
    tables = known.groupBy("paper_id", "table_ord").agg(ordered().alias("v")).where(F.size("v") >= 2)
    first = tables.groupBy("paper_id").agg(F.min_by(F.slice("v", 1, FALLBACK_VALUES), "table_ord").alias("fallback"))
    if by_column:
        columns = known.groupBy("paper_id", "table_ord", "metric_norm").agg(ordered().alias("v"), F.min("rec_ord").alias("col_ord")).where(F.size("v") >= 2)
        met = asked.select("paper_id", "_m").distinct().join(columns, "paper_id").where(F.col("metric_norm").contains(F.col("_m")))
        asked = asked.join(met.groupBy("paper_id", "_m").agg(F.min_by("v", F.struct("table_ord", "col_ord")).alias("column")), ["paper_id", "_m"], "left")
    else:
        asked = asked.withColumn("column", F.lit(None).cast("array<double>"))
    return asked.join(first, "paper_id", "left").select("paper_id", "claim_ord", F.coalesce("column", "fallback").alias("values"))


def verify_trends(claims: DataFrame, records: DataFrame, by_column: bool = False) -> DataFrame:
    """V8: (paper_id, claim_ord, reward, confidence) of claims with a trend; confidence 0 without a sequence."""
    found = claims.select("paper_id", "claim_ord", "trend").join(trend_sequences(claims, records, by_column), ["paper_id", "claim_ord"])
    verdict = F.when(F.size("values") >= 2, c.trend_verdict(F.col("trend.direction"), c.sequence_direction(F.col("values"))))
    return found.select("paper_id", "claim_ord", F.coalesce(verdict, F.lit(0.0)).alias("reward"), F.when(verdict.isNotNull(), 0.75).otherwise(0.0).alias("confidence"))


def verify_semi_symbolic(claims: DataFrame, records: DataFrame, by_column: bool = False) -> DataFrame:
    """V9: claims with `reward1` and `confidence1`: the most confident of their relations, then their trend, the first on ties."""
    asked = claims.select("paper_id", "claim_ord", F.posexplode("relations").alias("ord", "r")).select("paper_id", "claim_ord", "ord", "r.entity_a", "r.entity_b", "r.relation", "r.metric")
    relations = c.verify_relations(asked, records).select("paper_id", "claim_ord", "ord", F.col("reward1").alias("reward"), F.col("confidence1").alias("confidence"))
    trends = verify_trends(claims, records, by_column).select("paper_id", "claim_ord", F.lit((1 << 31) - 1).alias("ord"), "reward", "confidence")
    best = relations.unionByName(trends).groupBy("paper_id", "claim_ord").agg(F.max_by(F.struct("reward", "confidence"), F.struct("confidence", -F.col("ord"))).alias("b"))
    return claims.join(best, ["paper_id", "claim_ord"], "left").withColumns({"reward1": F.coalesce("b.reward", F.lit(0.0)), "confidence1": F.coalesce("b.confidence", F.lit(0.0))}).drop("b")


def verify_lexical(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims with `reward2` against evidence(paper_id, evidence); papers without one have blank evidence, so 0."""
    met = claims.join(evidence.select("paper_id", "evidence"), "paper_id", "left")
    text = F.coalesce("evidence", F.lit(""))
    return met.withColumn("reward2", c.lexical_reward(c.lexical_parts(F.col("sentence"), text), text)).drop("evidence")


def verify_learned(claims: DataFrame, evidence: DataFrame, head: DataFrame | None = None) -> DataFrame:
    """With head(paper_id, claim_ord, reward), the trained head's rewards (cached or full), those where it has one; the lexical one elsewhere."""
    lexical = verify_lexical(claims, evidence)
    if head is None:
        return lexical
    return lexical.join(head.select("paper_id", "claim_ord", F.col("reward").alias("_h")), ["paper_id", "claim_ord"], "left").withColumn("reward2", F.coalesce("_h", "reward2")).drop("_h")


def guarded(reward: Column, confidence: Column) -> Column:
    """A learned call that gave nothing counts as reward 0 with confidence 0.5."""
    ok = reward.isNotNull() & ~F.isnan(reward)
    return F.struct(F.when(ok, reward).otherwise(0.0).alias("reward"), F.when(ok, F.coalesce(confidence, F.lit(0.5))).otherwise(0.5).alias("confidence"))


def judge_reward(score: Column) -> Column:
    """0..10 to -1..1; null (an error) is 0."""
    return F.coalesce(score / 5.0 - 1.0, F.lit(0.0))


def layered_rewards(responses: DataFrame, records: DataFrame, evidence: DataFrame, head: DataFrame | None = None, by_column: bool = False) -> DataFrame:
    """A1: every claim of responses(paper_id, response_id, text) with `claim_reward` from the layers that fired; response_id is unique in a paper.

    Layers 0 and 1 fire with confidence of the gate at least, else the learned layer does. Claims are written once, as all layers read them."""
    found = kept(c.route(c.extract_claims(responses)).withColumn("claim_ord", F.xxhash64("response_id", "sentence_ord")), "claims")
    done = verify_learned(verify_semi_symbolic(c.verify_values(found, records), records, by_column), evidence, head)
    has = lambda k: F.array_contains("layers", k)
    sure = lambda k: F.col(f"confidence{k}") >= fixed.GATE
    exact, relational = F.when(has(0) & sure(0), F.col("reward0")), F.when(has(1) & sure(1), F.col("reward1"))
    learned = F.when(has(2) | (has(0) & ~sure(0)) | (has(1) & ~sure(1)), F.col("reward2"))
    return done.withColumn("claim_reward", c.fused_reward({0: exact, 1: relational, 2: learned}))


def holistic_baseline(claims: DataFrame) -> DataFrame:
    """Per paper the mean learned reward of its claims."""
    return claims.groupBy("paper_id").agg(F.count("*").alias("claims"), F.avg("reward2").alias("reward"))


def hashed_features(key: Column, size: int) -> Column:
    """A vector of `size` numbers in [-1, 1) from a text or id alone, the same in every process."""
    number = lambda i: F.conv(F.substring(F.md5(F.concat(key, F.lit("#"), i.cast("string"))), 1, 8), 16, 10).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: number(i) / float(1 << 31) - 1.0)


def pooled(df: DataFrame, key: str, vector: str, use: Column | None = None) -> DataFrame:
    """Per key the mean vector of its rows, of those with `use` alone; vectors of one length."""
    rows = df if use is None else df.where(use)
    each = rows.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias(vector))
