"""Responses as plain text: light claims, judge outputs, the baselines, the policy reward and the trained head."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import text as t
from . import claims as c


def light_claims(text: Column) -> Column:
    """Up to six parts of at least 12 characters with a digit or a hint word; without any, up to three lines of more than 12."""
    parts = F.filter(F.transform(F.split(text, r"[\n.!?;]+"), lambda p: F.btrim(p, F.lit(" -\t"))), lambda p: (F.length(p) >= 12) & p.rlike(fixed.CLAIM_HINT))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: F.length(p) > 12)
    return F.when(F.size(parts) > 0, F.slice(parts, 1, 6)).otherwise(F.slice(lines, 1, 3))


def says_conflict(text: Column) -> Column:
    """C17."""
    return F.lower(text).rlike("conflict|inconsisten|contradict")


def has_numeric_evidence(text: Column, least: int = 2) -> Column:
    """C18."""
    return F.regexp_count(text, F.lit(r"[-+]?\d+(?:\.\d+)?")) >= least


def without_latex_noise(text: Column) -> Column:
    """Render tokens go, commands leave what their braces hold, white space collapses."""
    plain = F.regexp_replace(text, fixed.RENDER_TOKENS, "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\\[a-zA-Z]+\{([^}]*)\}", "$1"), r"(?U)\s+", " "))


def fenced_body(raw: Column) -> Column:
    """What the first code fence holds, or the whole text."""
    inner = F.regexp_extract(raw, r"(?s)```(?:json)?(.*?)(?:```|\z)", 1)
    return F.regexp_replace(F.when(raw.contains("```"), inner).otherwise(raw), r"^\s+|\s+$", "")


def bracketed(raw: Column) -> Column:
    """From the first [ to the last ], null without one."""
    return F.nullif(F.regexp_extract(raw, r"(?s)\[.*\]", 0), F.lit(""))


def judge_score(raw: Column) -> Column:
    """`score` of a JSON object (5 where it has none), else the first integer of the text within 0 to 10, else 5."""
    body = fenced_body(raw)
    # the parser stops after the first value, so the braces must hold the whole body
    parsed = body.rlike(r"(?s)^\{.*\}$") & F.get_json_object(body, "$").isNotNull()
    number = F.nullif(F.regexp_extract(raw, r"\b(\d+)\b", 1), F.lit("")).cast("long")
    return F.when(parsed, F.coalesce(F.get_json_object(body, "$.score").try_cast("double").cast("int"), F.lit(5))).otherwise(F.least(F.greatest(F.coalesce(number, F.lit(5)), F.lit(0)), F.lit(10)).cast("int"))


def aspect_reward(raw: Column) -> Column:
    """Weighted aspects of a JSON object, 5 for each that is missing, from 0..10 to -1..1."""
    body = fenced_body(raw)
    total = sum((F.coalesce(F.get_json_object(body, f"$.{k}").try_cast("double"), F.lit(5.0)) * w for k, w in fixed.ASPECT_WEIGHTS.items()), F.lit(0.0))
    return total / 10.0 * 2.0 - 1.0


def surface_reward(response: Column, evidence: Column) -> Column:
    """Twice the F1 of the word sets (words of two characters or more) less a half; 0 where either has no word."""
    a, b = t.word_set(response, 2), t.word_set(evidence, 2)
    return F.when((F.coalesce(F.size(a), F.lit(0)) <= 0) | (F.coalesce(F.size(b), F.lit(0)) <= 0), 0.0).otherwise(t.set_f1(a, b) * 2 - 0.5)


def hybrid_baseline(responses: DataFrame, records: DataFrame, learned: Column | None = None) -> DataFrame:
    """A10: claims that a record decides give +1 or -1, all others `learned` (0 by default); their means weighted by their share."""
    routed = c.verify_values(c.route(c.extract_claims(responses)), records)
    decided = F.arrays_overlap("layers", F.array(F.lit(0), F.lit(1))) & (F.col("confidence0") > 0.5)
    score = F.when(decided, F.when(F.col("reward0") > 0, 1.0).otherwise(-1.0)).otherwise(F.lit(0.0) if learned is None else learned)
    return routed.groupBy("paper_id").agg(F.count_if(decided).alias("n_verifiable"), F.count_if(~decided).alias("n_unverifiable"), F.avg(score).alias("reward"))


def policy_reward(df: DataFrame, key: str, label: str, prob2: str, truth: str, said: str, evidence: str, correct: float, miss: float, prob: float, false: float, bonus: float) -> DataFrame:
    """One row per response from its claims' labels and probabilities of class 2; rows with null labels are no claims.

    Responses without any claim get -0.3. `truth` (the sample's class), `said` and `evidence` are alike in all rows of a response."""
    two = F.avg((F.col(label) == 2).cast("double"))
    a = df.groupBy(key).agg(F.count(label).alias("n"), F.avg(F.when(F.col(label) == 0, 1.0).when(F.col(label) == 1, -0.1).when(F.col(label) == 2, -0.5)).alias("base"), two.alias("two"), F.avg((F.col(label) == 0).cast("double")).alias("zero"), F.avg(F.when(F.col(label).isNotNull(), F.col(prob2))).alias("p"), F.max(truth).alias("truth"), F.max(F.col(said).cast("int")).alias("said"), F.max(F.col(evidence).cast("int")).alias("evidence"))
    spoke, shown, real = F.col("said") == 1, F.col("evidence") == 1, F.col("two") > 0
    conflict = F.when(spoke, F.when(real, 1.5).otherwise(-1.0)).otherwise(0.0)
    shaped = F.when(F.col("truth") == 2, F.col("two") * correct + F.col("p") * prob - (1.0 - F.col("two")) * miss).otherwise(F.col("two") * -false)
    proof = F.when(spoke & shown & real, bonus).when(spoke & ~shown, -0.15).otherwise(0.0)
    total = F.col("base") + conflict * 0.2 + F.when(F.col("zero") < 0.3, -0.5).otherwise(0.0) + shaped + proof
    return a.select(key, F.col("n").alias("claims"), F.when(F.col("n") == 0, -0.3).otherwise(total).alias("reward"))


def gelu(x: np.ndarray) -> np.ndarray:
    return x * 0.5 * (1.0 + np.frompyfunc(math.erf, 1, 1)(x / math.sqrt(2.0)).astype(np.float64))


def head_probabilities(visual: np.ndarray, text: np.ndarray, weights: dict[str, np.ndarray]) -> np.ndarray:
    """Class probabilities of rows; weights v1 v2 t1 t2 c1 c2 are (inputs + 1, outputs), the last row the offset."""
    layer = lambda x, k: x @ weights[k][:-1] + weights[k][-1]
    v, s = layer(gelu(layer(visual, "v1")), "v2"), layer(gelu(layer(text, "t1")), "t2")
    z = layer(gelu(layer(np.concatenate([v, s, np.abs(v - s)], axis=1), "c1")), "c2")
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def head_inference(df: DataFrame, visual: str, text: str, weights: dict[str, np.ndarray], rewards=(1.0, 0.0, -0.8), most_mb: int = 256) -> DataFrame:
    """Df with `head` (label, probs, reward); null where a vector is null, so a caller coalesces to the lexical score.

    The weights travel with the function; their size does not depend on the rows and is checked against `most_mb`."""
    if (size := sum(w.nbytes for w in weights.values())) > most_mb << 20:
        raise ValueError(f"weights of {size} bytes are above {most_mb} MB")

    @F.pandas_udf("label int, probs array<double>, reward double")
    def infer(v: pd.Series, s: pd.Series) -> pd.DataFrame:
        known = np.flatnonzero((v.notna() & s.notna()).to_numpy())
        label, probs, reward = np.zeros(len(v), np.int32), np.full((len(v), len(rewards)), np.nan), np.full(len(v), np.nan)
        if len(known):
            p = head_probabilities(np.stack(v.iloc[known]).astype(np.float64), np.stack(s.iloc[known]).astype(np.float64), weights)
            label[known], probs[known] = p.argmax(axis=1), p
            reward[known] = np.asarray(rewards)[label[known]] * p.max(axis=1)
        return pd.DataFrame({"label": label, "probs": list(probs), "reward": reward})

    got = df.withColumn("head", infer(F.col(visual), F.col(text)))
    return got.withColumn("head", F.when(F.col(visual).isNotNull() & F.col(text).isNotNull(), F.col("head")))
