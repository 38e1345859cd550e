"""Queries over responses, judges, baselines and the policy reward."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import responses as r
from ..operators import training
from ..sources.evidence import CLAIMS_SQL, PAIRED_SQL, fact_records, paired_documents, rendered_claims, table
from .registry import query

HINT = r"(?i)[0-9]|increase|decrease|higher|lower|more|less|significant|outperform|worse"


@query(
    rf"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[\n.!?;]+'), lambda x: trim(x, ' -' || chr(9))), lambda x: length(x) >= 12 AND regexp_matches(x, '{HINT}')) AS a,
      list_filter(list_transform(regexp_split_to_array(text, '\n'), lambda x: regexp_replace(x, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')), lambda x: length(x) > 12) AS b FROM documents)
    SELECT doc_id, len(c) AS n, md5(array_to_string(c, '|')) AS digest FROM (SELECT doc_id, CASE WHEN len(a) > 0 THEN a[1:6] ELSE b[1:3] END AS c FROM p)"""
)
def c15_light_claims(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select("doc_id", r.light_claims(F.col("text")).alias("c"))
    return c.select("doc_id", F.when(F.col("c").isNotNull(), F.size("c")).cast("long").alias("n"), F.md5(F.array_join("c", "|")).alias("digest"))


@query(r"SELECT doc_id, regexp_matches(lower(text), 'conflict|inconsisten|contradict') AS conflict, len(regexp_extract_all(text, '[-+]?[0-9]+(?:\.[0-9]+)?')) >= 2 AS evidence FROM documents")
def c17_c18_flags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", r.says_conflict(F.col("text")).alias("conflict"), r.has_numeric_evidence(F.col("text")).alias("evidence"))


@query(
    r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace('start_POSTSUBSCRIPT \textbf{x} ' || text, '(?:italic_|start_POSTSUBSCRIPT|end_POSTSUBSCRIPT|POSTSUPERSCRIPT)\s*', '', 'g'), '\\[a-zA-Z]+\{([^}]*)\}', '\1', 'g'), '[\s\x0b\x{85}\p{Z}]+', ' ', 'g'))) AS digest FROM documents"""
)
def c22_latex_noise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(r.without_latex_noise(F.concat(F.lit("start_POSTSUBSCRIPT \\textbf{x} "), F.col("text")))).alias("digest"))


#: Judge outputs: a fenced object, an object without a score, a sentence with numbers, a sentence without.
JUDGED = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '```json' || chr(10) || '{"score": ' || (doc_id % 11) || ', "numeric": ' || (doc_id % 7) || ', "trend": ' || (doc_id % 9) || '}' || chr(10) || '```'
  WHEN 1 THEN '{"numeric": ' || (doc_id % 10) || '}' WHEN 2 THEN 'I give ' || (doc_id % 15) || ' of 10' ELSE 'no idea' END AS raw FROM documents"""


def _outputs(spark, sf_dir):
    d, n = F.col("doc_id"), lambda m: (F.col("doc_id") % m).cast("string")
    fenced = F.concat(F.lit('```json\n{"score": '), n(11), F.lit(', "numeric": '), n(7), F.lit(', "trend": '), n(9), F.lit("}\n```"))
    raw = F.when(d % 4 == 0, fenced).when(d % 4 == 1, F.concat(F.lit('{"numeric": '), n(10), F.lit("}"))).when(d % 4 == 2, F.concat(F.lit("I give "), n(15), F.lit(" of 10"))).otherwise("no idea")
    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id % 11 WHEN 2 THEN least(doc_id % 15, 10) ELSE 5 END AS score FROM documents")
def c26_a8_judge_score(spark, sf_dir):
    return _outputs(spark, sf_dir).select("doc_id", r.judge_score(F.col("raw")).cast("long").alias("score"))


@query(
    """SELECT doc_id, round((CASE doc_id % 4 WHEN 0 THEN (doc_id % 7) * 0.3::DOUBLE + (doc_id % 9) * 0.15::DOUBLE + 2.75::DOUBLE WHEN 1 THEN (doc_id % 10) * 0.3::DOUBLE + 3.5::DOUBLE ELSE 5.0::DOUBLE END) / 5.0 - 1.0, 9) AS reward FROM documents"""
)
def a9_aspect_reward(spark, sf_dir):
    return _outputs(spark, sf_dir).select("doc_id", F.round(r.aspect_reward(F.col("raw")), 9).alias("reward"))


LONG_WORDS = "list_filter(list_distinct(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+')), lambda w: length(w) > 1)"


@query(
    f"""WITH {PAIRED_SQL}, w AS (SELECT doc_id, {LONG_WORDS.format(x="text")} AS a, {LONG_WORDS.format(x="evidence")} AS b FROM paired)
    SELECT doc_id, CASE WHEN coalesce(len(a), 0) = 0 OR coalesce(len(b), 0) = 0 THEN 0.0::DOUBLE ELSE round(4.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) - 0.5::DOUBLE, 9) END AS reward FROM w"""
)
def a7_surface_baseline(spark, sf_dir):
    return paired_documents(spark, sf_dir).select("doc_id", F.round(r.surface_reward(F.col("text"), F.col("evidence")), 9).alias("reward"))


@query(
    f"""WITH {CLAIMS_SQL} SELECT paper_id, count(*) FILTER (kind < 2) AS n_verifiable, count(*) FILTER (kind >= 2) AS n_unverifiable, round(avg(CASE WHEN verdict IS NULL THEN 0.0 WHEN verdict > 0 THEN 1.0 ELSE -1.0 END), 9) AS reward FROM claims GROUP BY 1"""
)
def a10_hybrid_baseline(spark, sf_dir):
    records = fact_records(spark, sf_dir)
    return r.hybrid_baseline(rendered_claims(records), records).withColumn("reward", F.round("reward", 9))


@query(
    """WITH a AS (SELECT o_custkey AS key, o_custkey % 3 AS truth, avg(CASE o_orderkey % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN -0.1::DOUBLE ELSE -0.5::DOUBLE END) AS base, avg(CASE WHEN o_orderkey % 3 = 2 THEN 1.0 ELSE 0.0 END) AS two, avg(CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0.0 END) AS zero,
      avg((o_orderkey % 10) / 10.0::DOUBLE) AS p, o_custkey % 2 = 0 AS said, o_custkey % 5 < 3 AS evidence, count(*) AS claims FROM orders GROUP BY ALL)
    SELECT key, claims, round(base + 0.2 * CASE WHEN said THEN CASE WHEN two > 0 THEN 1.5 ELSE -1.0 END ELSE 0.0 END + CASE WHEN zero < 0.3 THEN -0.5 ELSE 0.0 END + CASE WHEN truth = 2 THEN 0.4 * two + 0.2 * p - 0.3 * (1 - two) ELSE -0.25 * two END
      + CASE WHEN said AND evidence AND two > 0 THEN 0.15 WHEN said AND NOT evidence THEN -0.15 ELSE 0.0 END, 6) AS reward FROM a"""
)
def a13_policy_reward(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    d = table(spark, sf_dir, "orders").select(c.alias("key"), (o % 3).alias("label"), ((o % 10) / 10.0).alias("p2"), (c % 3).alias("truth"), (c % 2 == 0).alias("said"), (c % 5 < 3).alias("evidence"))
    return r.policy_reward(d, "key", "label", "p2", "truth", "said", "evidence", 0.4, 0.3, 0.2, 0.25, 0.15).withColumn("reward", F.round("reward", 6))


@query(
    """WITH a AS (SELECT avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) AS one, avg(CASE WHEN quality = doc_id % 2 THEN 1.0 ELSE 0.0 END) AS two FROM labels)
    SELECT round(abs(one - two), 9) AS gap, abs(one - two) <= 0.05 AS near, abs(one - two) <= 0.1 AS wide, abs(one - two) <= 0.05 AND abs(one - two) <= 0.1 AS go FROM a"""
)
def e12_e13_gap(spark, sf_dir):
    share = lambda x: F.avg((F.col("quality") == x).cast("double"))
    gap = F.abs(share(F.col("toxic")) - share(F.col("doc_id") % 2))
    return table(spark, sf_dir, "labels").agg(F.round(gap, 9).alias("gap"), (gap <= 0.05).alias("near"), (gap <= 0.1).alias("wide"), ((gap <= 0.05) & (gap <= 0.1)).alias("go"))


@query("SELECT share, CASE WHEN share >= 30 THEN 'GO' WHEN share >= 20 THEN 'MARGINAL' ELSE 'NO-GO' END AS verdict FROM (SELECT round(100.0 * count(*) FILTER (regexp_matches(text, '[0-9]')) / greatest(count(*), 1), 1) AS share FROM documents)")
def r10_go_no_go(spark, sf_dir):
    share = F.round(F.count_if(F.col("text").rlike("[0-9]")) * 100.0 / F.greatest(F.count("*"), F.lit(1)), 1)
    return table(spark, sf_dir, "documents").agg(share.alias("share")).select("share", F.when(F.col("share") >= 30, "GO").when(F.col("share") >= 20, "MARGINAL").otherwise("NO-GO").alias("verdict"))


@query()
def v14_head_inference(spark, sf_dir):
    """Each vector against itself reversed, with fixed weights; a test holds the numbers against a plain computation."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.reverse("embedding").alias("other"))
    one = e.select("embedding").where("embedding is not null").first()
    width = len(one["embedding"]) if one else 1
    return r.head_inference(e, "embedding", "other", example_weights(width)).select("vec_id", "head.label", "head.reward")


def _taught(spark, sf_dir, width_of=16):
    """(training rows, validation rows, starting weights): each vector against itself reversed; every fifth vec_id validates."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.reverse("embedding").alias("other"), F.pmod("label", F.lit(3)).alias("label"))
    width = e.agg(F.max(F.size("embedding"))).first()[0] or 1
    return e.where("vec_id % 5 <> 0"), e.where("vec_id % 5 = 0"), example_weights(width, width_of)


@query()
def m1_head_training(spark, sf_dir):
    """Loss, rate and accuracy by epoch; a test holds the weights against a plain loop."""
    train, validation, start = _taught(spark, sf_dir)
    done = training.train_head(train, validation, "vec_id", "embedding", "other", "label", start, epochs=2, batch=4096, rate=0.01, class_weights=(1.0, 1.2, 1.5))
    return spark.createDataFrame(done.history, "epoch int, loss double, rate double, accuracy double")


@query()
def m2_policy_training(spark, sf_dir):
    """The same of a policy epoch, with the starting weights as reference and judge; a test holds a step against a plain loop."""
    train, validation, start = _taught(spark, sf_dir)
    done = training.policy_training(train, validation, "vec_id", "embedding", "other", "label", start, start, epochs=1, batch=4096)
    return spark.createDataFrame(done.history, "epoch int, loss double, rate double, accuracy double")


def example_weights(width: int, latent: int = 16, classes: int = 3) -> dict[str, np.ndarray]:
    """Weights of a head from a fixed seed."""
    g = np.random.default_rng(42)
    sizes = {"v1": (width, latent), "v2": (latent, latent), "t1": (width, latent), "t2": (latent, latent), "c1": (3 * latent, latent), "c2": (latent, classes)}
    return {k: g.normal(size=(a + 1, b)) / np.sqrt(a) for k, (a, b) in sizes.items()}
