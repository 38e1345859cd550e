"""Queries over the relational and lexical layers, their fusion, and routing of whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import text as t
from ..operators import claims as c
from ..operators import coverage as cov
from ..operators import layers as ly
from ..sources.evidence import RECORDS_SQL, fact_records, stored_records, table
from .registry import query

# A claim per pair of part types of a paper, by three templates; and one trend claim per type.
PAIRS_SQL = (
    RECORDS_SQL
    + """, names AS (SELECT DISTINCT paper_id, entity FROM records), one AS (SELECT paper_id, entity, value FROM records WHERE metric = 'recall' QUALIFY row_number() OVER (PARTITION BY paper_id, entity ORDER BY table_ord) = 1),
  pairs AS (SELECT a.paper_id, a.entity AS a, b.entity AS b, (length(a.entity) + length(b.entity)) % 3 AS form FROM names a JOIN names b USING (paper_id) WHERE a.entity <> b.entity),
  relational AS (SELECT pairs.paper_id, a || '>' || b AS response_id, form, CASE WHEN form = 1 THEN y.value > x.value ELSE x.value > y.value END AS holds FROM pairs JOIN one x ON x.paper_id = pairs.paper_id AND x.entity = a JOIN one y ON y.paper_id = pairs.paper_id AND y.entity = b),
  seq AS (SELECT paper_id, list(value ORDER BY rec_ord)[1:10] AS v FROM records GROUP BY paper_id, table_ord HAVING count(*) >= 2 QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY table_ord) = 1),
  d AS (SELECT *, len(v) AS n, list_transform(range(1, len(v)), lambda i: v[i + 1] - v[i]) AS d, v[len(v) // 2 + 1:] AS half FROM seq),
  dir AS (SELECT paper_id, CASE WHEN len(list_filter(d, lambda x: x > 0)) / (n - 1)::DOUBLE >= 0.8 THEN 'increase' WHEN len(list_filter(d, lambda x: x < 0)) / (n - 1)::DOUBLE >= 0.8 THEN 'decrease'
    WHEN len(half) >= 2 AND list_max(half) > 0 AND (list_max(half) - list_min(half)) / list_max(half) < 0.05 THEN 'stable' ELSE 'stable' END AS direction FROM d),
  trends AS (SELECT n.paper_id, entity AS response_id, CASE length(entity) % 3 WHEN 0 THEN 'increase' WHEN 1 THEN 'decrease' ELSE 'stable' END = direction AS holds FROM names n JOIN dir USING (paper_id))"""
)


def _claim_texts(records):
    names = records.select("paper_id", "entity").distinct()
    pairs = names.withColumnRenamed("entity", "a").join(names.withColumnRenamed("entity", "b"), "paper_id").where("a <> b")
    form = (F.length("a") + F.length("b")) % 3
    said = F.when(form == 0, F.concat("a", F.lit(" achieves significantly higher recall than "), "b", F.lit(" on this suite.")))
    said = said.when(form == 1, F.concat(F.lit("Compared to "), "b", F.lit(", "), "a", F.lit(" is worse in recall on this suite."))).otherwise(F.concat("a", F.lit(" > "), "b", F.lit(" in recall on this suite.")))
    kind = F.length("entity") % 3
    trend = F.concat(F.lit("Recall "), F.when(kind == 0, "grows").when(kind == 1, "drops").otherwise("remains constant"), F.lit(" for "), "entity", F.lit(" on this suite."))
    relational = pairs.select("paper_id", F.concat("a", F.lit(">"), "b").alias("response_id"), said.alias("text"))
    return relational.unionByName(names.select("paper_id", F.col("entity").alias("response_id"), trend.alias("text")))


@query(f"WITH {PAIRS_SQL} SELECT paper_id, response_id, CASE WHEN holds THEN 0.8::DOUBLE ELSE -0.8::DOUBLE END AS reward1, 0.9::DOUBLE AS confidence1 FROM relational UNION ALL SELECT paper_id, response_id, CASE WHEN holds THEN 0.8::DOUBLE ELSE -0.8::DOUBLE END, 0.75::DOUBLE FROM trends")
def v6_v8_v9_semi_symbolic(spark, sf_dir):
    records = stored_records(spark, sf_dir)
    claims = c.route(c.extract_claims(_claim_texts(records))).withColumn("claim_ord", F.col("response_id"))
    return ly.verify_semi_symbolic(claims, records).select("paper_id", "response_id", "reward1", "confidence1")


@query(f"WITH {PAIRS_SQL}, r AS (SELECT paper_id, holds FROM relational UNION ALL SELECT paper_id, holds FROM trends) SELECT paper_id, count(*) AS claims, round(avg(CASE WHEN holds THEN 0.8 ELSE -0.8 END), 6) AS base FROM r GROUP BY 1")
def a1_layered_reward(spark, sf_dir):
    records = stored_records(spark, sf_dir)
    evidence = records.select("paper_id").distinct().withColumn("evidence", F.lit("no table speaks of it"))
    done = ly.layered_rewards(_claim_texts(records), records, evidence)
    return done.groupBy("paper_id").agg(F.count("*").alias("claims"), F.round(F.avg("claim_reward"), 6).alias("base"))


FORMS = """VALUES (0, 'gt', NULL), (1, 'lt', NULL), (2, 'gte', NULL), (3, 'gt', NULL), (4, NULL, 'increase'), (5, NULL, 'saturate')"""


@query(
    f"""WITH n AS (SELECT n_nationkey AS k, n_name AS a, (SELECT n_name FROM nation o WHERE o.n_nationkey = (nation.n_nationkey + 1) % (SELECT count(*) FROM nation)) AS b FROM nation), f(form, relation, direction) AS ({FORMS})
    SELECT k, a, relation, CASE WHEN relation IS NOT NULL THEN a END AS entity_a, CASE WHEN relation IS NOT NULL THEN b END AS entity_b, direction, CASE WHEN form = 4 THEN 'depth' WHEN form = 5 THEN '' END AS condition FROM n JOIN f ON form = k % 7 WHERE a NOT LIKE '% %' AND b NOT LIKE '% %'"""
)
def c4_c10_c13_families(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("a"))
    total = n.count()
    b = n.select(((F.col("k") + total - 1) % total).alias("k"), F.col("a").alias("b"))
    forms = ["{a} shows slightly better recall than {b} on this suite.", "Compared with {b}, {a} is inferior in recall on this suite.", "{a} >= {b} in recall on this suite.", "{a} outperforms {b} in recall on this suite.", "Recall of {a} grows as the depth is scaled over this suite.", "Recall of {a} saturates early on this suite.", "Overall, {a} exceeds {b} in recall on this suite."]
    text = F.coalesce(*[F.when(F.col("k") % 7 == i, F.expr("concat('" + f.replace("{a}", "', a, '").replace("{b}", "', b, '") + "')")) for i, f in enumerate(forms)])
    found = c.extract_claims(n.join(b, "k").where("a not like '% %' and b not like '% %'").withColumn("text", text))
    r = F.get("relations", 0)
    return found.select("k", "a", r["relation"].alias("relation"), r["entity_a"].alias("entity_a"), r["entity_b"].alias("entity_b"), F.col("trend.direction").alias("direction"), F.col("trend.condition").alias("condition"))


# Each benchmark item as a claim against the next item.
NEXT_SQL = "items AS (SELECT a.item_id, a.text AS claim, b.text AS evidence FROM benchmark a JOIN benchmark b ON b.item_id = (a.item_id + 1) % (SELECT count(*) FROM benchmark))"
PARTS_SQL = f"""{NEXT_SQL}, w AS (SELECT *, list_distinct(regexp_extract_all(lower(claim), '[\\p{{L}}\\p{{N}}_]+')) AS a, list_distinct(regexp_extract_all(lower(evidence), '[\\p{{L}}\\p{{N}}_]+')) AS b,
    list_distinct(regexp_extract_all(claim, '(?:^|[^\\p{{L}}\\p{{N}}_])([A-Z][\\p{{L}}\\p{{N}}_\\-]*[\\p{{L}}\\p{{N}}_])', 1)) AS names, list_distinct(regexp_extract_all(claim, '\\d+\\.?\\d*')) AS p, list_distinct(regexp_extract_all(evidence, '\\d+\\.?\\d*')) AS q FROM items),
  parts AS (SELECT *, CASE WHEN len(list_intersect(a, b)) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) END AS f1,
    CASE WHEN len(names) = 0 THEN 0.5::DOUBLE ELSE len(list_filter(names, lambda x: contains(lower(evidence), lower(x)))) / len(names)::DOUBLE END AS coverage,
    CASE WHEN len(p) = 0 THEN 0.5::DOUBLE WHEN len(q) = 0 THEN 0.3::DOUBLE ELSE len(list_intersect(p, q)) / len(p)::DOUBLE END AS numeric FROM w),
  lexical AS (SELECT item_id, f1, coverage, numeric, f1 * 0.4::DOUBLE + coverage * 0.3::DOUBLE + numeric * 0.3::DOUBLE AS c FROM parts),
  rewarded AS (SELECT *, CASE WHEN trim(evidence) = '' THEN 0.0::DOUBLE ELSE greatest(-1.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN c >= 0.5 THEN least(1.5::DOUBLE * c, 1.0::DOUBLE) WHEN c >= 0.2 THEN 0.0::DOUBLE ELSE -0.8::DOUBLE * (1.0::DOUBLE - 3.0::DOUBLE * c) END)) END AS reward FROM lexical JOIN (SELECT item_id, evidence FROM items) USING (item_id))"""


def _next_items(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    n = b.count()
    return b.select("item_id", F.col("text").alias("sentence")).join(b.select(((F.col("item_id") + n - 1) % n).alias("item_id"), F.col("text").alias("evidence")), "item_id")


@query(f"WITH {PARTS_SQL} SELECT item_id, round(f1, 9) AS f1, round(coverage, 9) AS coverage, round(numeric, 9) AS numeric, round(reward, 9) AS reward FROM lexical JOIN rewarded USING (item_id, f1, coverage, numeric)")
def v10_v12_lexical_verify(spark, sf_dir):
    items = _next_items(spark, sf_dir).withColumn("p", c.lexical_parts(F.col("sentence"), F.col("evidence")))
    reward = c.lexical_reward(F.col("p"), F.col("evidence"))
    return items.select("item_id", *[F.round(f"p.{x}", 9).alias(x) for x in ("f1", "coverage", "numeric")], F.round(reward, 9).alias("reward"))


@query(f"WITH {PARTS_SQL} SELECT item_id % 5 AS paper_id, count(*) AS claims, round(avg(CASE WHEN item_id % 4 = 0 THEN 0.25::DOUBLE ELSE reward END), 6) AS reward FROM rewarded GROUP BY 1")
def v17_a11_holistic(spark, sf_dir):
    """Every fourth claim has a reward of the head, the others fall back to the lexical one; their mean per paper."""
    items = _next_items(spark, sf_dir)
    claims = items.select(F.col("item_id").alias("own"), F.col("item_id").alias("paper_id"), F.col("item_id").alias("claim_ord"), "sentence")
    head = items.where("item_id % 4 = 0").select(F.col("item_id").alias("paper_id"), F.col("item_id").alias("claim_ord"), F.lit(0.25).alias("reward"))
    done = ly.verify_learned(claims, items.select(F.col("item_id").alias("paper_id"), "evidence"), head).withColumn("paper_id", F.col("own") % 5)
    return ly.holistic_baseline(done).select("paper_id", "claims", F.round("reward", 6).alias("reward"))


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN 0.0 ELSE (doc_id % 11) / 5.0::DOUBLE - 1.0::DOUBLE END AS reward, CASE WHEN toxic = 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS guarded, CASE WHEN toxic = 1 THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM labels")
def a6_a8_guarded_judge(spark, sf_dir):
    g = ly.guarded(F.when(F.col("toxic") == 1, F.lit(float("nan"))).otherwise(1.0), F.lit(0.9))
    score = F.when(F.col("quality").isNotNull(), F.col("doc_id") % 11)
    return table(spark, sf_dir, "labels").select("doc_id", ly.judge_reward(score).alias("reward"), g["reward"].alias("guarded"), g["confidence"].alias("confidence"))


NAMES = ("numeric", "metric", "comparison", "trend", "qualitative")
_SQL = [p.replace("'", "''") for p in (fixed.CLASSIFIER_NUMERIC, fixed.CLASSIFIER_METRIC, fixed.CLASSIFIER_METRIC_BIO, fixed.CLASSIFIER_COMPARISON, fixed.CLASSIFIER_TREND, fixed.CLASSIFIER_QUALITATIVE)]
CLASSIFIED_SQL = f"""f AS (SELECT item_id, split_part(text, ' ', 1) AS head, length(text) % 3 AS grp, regexp_matches(text, '{_SQL[0]}') AS num, regexp_matches(text, '{_SQL[1]}') OR regexp_matches(text, '{_SQL[2]}') AS met, regexp_matches(text, '{_SQL[3]}') AS cmp, regexp_matches(text, '{_SQL[4]}') AS tre, regexp_matches(text, '{_SQL[5]}') AS qua FROM benchmark),
  k AS (SELECT *, NOT num AND NOT cmp AND NOT tre AND qua AS only_qua, CASE WHEN num AND met THEN 0 WHEN cmp OR tre THEN 1 ELSE 2 END AS layer FROM f)"""


def _classified(spark, sf_dir):
    return cov.classified(table(spark, sf_dir, "benchmark"), "text").withColumn("grp", F.length("text") % 3)


@query(f"WITH {CLASSIFIED_SQL} SELECT item_id, num AS has_numeric, met AS has_entity_metric, cmp AS has_comparison, tre AS has_trend, only_qua AS is_qualitative_only, layer FROM k")
def r5_classifier(spark, sf_dir):
    return _classified(spark, sf_dir).select("item_id", *cov.FLAGS, "layer")


@query(
    f"""WITH {CLASSIFIED_SQL} SELECT grp, grouping(grp) AS whole, count(*) AS n, count(*) FILTER (layer = 0) AS layer0, round(100.0::DOUBLE * count(*) FILTER (layer = 0) / count(*), 1) AS layer0_pct, count(*) FILTER (layer = 1) AS layer1, round(100.0::DOUBLE * count(*) FILTER (layer = 1) / count(*), 1) AS layer1_pct,
    count(*) FILTER (layer = 2) AS layer2, round(100.0::DOUBLE * count(*) FILTER (layer = 2) / count(*), 1) AS layer2_pct, round(100.0::DOUBLE * count(*) FILTER (layer < 2) / count(*), 1) AS layer01_pct, count(*) FILTER (num) AS has_numeric, count(*) FILTER (met) AS has_entity_metric, count(*) FILTER (cmp) AS has_comparison, count(*) FILTER (tre) AS has_trend, count(*) FILTER (only_qua) AS is_qualitative_only
    FROM k GROUP BY GROUPING SETS ((grp), ())"""
)
def r6_r7_r8_coverage_statistics(spark, sf_dir):
    return cov.by_size(cov.coverage_statistics(_classified(spark, sf_dir), ["grp"]), "grp")


@query(f"WITH {RECORDS_SQL}, names AS (SELECT DISTINCT paper_id, entity FROM records) SELECT count(*) AS n, 0.0::DOUBLE AS layer0, 100.0::DOUBLE AS layer1, 0.0::DOUBLE AS layer2, 100.0::DOUBLE AS layer01 FROM (SELECT 1 FROM names a JOIN names b USING (paper_id) WHERE a.entity <> b.entity UNION ALL SELECT 1 FROM names)")
def r4_layer_shares(spark, sf_dir):
    return cov.layer_distribution(c.route(c.extract_claims(_claim_texts(fact_records(spark, sf_dir)))))


@query("SELECT label, i, round(avg(x), 6) AS x FROM (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY 1, 2")
def v15_pooled_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return ly.pooled(e.select("label", F.col("embedding").cast("array<double>").alias("v")), "label", "v").select("label", F.posexplode("v").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


@query("SELECT item_id, i, CAST(('0x' || substr(md5(text || '#' || i), 1, 8)) AS BIGINT) / 2147483648.0::DOUBLE - 1.0::DOUBLE AS x FROM benchmark, range(4) r(i)")
def v16_hashed_features(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(ly.hashed_features(F.col("text"), 4)).alias("i", "x"))
