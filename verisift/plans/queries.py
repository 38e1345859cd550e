"""Registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import text as t
from ..operators import claims as c
from ..operators import html_tables as ht
from ..operators import metrics as m
from ..operators import sampling as s
from ..sources.evidence import CLAIMS_SQL, PAIRED_SQL, RECORDS_SQL, fact_records, paired_documents, rendered_claims, stored_records, table
from . import construction, files, index, inputs, layers, responses, sets  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES, H, query  # noqa: F401


@query(
    f"""WITH {CLAIMS_SQL}, scored AS (
      SELECT paper_id, count(*) AS claims, avg(coalesce(verdict, 0.0)) AS base, avg(CASE WHEN kind = 3 THEN 0.0 ELSE 1.0 END) * 0.05 AS specificity FROM claims GROUP BY 1),
    covered AS (SELECT r.paper_id, avg(CASE WHEN EXISTS (SELECT 1 FROM claims k WHERE k.paper_id = r.paper_id AND k.kind <> 2 AND lower(k.entity) = r.entity_norm) THEN 1.0 ELSE 0.0 END) * 0.1 AS coverage FROM records r GROUP BY 1)
    SELECT paper_id, claims, round(base, 6) AS base, round(specificity, 6) AS specificity, round(coverage, 6) AS coverage, round(base + coverage + specificity, 6) AS total FROM scored JOIN covered USING (paper_id)"""
)
def flagship_reward_by_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = stored_records(spark, sf_dir)
    out = c.reward_by_paper(rendered_claims(records), records)
    return out.select("paper_id", "claims", *[F.round(x, 6).alias(x) for x in ("base", "specificity", "coverage", "total")])


@query(f"WITH {RECORDS_SQL} SELECT paper_id, table_ord, rec_ord, entity, metric, value FROM records")
def t8_fact_records(spark, sf_dir):
    return fact_records(spark, sf_dir).select("paper_id", "table_ord", "rec_ord", "entity", "metric", "value")


@query(
    f"""WITH {CLAIMS_SQL} SELECT paper_id, claim_ord, said / 10.0::DOUBLE AS value, '%' AS unit, CASE WHEN kind = 2 THEN 'QQZZXXYY' ELSE entity END AS entity, CASE WHEN kind = 3 THEN '' ELSE metric END AS metric, CASE WHEN kind = 3 THEN 2 ELSE 0 END AS best_layer FROM claims"""
)
def c1_to_c14_claims(spark, sf_dir):
    found = c.route(c.extract_claims(rendered_claims(fact_records(spark, sf_dir))))
    return found.select("paper_id", "claim_ord", F.get("numbers", 0)["value"].alias("value"), F.get("numbers", 0)["unit"].alias("unit"), F.get("entities", 0)["name"].alias("entity"), F.coalesce(F.get("metrics", 0), F.lit("")).alias("metric"), "best_layer")


@query(
    f"""WITH {CLAIMS_SQL} SELECT paper_id, claim_ord, verdict AS reward0, CASE WHEN kind IN (2, 3) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence0 FROM claims"""
)
def v4_symbolic_verify(spark, sf_dir):
    records = stored_records(spark, sf_dir)
    return c.verify_values(c.extract_claims(rendered_claims(records)), records).select("paper_id", "claim_ord", "reward0", F.round("confidence0", 9).alias("confidence0"))


@query(
    f"""WITH {RECORDS_SQL}, probes AS (SELECT DISTINCT paper_id, substr(entity_norm, 1, length(entity_norm) - 1) AS probe_entity, metric_norm AS probe_metric FROM records),
    scored AS (SELECT p.*, r.table_ord, r.rec_ord, r.value, (1.0::DOUBLE - levenshtein(probe_entity, entity_norm) / greatest(length(probe_entity), length(entity_norm))::DOUBLE) * 0.7::DOUBLE + (1.0::DOUBLE - levenshtein(probe_metric, metric_norm) / greatest(length(probe_metric), length(metric_norm))::DOUBLE) * 0.3::DOUBLE AS score FROM probes p JOIN records r USING (paper_id)),
    won AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY paper_id, probe_entity, probe_metric, table_ord ORDER BY score DESC, rec_ord) = 1)
    SELECT paper_id, probe_entity, probe_metric, table_ord, rec_ord, value, round(score, 9) AS score FROM won WHERE score >= 0.7 AND value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY paper_id, probe_entity, probe_metric ORDER BY score DESC, table_ord) = 1"""
)
def j6_j7_fuzzy_lookup(spark, sf_dir):
    records = stored_records(spark, sf_dir)
    probes = records.select("paper_id", F.expr("substr(entity_norm, 1, length(entity_norm) - 1)").alias("probe_entity"), F.col("metric_norm").alias("probe_metric"))
    return c.best_table(c.fuzzy_lookup(probes, records, 0.7)).select("paper_id", "probe_entity", "probe_metric", "table_ord", "rec_ord", "value", F.round("score", 9).alias("score"))


@query(
    f"""WITH {RECORDS_SQL}, one AS (SELECT paper_id, entity, value FROM records WHERE metric = 'recall' QUALIFY row_number() OVER (PARTITION BY paper_id, entity ORDER BY table_ord) = 1)
    SELECT a.paper_id, a.entity AS entity_a, b.entity AS entity_b, a.value AS value_a, b.value AS value_b, CASE WHEN a.value > b.value THEN 0.8::DOUBLE ELSE -0.8::DOUBLE END AS reward1, 0.9::DOUBLE AS confidence1 FROM one a JOIN one b USING (paper_id) WHERE a.entity < b.entity"""
)
def v5_relation_verify(spark, sf_dir):
    records = stored_records(spark, sf_dir)
    names = records.select("paper_id", "entity").distinct()
    pairs = names.withColumnRenamed("entity", "a").join(names.withColumnRenamed("entity", "b"), "paper_id").where("a < b")
    text = pairs.select("paper_id", F.concat("a", F.lit(" outperforms "), "b", F.lit(" in recall on this suite.")).alias("text"))
    relations = c.extract_claims(text).select("paper_id", F.explode("relations").alias("r")).select("paper_id", "r.entity_a", "r.entity_b", "r.relation", "r.metric")
    return c.verify_relations(relations, records).select("paper_id", "entity_a", "entity_b", "value_a", "value_b", "reward1", "confidence1")


@query(
    f"""WITH {RECORDS_SQL}, seq AS (SELECT paper_id, table_ord, metric, list(value ORDER BY rec_ord) AS v FROM records GROUP BY ALL),
    d AS (SELECT *, len(v) AS n, list_transform(range(1, len(v)), lambda i: v[i + 1] - v[i]) AS d, v[len(v) // 2 + 1:] AS half FROM seq)
    SELECT paper_id, table_ord, metric, CASE WHEN n < 2 THEN 'unknown' WHEN len(list_filter(d, lambda x: x > 0)) / (n - 1)::DOUBLE >= 0.8 THEN 'increase' WHEN len(list_filter(d, lambda x: x < 0)) / (n - 1)::DOUBLE >= 0.8 THEN 'decrease'
      WHEN len(half) >= 2 AND list_max(half) > 0 AND (list_max(half) - list_min(half)) / list_max(half) < 0.05 THEN 'saturate' ELSE 'stable' END AS direction FROM d"""
)
def v6_v7_trend_direction(spark, sf_dir):
    lists = fact_records(spark, sf_dir).groupBy("paper_id", "table_ord", "metric").agg(F.transform(F.array_sort(F.collect_list(F.struct("rec_ord", "value"))), lambda x: x["value"]).alias("v"))
    return lists.select("paper_id", "table_ord", "metric", c.sequence_direction(F.col("v")).alias("direction"))


WORDS = "list_distinct(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+'))"


@query(
    f"""WITH {PAIRED_SQL}, w AS (SELECT doc_id, {WORDS.format(x="text")} AS a, {WORDS.format(x="evidence")} AS b FROM paired)
    SELECT doc_id, round(CASE WHEN len(list_intersect(a, b)) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 9) AS f1 FROM w"""
)
def v11_token_f1(spark, sf_dir):
    words = lambda x: F.array_distinct(t.all_matches(F.lower(x), r"[\p{L}\p{N}_]+"))
    return paired_documents(spark, sf_dir).select("doc_id", F.round(t.set_f1(words(F.col("text")), words(F.col("evidence"))), 9).alias("f1"))


@query(
    f"""WITH {PAIRED_SQL}, n AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[0-9]+\\.?[0-9]*')) AS a, list_distinct(regexp_extract_all(evidence || ' ' || doc_id % 50, '[0-9]+\\.?[0-9]*')) AS b, doc_id % 3 = 0 AS blank FROM paired)
    SELECT doc_id, CASE WHEN len(a) = 0 THEN 0.5::DOUBLE WHEN blank THEN 0.3::DOUBLE ELSE round(len(list_intersect(a, b)) / len(a)::DOUBLE, 9) END AS numeric FROM n"""
)
def v13_numeric_consistency(spark, sf_dir):
    """Every third document has evidence without a number, the others a small number behind their item."""
    p = paired_documents(spark, sf_dir)
    evidence = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("evidence", r"\d", "")).otherwise(F.concat_ws(" ", "evidence", (F.col("doc_id") % 50).cast("string")))
    return p.select("doc_id", F.round(c.numeric_consistency(F.col("text"), evidence), 9).alias("numeric"))


JUDGED = "SELECT doc_id, CASE WHEN quality = 1 THEN 0 ELSE 2 END AS truth, CASE WHEN toxic = 1 THEN 2 WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS predicted FROM labels"


def _judged(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, 0).otherwise(2).alias("truth"), F.when(F.col("toxic") == 1, 2).when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("predicted"))


@query(f"SELECT avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END) AS accuracy, avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END) >= 0.75 AS go FROM ({JUDGED})")
def e1_accuracy(spark, sf_dir):
    a = F.avg((F.col("truth") == F.col("predicted")).cast("double"))
    return _judged(spark, sf_dir).agg(a.alias("accuracy"), (a >= 0.75).alias("go"))


@query(
    f"""WITH j AS ({JUDGED}), l AS (SELECT unnest([0, 1, 2]) AS label), x AS (SELECT label, (SELECT count(*) FROM j WHERE truth = label) AS t, (SELECT count(*) FROM j WHERE predicted = label) AS p, (SELECT count(*) FROM j WHERE truth = label AND predicted = label) AS h FROM l),
    y AS (SELECT label, coalesce(h / nullif(p, 0)::DOUBLE, 0.0::DOUBLE) AS precision, coalesce(h / nullif(t, 0)::DOUBLE, 0.0::DOUBLE) AS recall FROM x)
    SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0), 9) AS f1 FROM y"""
)
def e2_precision_recall(spark, sf_dir):
    return m.precision_recall(_judged(spark, sf_dir), "truth", "predicted", (0, 1, 2)).select("label", *[F.round(x, 9).alias(x) for x in ("precision", "recall", "f1")])


@query(f"SELECT a.x AS truth, b.x AS predicted, (SELECT count(*) FROM ({JUDGED}) WHERE truth = a.x AND predicted = b.x) AS n FROM (SELECT unnest([0, 1, 2]) AS x) a, (SELECT unnest([0, 1, 2]) AS x) b")
def e3_confusion(spark, sf_dir):
    return m.confusion(_judged(spark, sf_dir), "truth", "predicted", (0, 1, 2))


@query(
    f"""WITH j AS ({JUDGED}), n AS (SELECT count(*) AS t, avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END) AS po FROM j),
    pe AS (SELECT sum(a.n * b.n)::DOUBLE AS c FROM (SELECT truth AS x, count(*) AS n FROM j GROUP BY 1) a JOIN (SELECT predicted AS x, count(*) AS n FROM j GROUP BY 1) b USING (x))
    SELECT round((po - c / (t * t)) / (1 - c / (t * t)), 9) AS kappa FROM n, pe"""
)
def e4_kappa(spark, sf_dir):
    return m.kappa(_judged(spark, sf_dir), "truth", "predicted").select(F.round("kappa", 9).alias("kappa"))


REWARDS = "SELECT doc_id, (doc_id % 21 - 10) / 20.0::DOUBLE AS reward, CASE WHEN toxic = 1 THEN 'WRONG' ELSE 'CORRECT' END AS human, doc_id % 3 AS layer FROM labels"
LABEL = "CASE WHEN reward > 0.3 THEN 'CORRECT' WHEN reward > 0 THEN 'PARTIALLY_CORRECT' WHEN reward = 0 THEN 'UNVERIFIABLE' WHEN reward > -0.3 THEN 'PARTIALLY_CORRECT' ELSE 'WRONG' END"


def _rewards(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", ((F.col("doc_id") % 21 - 10) / 20.0).alias("reward"), F.when(F.col("toxic") == 1, "WRONG").otherwise("CORRECT").alias("human"), (F.col("doc_id") % 3).alias("layer")).withColumn("judged", m.reward_label(F.col("reward")))


@query(f"SELECT doc_id, {LABEL} AS judged FROM ({REWARDS})")
def e6_reward_label(spark, sf_dir):
    return _rewards(spark, sf_dir).select("doc_id", "judged")


@query(
    f"""WITH j AS (SELECT *, {LABEL} AS judged FROM ({REWARDS})) SELECT count(*) AS n, round(avg(CASE WHEN human = judged THEN 1.0 ELSE 0.0 END), 9) AS exact,
    round(avg(CASE WHEN (human IN ('CORRECT', 'PARTIALLY_CORRECT')) = (judged IN ('CORRECT', 'PARTIALLY_CORRECT')) THEN 1.0 ELSE 0.0 END), 9) AS binary FROM j"""
)
def e5_agreement(spark, sf_dir):
    return m.agreement(_rewards(spark, sf_dir), "human", "judged", fixed.JUDGE_LABELS[:2]).select("n", F.round("exact", 9).alias("exact"), F.round("binary", 9).alias("binary"))


@query(
    f"""WITH j AS (SELECT *, {LABEL} AS judged FROM ({REWARDS})) SELECT layer, grouping(layer) AS whole, count(*) AS n, round(avg(CASE WHEN human = judged THEN 1.0 ELSE 0.0 END), 9) AS exact FROM j GROUP BY GROUPING SETS ((layer), ())"""
)
def e7_r7_r8_stratified_agreement(spark, sf_dir):
    j = _rewards(spark, sf_dir).rollup("layer").agg(F.grouping("layer").cast("long").alias("whole"), F.count("*").alias("n"), F.round(F.avg((F.col("human") == F.col("judged")).cast("double")), 9).alias("exact"))
    return j.select("layer", "whole", "n", "exact")


@query(
    f"""WITH j AS (SELECT *, {LABEL} AS judged FROM ({REWARDS})) SELECT round(count(*) FILTER (human = 'WRONG' AND judged = 'WRONG') / nullif(count(*) FILTER (human = 'WRONG'), 0)::DOUBLE, 9) AS catch_strict,
    round(count(*) FILTER (human = 'WRONG' AND judged IN ('WRONG', 'PARTIALLY_CORRECT')) / nullif(count(*) FILTER (human = 'WRONG'), 0)::DOUBLE, 9) AS catch_loose, round(count(*) FILTER (human = 'CORRECT' AND judged = 'WRONG') / nullif(count(*) FILTER (human = 'CORRECT'), 0)::DOUBLE, 9) AS kill FROM j"""
)
def e8_error_rates(spark, sf_dir):
    return m.error_rates(_rewards(spark, sf_dir), "human", "judged").select(*[F.round(x, 9).alias(x) for x in ("catch_strict", "catch_loose", "kill")])


@query("SELECT label, count(*) AS n, avg(CASE WHEN label <> 2 THEN 1.0 ELSE 0.0 END) AS share FROM embeddings GROUP BY 1")
def e11_a20_label_counts(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.avg((F.col("label") != 2).cast("double")).alias("share"))


@query("SELECT o_custkey AS key, label FROM (SELECT o_custkey, o_orderkey % 3 AS label, count(*) AS n FROM orders GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, label) = 1")
def a14_majority(spark, sf_dir):
    return m.majority(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), (F.col("o_orderkey") % 3).alias("label")), "key", "label")


@query(
    """WITH d AS (SELECT o_custkey AS key, o_orderkey % 3 AS label, o_orderkey % 5 = 0 AS matched, o_orderkey % 11 = 0 AS reported FROM orders),
    a AS (SELECT key, avg(CASE label WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN -0.1::DOUBLE ELSE -0.5::DOUBLE END) AS base, avg(CASE WHEN matched THEN 1.0 ELSE 0.0 END) AS mt, bool_or(reported) AS said, bool_or(label = 2) AS really, avg(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END) AS ent FROM d GROUP BY 1)
    SELECT key, round(base + 0.3 * mt * 0.5 + 0.2 * CASE WHEN said THEN CASE WHEN really THEN 1.5 ELSE -1.0 END ELSE 0.0 END + CASE WHEN ent < 0.3 THEN -0.5 ELSE 0.0 END, 6) AS reward FROM a"""
)
def a12_trajectory_reward(spark, sf_dir):
    o = F.col("o_orderkey")
    d = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), (o % 3).alias("label"), (o % 5 == 0).alias("matched"), (o % 11 == 0).alias("reported"))
    return m.trajectory_reward(d, "key", "label", "matched", "reported").select("key", F.round("reward", 6).alias("reward"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std_pop, round(stddev_samp(value), 6) AS std_samp, min(value) AS low, max(value) AS high, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY 1")
def a16_reward_distribution(spark, sf_dir):
    r = m.reward_summary(table(spark, sf_dir, "events"), "event_type", "value")
    return r.select("event_type", "n", *[F.round(x, 6).alias(x) for x in ("mean", "std_pop", "std_samp")], "low", "high", F.round("median", 6).alias("median"))


@query("WITH d AS (SELECT value AS a, CASE WHEN event_id % 4 = 0 THEN value * 0.5 ELSE value END AS b FROM events) SELECT count(*) AS n, count(*) FILTER (abs(b - a) > 1e-8) AS changed, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(b - a), 6) AS mean_delta, round(avg(abs(b - a)), 6) AS mean_abs, round(max(abs(b - a)), 6) AS max_abs FROM d")
def a15_paired_comparison(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.col("value").alias("a"), F.when(F.col("event_id") % 4 == 0, F.col("value") * 0.5).otherwise(F.col("value")).alias("b"))
    return m.paired_comparison(d, "a", "b").select("n", "changed", *[F.round(x, 6).alias(x) for x in ("mean_a", "mean_b", "mean_delta", "mean_abs", "max_abs")])


@query("SELECT source, count(*) AS n, count(DISTINCT lang) AS langs FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 5")
def a17_a18_o3_most_common(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs")).orderBy(F.desc("n"), "source").limit(5)


W1 = "SELECT o_orderkey, o_totalprice / 1000 AS v, avg(o_totalprice / 1000) OVER w AS a, stddev_pop(o_totalprice / 1000) OVER w AS p, coalesce(stddev_samp(o_totalprice / 1000) OVER w, 0) AS q FROM orders WINDOW w AS (PARTITION BY o_custkey)"


def _groups(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 1000).alias("v"))


@query(f"SELECT o_orderkey, round(CASE WHEN p < 1e-6 THEN v - a ELSE greatest(-2.0, least(2.0, (v - a) / (p + 1e-6))) END, 5) AS norm FROM ({W1})")
def w1_group_normalise(spark, sf_dir):
    return s.normalise_groups(_groups(spark, sf_dir), "o_custkey", "v").select("o_orderkey", F.round("norm", 5).alias("norm"))


@query(f"SELECT o_orderkey, round(CASE WHEN q < 1e-6 THEN v - a ELSE (v - a) / (q + 1e-6) END, 5) AS norm FROM ({W1})")
def w2_group_normalise_sample(spark, sf_dir):
    return s.normalise_groups(_groups(spark, sf_dir), "o_custkey", "v", None, True).select("o_orderkey", F.round("norm", 5).alias("norm"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def w3_best_of_group(spark, sf_dir):
    return s.best_of_group(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    r AS (SELECT user_id, event_id, i, 0.05::DOUBLE * value AS ema FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, r.ema * 0.95::DOUBLE + e.value * 0.05::DOUBLE FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
    SELECT user_id, event_id, ema FROM r"""
)
def w4_running_baseline(spark, sf_dir):
    return s.running_baseline(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value").select("user_id", "event_id", "ema")


@query("SELECT event_type, CAST(floor((event_id - 1) / 100.0) AS BIGINT) AS interval, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1, 2")
def w5_interval_means(spark, sf_dir):
    return s.interval_means(table(spark, sf_dir, "events"), "event_type", "event_id", "value", 100).select("event_type", "interval", F.round("mean", 6).alias("mean"), "n")


@query(
    """WITH b AS (SELECT *, CASE WHEN mx IS NULL OR value > mx THEN 1 ELSE 0 END AS better FROM (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM events)),
    i AS (SELECT *, sum(better) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM b), c AS (SELECT *, sum(1 - better) OVER (PARTITION BY user_id, island ORDER BY event_id) AS since FROM i)
    SELECT user_id, min(CASE WHEN since >= 3 THEN event_id END) AS stop_step, arg_max(event_id, (value, -event_id)) AS best_step FROM c GROUP BY 1"""
)
def w9_a22_early_stop(spark, sf_dir):
    return s.early_stop(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 3)


@query(f"SELECT doc_id FROM documents ORDER BY {H.format(k='doc_id')}, doc_id LIMIT 100")
def s2_sample(spark, sf_dir):
    return s.sample_exact(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100)


@query(f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {H.format(k='doc_id')}, doc_id) <= greatest(floor((SELECT count(*) FROM documents) * 0.05), 1) THEN 'val' ELSE 'train' END AS split FROM documents")
def s1_split(spark, sf_dir):
    return s.split_train_val(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.05)


@query(f"SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de') QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {H.format(k='doc_id')}, doc_id) <= CASE lang WHEN 'en' THEN 100 ELSE 20 END")
def s4_s6_quota_sample(spark, sf_dir):
    return s.quota_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", {"en": 100, "de": 20}, "doc_id")


@query(f"SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY {H.format(k='doc_id')}, doc_id) <= greatest(1, least(CAST(round_even(count(*) OVER (PARTITION BY lang) * (1 - 0.9::DOUBLE), 0) AS BIGINT), greatest(1, count(*) OVER (PARTITION BY lang) - 1))) THEN 'val' ELSE 'train' END AS split FROM documents")
def s9_stratified_split(spark, sf_dir):
    return s.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], "doc_id").select("doc_id", "split")


@query(
    f"""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {H.format(k='doc_id')}, doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents), x AS (SELECT *, max(n) OVER () AS m FROM r)
    SELECT doc_id, unnest(range(1, CAST(ceil((m - k + 1) / n::DOUBLE) AS BIGINT) + 1))::INTEGER AS copy FROM x"""
)
def s11_oversample(spark, sf_dir):
    return s.oversample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id").select("doc_id", "copy")


@query(
    f"""WITH r AS (SELECT doc_id, source, row_number() OVER (ORDER BY {H.format(k='doc_id')}, doc_id) AS k, count(*) OVER () AS n FROM documents) SELECT a.doc_id, b.doc_id AS other_doc_id, b.source AS other_source FROM r a JOIN r b ON b.k = a.k % a.n + 1"""
)
def j16_mispair(spark, sf_dir):
    return s.mispair(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "source").select("doc_id", "other_doc_id", "other_source")


@query("SELECT d.doc_id, l.quality IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)")
def j2_j4_left_probe(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.col("quality").isNotNull().alias("labelled"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def j3_semi_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j5_u3_anti_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT conv_id, count(*) FILTER (role = 'user') AS questions, arg_min(text, turn) FILTER (role = 'assistant') AS answer FROM conversations GROUP BY 1")
def c20_message_parsing(spark, sf_dir):
    said = F.col("role") == "assistant"
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("questions"), F.min_by("text", F.when(said, F.col("turn"))).alias("answer"), F.count_if(said).alias("n")).select("conv_id", "questions", F.when(F.col("n") > 0, F.col("answer")).alias("answer"))


@query("SELECT page_id, coalesce(nullif(substr(regexp_replace(url, '[^A-Za-z0-9\\-_.]', '_', 'g'), 1, 160), ''), 'unknown') AS key FROM pages")
def c23_safe_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.safe_key(F.col("url")).alias("key"))


@query("SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '[.!?]\\s+'), lambda x: x), lambda x: length(x) > 15)) AS n FROM documents")
def c16_rough_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(F.split("text", r"[.!?]\s+"), lambda x: F.length(x) > 15)).cast("long").alias("n"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(text, '[0-9]+\\.[0-9]+')) AS with_decimal, round(100.0 * count(*) FILTER (regexp_matches(text, '[0-9]+\\.[0-9]+')) / count(*), 1) AS percent FROM documents GROUP BY 1")
def r5_r6_coverage(spark, sf_dir):
    hit = F.count_if(F.col("text").rlike(r"[0-9]+\.[0-9]+"))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), hit.alias("with_decimal"), F.round(hit * 100.0 / F.count("*"), 1).alias("percent"))


@query(f"WITH {CLAIMS_SQL} SELECT 100.0 * avg(CASE WHEN kind <> 3 THEN 1.0 ELSE 0.0 END) AS layer0, 0.0::DOUBLE AS layer1, 100.0 * avg(CASE WHEN kind = 3 THEN 1.0 ELSE 0.0 END) AS layer2 FROM claims")
def r4_layer_distribution(spark, sf_dir):
    routed = c.route(c.extract_claims(rendered_claims(fact_records(spark, sf_dir))))
    return routed.agg(*[(100.0 * F.avg(F.array_contains("layers", k).cast("double"))).alias(f"layer{k}") for k in (0, 1, 2)])


@query(
    f"""WITH {RECORDS_SQL}, cells AS (SELECT *, dense_rank() OVER (PARTITION BY paper_id, table_ord ORDER BY entity) - 1 AS row_idx, row_number() OVER (PARTITION BY paper_id, table_ord, entity ORDER BY rec_ord) AS col_idx FROM records)
    SELECT paper_id, table_ord, row_idx, col_idx, entity, CASE metric WHEN 'latency' THEN 'Speed / latency' ELSE 'Quality / ' || metric END AS metric, value, '' AS unit, value::VARCHAR AS raw_text FROM cells"""
)
def t1_to_t9_html_tables(spark, sf_dir):
    """Fact records of each nation's tables written as HTML with a spanning header, and read back."""
    cells = fact_records(spark, sf_dir).groupBy("paper_id", "table_ord", "entity").agg(F.array_sort(F.collect_list(F.struct("rec_ord", "value"))).alias("v"))
    row = F.concat(F.lit("<tr><td>"), F.col("entity"), F.lit("</td><td>"), F.array_join(F.transform("v", lambda x: x["value"].cast("string")), "</td><td>"), F.lit("</td></tr>"))
    pages = cells.groupBy("paper_id", "table_ord").agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("b"))
    head = "<table><tr><th rowspan=2>Model</th><th colspan=2>Quality</th><th>Speed</th></tr><tr><th>accuracy</th><th>recall</th><th>latency</th></tr>"
    return ht.records_of(ht.table_rows(pages.select("paper_id", "table_ord", F.concat(F.lit(head), F.col("b"), F.lit("</table>")).alias("html")))).drop("html")


@query()
def s12_s13_perturbed_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ladder = docs.select("*", F.explode(F.array(*map(F.lit, (0.01, 0.02, 0.05, 0.10, 0.20)))).alias("ratio"))
    return ladder.select("doc_id", "ratio", s.perturb_numbers(F.col("text"), F.col("ratio")).alias("perturbed"))
