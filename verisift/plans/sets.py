"""Queries over metrics, roll-ups, quotas, perturbations and synthetic rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import construction as k
from ..operators import metrics as m
from ..operators import sampling as s
from ..sources.evidence import table
from .registry import H, query

REWARDS = "SELECT doc_id, (doc_id % 21 - 10) / 20.0::DOUBLE AS reward, doc_id % 3 AS layer FROM labels"
LABEL = "CASE WHEN reward > 0.3 THEN 'CORRECT' WHEN reward > 0 THEN 'PARTIALLY_CORRECT' WHEN reward = 0 THEN 'UNVERIFIABLE' WHEN reward > -0.3 THEN 'PARTIALLY_CORRECT' ELSE 'WRONG' END"


@query(f"WITH j AS (SELECT layer, {LABEL} AS judged FROM ({REWARDS})) SELECT layer, judged, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY layer), 9)::DOUBLE AS share FROM j GROUP BY 1, 2")
def e7_label_distribution(spark, sf_dir):
    j = table(spark, sf_dir, "labels").select((F.col("doc_id") % 3).alias("layer"), m.reward_label((F.col("doc_id") % 21 - 10) / 20.0).alias("judged"))
    return m.label_distribution(j, "layer", "judged").withColumn("share", F.round("share", 9))


PERTURBED = "d AS (SELECT CAST(vec_id % 25 AS DOUBLE) / 100 AS ratio, CASE WHEN label >= 4 THEN 2 ELSE 0 END AS predicted, (vec_id % 7) / 7.0::DOUBLE AS p FROM embeddings), l AS (SELECT unnest([0.01, 0.02, 0.05, 0.10, 0.15, 0.20])::DOUBLE AS level), x AS (SELECT level, count(*) AS n, avg(CASE WHEN predicted = 2 THEN 1.0 ELSE 0.0 END) AS rate, avg(p) AS mean_prob FROM d, l WHERE abs(ratio - level) < CASE WHEN level > 0.02 THEN level * 0.3::DOUBLE ELSE 0.005::DOUBLE END GROUP BY 1 HAVING count(*) >= 5)"


def _perturbed(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(((F.col("vec_id") % 25).cast("double") / 100).alias("ratio"), F.when(F.col("label") >= 4, 2).otherwise(0).alias("predicted"), ((F.col("vec_id") % 7) / 7.0).alias("p"))


@query(f"WITH {PERTURBED} SELECT level, n, round(rate, 9) AS rate, round(mean_prob, 9) AS mean_prob, CASE WHEN level = 0.05 THEN rate >= 0.6 END AS meets FROM x")
def e9_j10_sensitivity(spark, sf_dir):
    x = m.sensitivity(_perturbed(spark, sf_dir), "ratio", "predicted", prob2="p")
    return x.select("level", "n", F.round("rate", 9).alias("rate"), F.round("mean_prob", 9).alias("mean_prob"), "meets")


@query(f"WITH {PERTURBED} SELECT coalesce(bool_or(level = 0.05 AND rate >= 0.6), false) AS meets FROM x")
def e9_target(spark, sf_dir):
    return m.sensitivity_target(m.sensitivity(_perturbed(spark, sf_dir), "ratio", "predicted"))


@query("SELECT CAST(vec_id % 25 AS INTEGER) AS percent, count(*) AS n, round(avg(CASE WHEN label >= 4 THEN 1.0 ELSE 0.0 END), 9) AS rate, false AS synthetic_used FROM embeddings WHERE vec_id % 25 > 0 GROUP BY 1")
def e10_policy_sensitivity(spark, sf_dir):
    d = _perturbed(spark, sf_dir).withColumn("found", F.col("predicted") == 2)
    return m.policy_sensitivity(d, "ratio", "found", d.limit(0)).withColumn("rate", F.round("rate", 9))


@query("SELECT CAST(vec_id % 25 AS INTEGER) AS percent, count(*) AS n, 1.0::DOUBLE AS rate, true AS synthetic_used FROM embeddings WHERE vec_id % 25 > 0 GROUP BY 1")
def e10_synthetic_fallback(spark, sf_dir):
    d = _perturbed(spark, sf_dir)
    return m.policy_sensitivity(d.select(F.lit(0.0).alias("ratio"), F.lit(False).alias("found")), "ratio", "found", d.withColumn("found", F.lit(True)))


@query(
    """WITH f AS (SELECT vec_id, embedding FROM embeddings WHERE label = 0 ORDER BY vec_id LIMIT 50), e AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM f),
    h AS (SELECT *, md5(vec_id || '#' || i) AS h FROM e), n AS (SELECT vec_id, x + 0.05::DOUBLE * ((CAST('0x' || substr(h, 1, 8) AS BIGINT) + CAST('0x' || substr(h, 9, 8) AS BIGINT) + CAST('0x' || substr(h, 17, 8) AS BIGINT) + CAST('0x' || substr(h, 25, 8) AS BIGINT)) / 4294967296.0::DOUBLE - 2.0::DOUBLE) * sqrt(3.0::DOUBLE) AS y FROM h),
    s AS (SELECT vec_id, sum(y) AS t FROM n GROUP BY 1) SELECT count(*) AS n, coalesce(avg(CASE WHEN t > 0.2 THEN 0.0 ELSE 1.0 END), 0.0)::DOUBLE AS share FROM s"""
)
def e11_robustness(spark, sf_dir):
    """The first 50 entailed rows with noise; class 2 where the noisy vector's sum is above a bound."""
    first = table(spark, sf_dir, "embeddings").where("label = 0").select("vec_id", "embedding").orderBy("vec_id").limit(50)
    total = F.aggregate(m.noisy("embedding", F.col("vec_id")), F.lit(0.0), lambda a, x: a + x)
    return m.robustness(first, F.when(total > 0.2, 2).otherwise(0))


@query("WITH c AS (SELECT r_name AS name, r_regionkey < 3 AS passed FROM region) SELECT bool_and(passed) AS go, count(*) FILTER (passed) AS passed, array_to_string(list_sort(list(name) FILTER (NOT passed)), ',') AS failed FROM c")
def e13_go_summary(spark, sf_dir):
    out = m.go_summary(table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), (F.col("r_regionkey") < 3).alias("passed")))
    return out.withColumn("failed", F.array_join("failed", ","))


@query("SELECT rpad(r_name, 24, ' ') || ' ' || lpad(r_regionkey || '.5000', 10, ' ') AS line FROM region")
def e14_report_lines(spark, sf_dir):
    return m.report_lines(table(spark, sf_dir, "region").select("r_name", (F.col("r_regionkey") + 0.5).alias("v")), "r_name", "v")


@query("SELECT lang, count(*) AS n, round(avg(doc_id % 4), 9) AS mean_images, round(avg(length(text)), 6) AS mean_answer, round(100.0 * avg(CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS thought_pct FROM documents GROUP BY 1")
def a19_conditional_averages(spark, sf_dir):
    i = F.col("doc_id")
    images = F.when(i % 4 > 0, F.sequence(F.lit(1), (i % 4).cast("int")))
    d = table(spark, sf_dir, "documents").select("lang", images.alias("images"), "text", F.when(i % 3 == 0, "so it is").when(i % 3 == 1, "  ").alias("thought"))
    a = m.sample_averages(d, "lang", "images", "text", "thought")
    return a.select("lang", "n", F.round("mean_images", 9).alias("mean_images"), F.round("mean_answer", 6).alias("mean_answer"), F.round("thought_pct", 6).alias("thought_pct"))


@query("SELECT CAST(event_id // 500 AS BIGINT) AS epoch, count(*) AS steps, round(avg(value), 6) AS mean, max(value) AS best, array_to_string(list(user_id ORDER BY event_id), ',') AS layer0_path, array_to_string(list(event_id % 7 ORDER BY event_id), ',') AS layer1_path FROM events GROUP BY 1")
def a21_epoch_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value", F.col("user_id").alias("layer0"), (F.col("event_id") % 7).alias("layer1"))
    r = m.epoch_rollup(e, "event_id", 500, "value", ["layer0", "layer1"])
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return r.select("epoch", "steps", F.round("mean", 6).alias("mean"), "best", text("layer0_path"), text("layer1_path"))


_SCORES = {"reward": "(event_id % 13) / 4.0::DOUBLE", "gates": "(event_id % 5) / 4.0::DOUBLE + CASE WHEN event_id % 2 = 0 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END + (event_id % 3) / 4.0::DOUBLE * 0.05::DOUBLE", "mixed": "(event_id % 13) / 4.0::DOUBLE + (event_id % 7) / 4.0::DOUBLE * 0.3::DOUBLE"}


@query(" UNION ALL ".join(f"SELECT '{n}' AS kind, user_id, arg_max(event_id, ({x}, -event_id)) AS best_epoch, round(max({x}), 9) AS score FROM events GROUP BY 2" for n, x in _SCORES.items()))
def a22_checkpoint_scores(spark, sf_dir):
    e, i = table(spark, sf_dir, "events").select("user_id", "event_id"), F.col("event_id")
    scores = m.checkpoint_scores((i % 13) / 4.0, (i % 5) / 4.0, i % 2 == 0, (i % 3) / 4.0, (i % 7) / 4.0)
    each = [m.best_checkpoint(e, "user_id", "event_id", x).select(F.lit(n).alias("kind"), "user_id", "best_epoch", F.round("score", 9).alias("score")) for n, x in scores.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(f"SELECT o_orderkey, layer FROM (SELECT o_orderkey, o_orderkey % 4 AS layer, o_custkey % 2 AS split FROM orders) WHERE layer < 3 QUALIFY row_number() OVER (PARTITION BY layer ORDER BY split, {H.format(k='o_orderkey')}, o_orderkey) <= CASE layer WHEN 0 THEN 100 ELSE 200 END")
def s4_layer_quotas(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("layer"), (F.col("o_custkey") % 2).alias("split"))
    return s.layer_quotas(o, "layer", ["split", s.hashed_rank(F.col("o_orderkey"), "42"), "o_orderkey"]).select("o_orderkey", "layer")


@query(f"WITH d AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'tqa' WHEN 'de' THEN 'mqa' WHEN 'fr' THEN 'vqa' END AS split FROM documents) SELECT doc_id, split FROM d WHERE split IS NOT NULL QUALIFY row_number() OVER (PARTITION BY split ORDER BY {H.format(k='doc_id')}, doc_id) <= CASE split WHEN 'tqa' THEN 30 WHEN 'mqa' THEN 21 ELSE 9 END")
def s6_split_quotas(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", "tqa").when(F.col("lang") == "de", "mqa").when(F.col("lang") == "fr", "vqa").alias("split"))
    return s.quota_sample(s.in_splits(d, "split", "tqa, mqa,vqa"), "split", s.split_quotas(60), "doc_id")


@query("SELECT doc_id FROM documents WHERE trim(coalesce(text, '')) <> '' AND trim(coalesce(source, '')) <> '' AND length(text) >= 200")
def s17_required_text(spark, sf_dir):
    return s.with_required_text(table(spark, sf_dir, "documents"), "text", "source", 200).select("doc_id")


@query(f"SELECT doc_id, (row_number() OVER (ORDER BY {H.format(k='doc_id')}, doc_id) - 1) // 32 AS batch FROM documents")
def s18_batches(spark, sf_dir):
    return s.batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 32)


@query("SELECT DISTINCT source FROM documents WHERE source <> ''")
def o1_sorted_ids(spark, sf_dir):
    return s.sorted_ids(table(spark, sf_dir, "documents"), "source")


@query("SELECT DISTINCT CAST(vec_id % 25 AS INTEGER) AS percent FROM embeddings ORDER BY 1")
def o5_sorted_levels(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 25).cast("int").alias("percent")).distinct().orderBy("percent")


def _h(salt: str, key: str = "i") -> str:
    return f"CAST('0x' || substr(md5({key} || '{salt}'), 1, 8) AS BIGINT)"


_VALUE = f"CASE WHEN {_h('value')} % 1000 % 10 = 0 THEN ({_h('value')} % 1000 // 10) || '.0' ELSE ({_h('value')} % 1000 // 10) || '.' || ({_h('value')} % 1000 % 10) END"


@query(
    f"""SELECT i AS id, CASE i % 5 WHEN 0 THEN 'Model ' || i || ' reaches an accuracy of ' || v || '%.' WHEN 1 THEN 'The loss of run ' || i || ' falls to ' || v || '.' WHEN 2 THEN 'System ' || i || ' needs ' || v || ' ms per step.' WHEN 3 THEN 'Method ' || i || ' scores ' || v || ' on the test set.' ELSE 'Variant ' || i || ' improves recall by ' || v || ' points.' END AS text,
      CAST({_h('label')} % 3 AS INTEGER) AS label, {_h('label')} % 3 - 1.0::DOUBLE + {_h('/0')} / 4294967296.0::DOUBLE - 0.5::DOUBLE AS first FROM (SELECT i, {_VALUE} AS v FROM (SELECT event_id AS i FROM events))"""
)
def s15_synthetic_rows(spark, sf_dir):
    return k.synthetic_rows(table(spark, sf_dir, "events"), "event_id").select("id", "text", "label", F.get("features", 0).alias("first"))


@query()
def s12_o6_perturbations(spark, sf_dir):
    """Texts with changed numbers and their value lists from right to left; a test recomputes them in plain Python."""
    d = table(spark, sf_dir, "documents").select("doc_id", s.perturbation(F.col("text"), 0.1).alias("p"))
    return d.select("doc_id", "p.text", "p.original", "p.changed", "p.num_changed")
