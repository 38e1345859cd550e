"""The evidence adapter: star-schema tables as long fact records, and claims about them as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import kept

#: value in tenths per metric, from integers alone, so that every engine gets the same
METRICS = {"accuracy": "(sum_discount * 10) div n", "recall": "(sum_quantity * 4) div n", "latency": "n"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fact_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id (nation), table_ord (return flag), rec_ord, entity (part type), metric, value, and their normalised names.

    The facts are aggregated before the small dimensions join by name, so lineitem shuffles once, as partial sums."""
    item, part, supplier, nation = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation"))
    joined = item.select("l_partkey", "l_suppkey", "l_returnflag", "l_discount", "l_quantity").join(part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    sums = joined.groupBy("s_nationkey", "l_returnflag", "p_type").agg(F.sum(F.round(F.col("l_discount") * 1000).cast("long")).alias("sum_discount"), F.sum(F.round(F.col("l_quantity") * 10).cast("long")).alias("sum_quantity"), F.count("*").alias("n"))
    named = sums.join(nation.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("metric"), F.expr(e).cast("long").alias("tenths")) for k, (m, e) in enumerate(METRICS.items())]))
    long = named.select(F.col("n_name").alias("paper_id"), F.expr("case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end").alias("table_ord"), F.col("p_type").alias("entity"), each.alias("m"))
    kinds = F.expr("array_position(array('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'), entity)").cast("int")
    return long.select("paper_id", "table_ord", (kinds * 3 + F.col("m.k")).alias("rec_ord"), "entity", F.col("m.metric").alias("metric"), F.col("m.tenths").alias("tenths"), (F.col("m.tenths") / F.lit(10.0)).alias("value"), F.lower("entity").alias("entity_norm"), F.col("m.metric").alias("metric_norm"))


def stored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact_records, written once: for plans that read them in several places, so that lineitem is scanned once."""
    return kept(fact_records(spark, sf_dir), "records")


def paired_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, evidence: each document beside one benchmark item, all items in turn; empty evidence without one."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("evidence"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("item_id", F.pmod(F.col("doc_id"), F.lit(max(1, items.count()))))
    return docs.join(items, "item_id", "left").select("doc_id", "text", F.coalesce("evidence", F.lit("")).alias("evidence"))


PAIRED_SQL = "paired AS (SELECT doc_id, d.text, coalesce(b.text, '') AS evidence FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % (SELECT greatest(count(*), 1) FROM benchmark))"

RECORDS_SQL = """records AS (
  SELECT paper_id, table_ord, (list_position(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'], entity) * 3 + k)::INTEGER AS rec_ord, entity, metric, tenths, tenths / 10.0::DOUBLE AS value, lower(entity) AS entity_norm, metric AS metric_norm
  FROM (
    SELECT paper_id, table_ord, entity, unnest([0, 1, 2]) AS k, unnest(['accuracy', 'recall', 'latency']) AS metric, unnest([(d * 10) // n, (q * 4) // n, n]) AS tenths
    FROM (
      SELECT n_name AS paper_id, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS table_ord, p_type AS entity,
        sum(CAST(round(l_discount * 1000) AS BIGINT))::BIGINT AS d, sum(CAST(round(l_quantity * 10) AS BIGINT))::BIGINT AS q, count(*) AS n
      FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3)))"""

#: Any table's fact may be claimed; the best record of a name is that of the first table that has it, so `known` may differ.
CLAIMS_SQL = (
    RECORDS_SQL
    + """, claims AS (
  SELECT *, CASE WHEN kind IN (2, 3) THEN NULL WHEN abs(said / 10.0::DOUBLE - known) <= 0.05::DOUBLE THEN 1.0::DOUBLE WHEN abs(said / 10.0::DOUBLE - known) / greatest(abs(known), 1e-8::DOUBLE) <= 0.01::DOUBLE THEN 0.8::DOUBLE ELSE -1.0::DOUBLE END AS verdict FROM (
    SELECT *, CASE kind WHEN 1 THEN tenths + tenths // 5 + 1 ELSE tenths END AS said, first_value(value) OVER (PARTITION BY paper_id, entity, metric ORDER BY table_ord) AS known FROM (
      SELECT paper_id, table_ord, table_ord * 100 + rec_ord AS claim_ord, entity, metric, tenths, value, CAST(('0x' || substr(md5(paper_id || table_ord || entity || metric), 1, 8)) AS BIGINT) % 4 AS kind FROM records)))"""
)


def rendered_claims(records: DataFrame) -> DataFrame:
    """One sentence per record. kind 0: as it is; 1: a fifth too high; 2: of an unknown name; 3: without a metric."""
    kind = (F.conv(F.substring(F.md5(F.concat("paper_id", F.col("table_ord").cast("string"), "entity", "metric")), 1, 8), 16, 10).cast("long") % 4).alias("kind")
    c = records.select("paper_id", (F.col("table_ord") * 100 + F.col("rec_ord")).alias("claim_ord"), "entity", "metric", "tenths", kind)
    c = c.withColumn("said", F.when(F.col("kind") == 1, F.col("tenths") + F.expr("tenths div 5") + 1).otherwise(F.col("tenths")))
    name = F.when(F.col("kind") == 2, "QQZZXXYY").otherwise(F.col("entity"))
    metric = F.when(F.col("kind") == 3, "").otherwise(F.concat(F.lit(" "), F.col("metric")))
    text = F.concat(name, F.lit(" achieves "), F.expr("said div 10").cast("string"), F.lit("."), F.expr("said % 10").cast("string"), F.lit("%"), metric, F.lit(" on the benchmark suite."))
    return c.select("paper_id", "claim_ord", text.alias("text"))
