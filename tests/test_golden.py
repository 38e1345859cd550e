"""Golden micro-cases."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from verisift.functions import text as t
from verisift.operators import claims as c
from verisift.operators import html_tables as ht
from verisift.operators import metrics as m
from verisift.operators import sampling as s
from verisift.plans import queries as plans
from verisift.sources.evidence import fact_records
from verisift.streaming import ingest as st


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "b", "want"), [("economy", "economy", 1.0), ("bert", "bert.", 0.8), ("small", "smell", 0.8), ("ours", "ourmethod", 1 / 3), ("", "", 1.0), ("", "x", 0.0)])
def test_similarity(spark, a, b, want):
    assert one(spark, t.similarity(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize(("cell", "value", "unit"), [("**85.3** ± 0.2", 85.3, ""), ("0.91 (0.02)", 0.91, ""), ("1,234", 1.0, ""), ("n/a", None, ""), ("12%", 12.0, "%")])
def test_cell_number(spark, cell, value, unit):
    x = one(spark, t.cell_number(F.col("a")), a=cell)
    assert (x["value"], x["unit"]) == (value, unit)


@pytest.mark.parametrize(("said", "true", "want"), [(85.3, 85.32, 1.0), (85.3, 85.9, 0.8), (88.0, 85.3, -1.0), (0.0, 0.04, 1.0)])
def test_value_verdict(spark, said, true, want):
    assert one(spark, c.value_verdict(F.col("a"), F.col("b")), a=said, b=true) == want


def test_names_numbers_and_relations(spark):
    assert one(spark, t.claim_name(F.col("a")), a="Our Method") == "ours"
    assert one(spark, t.claim_name(F.col("a")), a="BERT-base_v 2") == "bertbasev2"
    assert [(n["value"], n["unit"]) for n in one(spark, t.numbers(F.col("a")), a="use 85 samples, GPT-4o")] == [(85.0, "s"), (-4.0, "")]
    assert [n["value"] for n in one(spark, t.numbers(F.col("a")), a="BERT reaches F1 of 0.85")] == [1.0, 0.85]
    r = one(spark, t.comparisons(F.col("a"), F.lit("accuracy")), a="LARGE outperforms SMALL in accuracy")
    assert [tuple(x) for x in r] == [("LARGE", "SMALL", "gt", "accuracy")]
    assert one(spark, t.comparisons(F.col("a"), F.lit("")), a="LARGE surpasses SMALL in accuracy") == []
    assert one(spark, t.comparisons(F.col("a"), F.lit("")), a="A1 ≥ B1")[0]["relation"] == "lt"
    assert one(spark, t.trend(F.col("a")), a="accuracy increases, then drops")["direction"] == "increase"


@pytest.mark.parametrize(("v", "want"), [([1, 2, 3, 4, 5, 6], "increase"), ([6, 5, 4], "decrease"), ([1, 9, 9.0, 9.1], "saturate"), ([1, 2, 1, 2], "stable"), ([5], "unknown")])
def test_direction(spark, v, want):
    assert spark.createDataFrame([([float(x) for x in v],)], "v array<double>").select(c.sequence_direction(F.col("v"))).first()[0] == want


def test_lexical(spark):
    a, b = F.lit("BERT reaches 85 accuracy"), F.lit("BERT gets 85 accuracy on GLUE")
    assert spark.range(1).select(c.lexical_parts(a, b)["f1"]).first()[0] == pytest.approx(0.6)
    assert spark.range(1).select(c.lexical_reward(c.lexical_parts(a, b), b)).first()[0] == 1.0
    assert spark.range(1).select(c.lexical_reward(c.lexical_parts(a, F.lit("")), F.lit(" "))).first()[0] == 0.0


def test_fusion(spark):
    assert spark.range(1).select(c.fused_reward({0: F.lit(1.0), 1: F.lit(-0.8), 2: F.lit(None).cast("double")})).first()[0] == pytest.approx(0.325)


def test_spanning_header(spark):
    html = "<table><tr><td rowspan=2>Model</td><td colspan=2>GLUE</td></tr><tr><td>Acc</td><td>AUC</td></tr><tr><td>A</td><td>1</td><td>2</td></tr></table>"
    got = ht.records_of(ht.table_rows(spark.createDataFrame([(1, html), (2, None), (3, "<p>x</p>")], "id int, html string"))).collect()
    assert [(r["entity"], r["metric"], r["value"]) for r in got] == [("A", "GLUE / Acc", 1.0), ("A", "GLUE / AUC", 2.0)]


def test_kappa_and_majority(spark):
    df = spark.createDataFrame([("C", "C"), ("C", "W"), ("W", "W"), ("W", "W")], "a string, b string")
    assert m.kappa(df, "a", "b").first()[0] == pytest.approx(0.5)
    assert m.kappa(df, "a", "a").first()[0] == 1.0
    assert m.kappa(df.limit(0), "a", "b").first()[0] == 0.0
    votes = spark.createDataFrame([(1, x) for x in (2, 0, 0, 2)], "k int, l int")
    assert m.majority(votes, "k", "l").first()["label"] == 0


def test_group_normalisation(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 0.0), (1, 0.0), (1, 0.0), (2, 0.3), (2, 0.3)], "g int, v double")
    got = sorted((r["g"], round(r["norm"], 4)) for r in s.normalise_groups(df, "g", "v").collect())
    assert got == [(1, -0.5773)] * 3 + [(1, 1.732)] + [(2, 0.0)] * 2


def test_perturbation_changes_numbers_only(spark):
    text = "It has 40 layers, 12.50 points and B2B in 1999."
    got = spark.createDataFrame([(text,), ("no number",), (None,)], "t string").select(s.perturb_numbers(F.col("t"), 0.2).alias("p")).collect()
    assert got[0]["p"] != text and "B2B" in got[0]["p"] and got[1]["p"] == "no number" and got[2]["p"] is None


def test_stream_ingest_and_running_average(spark, tmp_path):
    spark.createDataFrame(pd.DataFrame({"run": ["a", "a", "b"], "step": [1, 2, 1], "value": [1.0, -1.0, 0.5]})).write.parquet(f"{tmp_path}/in")
    st.ingest(spark, f"{tmp_path}/in", "run string, step long, value double", f"{tmp_path}/out", f"{tmp_path}/cp", "value > 0")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2 and spark.read.parquet(f"{tmp_path}/out-rejected").count() == 1
    stream = st.running_average(spark.readStream.schema("run string, step long, value double").parquet(f"{tmp_path}/in"))
    stream.writeStream.format("memory").queryName("ema").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["run"], r["step"], round(r["ema"], 6)) for r in spark.table("ema").collect()) == [("a", 1, 0.05), ("a", 2, -0.0025), ("b", 1, 0.025)]


def test_papers_without_claims_or_records_score_zero(spark):
    said = spark.createDataFrame([("a", 0, "SMALL achieves 5.0% recall on the benchmark suite."), ("b", 0, "Nothing of the kind."), ("c", 0, "SMALL achieves 5.0% recall on the benchmark suite.")], "paper_id string, claim_ord int, text string")
    records = spark.createDataFrame([(p, 0, 0, "SMALL", "recall", 50, 5.0, "small", "recall") for p in "ab"], "paper_id string, table_ord int, rec_ord int, entity string, metric string, tenths long, value double, entity_norm string, metric_norm string")
    got = {r["paper_id"]: tuple(round(r[x], 6) for x in ("claims", "base", "specificity", "coverage", "total")) for r in c.reward_by_paper(said, records).collect()}
    assert got == {"a": (1, 1.0, 0.05, 0.1, 1.15), "b": (0, 0, 0, 0, 0), "c": (1, 0, 0.05, 0, 0.05)}


def test_html_of_every_table(spark):
    sf = "/root/testdata/sf0.001"
    got = plans.t1_to_t9_html_tables(spark, sf).select("paper_id", "table_ord", "entity", "metric", "value").collect()
    names = {"accuracy": "Quality / accuracy", "recall": "Quality / recall", "latency": "Speed / latency"}
    want = [(r["paper_id"], r["table_ord"], r["entity"], names[r["metric"]], r["value"]) for r in fact_records(spark, sf).collect()]
    assert {r[1] for r in want} == {0, 1, 2} and sorted(map(tuple, got)) == sorted(want)


def test_running_average_rejects_late_steps(spark, tmp_path):
    schema = "run string, step long, value double"
    for k, rows in enumerate(([("r", 1, 1.0), ("r", 2, 2.0), ("r", 2, 3.0)], [("r", 1, 9.0), ("r", 3, 4.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        st.write_running_average(stream, f"{tmp_path}/out", f"{tmp_path}/check", 0.5)
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("step", "value").collect()
    assert [(r["step"], r["value"], r["ema"]) for r in got] == [(1, 1.0, 0.5), (2, 2.0, 1.25), (2, 3.0, 2.125), (3, 4.0, 3.0625)]
    assert [(r["step"], r["value"]) for r in spark.read.parquet(f"{tmp_path}/out-rejected").collect()] == [(1, 9.0)]
