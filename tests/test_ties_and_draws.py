"""Rows that an order leaves tied, draws from more rows than are drawn, and mixes that look at few texts."""

import time

import duckdb
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tests.compare import difference
from verisift.operators import construction as k
from verisift.operators import sampling as s
from verisift.plans import queries as plans


def test_tied_lines_in_a_table_of_parts(spark, tmp_path):
    """The larger parts are read first; of lines with one number the first in the table counts all the same."""
    t = pq.read_table("/root/testdata/sf0.001/lineitem.parquet")
    (folder := tmp_path / "lineitem.parquet").mkdir()
    cuts = [i * (i + 1) // 2 * t.num_rows // 36 for i in range(9)]
    for i in range(8):
        pq.write_table(t.slice(cuts[i], cuts[i + 1] - cuts[i]), f"{folder}/part-{i}.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/*.parquet'")
    assert con.execute("SELECT count(*) FROM lineitem").fetchone()[0] == t.num_rows
    for name in ("j1_build_index", "j1_index_counters"):
        assert difference(plans.QUERIES[name](spark, str(tmp_path)), con, plans.ORACLES[name]) is None


def test_draws_with_replacement_from_more_rows(spark, tmp_path):
    """The query draws 500,000 times from 500,001 documents: with replacement, as its SQL."""
    spark.range(500_001).select(F.col("id").alias("doc_id")).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = plans.QUERIES["s3_sample_with_replacement"](spark, str(tmp_path)).toArrow()
    want = con.sql(plans.ORACLES["s3_sample_with_replacement"]).to_arrow_table()
    assert got.select(want.column_names).sort_by("doc_id").to_pydict() == want.sort_by("doc_id").to_pydict()
    few = spark.range(5)
    assert k.sample_with_replacement(few, "id", 5, replace=True).count() == 5 == k.sample_with_replacement(few, "id", 9, replace=False).count()
    assert k.sample_with_replacement(few.limit(0), "id", 3, replace=True).count() == 0


def test_first_rows_that_pass(spark):
    """As if all rows were tested: with many that pass, few, none, fewer than wanted, null keys and equal ones."""
    df = spark.range(30_000).select(F.when(F.col("id") >= 3, F.col("id") - F.col("id") % 2).alias("id"), (F.col("id") % 7919).alias("x"))
    for n, test in ((5, "true"), (40, "x < 3000"), (3, "x = 17 or id is null"), (4, "x = 4001"), (6, "x < 0"), (0, "true"), (40_000, "x > 9")):
        passing = lambda rows, test=test: rows.where(test).withColumn("y", F.col("x") + 1)
        want = s.sample_exact(passing(df).orderBy("x"), "id", n, "z").select("id").collect()
        got = s.sample_passing(df, "id", n, passing, "z")
        assert sorted(map(str, want)) == sorted(map(str, got.select("id").collect())) and got.where("y <> x + 1").isEmpty(), test
    assert s.sample_passing(df.limit(0), "id", 5, lambda rows: rows).count() == 0


def test_mix_changes_few_texts(spark, monkeypatch):
    """A mix of some dozen rows from 40,000 changes the numbers of some hundreds, and draws the first rows of each order."""
    df = spark.range(40_000).select("id", F.concat(F.lit("row reaches "), F.col("id").cast("string"), F.lit(".5 points")).alias("t"))
    met = spark.sparkContext.accumulator(0)

    def changed(text, ratio, salt):
        def longer(t):
            met.add(1)
            return t.replace(".5", ".55")

        return F.udf(longer, "string")(text)

    monkeypatch.setattr(k, "perturb_numbers", changed)
    got = k.class_mix(df, "id", "t", 10, 6, {0.1: 4, 0.2: 3}).collect()
    assert 0 < met.value < 3000
    first = lambda n, salt: {r["id"] for r in s.sample_exact(df, "id", n, salt).collect()}
    ids = lambda *kind: {r["id"] for r in got if (r["label"], r["ratio"]) == kind}
    assert [ids(0, 0.0), ids(1, 0.0), ids(2, 0.1), ids(2, 0.2)] == [first(10, "entails"), first(6, "neutral"), first(4, "level0.1"), first(3, "level0.2")]
    assert sorted(r["place"] for r in got) == list(range(23))


def test_a_text_of_many_numbers(spark):
    """Which numbers change is worked out once a text, not again at each number."""
    text = " ".join(f"x {i % 2000}.25" for i in range(2500))
    began = time.time()
    p = spark.createDataFrame([(text,)], "t string").select(s.perturbation(F.col("t"), 0.2).alias("p")).first()["p"]
    assert time.time() - began < 30
    old, new = text.split(), p["text"].split()
    at = [i for i, (a, b) in enumerate(zip(old, new, strict=True)) if a != b]
    assert len(at) == 3 == p["num_changed"] and p["original"] == [float(old[i]) for i in reversed(at)] and p["changed"] == [float(new[i]) for i in reversed(at)]
