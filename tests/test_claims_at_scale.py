"""Lookup by the index of pieces and coverage by parts, against every pair of names."""

import random
import time

import pytest
from pyspark.sql import functions as F

from verisift.operators.claims import covered_share, fuzzy_lookup, near_names, touched_names

RECORDS = "paper_id string, table_ord int, rec_ord int, entity_norm string, metric_norm string, value double, `a.b` string, _rank int, key long"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def alike(a, b):
    n = max(len(a), len(b))
    return 1.0 if not n else 0.0 if not min(len(a), len(b)) else 1 - edits(a, b) / n


def changed(g, name, letters):
    for _ in range(g.randrange(0, max(2, len(name) // 2))):
        p = g.randrange(len(name) + 1)
        name = g.choice([name[:p] + g.choice(letters) + name[p:], name[:p] + name[p + 1 :], name[: max(0, p - 1)] + g.choice(letters) + name[p:]])
    return name


@pytest.fixture(scope="module")
def names():
    g = random.Random(11)
    base = ["".join(g.choices("abcde", k=g.choice([0, 1, 2, 3, 4, 5, 7, 9, 12, 15, 16, 17, 23, 31, 33, 40, 70]))) for _ in range(60)]
    return base, [changed(g, b, "abcde") for b in base] + ["", "x"]


@pytest.mark.parametrize("least", [1.0, 0.85, 4 / 7, 3 / 7, 0.1, 0.0, -0.2])
def test_near_names_miss_no_pair(spark, names, least):
    known, asked = names
    pairs = {(a, b) for a in set(asked) for b in set(known) if alike(a, b) >= least - 1e-9}
    probe = spark.createDataFrame([(p, a) for p in ("p", "q") for a in set(asked)], "paper_id string, probe_entity string")
    got = near_names(probe, spark.createDataFrame([("p", b) for b in set(known)], "paper_id string, entity_norm string"), least).collect()
    assert {r["paper_id"] for r in got} <= {"p"} and {(r["probe_entity"], r["entity_norm"]) for r in got} == pairs and len(got) == len(pairs)


@pytest.mark.parametrize("threshold", [0.7, 0.6, 0.95])
def test_lookup_finds_the_best_record_of_each_table(spark, names, threshold):
    g = random.Random(4)
    known, asked = names
    records = [(p, g.randrange(3), i, g.choice(known), g.choice(["f1", "recall", "", "precision"]), float(i)) for p in ("p", "q") for i in range(150)]
    records += [("p", 0, 900, None, "f1", 1.0), ("p", 0, 901, "abc", None, 1.0), (None, 0, 902, "abc", "f1", 1.0)]
    probes = [(p, a, g.choice(["f1", "", "recal"])) for p in ("p", "q", "r") for a in asked] + [("p", None, "f1"), ("p", "abc", None), (None, "abc", "f1"), ("p", "abcde", "f1"), ("p", "abcde", "f1")]
    want = {}
    for p, a, m in probes:
        for q, table, i, e, n, value in records:
            if None in (p, a, m, e, n) or p != q:
                continue
            score = alike(a, e) * 0.7 + (0.5 if m == "" else alike(m, n)) * 0.3
            best = want.get((p, a, m, table))
            if score >= threshold and (best is None or (-score, i) < (-best[1], best[0])):
                want[p, a, m, table] = (i, score, value)
    df = spark.createDataFrame([(*r, "x", 7, 8) for r in records], RECORDS).repartition(5)
    out = fuzzy_lookup(spark.createDataFrame(probes, "paper_id string, probe_entity string, probe_metric string"), df, threshold)
    got = {(r["paper_id"], r["probe_entity"], r["probe_metric"], r["table_ord"]): (r["rec_ord"], r["score"], r["value"]) for r in out.collect()}
    assert got.keys() == want.keys() and all(got[k][::2] == want[k][::2] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)
    assert set(df.columns) <= set(out.columns) and fuzzy_lookup(spark.createDataFrame([], "paper_id string, probe_entity string, probe_metric string"), df.limit(0)).count() == 0


def test_lookup_in_a_paper_of_many_records(spark):
    """20,000 records of one paper and as many probes: 400 million pairs of names if each met each."""
    n = 20_000
    name = F.substr(F.md5(F.concat(F.col("id").cast("string"), F.lit("n"))), F.lit(1), F.lit(14))
    records = spark.range(n).select(F.lit("p").alias("paper_id"), (F.col("id") % 3).cast("int").alias("table_ord"), F.col("id").cast("int").alias("rec_ord"), name.alias("entity_norm"), F.lit("f1").alias("metric_norm"), F.col("id").cast("double").alias("value"))
    probes = records.select("paper_id", F.concat(F.substr("entity_norm", F.lit(1), F.lit(12)), F.lit("zz")).alias("probe_entity"), F.col("metric_norm").alias("probe_metric"), "rec_ord")
    began = time.time()
    met = near_names(probes.select("paper_id", "probe_entity").distinct(), records.select("paper_id", "entity_norm").distinct(), 0.75)
    assert met.where("substr(probe_entity, 1, 12) = substr(entity_norm, 1, 12)").count() == n
    best = fuzzy_lookup(probes, records, 0.85).join(probes.select("probe_entity", F.col("rec_ord").alias("own")), "probe_entity")
    assert best.where("rec_ord = own").count() == n and time.time() - began < 240


def test_touched_names(spark, names):
    known, asked = names
    want = {b for b in known if any(a in b or b in a for a in asked)}
    df = lambda values: spark.createDataFrame([("p", v) for v in values] + [("p", None), (None, "abc")], "paper_id string, name string")
    got = [r["name"] for r in touched_names(df(asked), df(known)).collect()]
    assert set(got) == want and len(got) == len(want)
    assert touched_names(df([]).where("paper_id is not null"), df(known)).count() == 0


def test_coverage_with_many_names(spark):
    """10,000 claimed names against 10,000 record names of one paper, a third of the records under one name."""
    names = spark.range(10_000).select(F.lit("p").alias("paper_id"), F.concat(F.lit("m"), F.md5(F.col("id").cast("string"))).alias("name"))
    claimed = names.where("conv(substr(name, 2, 1), 16, 10) < 8").select("paper_id", F.expr("substr(name, 3, 20)").alias("name"))
    records = names.select("paper_id", F.lit(0).alias("table_ord"), F.monotonically_increasing_id().alias("rec_ord"), F.col("name").alias("entity_norm"))
    hot = spark.range(5000).select(F.lit("p").alias("paper_id"), F.lit(1).alias("table_ord"), F.col("id").alias("rec_ord"), F.lit("nothing").alias("entity_norm"))
    share = covered_share(claimed, records.union(hot)).collect()
    assert [r["paper_id"] for r in share] == ["p"] and abs(share[0]["covered"] - claimed.count() / 15_000) < 1e-9
