"""Runs, keys and classes that may hold a third of all rows, against plain Python."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from verisift.operators import construction as k
from verisift.operators import metrics as m
from verisift.operators import sampling as s


def test_running_baseline_of_a_dense_run(spark):
    """A million steps of one run: the average of the last ones is that of a plain loop."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("hot").alias("run"), F.col("id").alias("step"), (F.col("id") % 1000 / 7).alias("value"))
    began = time.time()
    got = {r["step"]: r["ema"] for r in s.running_baseline(df, "run", "step", "value").where("step % 99991 = 0 or step > 999990").collect()}
    assert time.time() - began < 60
    state = 0.0
    for i in range(n):
        state = state * 0.95 + (i % 1000 / 7) * 0.05
        if i in got:
            assert math.isclose(got[i], state, rel_tol=1e-9, abs_tol=1e-12), i
    assert len(got) == 20


def stopped(rows, patience):
    best, since, stop, at = None, 0, None, None
    for step, score in rows:
        if score is None:
            continue
        if best is None or score > best:
            best, since, at = score, 0, step
        else:
            since += 1
            if since >= patience and stop is None:
                stop = step
    return stop, at


@pytest.mark.parametrize("block", [1, 4, 1 << 14])
def test_early_stop_by_plain_python(spark, block):
    g = random.Random(2)
    runs = {r: [(i, None if g.random() < 0.1 else float(g.randrange(20)) + (i / 3 if r == "up" else 0)) for i in range(-7, 60)] for r in ("a", "b", "up", "", None)}
    runs["none"], runs["one"] = [(1, None)], [(5, 2.0)]
    rows = [(r, i, x, 1) for r, steps in runs.items() for i, x in steps]
    df = spark.createDataFrame(rows, "run string, step int, score double, _at int").repartition(6)
    for patience in (1, 3):
        got = {r["run"]: (r["stop_step"], r["best_step"]) for r in s.early_stop(df, "run", "step", "score", patience, block).collect()}
        assert got == {r: stopped(steps, patience) for r, steps in runs.items() if r != "none"}
    assert s.early_stop(df.limit(0), "run", "step", "score", 3).count() == 0


def middle(values):
    v = sorted(values)
    return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2


def test_exact_medians(spark):
    g = random.Random(9)
    groups = {"even": [g.gauss(0, 1) for _ in range(40_000)], "odd": [g.expovariate(1) for _ in range(39_999)], "ties": [1.0] * 7000 + [2.0] * 7000, "two": [3.0, 8.0], "one": [5.0], None: [1.0, 2.0, 4.0], "skew": [0.0] * 5000 + [1.0] * 5001 + [9.0]}
    rows = [(key, x) for key, v in groups.items() for x in v] + [("none", None), ("one", None)]
    df = spark.createDataFrame(rows, "key string, value double").repartition(9)
    got = {r["key"]: r for r in m.reward_summary(df, "key", "value").collect()}
    assert {key: r["median"] for key, r in got.items()} == {key: middle(v) for key, v in groups.items()} | {"none": None}
    assert got["one"]["n"] == 2 and m.reward_summary(df.limit(0), "key", "value").count() == 0


def test_median_of_one_hot_key(spark):
    n = 300_001
    df = spark.range(n).select(F.lit(1).alias("key"), (F.pmod(F.xxhash64("id"), F.lit(10**12)) / 10**6).alias("value"))
    want = sorted(r["value"] for r in df.select("value").collect())[n // 2]
    assert m.exact_medians(df, "key", "value").collect()[0]["median"] == want


def test_kinds_and_classes_of_a_third_of_all_rows(spark):
    """Drawn rows are those of a plain rank over whole kinds."""
    df = spark.range(9000).select("id", F.when(F.col("id") < 3000, "hot").when(F.col("id") < 3050, "few").when(F.col("id") < 8000, "rest").alias("kind"))
    h = {r["id"]: r["h"] for r in df.select("id", s.hashed_rank(F.col("id"), "42").alias("h")).collect()}
    order = lambda ids: sorted(ids, key=lambda i: (h[i], i))
    got = {r["id"] for r in k.priority_sample(df, "kind", "id", 1000, ("few", "hot"), 20).collect()}
    named = set(order(range(3000, 3050))) | set(order(range(3000))[: (1000 - 50) // 3])
    assert got == named | set(order(set(range(9000)) - named)[: 1000 - len(named)])
    e = spark.range(6000).select("id", (F.col("id") % 3).cast("int").alias("label"), (F.col("id") % 7 / 100.0).alias("ratio"))
    got = {r["id"] for r in k.coverage_set(e, "id", "label", "ratio", 5, 2, 4, (0.01, 0.02, 0.05)).collect()}
    sure = {i for c in range(3) for i in order(range(c, 6000, 3))[:5]} | {i for p in (1, 2, 5) for i in order(i for i in range(2, 6000, 3) if i % 7 == p)[:2]}
    assert got == sure | set(order(set(range(6000)) - sure)[:4])
