"""File sources and sinks, data-set construction, judges and the trained head on small cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from verisift.operators import construction as k
from verisift.operators import responses as r
from verisift.plans.responses import example_weights
from verisift.sources import files


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "ü"}\n\n{"id": \n{"id": 2}\n')
    got = files.read_json_lines(spark, f"{tmp_path}/a.jsonl", "id long, t string").collect()
    assert [(x["id"], x["t"], x["_corrupt"] is None) for x in got] == [(1, "ü", True), (None, None, False), (2, None, True)]


def test_json_files(spark, tmp_path):
    for name, text in {"p.1": '{\n "id":\n 1}\n', "bad": '{"id": ', "q": '{"id": 2}'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    (tmp_path / "other.txt").write_text("x")
    got = {x["name"]: x["doc"] and x["doc"]["id"] for x in files.read_json_files(spark, str(tmp_path), "id long").collect()}
    assert got == {"p.1": 1, "bad": None, "q": 2}


def test_csv_with_mark_and_blanks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffid , score\n a1 , 0.5\nb, x\n", encoding="utf-8")
    got = files.read_csv(spark, f"{tmp_path}/a.csv", "id string, score double, more int").collect()
    assert [tuple(x) for x in got] == [("a1", 0.5, None), ("b", None, None)]


def test_bounded_scans(spark):
    df = spark.range(10)
    assert [x["id"] for x in files.first_accepted(df, "id % 3 = 0", "id", 2).collect()] == [0, 3]
    assert sorted(x["id"] for x in files.within_first(df, "id", 5, "id % 3 = 0").collect()) == [0, 3]
    assert files.within_first(df, "id", 0, "id % 3 = 0").count() == 4


def test_sinks_and_cache(spark, tmp_path):
    df = spark.range(25).withColumn("split", F.when(F.col("id") < 5, "val").otherwise("train"))
    files.write_splits(df, "split", f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s/split=val").count() == 5
    files.write_shards(df, "id", f"{tmp_path}/x", 10)
    assert spark.read.parquet(f"{tmp_path}/x/shard=2").count() == 5
    files.write_report(df.groupBy().count(), f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").first()["count"] == 25
    files.write_json_lines(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 25
    built = []
    make = lambda: built.append(1) or df
    assert [files.cached(spark, f"{tmp_path}/c", make).count() for _ in range(2)] == [25, 25] and len(built) == 1


def test_draws_with_replacement(spark):
    df = spark.range(5)
    many = k.sample_with_replacement(df, "id", 40).collect()
    assert sorted(x["draw"] for x in many) == list(range(40)) and {x["id"] for x in many} <= set(range(5))
    few = [x["id"] for x in k.sample_with_replacement(df, "id", 3).collect()]
    assert len(set(few)) == 3
    assert k.sample_with_replacement(df.limit(0), "id", 3).count() == 0


def test_priority_waterfall(spark):
    df = spark.createDataFrame([(i, "a" if i < 50 else "b" if i < 54 else None) for i in range(100)], "id int, kind string")
    got = k.priority_sample(df, "kind", "id", 30, ("b", "a", "none"), 5).groupBy("kind").count().collect()
    n = {x["kind"]: x["count"] for x in got}
    assert sum(n.values()) == 30 and n["b"] == 4 and n["a"] >= 8
    assert k.priority_sample(df, "kind", "id", 100, ("a",)).count() == 100
    assert k.priority_sample(df, "kind", "id", 7, ("zz",)).count() == 7
    # the floor never exceeds what is asked for
    assert k.priority_sample(df, "kind", "id", 10, ("a",), 500).count() == 10


def test_class_mix(spark):
    df = spark.createDataFrame([(i, f"row {i} reaches {20 + i}.5 points") for i in range(60)], "id int, t string")
    got = k.class_mix(df, "id", "t", 10, 6, k.level_counts(10, {0.1: 0.5, 0.2: 0.5})).collect()
    assert sorted((x["label"], x["ratio"]) for x in got) == [(0, 0.0)] * 10 + [(1, 0.0)] * 6 + [(2, 0.1)] * 5 + [(2, 0.2)] * 5
    own = {i: f"row {i} reaches {20 + i}.5 points" for i in range(60)}
    assert all((x["t"] == own[x["id"]]) == (x["label"] == 0) for x in got)
    with pytest.raises(ValueError):
        k.class_mix(df, "id", "t", 100, 1, {})


def test_image_guard(spark):
    df = spark.createDataFrame([("a", 0), ("b", 10), ("c", 99), ("d", None)], "path string, length long")
    assert [x["reason"] for x in k.image_status(df, 50).orderBy("path").collect()] == ["empty", "ok", "too_many_bytes", "missing"]


@pytest.mark.parametrize(("raw", "want"), [('{"score": 7}', 7), ('{"score": 7.9}', 7), ('x ```json\n{"score": 3}\n``` y', 3), ("{}", 5), ("12 of 20", 10), ("none", 5), ("", 5), ("```\n{\"score\": 2}", 2)])
def test_judge_score(spark, raw, want):
    assert value(spark, r.judge_score, raw) == want


def test_small_texts(spark):
    assert value(spark, r.light_claims, "Accuracy is higher here. Short. Nothing of note to see") == ["Accuracy is higher here"]
    assert value(spark, r.light_claims, "nothing of note to see\nshort\nand another plain line") == ["nothing of note to see", "and another plain line"]
    assert value(spark, r.bracketed, "a [1, [2]] b") == "[1, [2]]" and value(spark, r.bracketed, "none") is None
    assert value(spark, r.without_latex_noise, "a  \\textbf{b}\n italic_ c") == "a b c"
    assert value(spark, r.has_numeric_evidence, "1 and -2.5") and not value(spark, r.has_numeric_evidence, "only 1")
    assert value(spark, lambda t: r.surface_reward(t, F.lit("Alpha beta")), "alpha BETA a") == pytest.approx(1.5)
    assert value(spark, lambda t: r.surface_reward(t, F.lit("Alpha beta")), None) == 0.0
    assert value(spark, r.aspect_reward, "bad") == pytest.approx(0.0)


def test_policy_reward(spark):
    df = spark.createDataFrame([("a", 0, 0.1, 2, True, True), ("a", 2, 0.7, 2, True, True), ("b", None, None, 1, False, False)], "k string, l int, p double, c int, s boolean, e boolean")
    got = {x["k"]: (x["claims"], x["reward"]) for x in r.policy_reward(df, "k", "l", "p", "c", "s", "e", 0.4, 0.3, 0.2, 0.25, 0.15).collect()}
    assert got["b"] == (0, -0.3)
    assert got["a"] == (2, pytest.approx(0.25 + 0.3 + 0.2 + 0.08 - 0.15 + 0.15))


def test_head(spark):
    g, w = np.random.default_rng(1), example_weights(4, 3)
    rows = [(i, g.normal(size=4).tolist(), g.normal(size=4).tolist()) for i in range(20)] + [(20, None, [0.0] * 4)]
    got = {x["i"]: x["head"] for x in r.head_inference(spark.createDataFrame(rows, "i int, a array<double>, b array<double>"), "a", "b", w).collect()}
    gelu = lambda x: [v / 2 * (1 + math.erf(v / math.sqrt(2))) for v in x]
    lin = lambda x, m: [sum(x[j] * m[j][o] for j in range(len(x))) + m[-1][o] for o in range(len(m[0]))]
    for i, a, b in rows[:20]:
        v, s = lin(gelu(lin(a, w["v1"])), w["v2"]), lin(gelu(lin(b, w["t1"])), w["t2"])
        z = lin(gelu(lin(v + s + [abs(x - y) for x, y in zip(v, s, strict=True)], w["c1"])), w["c2"])
        e = [math.exp(x) for x in z]
        p = [x / sum(e) for x in e]
        best = p.index(max(p))
        assert got[i]["label"] == best and got[i]["probs"] == pytest.approx(p) and got[i]["reward"] == pytest.approx((1.0, 0.0, -0.8)[best] * p[best])
    assert got[20] is None
    with pytest.raises(ValueError):
        r.head_inference(spark.range(1), "id", "id", w, most_mb=0)
