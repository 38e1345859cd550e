"""Operators that SQL can't hold to account: numbering at size, perturbations, guards, result files, polling, calls, chains."""

import hashlib
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from verisift.operators import construction as k
from verisift.operators import layers as ly
from verisift.operators import sampling as s
from verisift.sources import files as f
from verisift.streaming import ingest as st


@pytest.mark.parametrize("partitions", [1, 7])
def test_places_of_many_rows(spark, partitions):
    n = 3_000_000
    rows, total = s.numbered(spark.range(n, numPartitions=partitions), "id")
    a = rows.agg(F.count("*").alias("n"), F.count_distinct("place").alias("d"), F.min("place").alias("lo"), F.max("place").alias("hi")).first()
    assert (total, a["n"], a["d"], a["lo"], a["hi"]) == (n, n, n, 0, n - 1)


def test_pairs_of_many_rows(spark):
    n = 3_000_000
    a = s.mispair(spark.range(n).withColumn("t", F.col("id")), "id", "t").agg(F.count("*").alias("n"), F.count_distinct("other_id").alias("d"), F.count_if(F.col("id") == F.col("other_id")).alias("own")).first()
    assert (a["n"], a["d"], a["own"]) == (n, n, 0)


def test_split_of_few_and_no_rows(spark):
    assert s.split_train_val(spark.range(0), "id").count() == 0
    assert [r["split"] for r in s.split_train_val(spark.range(1), "id").collect()] == ["val"]
    rows = s.split_train_val(spark.range(1000), "id", 0.1).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in rows} == {"val": 100, "train": 900}


def test_least_validation_rows_and_null_strata(spark):
    df = spark.range(300).select("id", F.when(F.col("id") < 200, "a").when(F.col("id") < 290, "b").alias("x"))
    least = F.when(F.col("x") == "b", 20).otherwise(0)
    got = {(r["x"], r["split"]): r["count"] for r in s.stratified_split(df, ["x"], "id", least=least).groupBy("x", "split").count().collect()}
    assert got == {("a", "val"): 20, ("a", "train"): 180, ("b", "val"): 20, ("b", "train"): 70, (None, "val"): 1, (None, "train"): 9}


def test_running_baseline_by_plain_python(spark):
    rows = [("a", i, float(i % 7)) for i in range(-3000, 2500)] + [("b", 10_000 * i, float(i)) for i in range(9)] + [("b", None, 2.0), (None, 5, 1.0), (None, 3, 4.0), ("", 1, 8.0), ("c", 1, None), ("c", 2, 3.0), ("c", 1025, None), ("c", 3000, 1.0), ("c", 3000, 1.0)]
    want, state = [], {}
    for run, step, value in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] is not None, r[2] or 0)):
        if value is not None:
            state[run] = state.get(run, 0.0) * 0.95 + value * 0.05
        want.append((run, step, value, None if value is None else round(state[run], 9)))
    got = s.running_baseline(spark.createDataFrame(rows, "run string, step long, value double").repartition(5), "run", "step", "value").collect()
    order = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in (str(r[0]), *r[1:]))
    assert sorted(((r[0], r[1], r[2], None if r[3] is None else round(r[3], 9)) for r in got), key=order) == sorted(want, key=order)
    assert s.running_baseline(spark.createDataFrame([], "run string, step long, value double"), "run", "step", "value").count() == 0


def test_quotas_and_copies_by_rank(spark):
    """Against ranks over whole classes, with quotas above a class, of 0 and in the middle of an interval."""
    df = spark.range(5000).select("id", F.when(F.col("id") < 3500, "a").when(F.col("id") < 4900, "b").when(F.col("id") < 4990, "c").alias("x"))
    ranked = s.rank_within(df, ["x"], "id").collect()
    quotas = {"a": 777, "b": 5000, "c": 0, "none": 3}
    assert sorted((r["id"], r["x"]) for r in s.quota_sample(df, "x", quotas, "id").collect()) == sorted((r["id"], r["x"]) for r in ranked if r["x"] and r["rank"] <= quotas[r["x"]])
    n = {"a": 3500, "b": 1400, "c": 90}
    for factors in (None, {"b": 1.5, "c": 0.5}):
        want = sorted((r["id"], k) for r in ranked if r["x"] for k in range(1, 1 + -(-(int(3500 * max(1.0, (factors or {}).get(r["x"], 1.0))) - r["rank"] + 1) // n[r["x"]])))
        assert sorted((r["id"], r["copy"]) for r in s.oversample(df, "x", "id", factors).collect()) == want


def test_perturbation_by_plain_python(spark):
    texts = ["In 1999 we saw 12 of 40 birds and 3.50 of 9000 nests, x7 and 7x stay", "none", "", None, "5"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", s.perturbation(F.col("t"), 0.2).alias("p")).collect()
    for r in rows:
        if r["t"] is None:
            assert r["p"]["text"] is None
            continue
        number = r"(?<![\w.])\d+(?:\.\d+)?(?![\w.]*\w)"
        found = list(re.finditer(number, r["t"]))
        h = lambda i, salt: int(hashlib.md5(f"{r['t']}42{salt}{i}".encode()).hexdigest()[:8], 16) / 2**32  # noqa: B023, E731
        ok = [i for i, x in enumerate(found) if float(x[0]) < 2100]
        chosen = sorted(sorted(ok, key=lambda i: h(i, "pick"))[:3], reverse=True)
        text, old, new = r["t"], [], []
        for i in chosen:
            x = found[i]
            v = float(x[0]) * (1 + (-1 if h(i, "sign") < 0.5 else 1) * 0.2 * (0.5 + h(i, "size")))
            said = str(round(v)) if "." not in x[0] else re.match(r"-?\d+\.\d+?(?=0*$)", f"{v:.10f}")[0]
            text = text[: x.start()] + said + text[x.end() :]
            old, new = [*old, float(x[0])], [*new, float(said)]
        assert (r["p"]["text"], r["p"]["original"], r["p"]["changed"], r["p"]["num_changed"]) == (text, old, new, len(chosen))


def test_class_plan():
    assert k.class_counts(101, (0.4, 0.3, 0.3)) == (40, 30, 31)
    assert k.level_reserve([0.05, 0.1], 0.9, 3) == {0.05: 34, 0.1: 34}
    assert k.level_plan(71, [0.05, 0.1], 0.9, 3) == {0.05: 36, 0.1: 35}
    with pytest.raises(ValueError):
        k.level_plan(10, [0.05], 0.9, 3)


def test_png_guard(spark):
    png = lambda w, h: b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h)
    rows = [("a", 10, png(20_000, 10_000)), ("b", 10, png(4096, 1024)), ("c", 10, b"jpeg"), ("d", None, None), ("e", 0, b""), ("f", 1 << 30, png(1, 1))]
    df = spark.createDataFrame(rows, "path string, length long, content binary")
    assert [r["reason"] for r in k.image_status(df).orderBy("path").collect()] == ["too_many_pixels", "ok", "ok", "missing", "empty", "too_many_bytes"]
    size = k.png_size(F.col("content"))
    small = k.shrunk(size["width"], size["height"])
    assert [tuple(r["s"]) for r in df.where("path = 'b'").select(small.alias("s")).collect()] == [(2048, 512)]


def test_features_weights_and_settings(spark, tmp_path):
    df = spark.createDataFrame([("train", [1.0], [2.0], 1, 0.5), ("val", [3.0], [4.0], 2, None)], "split string, visual array<float>, text array<float>, label int, perturbation_ratio double")
    f.write_features(df, f"{tmp_path}/x")
    assert [r["perturbation_ratio"] for r in f.read_features(spark, f"{tmp_path}/x", "val").collect()] == [0.0]
    w = {"a": np.arange(6.0).reshape(2, 3), "b": np.ones((1, 1))}
    f.write_weights(spark, w, f"{tmp_path}/w")
    assert all(np.array_equal(v, w[n]) for n, v in f.read_weights(spark, f"{tmp_path}/w").items())
    assert f.Settings().overridden("run.gate=0.5", "--clip=false", "limit=3") == f.Settings(gate=0.5, clip=False, limit=3)
    with pytest.raises(ValueError):
        f.Settings().overridden("x=1")


def test_results_go_on_where_they_stopped(spark, tmp_path):
    path, schema = f"{tmp_path}/out", "id long, said string"
    work = spark.range(4)
    process = lambda d: d.withColumn("said", F.lit("x"))
    f.append_results(work.where("id < 2"), "id", process, path, schema)
    (tmp_path / "out" / "torn.json").write_text('{"id": 3, "sa')
    f.append_results(work, "id", process, path, schema)
    assert sorted(r["id"] for r in f.finished(spark, path, schema).collect()) == [0, 1, 2, 3]


def test_three_way_sink(spark, tmp_path):
    f.write_three_way(spark.createDataFrame([(1, "a"), (2, None), (3, "")], "id int, p string"), "p <> ''", f"{tmp_path}/s")
    count = lambda name: spark.read.json(f"{tmp_path}/s/{name}").count()
    assert (count("manifest"), count("missing")) == (1, 2) and spark.read.json(f"{tmp_path}/s/meta").first().asDict() == {"rows": 3, "usable": 1, "missing": 2}


def test_bounded_stream(spark, tmp_path):
    spark.range(30).select("id", (F.col("id") % 3 > 0).alias("ok")).repartition(5).write.parquet(f"{tmp_path}/in")
    taken = st.ingest_up_to(spark, f"{tmp_path}/in", "id long, ok boolean", f"{tmp_path}/out", f"{tmp_path}/cp", "ok", "id", 12)
    assert taken == 12 == spark.read.parquet(f"{tmp_path}/out").count()
    counts = st.ingest_counts(spark, f"{tmp_path}/out").first()
    assert counts["taken"] == 12 and counts["rejected"] <= 10


def test_polling_calls_and_chain(spark, tmp_path):
    seen, marks = iter([1, 5, 9]), []
    assert st.when_reached(lambda: next(seen), 9, lambda: marks.append("ran"), lambda: "mark" in marks, lambda: marks.append("mark"), 0)
    assert marks == ["ran", "mark"] and st.when_reached(lambda: 0, 9, lambda: marks.append("again"), lambda: True, lambda: None, 0)
    assert not st.when_reached(lambda: 0, 9, lambda: None, lambda: False, lambda: None, 0, 2)
    folder = str(tmp_path)

    def call(text):  # the second try of `late` is good
        import os

        path = f"{folder}/{text}"
        tries = os.path.getsize(path) if os.path.exists(path) else 0
        with open(path, "a") as out:
            out.write("x")
        if text == "bad" or (text == "late" and not tries):
            raise OSError
        return "" if text == "mute" else text

    df = spark.createDataFrame([(1, "fine"), (2, "late"), (3, "bad"), (4, "mute")], "id int, prompt string")
    got = {r["id"]: (r["reply"], r["attempts"], r["error"]) for r in st.called(df, "id", "prompt", call, wait_s=0.0).collect()}
    assert got == {1: ("fine", 1, None), 2: ("late", 2, None), 3: (None, 3, "OSError"), 4: (None, 3, "bad reply")}
    done = []
    with pytest.raises(ZeroDivisionError):
        st.run_stages([("a", lambda: done.append("a")), ("b", lambda: 1 / 0), ("c", lambda: done.append("c"))], lambda _: None)
    assert done == ["a"]


def test_trend_by_column(spark):
    records = spark.createDataFrame([("p", 0, i, m, v) for i, (m, v) in enumerate([("loss", 5.0), ("recall", 1.0), ("recall", 2.0), ("recall", 3.0), ("loss", 4.0)])], "paper_id string, table_ord int, rec_ord int, metric_norm string, value double")
    claims = spark.createDataFrame([("p", 0, "increase", ["Recall"]), ("p", 1, "decrease", ["loss"]), ("p", 2, "increase", []), ("q", 3, "increase", [])], "paper_id string, claim_ord int, direction string, metrics array<string>").withColumn("trend", F.struct("direction"))
    got = {r["claim_ord"]: (r["reward"], r["confidence"]) for r in ly.verify_trends(claims, records, by_column=True).collect()}
    assert got == {0: (0.8, 0.75), 1: (0.8, 0.75), 2: (-0.8, 0.75), 3: (0.0, 0.0)}


def test_head_inference_of_no_rows(spark, tmp_path):
    from verisift.plans.responses import v14_head_inference

    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert v14_head_inference(spark, str(tmp_path)).count() == 0
