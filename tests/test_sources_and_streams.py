"""NPY data source, paged streams with offsets, bounded ingest under replay, counts as state."""

import json
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from verisift.sources.npy import NpyFile, read_npy, write_npy
from verisift.streaming import ingest as st
from verisift.streaming.paged import FolderListing, between, forward, read_paged, run_paged

SF = "/root/testdata/sf0.001"


@pytest.fixture
def features(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").withColumn("row", F.row_number().over(__import__("pyspark.sql").sql.Window.orderBy("vec_id")) - 1)
    split = F.when(F.col("row") < 30, "val").otherwise("train")
    numbered = rows.select(split.alias("split"), (F.col("row") - F.when(F.col("row") < 30, 0).otherwise(30)).alias("row"), F.col("embedding").alias("visual"), F.slice(F.reverse("embedding"), 1, 5).alias("text"), "label", (F.col("row") / 7).cast("float").alias("perturbation_ratio"))
    return numbered.repartition(7, "label").persist()


def arrays(df):
    rows = df.orderBy("row").collect()
    return [np.array([r[c] for r in rows]) for c in ("visual", "text", "label", "perturbation_ratio")]


def test_npy_there_and_back(spark, tmp_path, features):
    write_npy(features, str(tmp_path))
    for split in ("train", "val"):
        want = arrays(features.where(F.col("split") == split))
        for name, x in zip(("visual_features", "text_features", "labels", "perturbation_ratios"), want, strict=True):
            there = np.load(tmp_path / split / f"{name}.npy", mmap_mode="r")
            assert there.shape == x.shape and np.array_equal(there, x.astype(there.dtype))
        got = read_npy(spark, f"file://{tmp_path}", split, rows=16)
        assert {r["split"] for r in got.collect()} == {split} and all(np.array_equal(a, b) for a, b in zip(arrays(got), want, strict=True))
    whole = read_npy(spark, str(tmp_path), rows=16)
    n = features.count()
    assert whole.rdd.getNumPartitions() == -(-30 // 16) + -(-(n - 30) // 16) and read_npy(spark, str(tmp_path), "val", 16).rdd.getNumPartitions() == 2
    assert whole.where("split in ('val', 'other')").count() == 30 and read_npy(spark, str(tmp_path), "other").count() == 0 and whole.count() == n
    assert not [p for p in tmp_path.rglob("*") if p.is_file() and p.suffix != ".npy"]


def test_npy_without_ratios_and_other_types(spark, tmp_path):
    (tmp_path / "s").mkdir()
    x = np.arange(24, dtype=">f8").reshape(8, 3)
    np.save(tmp_path / "s/visual_features.npy", x)
    np.save(tmp_path / "s/text_features.npy", x[:, :0])
    np.save(tmp_path / "s/labels.npy", np.arange(8, dtype=np.uint8))
    (tmp_path / "notes").mkdir()
    rows = read_npy(spark, str(tmp_path), rows=3).orderBy("row").collect()
    assert [r["visual"] for r in rows] == x.tolist() and [(r["text"], r["label"], r["perturbation_ratio"]) for r in rows] == [([], i, 0.0) for i in range(8)]
    np.save(tmp_path / "s/labels.npy", np.zeros(0, np.int64))
    with pytest.raises(Exception, match="differ in length"):
        read_npy(spark, str(tmp_path)).count()
    np.save(tmp_path / "s/labels.npy", np.asfortranarray(np.zeros((8, 2))))
    with pytest.raises(ValueError, match="row by row"):
        NpyFile.open(str(tmp_path / "s/labels.npy"))


def test_npy_writes_all_or_nothing(spark, tmp_path, features):
    write_npy(features.where("split = 'val'"), str(tmp_path))
    before = arrays(read_npy(spark, str(tmp_path)))
    bad = [features, features.withColumn("row", F.col("row") + F.lit(1)).withColumn("split", F.lit("n")), features.withColumn("label", F.lit(None)).withColumn("split", F.lit("n")), features.withColumn("split", F.lit("../n")), features.withColumn("text", F.when(F.col("row") == 3, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>"))).where("split = 'train'")]
    for df in bad:
        with pytest.raises(Exception):
            write_npy(df, str(tmp_path))
        assert all(np.array_equal(a, b) for a, b in zip(arrays(read_npy(spark, str(tmp_path))), before, strict=True))
    assert not [p for p in tmp_path.rglob("*") if p.is_file() and p.suffix != ".npy"]
    write_npy(features.where("split = 'val' and row < 4").withColumn("perturbation_ratio", F.lit(None)), str(tmp_path), "overwrite")
    rows = read_npy(spark, str(tmp_path)).collect()
    assert len(rows) == 4 and {r["perturbation_ratio"] for r in rows} == {0.0}
    write_npy(features.limit(0), str(tmp_path / "empty"))
    assert read_npy(spark, str(tmp_path)).count() == 4


def listing(folder, pages, more=True):
    """Pages of items of three rows each."""
    for number, items in pages.items():
        for item in items:
            (folder / item).write_text("".join(f"{item} {i}\n" for i in range(3)))
        (folder / f"{number}.json").write_text(json.dumps({"items": items, "more": more}))


def test_offsets_of_a_listing(tmp_path):
    listing(tmp_path, {0: ["a", "b"], 1: [], 2: ["c", "d", "e"]})
    source, at, seen = FolderListing(str(tmp_path)), {"page": 0, "taken": 0}, []
    while True:
        end, items = forward(source, at, 2)
        assert between(source, at, end) == items and len(items) <= 2
        if end == at:
            break
        seen, at = seen + items, end
    assert seen == ["a", "b", "c", "d", "e"] == forward(source, {"page": 0, "taken": 0}, None)[1]
    listing(tmp_path, {3: ["f"]}, more=False)
    assert forward(source, at, 9) == ({"page": 3, "taken": 1}, ["f"])


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    listing(tmp_path, {0: ["a", "b", "c"], 1: ["d", "e"]})
    batches = []

    def put(rows, number):
        held = sorted(r["value"] for r in rows.collect())
        batches.append((number, held))
        if number == 1 and len([b for b in batches if b[0] == 1]) == 1:
            raise RuntimeError("killed")

    run = lambda: run_paged(spark, str(tmp_path), put, str(tmp_path / "cp"), items=2)
    with pytest.raises(Exception):
        run()
    run()
    assert [b[0] for b in batches] == [0, 1, 1, 2] and batches[1] == batches[2]
    assert sorted(sum((b[1] for b in batches if b is not batches[1]), [])) == sorted(f"{x} {i}" for x in "abcde" for i in range(3))
    listing(tmp_path, {2: ["f", "g", "h"]}, more=False)
    run()
    run()
    assert [(n, len(x)) for n, x in batches[4:]] == [(3, 6), (4, 3)]
    assert read_paged(spark, str(tmp_path)).count() == 24


def forget_commit(checkpoint, number):
    for name in (str(number), f".{number}.crc"):
        (checkpoint / "commits" / name).unlink(missing_ok=True)


def sunk(spark, tmp_path, key):
    return sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select(key).collect())


@pytest.mark.parametrize("limit", [5, 8, 100])
def test_bounded_ingest_under_replay(spark, tmp_path, limit):
    for i in range(4):
        spark.createDataFrame([(10 * i + k, k != 2) for k in range(4)], "id long, ok boolean").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    run = lambda most=limit: st.ingest_up_to(spark, str(tmp_path / "in/*"), "id long, ok boolean", str(tmp_path / "out"), str(tmp_path / "cp"), "ok", "id", most)
    want = min(limit, 12)
    assert run() == want
    rows = sunk(spark, tmp_path, "id")
    last = max(int(p.name) for p in (tmp_path / "cp/commits").iterdir() if p.name.isdigit())
    for _ in range(2):  # as after a crash before the commit; a limit that is not reached lets the batch run
        forget_commit(tmp_path / "cp", last)
        assert run() == want and sunk(spark, tmp_path, "id") == rows and len(set(rows)) == want
    counts = {r["batch"]: r for r in st.batch_counts(spark, str(tmp_path / "out")).collect()}
    assert sum(r["taken"] for r in counts.values()) == want and max(r["total"] for r in counts.values()) == want
    if limit == 100:
        assert sum(r["rejected"] for r in counts.values()) == 4 == st.ingest_counts(spark, str(tmp_path / "out")).first()["rejected"]
    more, now = run(limit + 3), sunk(spark, tmp_path, "id")
    assert more == len(set(now)) == len(now) == min(limit + 3, 12) and set(rows) <= set(now)


def test_replay_of_a_batch_in_the_middle(spark, tmp_path):
    """The batch that crosses the limit runs again after its rows were written and its commit was lost."""
    for i in range(3):
        spark.createDataFrame([(10 * i + k, True) for k in range(4)], "id long, ok boolean").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    put, count = st._bounded(str(tmp_path / "out"), "ok", ["id"], 6), lambda: len(sunk(spark, tmp_path, "id"))
    read = [spark.read.parquet(str(tmp_path / f"in/{i}")) for i in range(3)]
    for number in (0, 1, 1, 0, 1):
        put(read[number], number)
    with pytest.raises(st.LimitReached):
        put(read[2], 2)
    assert count() == 6 == st.taken_so_far(spark, str(tmp_path / "out"))


def test_listing_up_to_a_limit_over_restarts(spark, tmp_path):
    (tmp_path / "list").mkdir()
    listing(tmp_path / "list", {0: ["a", "b", "c"], 1: ["d", "e"]})
    run = lambda limit: st.ingest_listing(spark, str(tmp_path / "list"), str(tmp_path / "out"), str(tmp_path / "cp"), "value not like '% 1'", limit, items=1)
    assert run(7) == 7 and sunk(spark, tmp_path, "value") == ["a 0", "a 2", "b 0", "b 2", "c 0", "c 2", "d 0"]
    shutil.rmtree(tmp_path / "list")  # a run at its limit reads nothing
    assert run(7) == 7


def test_count_as_state_fires_once(spark, tmp_path):
    ran = []
    save = lambda i: spark.range(4).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))

    def run(stage=lambda: ran.append(1)):
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        st.once_reached(stream, 10, stage, str(tmp_path / "marker"), str(tmp_path / "cp"))

    save(0), save(1)
    run()
    assert not ran and not (tmp_path / "marker").exists()
    save(2)

    def fail():
        raise RuntimeError("stage failed")

    with pytest.raises(Exception):
        run(fail)
    run()
    assert ran == [1] and (tmp_path / "marker").exists()
    save(3)
    run()
    assert ran == [1]


def test_progress_is_said(spark, tmp_path):
    said, listener = [], None
    for i in range(3):
        spark.range(40).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    listener = st.Progress(50, said.append)
    spark.streams.addListener(listener)
    try:
        st.ingest(spark, str(tmp_path / "in/*"), "id long", str(tmp_path / "out"), str(tmp_path / "cp"), "id >= 0", files_per_trigger=1)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for _ in range(100):
            if len(said) >= 2:
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert len(said) == 2 and "80 rows" in said[0] and "120 rows" in said[1]
