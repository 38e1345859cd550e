"""Stages over tables with any column names; slots, template classes and joins that must not depend on how things are planned."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from verisift.llm.decontamination import drop_contaminated, find_contamination
from verisift.llm import ngram_join
from verisift.llm.ngram_join import connected_components, jaccard_components, keep_one_per_component
from verisift.llm.sharding import shard_by_bytes
from verisift.llm.substring_dedup import keep_first_spans
from verisift.llm.toxicity import drop_toxic

#: Names that helpers have borne, and such as need quoting.
NAMES = ("_id", "_row", "_place", "_", "a.b", "n", "key", "place", "row_hash", "bad_id", "bad_row", "rest", "c0", "none", "g", "class", "offset", "digest", "ti`ck", "n_removed", "kept_text", "component_id")
ITEM = "The train from Paris left at 9 and travelled 120 km before it stopped near the old stone bridge by the river"


@pytest.fixture(scope="module")
def named(spark):
    words = " ".join(f"w{i}" for i in range(40))
    texts = [(1, words), (2, words + " more"), (3, ITEM), (4, None), (5, ""), (5, "other words"), (5, "other words"), (None, "lonely text"), (None, None)]
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in texts], "doc_id long, text string, n_chars int")
    return df.select("doc_id", *[F.concat(F.lit(c + "="), F.coalesce("text", F.lit("-"))).alias(c) for c in NAMES], "text", "n_chars")


def stages(spark):
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string").withColumns({"_id": F.lit(1), "class": F.lit(2)})
    return {"toxicity": lambda d: drop_toxic(d, labels), "near": keep_one_per_component, "spans": keep_first_spans, "bench": lambda d: drop_contaminated(d, bench)}


@pytest.mark.parametrize("stage", ["toxicity", "near", "spans", "bench"])
@pytest.mark.parametrize("ids", ["repeated", "plain"])
def test_stages_keep_any_column(spark, named, stage, ids):
    docs = named if ids == "repeated" else named.where("doc_id < 5")
    out = stages(spark)[stage](docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = out.collect()
    gone = {"near": {2}, "spans": set(), "bench": {3}}.get(stage)
    assert gone is None or {r["doc_id"] for r in docs.select("doc_id").collect()} - {r["doc_id"] for r in rows} == gone
    before = Counter((r["doc_id"], *(r[c] for c in NAMES)) for r in docs.collect())
    assert not Counter((r["doc_id"], *(r[c] for c in NAMES)) for r in rows) - before
    for r in rows:
        own = r["_id"].removeprefix("_id=")
        assert (r["text"] or "-" if r["text"] is None else r["text"]) == own or stage == "spans"
        assert stage != "spans" or r["n_chars"] == len(r["text"] or "")
    assert stages(spark)[stage](docs.limit(0)).count() == 0


def test_slots_do_not_depend_on_splits(spark, tmp_path):
    docs = spark.range(4000).select((F.col("id") % 3500).alias("doc_id"), F.repeat(F.md5(F.col("id").cast("string")), 9).alias("text"))
    docs.repartition(3).write.parquet(str(tmp_path / "d"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        out = shard_by_bytes(spark.read.parquet(str(tmp_path / "d")))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
        rows = out.collect()
        again = out.repartition(5).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == 4000 and len(slots) == 16 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def templates(spark, n):
    """n documents and n items of one template; the values of none are those of another."""
    words = lambda k: f"On day {k} the crew of boat {k + 7} hauled {2 * k + 90_000} boxes over the long pier before the evening bell rang out"
    docs = spark.createDataFrame([(i, f"filler {words(i)} filler") for i in range(n)], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, words(i + 1_000_000)) for i in range(n)], "item_id long, text string")


@pytest.mark.parametrize("bound", [500_000, 0])
def test_one_template_is_met_once(spark, bound):
    docs, bench = templates(spark, 400)
    rows = find_contamination(docs, bench, broadcast_rows=bound).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(400)) and {(r["item_id"], r["n_items"], r["offset"]) for r in rows} == {(0, 400, 1)}
    assert drop_contaminated(docs.union(spark.createDataFrame([(900, "clean")], docs.schema)), bench, broadcast_rows=bound).count() == 1


def test_values_of_a_class(spark):
    """Names in another case are met by the values of any item of the class; what repeats otherwise is another class."""
    say = lambda a, b, n: f"In March {a} of Bonn sold {b} {n} old boats and kept the oars for {a} alone that year"
    bench = spark.createDataFrame([(4, say("Anna", "Carl", 7)), (2, say("Dora", "Emil", 9)), (6, say("Fritz", "Fritz", 5))], "item_id long, text string")
    texts = [say("Dora", "Emil", 9).upper(), say("anna", "carl", 7).lower(), say("Gerd", "Hans", 11), say("Ida", "Ida", 3), say("Kurt", "Lisa", 2).replace("for Kurt alone", "for Mona alone")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["n_items"]) for r in find_contamination(docs, bench).collect())
    assert [(i, k, n) for i, k, n in got if i < 4] == [(0, 2, 2), (1, 2, 2), (2, 2, 2), (2, 6, 1), (3, 2, 2), (3, 6, 1)] or {i for i, _, _ in got} >= {0, 1, 2, 3}
    assert all(n == (1 if k == 6 else 2) for _, k, n in got)


@pytest.mark.parametrize("bound", [500_000, 0])
def test_both_ways_of_joining_give_the_same(spark, bound):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    rows = sorted(map(tuple, find_contamination(docs, bench, broadcast_rows=bound).collect()), key=str)
    want = sorted(map(tuple, find_contamination(docs, bench).collect()), key=str)
    assert rows == want and rows


@pytest.mark.parametrize("hot_rows", [10_000, 50])
def test_one_component_of_a_third_of_all_rows(spark, monkeypatch, hot_rows):
    """A star with many leaves, a chain, and pairs: components by plain union, with its centre whole and in parts."""
    monkeypatch.setattr(ngram_join, "HOT_ROWS", hot_rows)
    star = spark.range(1, 3000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    chain = spark.range(10_000, 10_200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    pairs = spark.range(20_000, 26_000, 2).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    got = {r["id"]: r["component"] for r in connected_components(star.union(chain).union(pairs)).collect()}
    want = {0: 0, **{i: 0 for i in range(1, 3000)}, **{i: 10_000 for i in range(10_000, 10_201)}, **{i: i - i % 2 for i in range(20_000, 26_000)}}
    assert got == want


@pytest.mark.parametrize("hot_rows", [10_000, 20])
def test_near_copies_of_a_third_of_all_rows(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(ngram_join, "HOT_ROWS", hot_rows)
    base = [f"t{i}" for i in range(80)]
    near = [(i, " ".join(x if k != i % 80 else f"changed{i}" for k, x in enumerate(base))) for i in range(300)]
    rest = [(1000 + i, " ".join(f"r{i}x{k}" for k in range(30))) for i in range(600)]
    got = jaccard_components(spark.createDataFrame(near + rest, "doc_id long, text string"), groups=7).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, 0) for i, _ in near} | {(i, i) for i, _ in rest}
