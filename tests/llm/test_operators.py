"""The training-data operators against brute force, on small tables with nulls, ties, repeated rows and clashing columns."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from verisift.llm import queries
from verisift.llm.decontamination import drop_contaminated, find_contamination
from verisift.llm.fingerprints import fingerprint_documents
from verisift.llm.language import identify_languages
from verisift.llm.ngram_join import jaccard_components, keep_one_per_component
from verisift.llm.quality import score_quality
from verisift.llm.sharding import minimax_cuts, shard_by_bytes
from verisift.llm.substring_dedup import dedup_substrings, keep_first_spans
from verisift.llm.token_files import token_files
from verisift.llm.tokens import PairIndexBPE, encode_documents
from verisift.llm.toxicity import alarm_bound, drop_toxic, score_toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, b long, g int, id long, run int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
    base = " ".join(f"a{i}" for i in range(60))
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (5, "two words"), (None, "one"), (None, None), (6, base), (7, base + " tail of more words"), (8, "head " + base), (9, long), (10, long), (11, "é ü <|endoftext|> 中文  x\n\n y "), (12, "IDIOT! 12 km. Foo"), (13, "a a a a a a a a a a a a a a a a a a a a a a")]
    return spark.createDataFrame([(i, t, "en" if i else None, None, None, 1, 2, 3, 4) for i, t in texts], SCHEMA)


@pytest.fixture(params=["plain", "odd", "none"])
def table(request, docs, odd):
    return {"plain": docs, "odd": odd, "none": odd.limit(0)}[request.param]


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def words(text):
    return (text or "").encode().split()


def test_shards(table):
    got = shard_by_bytes(table).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs(table))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(0 <= k < 16 and sorted(v) == list(range(len(v))) for k, v in slots.items())


def test_minimax_is_smallest():
    sizes = np.array([5, 1, 9, 2, 2, 7, 3])
    capacity, _ = minimax_cuts(sizes, 3)
    fits = lambda c: sum(1 for _ in _runs(sizes, c)) <= 3
    assert fits(capacity) and (capacity - 1 < sizes.max() or not fits(capacity - 1))


def _runs(sizes, c):
    run = 0
    for s in [*sizes, None]:
        if s is None or run + s > c:
            yield run
            run = 0
        run += s or 0


def test_bpe_is_the_library_s(table):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter()
    for i, t in pairs(table):
        ids = model.encode(t or "", add_special_tokens=False).ids
        back = model.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert Counter(map(tuple, encode_documents(table, queries.tokenizer_path()).collect())) == want


def test_bpe_runs_of_one_symbol():
    from tokenizers import Tokenizer

    model, own = Tokenizer.from_file(queries.tokenizer_path()), PairIndexBPE(queries.tokenizer_path())
    for t in ("aaaaaaaaa", "        x", "====-----=", "hahahahaha", "   ​"):
        ids = own.encode_units([t])[0]
        assert ids == model.encode(t, add_special_tokens=False).ids and own.decode(ids) == t


def test_token_files(table):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.tokenizer_path())
    at, want = 0, []
    for i, t in sorted(pairs(table), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_files(table, queries.tokenizer_path()).collect()), key=lambda r: r[1]) == want


@pytest.mark.parametrize("groups", [1, 5, 40])
def test_substrings(table, groups):
    rows = pairs(table)
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - 12):
            if i is not None:
                k = tuple(w[p : p + 13])
                first[k] = min(first.get(k, i), i)
    want = Counter()
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if i is not None and first[tuple(w[p : p + 13])] < i:
                gone[p : p + 13] = [True] * 13
        want[i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()] += 1
    assert Counter(map(tuple, dedup_substrings(table, groups=groups).collect())) == want


@pytest.mark.parametrize("groups", [1, 5])
def test_components(table, groups):
    rows = pairs(table)
    sets = []
    for _, t in rows:
        w = [x.lower() for x in words(t)]
        sets.append({tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    at = list(range(len(rows)))

    def top(x):
        while at[x] != x:
            x = at[x]
        return x

    held = defaultdict(list)
    for k, s in enumerate(sets):
        met = Counter(o for x in s for o in held[x])
        for x in s:
            held[x].append(k)
        for o, n in met.items():
            if 100 * n >= 75 * (len(s) + len(sets[o]) - n):
                at[top(k)] = top(o)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)].append(i)
    want = Counter((i, len(s), min(least[top(k)], default=None)) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))
    assert Counter(map(tuple, jaccard_components(table, groups=groups).collect())) == want


def test_fingerprints(table):
    order = sorted(pairs(table), key=lambda x: (x[0] is None, -(x[0] or 0), x[1] is not None, x[1] or ""))
    texts = [t or "" for _, t in order]
    want = Counter()
    for k, (i, _) in enumerate(order):
        t, u = texts[k], texts[(k + 1) % len(texts)]
        want[i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest()] += 1
    got = fingerprint_documents(table).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_quality(spark, table):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = score_quality(table, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in pairs(table)) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert score_quality(table, labels.limit(0)).count() == len(got)


def test_language(table):
    got = identify_languages(table).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in pairs(table))
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    x = identify_languages(d).where("held_out").join(d.select("doc_id", "lang"), "doc_id")
    assert x.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    y = score_quality(d, labels).where("held_out").join(labels, "doc_id")
    assert y.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.93


def test_toxicity_of_rows_that_it_has_not_seen(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    unseen = F.pmod(F.xxhash64(F.col("doc_id") + 7), F.lit(2)) == 0
    z = score_toxicity(d, labels.where(~unseen)).join(labels.where(unseen).select("doc_id", F.col("toxic").alias("said")), "doc_id")
    rates = {r["said"]: r["rate"] for r in z.groupBy("said").agg(F.avg(F.col("toxic").cast("int")).alias("rate")).collect()}
    assert rates[1] > 0.85 and rates[0] < 0.04, rates


def test_bound_of_false_alarms():
    scores, toxic = np.array([5.0, 4, 3, 2, 1, 0, -1, -2]), np.array([1, 1, 0, 1, 0, 0, 0, 0])
    assert alarm_bound(scores, toxic, 0) == 3.5 and alarm_bound(scores, toxic, 0.2) == 1.5 and alarm_bound(scores, toxic * 0, 0.2) is None


def test_toxicity_without_usable_labels(spark, odd):
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    for rows, said in (([], 0), ([(1, None), (None, 1)], 0), ([(4, 0), (6, 0)], 0), ([(4, 1), (6, 1)], odd.count())):
        assert score_toxicity(odd, labels(rows)).where("toxic").count() == said


def test_toxicity(spark, table):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = score_toxicity(table, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in pairs(table)) and all(0 <= r["severity"] <= 3 for r in got)
    kept = drop_toxic(table, labels)
    assert kept.columns == table.columns and kept.count() == sum(not r["toxic"] for r in got)


def test_contamination(spark):
    item = "The train from Paris left at 9 and travelled 120 km before it stopped near the old stone bridge by the river"
    other = item.replace("Paris", "Berlin").replace("120", "340").replace("9", "7")
    broken = item.replace("Paris", "Paris and Paris").replace("and Paris ", "")
    rows = [(1, item), (2, f"x y z {other} and so on"), (3, "nothing of the kind is said in these few words at all"), (4, None), (5, ""), (None, item), (6, broken), (6, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"offset": F.lit(1), "hits": F.lit("x"), "item_id": F.lit(9)})
    bench = spark.createDataFrame([(7, item), (8, "too short"), (9, None)], "item_id long, text string").withColumn("doc_id", F.lit(5))
    got = sorted((r["doc_id"] or -1, r["item_id"]) for r in find_contamination(docs, bench).collect())
    assert got == [(-1, 7), (1, 7), (2, 7), (6, 7)]
    left = drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5, 6]
    assert find_contamination(docs.limit(0), bench).count() == 0 and drop_contaminated(docs, bench.limit(0)).count() == len(rows)


def test_slots_must_agree(spark):
    item = "Anna gave Berta 5 apples and then Anna took 3 of the apples back home with her"
    docs = spark.createDataFrame([(1, item.replace("Anna", "Carl")), (2, "Dora gave Berta 5 apples and then Emil took 3 of the apples back home with her")], "doc_id long, text string")
    assert [r["doc_id"] for r in find_contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()] == [1]


def test_single_slots_veto_nothing(spark):
    shop = "Anna has 3 apples in her basket and then buys 5 more of them at the market before she walks home along the river with friends"
    openers = "The cat sat down on the mat near the door and looked at all of us. The dog ran far away over the hill to find the old bone that it had hidden there before"
    walk = "then we all walked down to the harbour and watched the ships come in Paris was far away and 7 gulls sat on the wall"
    texts = [shop.replace("3", "4").replace("5", "4"), openers.replace("The dog", "Two dog"), "then we all walked down to the harbour and watched the ships come in Rome is not Madrid or 9 others by Paris"]
    clash = walk.replace("walked", "ran").replace("Paris", "Rome")  # no verbatim run of 13 words
    docs = spark.createDataFrame([*enumerate(texts), (3, clash)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, shop), (1, openers), (2, walk)], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in find_contamination(docs, bench).collect()) == [(0, 0), (1, 1), (2, 2), (3, 2)]


def test_slots_count_in_the_matching_run_only(spark):
    item = "Anna paid 5 coins for the bread and then she paid 8 coins for milk while others waited Anna sang 5 songs 5 times Anna 5 Anna 5"
    text = "Carl paid 6 coins for the bread and then she paid 9 coins for milk but nobody came Emil saw 7 boats 8 cars Dora 1 Fritz 2"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [r["doc_id"] for r in find_contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()] == [1]


def test_items_are_met_at_every_offset(spark):
    rich = "Ann has 3 kg, Bob has 5 kg, Cid has 7 kg, Dan has 2 kg, Eve has 4 kg, Flo has 6 kg, Gus has 8"
    items = [rich, "how many of the small boats came back at night", "the boats came back late at night", "why is water wet", "what 5 kg"]
    rows = [(100 * k + n, " ".join([*["filler"] * n, item, "filler"])) for k, item in enumerate(items) for n in range(7)]
    docs = spark.createDataFrame([*rows, (900, "why is Water not wet and what 6 kg"), (901, None), (902, "why")], "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (9, ""), (10, None)], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["offset"]) for r in find_contamination(docs, bench).collect())
    assert got == [(i, i // 100, i % 100) for i, _ in rows]


def test_case_units_and_item_ids(spark):
    named = "In March Anna Weber of Bonn sold Carl Braun 7 old boats"
    far = "the ferry needs 120km of calm water and 3 kg of coal before it can reach the small island"
    texts = [named.upper(), named.lower(), far.replace("120km", "120 km").replace("3 kg", "3kg"), far.upper(), "another text of the same item that nobody else would ever write like this"]
    docs = spark.createDataFrame([(i, f"some filler {t} more filler") for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, named), (1, far), (1, texts[4]), (1, far)], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["offset"]) for r in find_contamination(docs, bench).collect()), key=str)
    assert got == [(0, None, 2), (1, None, 2), (2, 1, 2), (3, 1, 2), (4, 1, 2)]
    assert drop_contaminated(docs, bench).count() == 0


@pytest.mark.parametrize("size", range(1, 10))
def test_window_keys_tell_windows_apart(spark, size):
    from verisift.llm.decontamination import _keys

    lists = [list("abcabcabcdabcabcab"), list("cabcab"), ["a"] * 9, []]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, w array<string>").select("i", _keys(F.col("w"), size).alias("k")).collect()
    seen = {}
    for r in rows:
        windows = [tuple(lists[r["i"]][j : j + size]) for j in range(len(lists[r["i"]]) - size + 1)]
        assert len(windows) == len(r["k"] or [])
        for w, k in zip(windows, r["k"] or [], strict=True):
            assert seen.setdefault(w, k) == k
    assert len(set(seen.values())) == len(seen)


def test_long_texts_hash_like_short_ones():
    from verisift.llm.common import HASH_BYTES, words as hashed

    parts = [b"one two", b"x" * (HASH_BYTES + 5), b" ".join(b"w%d" % (i % 5000) for i in range(200_000)), b"", b"two one"]
    data, off = np.frombuffer(b"".join(parts), np.uint8), np.r_[0, np.cumsum([len(p) for p in parts])]
    h, start, stop, first = hashed(data, off)
    found = {}
    for a, z, x in zip(start.tolist(), stop.tolist(), h.tolist(), strict=True):
        assert found.setdefault(bytes(data[a:z]), x) == x
    assert len(set(found.values())) == len(found) == 5003 and np.diff(first).tolist() == [len(p.split()) for p in parts]


def test_one_row_stays_of_each_component(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(None, a), (7, a), (7, a + " more"), (None, a.upper()), (None, b), (None, b + " more"), (4, c), (4, c), (4, "apart"), (None, None), (9, "")]
    out = keep_one_per_component(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _lang string"))
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    want = [(7, min(a, a + " more", key=digest)), (None, min(b, b + " more", key=digest)), (4, c), (4, "apart"), (None, None), (9, "")]
    assert out.columns == ["doc_id", "text", "_lang"] and Counter(got) == Counter(want)


def test_stages_keep_columns(table):
    for stage in (keep_one_per_component, keep_first_spans):
        out = stage(table)
        assert out.columns == table.columns and out.count() <= table.count()


def test_equal_texts_share_a_shard_and_sizes_are_near(docs):
    rows = shard_by_bytes(docs).collect()
    by_text, load = defaultdict(set), Counter()
    for r in rows:
        by_text[(r["text_crc32"], r["size"])].add(r["shard"])
        load[r["shard"]] += r["size"]
    groups = Counter()
    for r in rows:
        groups[(r["text_crc32"], r["size"])] += r["size"]
    assert all(len(s) == 1 for s in by_text.values())
    assert max(load.values()) - min(load.get(k, 0) for k in range(16)) <= 2 * max(groups.values())


def test_minimax_by_brute_force():
    from itertools import combinations

    g = np.random.default_rng(3)
    for _ in range(60):
        sizes = g.integers(1, 30, g.integers(1, 9)).tolist()
        shards = int(g.integers(1, 5))
        got, _ = minimax_cuts(np.array(sizes), shards)
        best = min(max(sum(sizes[a:z]) for a, z in zip([0, *c], [*c, len(sizes)], strict=True)) for k in range(min(shards, len(sizes))) for c in combinations(range(1, len(sizes)), k))
        assert got == best, (sizes, shards)


def test_fingerprints_tell_likeness(docs):
    rows = fingerprint_documents(docs).where("n_chars > 400").collect()
    assert np.mean([r["near_edited"] for r in rows]) > np.mean([r["near_next"] for r in rows]) + 0.2
    by_text = defaultdict(set)
    text = dict(pairs(docs))
    for r in rows:
        by_text[text[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(s) == 1 for s in by_text.values())


def test_language_sample_ignores_row_order(docs):
    """Repeated ids bring more rows than the sample takes: which ones doesn't depend on the partitions."""
    twice = docs.unionByName(docs.withColumn("text", F.reverse("text")))
    runs = [sorted(map(tuple, identify_languages(t, sample=20).collect())) for t in (twice.repartition(3), twice.repartition(7, "text"))]
    assert [r[:3] for r in runs[0]] == [r[:3] for r in runs[1]] and np.allclose([r[3] for r in runs[0]], [r[3] for r in runs[1]])
