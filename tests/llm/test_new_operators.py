"""Chunked BPE against tiktoken, whitening against numpy and Fractions, fill-in-middle against plain string code."""

import base64
import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.compare import difference, views
from verisift.llm import queries
from verisift.llm.chunked_bpe import RankBPE, decode_ids, encode_chunked
from verisift.llm.fill_in_middle import UNITS, boundaries, code_points, fill_in_middle, restore_texts, restored
from verisift.llm.whitening import fit_whitening, identity_error, whiten_embeddings

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, ids string, k int, digest string, `a.b` string, form string, n int"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def odd(spark):
    g = random.Random(3)
    mixed = "".join(g.choice(["word ", "don't ", "  ", "\n\n", "’ll've", "12 345", "é中文", "--", " x"]) for _ in range(400))
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (4, "two"), (None, "one"), (None, None), (5, mixed), (5, mixed), (6, mixed), (None, mixed),
        (7, "a" * 300), (8, "word " * 20 + "b" * 130 + " tail of words" * 9), (9, " " * 210 + "x"), (10, "it's we're they'll I've " * 12), (11, "<P> holds a mark"), (12, "<S>"), (13, "🙂" * 90 + " \U0010ffff end"), (14, "x" * 41), (15, "ab cd " * 7),
    ]
    return spark.createDataFrame([(i, t, "c", 1, "d", "e", "plain", 5) for i, t in texts], SCHEMA)


@pytest.fixture(params=["plain", "odd", "none"])
def table(request, spark, odd):
    return {"plain": spark.read.parquet(f"{SF}/documents.parquet"), "odd": odd, "none": odd.limit(0)}[request.param]


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("chunk, overlap", [(1 << 16, 1 << 10), (40, 12), (40, 40), (7, 6)])
def test_chunks_give_the_library_s_ids(table, library, chunk, overlap):
    want = Counter((i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in pairs(table))
    rows = decode_ids(encode_chunked(table, RANKS, PATTERN, chunk, overlap), RANKS, PATTERN).collect()
    assert Counter((r["doc_id"], tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist()), bytes(r["decoded"])) for r in rows) == want
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in rows)


def test_merges_are_the_library_s(library):
    own, g = RankBPE(RANKS, PATTERN), random.Random(1)
    for n in (1, 2, 5, 30, 48, 49, 50, 400, 3000):
        for letters in ("ab", "aaaa", "etaoin", "=-", "zqxé中"):
            w = "".join(g.choice(letters) for _ in range(n))
            assert own.merge(w.encode()) == library._encode_single_piece(w)


def test_pattern_takes_every_character_alike(library):
    own = RankBPE(RANKS, PATTERN)
    chars = [chr(c) for c in range(0x250)] + [chr(c) for c in (0x85, 0xA0, 0x1680, 0x2000, 0x2028, 0x200B, 0x202F, 0x205F, 0x3000, 0xFEFF, 0x4E2D, 0x0661, 0x1F642)]
    for c in chars:
        text = f"a{c} {c}{c}b 1{c}'s{c}"
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode_ordinary(text), hex(ord(c))


def test_chunks_refuse_what_cannot_be_stitched(odd):
    for chunk, overlap in ((10, 11), (10, 3)):
        with pytest.raises(ValueError):
            encode_chunked(odd, RANKS, PATTERN, chunk, overlap)


def test_fill_in_middle(table):
    want = Counter()
    for i, t in pairs(table):
        t, h = t or "", hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        a, b, c, d = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        x, y = sorted((a % (len(t) + 1), b % (len(t) + 1)))
        if not t or "<P>" in t or "<S>" in t or "<M>" in t or c % 100 >= 90:
            want[i, len(t), "plain", None, None, t, t] += 1
        elif d % 100 < 20:
            want[i, len(t), "spm", x, y - x, f"<S>{t[y:]}<P>{t[:x]}<M>{t[x:y]}", t] += 1
        else:
            want[i, len(t), "psm", x, y - x, f"<P>{t[:x]}<S>{t[y:]}<M>{t[x:y]}", t] += 1
    assert Counter(map(tuple, restore_texts(fill_in_middle(table)).collect())) == want


@pytest.mark.parametrize("unit", sorted(UNITS))
def test_units(table, unit):
    rows = restore_texts(fill_in_middle(table, unit=unit, seed="x", cut_percent=100, suffix_first=50).withColumn("restored", F.lit("clash"))).collect()
    assert Counter((r["doc_id"], r["restored"]) for r in rows) == Counter((i, t or "") for i, t in pairs(table))
    assert not rows or {"psm", "spm"} <= {r["form"] for r in rows}
    for r in rows:
        if r["form"] != "plain":
            ends = boundaries(code_points(r["restored"]), unit).tolist()
            assert r["n"] == len(ends) - 1 and {r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]} <= set(ends)


def test_boundaries():
    p = code_points("ab  c\n\nd")
    assert boundaries(p, "char").tolist() == list(range(9)) and boundaries(p, "word").tolist() == [0, 2, 4, 5, 7, 8] and boundaries(p, "line").tolist() == [0, 6, 7, 8]
    assert boundaries(code_points(""), "line").tolist() == [0]


def test_marks(odd):
    assert restored("<S>c<P><<M>b", "spm") == "<bc"
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("ab", "bc", "d"), ("aXa", "b", "c"), ("<P>x", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle(odd, marks=marks)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), views(SF), queries.ORACLES[name]) is None


def vectors(df):
    return [(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()]


def usable(rows):
    good = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) and abs(64 * x) <= 2**31 for x in v)]
    most = Counter(len(v) for _, v in good)
    size = max(most, key=lambda k: (most[k], k), default=0)
    return [(i, [math.floor(64 * float(x)) + 1_000_000 for x in v]) for i, v in good if len(v) == size]


def expected_deviations(rows):
    n, sums = len(rows), [sum(c) for c in zip(*(x for _, x in rows), strict=True)]
    return Counter((i, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))) for i, x in rows)


def hold(got, rows, k):
    """Whitened rows against numpy's eigenvalues of the covariance; each component up to its sign."""
    x = np.array([x for _, x in rows], float)
    y = x - x.mean(axis=0)
    values, v = np.linalg.eigh(y.T @ y / len(y))
    values, v = values[::-1], v[:, ::-1]
    assert {r["component"] for r in got} == set(range(1, k + 1)) and {r["n"] for r in got} == {len(rows)}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] <= 1e-9
    assert Counter((r["vec_id"], int(r["deviation"])) for r in got if r["component"] == 1) == expected_deviations(rows)
    for c in range(k):
        mine = sorted(((r["vec_id"] is None, r["vec_id"] or 0, r["whitened"]) for r in got if r["component"] == c + 1))
        z = y @ v[:, c] / np.sqrt(values[c])
        for sign in (1, -1):
            want = sorted(((i is None, i or 0, sign * a) for (i, _), a in zip(rows, z.tolist(), strict=True)))
            if all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6 for a, b in zip(mine, want, strict=True)):
                break
        else:
            raise AssertionError(f"component {c + 1} differs")
        assert all(abs(r["explained"] - values[c] / values.sum()) < 1e-9 for r in got if r["component"] == c + 1)


@pytest.mark.parametrize("parts", [1, 40])
def test_whitening(spark, parts):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").repartition(parts)
    rows = usable(vectors(table))
    hold(whiten_embeddings(table).collect(), rows, min(32, len(rows[0][1])))
    fit = fit_whitening(table.select("embedding"))
    assert np.abs(fit.components.T @ fit.components - np.eye(fit.components.shape[1])).max() < 1e-12 and identity_error(table.select("embedding"), fit) < 1e-9


def test_whitening_of_odd_rows(spark):
    g = np.random.default_rng(5)
    some = [(i // 2, [float(x) for x in g.normal(size=3) * (9, 2, 0.5)]) for i in range(60)]
    rows = [*some, some[0], some[0], (None, [1.0, 2.0, 3.0]), (70, None), (71, []), (72, [1.0, None, 2.0]), (73, [float("nan"), 0.0, 0.0]), (74, [float("inf"), 0.0, 0.0]), (75, [1.0, 2.0]), (76, [1e30, 0.0, 0.0]), (77, [-0.0, -1e-9, 0.5])]
    table = spark.createDataFrame([(i, v, 1, 2.0, "x", 3) for i, v in rows], "vec_id long, embedding array<double>, component int, deviation double, `a.b` string, vector int").repartition(7)
    hold(whiten_embeddings(table).collect(), usable(rows), 3)
    assert whiten_embeddings(table.limit(0)).count() == 0 and whiten_embeddings(table.where("embedding is null")).count() == 0
    assert whiten_embeddings(table.withColumn("embedding", F.array(F.lit(1.5), F.lit(2.5)))).count() == 0  # no variance
    flat = table.where("vec_id < 30").withColumn("embedding", F.concat("embedding", F.array(F.lit(1.0))))
    assert {r["component"] for r in whiten_embeddings(flat).collect()} == {1, 2, 3}
    renamed = table.select(F.col("vec_id").alias("a.id"), F.col("embedding").cast("array<float>").alias("v`x"))
    assert whiten_embeddings(renamed, "a.id", "v`x", components=2).select("component").distinct().count() == 2


def test_deviations_beyond_64_bits(spark):
    rows = [(i, [x, -x]) for i, x in enumerate([3.3e7, -3.3e7, 1.0] * 400)]
    got = whiten_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").collect()
    assert Counter((r["vec_id"], int(r["deviation"])) for r in got) == expected_deviations(usable(rows))
