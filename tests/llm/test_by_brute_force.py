"""Models and fingerprints against plain Python: statistics and densities, centroids, phrases and sketches."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from verisift.llm.common import mix, range_hashes
from verisift.llm.fingerprints import _EMPTY, LEVELS, ROUNDS, SLOTS, fingerprint_documents, fingerprint_text, phrases, sketches
from verisift.llm.language import GRAMS, identify_languages
from verisift.llm.quality import FEATURES, score_quality, statistics

SF = "/root/testdata/sf0.001"
TEXTS = ["", "one", "Two words", "A  b\n\na b.\nA  b\n", "LOUD Words!! $5 {x} THE end? yes; no, ok: (maybe) `c-d/e\"f'", "é ü 中文 é ü", "same line of text here\nsame line of text here\nother\n", "a b a b a b a b", "x" * 300]


def plain_statistics(text):
    raw = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    n, size = len(words), max(1, len(raw))
    lengths = [len(w) for w in words]
    mean = sum(lengths) / max(n, 1)
    spread = math.sqrt(max(0, sum(x * x for x in lengths) / max(n, 1) - mean**2))
    share = lambda chars: math.sqrt(sum(b in chars for b in raw) / size)
    upper, marks = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!#$%&*@^~|=+<>{}[]\\_"
    lines = [x for x in re.findall(rb"[^\n]*\n|[^\n]+\Z", raw)]
    pairs = Counter(zip(words, words[1:]))
    root = lambda x: math.sqrt(max(0, x))
    return [
        math.log1p(n), math.log1p(mean), math.log1p(spread), share(upper), share(b"0123456789"), share(b".,;:?"), share(marks), share(b"\"'()-/`"), share(range(192, 256)),
        root(sum(sum(b in upper for b in w) >= 2 for w in words) / max(n, 1)), root(sum(w[-1] in marks for w in words) / max(n, 1)), len(set(words)) / max(n, 1),
        root(sum(c - 1 for x, c in Counter(lines).items() if len(x) > 12) / max(len(lines), 1)), math.log1p(n / max(len(lines), 1)), math.log1p(n / max(sum(b in b".!?" for b in raw), 1)),
        root(sum(c - 1 for c in pairs.values()) / max(n, 1)), root(max(Counter(words).values(), default=0) / max(n, 1)), share(b" \t\n\r\x0b\x0c"),
    ]


def test_statistics():
    texts = [t.encode() for t in TEXTS]
    got = statistics(np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64))
    for row, text in zip(got, TEXTS, strict=True):
        for name, a, b in zip(FEATURES, row, plain_statistics(text), strict=True):
            assert a == pytest.approx(b, abs=1e-12), (name, text)


def test_quality_scores_are_density_differences(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    said = {r["doc_id"]: r["quality"] for r in labels.collect()}
    x = {r["doc_id"]: np.array(plain_statistics(r["text"] or "")) for r in docs.collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    taught = {c: np.array([v for i, v in x.items() if said.get(i) == c and not held(i)]) for c in (0, 1)}
    both = np.vstack([taught[0], taught[1]])
    centre, scale = both.mean(axis=0), np.sqrt(np.maximum(both.var(axis=0), 1e-8))
    z = {c: (t - centre) / scale for c, t in taught.items()}
    own = {c: np.cov(t.T, bias=True) for c, t in z.items()}
    common = sum(len(z[c]) * own[c] for c in (0, 1)) / len(both)
    d, models = both.shape[1], {}
    for c in (0, 1):
        s = 0.8 * own[c] + 0.2 * common
        s = 0.95 * s + 0.05 * np.trace(s) / d * np.eye(d) + 1e-6 * np.eye(d)
        models[c] = z[c].mean(axis=0), np.linalg.inv(s), np.linalg.slogdet(s)[1]
    prior = math.log((len(z[1]) + 1) / (len(z[0]) + 1))

    def density(v, c):
        m, inverse, log_det = models[c]
        return -0.5 * ((v - m) @ inverse @ (v - m) + log_det)

    for r in score_quality(docs, labels).collect():
        v = np.clip((x[r["doc_id"]] - centre) / scale, -12, 12)
        want = 1 / (1 + math.exp(-max(-60, min(60, density(v, 1) - density(v, 0) + prior))))
        assert r["score"] == pytest.approx(want, abs=1e-6) and r["held_out"] == held(r["doc_id"])


def plain_grams(text):
    folded = re.sub(rb" +", b" ", bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in text.encode()))
    out = np.zeros(GRAMS)
    for k in (2, 3):
        for i in range(len(folded) - k + 1):
            code = int.from_bytes(folded[i : i + k], "big")
            out[(((code * 2654435761) & 0xFFFFFFFF) ^ k) >> 20] += 1
    return out


def test_languages_by_centroids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "", "en"), (10**6 + 2, "12 34 !?", None), (10**6 + 3, "plain words", None)], docs.schema)
    rows = docs.union(odd).collect()
    grams = {r["doc_id"]: plain_grams(r["text"] or "") for r in rows}
    taught = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["lang"] is not None and r["text"] is not None]
    frequency = sum((grams[r["doc_id"]] > 0).astype(int) for r in taught)
    idf = np.log((1 + len(taught)) / (1 + frequency)) + 0.05
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    vector = {i: unit(np.sqrt(c) * idf) for i, c in grams.items()}
    got = {r["doc_id"]: r for r in identify_languages(docs.union(odd)).collect()}
    for i in (10**6, 10**6 + 1, 10**6 + 2):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    order = {r["doc_id"]: (r["p"], r["h"]) for r in docs.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id"), 24).alias("p"), F.xxhash64("doc_id", "text").alias("h")).collect()}
    model = []
    for lang in sorted({r["lang"] for r in taught}):
        x = [vector[r["doc_id"]] for r in sorted((r for r in taught if r["lang"] == lang and r["text"]), key=lambda r: order.get(r["doc_id"], (0, 0)))]
        start, seeds = unit(np.mean(x, axis=0)), []
        near = [v @ start for v in x]
        for _ in range(min(4, len(x))):
            far = min(range(len(x)), key=lambda k: near[k])
            seeds.append(x[far])
            near = [max(n, v @ x[far]) for n, v in zip(near, x, strict=True)]
        for _ in range(12):
            own = [max(range(len(seeds)), key=lambda k, v=v: (v @ seeds[k], -k)) for v in x]
            seeds = [unit(np.mean([v for v, o in zip(x, own, strict=True) if o == k], axis=0)) if k in own else seeds[k] for k in range(len(seeds))]
        model += [(lang, c) for c in seeds]
    for r in rows:
        if r["doc_id"] < 10**6 and any(map(str.isalpha, r["text"] or "")):
            best = max(v @ c for v in [vector[r["doc_id"]]] for _, c in model)
            near = {lang for lang, c in model if vector[r["doc_id"]] @ c > best - 1e-5}
            assert got[r["doc_id"]]["score"] == pytest.approx(min(1, best), abs=1e-4) and got[r["doc_id"]]["lang_pred"] in near


def plain_phrases(x):
    """Names of the phrases of one text's symbols, one symbol at a time."""
    runs = []
    for s in x:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    hashed = lambda v: int(mix(np.array([v & (2**64 - 1)], np.uint64))[0])
    y = [s if n == 1 else hashed(s + n * 0x9E3779B97F4A7C15) for s, n in runs]
    label = y
    for _ in range(ROUNDS):
        new = []
        for i, a in enumerate(label):
            d = a ^ label[i - 1] if i else 0
            at = (d & -d).bit_length() - 1 if d else 0
            new.append(2 * at + (a >> at & 1))
        label = new
    cuts = [i for i in range(len(y)) if i == 0 or (i < len(y) - 1 and label[i] < label[i - 1] and label[i] <= label[i + 1])]
    return [int(range_hashes(np.array(y, np.uint64), np.array([a]), np.array([z]))[0]) for a, z in zip(cuts, [*cuts[1:], len(y)], strict=True)]


def symbols(text):
    return [int(v) for v in mix(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))]


def plain_fingerprint(text):
    x, least = symbols(text), {}
    for level in range(LEVELS):
        x = plain_phrases(x) if x else []
        if level >= LEVELS - 2:
            for s in x:
                h = int(mix(np.array([s ^ (level + 1)], np.uint64))[0])
                least[h % SLOTS] = min(least.get(h % SLOTS, h), h)
    return [((least[k] >> 8) % _EMPTY) if k in least else _EMPTY for k in range(SLOTS)]


def test_fingerprints_by_plain_parsing(spark):
    texts = [*TEXTS, "aaaa bbbb " * 30, "".join(chr(97 + i * i % 23) for i in range(900))]
    assert sketches(texts).tolist() == [plain_fingerprint(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in fingerprint_documents(docs).collect():
        t, u = texts[r["doc_id"]], texts[(r["doc_id"] - 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        a, b, c = plain_fingerprint(t), plain_fingerprint(edited), plain_fingerprint(u)
        assert r["fingerprint"] == fingerprint_text(np.array(a)) and r["edited_fingerprint"] == fingerprint_text(np.array(b))
        like = lambda p, q: 1.0 if not any(x != _EMPTY or y != _EMPTY for x, y in zip(p, q, strict=True)) else sum(x == y != _EMPTY for x, y in zip(p, q, strict=True)) / sum(x != _EMPTY or y != _EMPTY for x, y in zip(p, q, strict=True))
        assert r["near_edited"] == pytest.approx(like(a, b)) and r["near_next"] == pytest.approx(like(a, c))


def test_equal_substrings_have_equal_phrases_at_any_offset():
    g = np.random.default_rng(8)
    shared = "".join(g.choice(list("abcdefghij "), 600))
    for k in range(1, 12):
        other = "".join(g.choice(list("klmnop"), k)) + shared + "".join(g.choice(list("qrst"), 3 * k))
        x, y = (phrases(np.array(symbols(t), np.uint64), np.zeros(len(t), np.int64))[0].tolist() for t in (shared, other))
        assert sum((Counter(x) & Counter(y)).values()) >= len(x) - 2 * (ROUNDS + 2)


def test_word_features():
    from verisift.llm.toxicity import FEATURES as HASHED
    from verisift.llm.toxicity import PREFIXES, word_features

    texts = ["", "Idiots! idiot, IDIOTS", "unbelievable unbelievably über x1y", "a bb ccccc"]
    raw = [t.encode() for t in texts]
    doc, feature = word_features(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64))
    for i, r in enumerate(raw):
        words = {bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in re.findall(rb"[A-Za-z\x80-\xff]+", r)}
        want = set()
        for w in words:
            for k in (0, *PREFIXES):
                if len(w) >= k:
                    part = np.frombuffer(w[:k] if k else w, np.uint8)
                    h = int(range_hashes(part, np.array([0]), np.array([len(part)]))[0])
                    want.add((h if not k else h ^ (k << 42)) >> 42)
        assert set(feature[doc == i].tolist()) == want and all(f < HASHED for f in want)


def test_cumulative_link_by_differences():
    """Adam over slopes taken by differences of the plain loss reaches the same probabilities."""
    from verisift.llm.toxicity import CumulativeLink

    g = np.random.default_rng(4)
    x = (g.random((40, 4)) < 0.5).astype(np.float32)
    grade = np.clip((x @ np.array([1.5, -1, 0.5, 0]) + g.normal(size=40)).round().astype(int), 0, 3)
    model = CumulativeLink.fit(x, grade, 3)
    assert (np.diff(model.bounds) > 0).all()

    def bounds(p):
        return p[4] + np.r_[0, np.cumsum(np.log1p(np.exp(p[5:])))]

    def loss(p):
        total = 0.5 * 1e-3 * (p[:4] ** 2).sum()
        for row, y in zip(x, grade, strict=True):
            for k, b in enumerate(bounds(p), 1):
                q = 1 / (1 + math.exp(-(row @ p[:4] - b)))
                total -= math.log(q if y >= k else 1 - q) / len(x)
        return total

    base = np.array([(grade >= k).mean() for k in (1, 2, 3)]).clip(1e-4, 1 - 1e-4)
    b = -np.log(base / (1 - base))
    p = np.r_[np.zeros(4), b[0], np.log(np.expm1(np.maximum(np.diff(b), 1e-2)))]
    m, v = np.zeros(7), np.zeros(7)
    for t in range(1, 301):
        slope = np.array([(loss(p + e) - loss(p - e)) / 2e-5 for e in np.eye(7) * 1e-5])
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        p = p - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    want = np.array([[1 / (1 + math.exp(-(row @ p[:4] - b))) for b in bounds(p)] for row in x])
    got = model.at_least(x @ model.weight)
    assert np.allclose(got, want, atol=0.01) and np.allclose(got.sum(axis=1), [sum(r) for r in want], atol=0.02)


def test_contamination_by_every_offset(spark):
    """Every item laid over every document at every offset at which windows meet."""
    import random

    import regex

    from verisift.llm import decontamination as de

    g = random.Random(6)
    unit = de._UNIT

    def parts(text):
        plain = regex.sub(rf"(?<=\d)(?={unit}(?![\p{{L}}\p{{N}}]))", " ", text.translate({ord(c): None for c in de._MARKS}))
        t = regex.sub(rf"(?<=\d[\x20\x09-\x0D]){unit}(?![\p{{L}}\p{{N}}])", "<unit>", plain)
        t = regex.sub(r"\d+", "<num>", regex.sub(r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}+", "<name>", t))
        cut = lambda x: [w for w in re.split(r"[\x20\x09-\x0D]+", x.lower()) if w]
        return cut(plain), cut(t)

    vocabulary = ["the", "boat", "of", "Anna", "Carl", "has", "3", "12", "kg", "7km", "sold", "red", "old", "near", "Bonn", "and", "x2"]
    say = lambda n: " ".join(g.choice(vocabulary) for _ in range(n))
    items = [say(n) for n in (3, 5, 7, 9, 14, 20, 26)] + ["Anna has 3 red boats of 5 kg near the old town of Bonn and sold 3", "Carl has 4 red boats of 6 kg near the old town of Rome and sold 4"]
    bench = [(i % 8, t) for i, t in enumerate(items)] + [(None, items[4]), (50, None)]

    def changed(t):
        return " ".join(g.choice([w, w, w, w.upper() if g.random() < 0.3 else w, str(g.randrange(9)) if w[0].isdigit() else w, g.choice(["Emil", "Dora"]) if w[0].isupper() else w, g.choice(vocabulary) if g.random() < 0.3 else w]) for w in t.split())

    docs = [(k, f"{say(g.randrange(6))} {changed(g.choice(items))} {say(g.randrange(6))}") for k in range(150)]
    classes = {}
    for item_id, text in {b for b in bench if b[1]}:
        w, t = parts(text)
        slots = [i for i, x in enumerate(t) if "<" in x]
        pattern = tuple(next(k for k, j in enumerate(slots) if (t[j], w[j]) == (t[i], w[i])) for i in slots)
        classes.setdefault((tuple(t), pattern), []).append((item_id, w))
    want = {}
    for doc_id, text in docs:
        dw, dt = parts(text)
        for (t, pattern), members in classes.items():
            n, slots = len(t), [i for i, x in enumerate(t) if "<" in x]
            size, offsets = min(7, n), set()
            for _, w in members:
                for at in range(n - size + 1):
                    part = t[at : at + size]
                    by_template = n >= 7 and sum("<" not in x for x in part) >= de.LITERAL
                    for place in range(len(dw) - size + 1):
                        if (by_template and tuple(dt[place : place + size]) == part) or ((not by_template or any("<name>" in x for x in part)) and dw[place : place + size] == w[at : at + size]):
                            offsets.add(place - at)
            for off in offsets:
                inside = [i for i in range(n) if 0 <= i + off < len(dw)]
                equal = [i for i in inside if (any(w[i] == dw[i + off] for _, w in members) if "<" in t[i] else t[i] == dw[i + off])]
                same = [i for i in inside if i in equal or t[i] == dt[i + off]]

                def runs(places):
                    out = []
                    for i in places:
                        if out and out[-1][-1] == i - 1:
                            out[-1].append(i)
                        else:
                            out.append([i])
                    return out

                def consistent(places, off=off, pattern=pattern, slots=slots, dw=dw):
                    pairs = [(pattern[slots.index(i)], dw[i + off]) for i in places if i in slots]
                    return len(set(pairs)) - len({p for p, _ in pairs}) <= de.CONFLICT * len(pairs)

                enough = lambda k, n=n: k >= de.PROOF or k >= de.SHARE * n
                if enough(len(same)) and (any(len(r) >= de.PROOF for r in runs(equal)) or consistent(same) or any(enough(len(r)) and consistent(r) for r in runs(same))):
                    ids = [i for i, _ in members if i is not None]
                    key = (doc_id, min(ids) if ids else None)
                    figures = (len(same), -off, n, sum(i in slots for i in same), len(members))
                    want[key] = max(want.get(key, (0,)), figures)
    rows = de.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): (r["matched"], -r["offset"], r["item_size"], r["slots"], r["n_items"]) for r in rows}
    assert len(got) == len(rows) and got == want and len(want) > 60
