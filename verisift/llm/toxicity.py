"""Toxicity: cumulative-link ordinal regression over sparse word features, one weight vector for all ordered thresholds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, range_hashes, steps, text_buffer, words, written

#: Hashed features, and those of them that get a weight.
FEATURES, WEIGHTED = 1 << 22, 1024
#: A word's first so many bytes are features too: inflected and joined forms share them.
PREFIXES = (5, 7, 9)
#: The model is fitted on at most this many labelled rows, those with the smallest hash of their id.
MAX_LABELLED = 20_000
#: Severity grades above 0.
GRADES = 3
#: Share of the clean validation rows that the bound of the first grade may call toxic.
FALSE_ALARMS = 0.02
#: One labelled row of so many is left out of a first fit, to place that bound.
VALIDATION = 3

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def word_features(data: np.ndarray, off: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature), distinct and ascending: the lower-case words of letters of each text and their prefixes, those in `wanted` alone."""
    plain = np.where(_LETTER[data], data, np.uint8(32))
    plain[(plain > 64) & (plain < 91)] += 32
    h, start, stop, first = words(plain, off)
    doc = np.repeat(np.arange(len(off) - 1, dtype=np.int64), np.diff(first))
    found = []
    for k in (0, *PREFIXES):
        far = stop - start >= k
        x = h if not k else range_hashes(plain, start[far], start[far] + k) ^ np.uint64(k << 42)
        f, d = (x >> np.uint64(42)).astype(np.int64), doc[far]
        if wanted is not None:
            some = wanted[f]
            f, d = f[some], d[some]
        found.append(d * FEATURES + f)
    key = np.unique(np.concatenate(found))
    return key // FEATURES, key % FEATURES


def _counts(labelled: DataFrame) -> DataFrame:
    """feature, clean, toxic: how many labelled texts of either class hold it; feature -1 has how many there are."""

    def run(batches):
        have, n = np.zeros((2, FEATURES), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            y = batch.column(0).to_numpy()
            data, off = text_buffer(batch.column(1))
            n += np.bincount(y, minlength=2)
            for i, j in steps(off):
                doc, feature = word_features(data[off[i] : off[j]], off[i : j + 1] - off[i])
                for c in (0, 1):
                    np.add.at(have[c], feature[y[i:j][doc] == c], 1)
        at = np.flatnonzero(have.any(0))
        yield pa.RecordBatch.from_pydict({"feature": pa.array(np.r_[-1, at], pa.int32()), "clean": np.r_[n[0], have[0][at]].astype(np.int64), "toxic": np.r_[n[1], have[1][at]].astype(np.int64)})

    return labelled.mapInArrow(run, "feature int, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _chosen(counts: DataFrame, clean: int, toxic: int) -> DataFrame:
    """The WEIGHTED features that tell most: feature, mark (it stands for toxic rows)."""
    share = lambda c, n: (F.col(c) + 0.5) / (n + 1.0)
    log, gap, both = F.log(share("toxic", toxic) / share("clean", clean)), share("toxic", toxic) - share("clean", clean), F.col("clean") + F.col("toxic")
    rows = counts.where("feature >= 0").where(both >= 3).withColumn("gain", both * F.abs(log) * F.abs(gap)).where("gain > 0")
    return rows.select("feature", "gain", ((log > float(np.log(4))) & (F.col("toxic") >= 5)).alias("mark")).orderBy(F.desc("gain"), "feature").limit(WEIGHTED)


def _sparse(labelled: DataFrame, chosen: np.ndarray, mark: np.ndarray) -> DataFrame:
    """h (the row's hash), y, density (share of features that mark toxic rows), places of the chosen features that it holds: at most WEIGHTED."""

    def run(batches):
        place = np.full(FEATURES, -1, np.int16)
        place[chosen] = np.arange(len(chosen))
        marks = np.zeros(FEATURES, bool)
        marks[chosen[mark]] = True
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            for i, j in steps(off):
                doc, feature = word_features(data[off[i] : off[j]], off[i : j + 1] - off[i])
                density = np.bincount(doc[marks[feature]], minlength=j - i) / np.maximum(np.bincount(doc, minlength=j - i), 1)
                inside = place[feature] >= 0
                cut = np.searchsorted(doc[inside], np.arange(j - i + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(place[feature[inside]]))
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(i, j - i), batch.column(0).slice(i, j - i), pa.array(density), lists], names=["h", "y", "density", "places"])

    return labelled.select("y", "text", "h").mapInArrow(run, "h long, y int, density double, places array<short>")


def severity_grades(toxic: np.ndarray, density: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """0 where not toxic; toxic rows fall into 1..grades by equal shares of the density of words that mark toxic rows. Ties share a grade."""
    out = np.zeros(len(toxic), np.int64)
    own = density[toxic == 1]
    if len(own):
        cuts = np.quantile(own, np.arange(1, grades) / grades)
        out[toxic == 1] = 1 + np.searchsorted(cuts, own, side="left")
    return out


class CumulativeLink:
    """P(grade >= k | x) = sigmoid(w x - b_k) with b_1 <= ... <= b_K."""

    def __init__(self, weight: np.ndarray, bounds: np.ndarray):
        self.weight, self.bounds = weight, bounds

    @classmethod
    def fit(cls, x: np.ndarray, grade: np.ndarray, grades: int, ridge: float = 1e-3, rounds: int = 300, rate: float = 0.1) -> CumulativeLink:
        """Adam on the mean log loss of the thresholds, all sharing w; the bounds are a first one and positive steps."""
        n, d = x.shape
        at_least = (grade[:, None] >= np.arange(1, grades + 1)).astype(np.float32)
        p = np.zeros(d + grades, np.float32)
        base = np.clip(at_least.mean(0), 1e-4, 1 - 1e-4)
        b = -np.log(base / (1 - base))
        p[d], p[d + 1 :] = b[0], np.log(np.expm1(np.maximum(np.diff(b), 1e-2)))
        m, v = np.zeros_like(p), np.zeros_like(p)
        for t in range(1, rounds + 1):
            up = np.log1p(np.exp(p[d + 1 :]))
            bounds = p[d] + np.r_[0, np.cumsum(up)]
            q = 1 / (1 + np.exp(-np.clip((x @ p[:d])[:, None] - bounds, -30, 30)))
            e = (q - at_least) / n
            g = np.empty_like(p)
            g[:d] = x.T @ e.sum(1) + ridge * p[:d]
            gb = -e.sum(0)
            g[d] = gb.sum()
            g[d + 1 :] = (gb[::-1].cumsum()[::-1])[1:] / (1 + np.exp(-p[d + 1 :]))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return cls(p[:d].astype(float), p[d] + np.r_[0, np.cumsum(np.log1p(np.exp(p[d + 1 :])))].astype(float))

    def at_least(self, s: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(s[:, None] - self.bounds, -60, 60)))


def alarm_bound(scores: np.ndarray, toxic: np.ndarray, share: float = FALSE_ALARMS) -> float | None:
    """The lowest bound, half way between two scores, that at most `share` of the clean rows pass; None without both classes."""
    clean = np.sort(scores[toxic == 0])[::-1]
    if not len(clean) or not (toxic == 1).any():
        return None
    passing = int(share * len(clean))
    below = clean[passing]
    above = scores[scores > below]
    return float((below + above.min()) / 2) if len(above) else float(below)


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, grades: int = GRADES):
    """(features, their weights, bounds). Labels are labels(doc_id, toxic); null ones are left out.

    Fitted on at most max_labelled labelled rows; their ids (a bounded number) are broadcast. Feature counts are aggregated by
    Spark; the driver gets the WEIGHTED best and each labelled row's places among them. A first fit without one row of
    VALIDATION places the bound of the first grade: the labels are few, so unseen toxic words weigh less than seen ones.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_labelled)
    labelled = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("y", "text", F.xxhash64("doc_id").alias("h"))
    counts = written(_counts(labelled))
    n = counts.where("feature = -1").first()
    if n is None or not n["clean"] or not n["toxic"]:
        return np.zeros(0, np.int64), np.zeros(0), np.full(grades, 50.0 if n is None or not n["toxic"] else -50.0)
    best = _chosen(counts, n["clean"], n["toxic"]).collect()
    chosen, mark = np.array([r["feature"] for r in best], np.int64), np.array([r["mark"] for r in best], bool)
    rows = _sparse(labelled, chosen, mark).toArrow()
    h, y, density = (rows.column(c).to_numpy() for c in ("h", "y", "density"))
    lists = rows.column("places").combine_chunks()
    x = np.zeros((len(y), len(chosen)), np.float32)
    x[np.repeat(np.arange(len(y)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = 1
    order = np.lexsort((density, y, h))
    x, h, y, grade = x[order], h[order], y[order], severity_grades(y, density, grades)[order]
    left_out = h % VALIDATION == 0
    bound = None
    if left_out.any() and 0 < y[~left_out].sum() < (~left_out).sum():
        part = CumulativeLink.fit(x[~left_out], grade[~left_out], grades)
        bound = alarm_bound(x[left_out] @ part.weight - part.bounds[0], y[left_out])
    model = CumulativeLink.fit(x, grade, grades)
    return chosen, model.weight, model.bounds + min(0.0, bound or 0.0)


def _scorer(docs: DataFrame, labels: DataFrame):
    """A function from a column of texts to P(grade >= k) of each text."""
    chosen, weight, bounds = fit_toxicity(docs, labels)

    def scorer():
        model, table = CumulativeLink(weight, bounds), np.zeros(FEATURES, np.float32)
        table[chosen] = weight
        wanted = table != 0

        def score(column):
            data, off = text_buffer(column)
            for i, j in steps(off):
                doc, feature = word_features(data[off[i] : off[j]], off[i : j + 1] - off[i], wanted)
                yield i, j, model.at_least(np.bincount(doc, table[feature], j - i))

        return score

    return scorer


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Expected severity of every whole text of docs(doc_id, text), learnt from labels(doc_id, toxic).

    Null and empty texts have no word and severity near 0. Null or repeated doc_ids keep their rows; without labels of both
    classes every row gets the one class there is (none: not toxic); an empty table gives no rows; other columns are ignored.
    Returns doc_id, p_toxic (of grade 1 or more), severity (expected grade, 0 to 3), toxic (p_toxic >= threshold).
    """
    scorer = _scorer(docs, labels)

    def run(batches):
        score = scorer()
        for batch in batches:
            for i, j, p in score(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(p[:, 0]), pa.array(p.sum(1)), pa.array(p[:, 0] >= threshold)], names=["doc_id", "p_toxic", "severity", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, p_toxic double, severity double, toxic boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns whatever their names, that score_toxicity would not call toxic.

    Rows with null and empty texts stay, as do all without labels of both classes, unless every label says toxic; null and
    repeated doc_ids and repeated rows are judged each by its text; an empty table stays empty."""
    scorer, at = _scorer(docs, labels), docs.columns.index("text")

    def run(batches):
        score = scorer()
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for i, j, p in score(batch.column(at)):
                keep[i:j] = p[:, 0] < threshold
            yield batch.filter(pa.array(keep))

    placed = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    return placed.mapInArrow(run, placed.schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
