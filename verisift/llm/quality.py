"""Quality: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import range_hashes, steps, text_buffer, windows, words, written

FEATURES = (
    "log_words", "word_length", "word_length_spread", "upper", "digit", "stop", "mark", "other_sign", "beyond_ascii", "upper_words", "marked_words",
    "distinct_words", "repeated_lines", "line_words", "sentence_words", "repeated_pairs", "top_share", "spaces",
)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _class("0123456789")
_STOP = _class(".,;:?")
_MARK = _class("!#$%&*@^~|=+<>{}[]\\_")
_OTHER = _class("\"'()-/`")
_HIGH = np.arange(256) >= 192
_BLANK = _class(" \t\n\r\x0b\x0c")


def _per(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of values between the cuts."""
    c = np.zeros(len(values) + 1)
    np.cumsum(values, out=c[1:])
    return c[cuts[1:]] - c[cuts[:-1]]


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text, each transformed to be near symmetric."""
    n_docs = len(off) - 1
    size = np.diff(off).astype(float)
    h, start, stop, first = words(data, off)
    n = np.diff(first).astype(float)
    length = (stop - start).astype(float)
    w1, s1 = np.maximum(n, 1), np.maximum(size, 1)
    mean = _per(length, first) / w1
    spread = np.sqrt(np.maximum(_per(length**2, first) / w1 - mean**2, 0))
    share = {k: _per(t[data], off) / s1 for k, t in (("upper", _UPPER), ("digit", _DIGIT), ("stop", _STOP), ("mark", _MARK), ("other", _OTHER), ("high", _HIGH), ("blank", _BLANK))}
    loud = np.add.reduceat(_UPPER[data].astype(np.int64), start) if len(start) else np.zeros(0)
    marked = _MARK[data[stop - 1]] if len(stop) else np.zeros(0)
    doc = np.repeat(np.arange(n_docs, dtype=np.uint64), np.diff(first))
    # distinct words: sort by text, then by hash
    o = np.lexsort((h, doc)) if len(h) else np.zeros(0, np.int64)
    hs, ds = h[o], doc[o]
    new = np.zeros(len(o), bool)
    if len(o):
        new[0] = True
        new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    distinct = _per(new, first)
    runs = np.flatnonzero(new)
    top = np.zeros(n_docs)
    if len(runs):
        np.maximum.at(top, ds[runs].astype(np.int64), np.diff(np.r_[runs, len(o)]).astype(float))
    pair = windows(h, 2)

    valid = np.ones(len(pair), bool)
    ends = first[1:] - 1
    valid[ends[(ends >= 0) & (ends < len(pair))]] = False
    pd_, ph = doc[: len(pair)][valid], pair[valid]
    o = np.lexsort((ph, pd_)) if len(ph) else np.zeros(0, np.int64)
    again = np.zeros(len(o), bool)
    if len(o):
        again[1:] = (ph[o][1:] == ph[o][:-1]) & (pd_[o][1:] == pd_[o][:-1])
    repeated_pairs = np.bincount(pd_[o].astype(np.int64), again, n_docs) if len(o) else np.zeros(n_docs)
    # lines
    line = np.unique(np.r_[off, np.flatnonzero(data == 10) + 1])
    a, b = line[:-1], line[1:]
    ld = np.searchsorted(off, a, side="right") - 1
    lh = range_hashes(data, a, b)
    o = np.lexsort((lh, ld)) if len(a) else np.zeros(0, np.int64)
    same = np.zeros(len(o), bool)
    if len(o):
        same[1:] = (lh[o][1:] == lh[o][:-1]) & (ld[o][1:] == ld[o][:-1]) & ((b - a)[o][1:] > 12)
    lines = np.bincount(ld, minlength=n_docs)[:n_docs] if len(a) else np.zeros(n_docs)
    same_lines = np.bincount(ld[o], same, n_docs) if len(o) else np.zeros(n_docs)
    sentence = _per(np.isin(data, [46, 33, 63]), off)

    root = lambda x: np.sqrt(np.maximum(x, 0))
    return np.column_stack(
        [
            np.log1p(n), np.log1p(mean), np.log1p(spread), root(share["upper"]), root(share["digit"]), root(share["stop"]), root(share["mark"]), root(share["other"]), root(share["high"]),
            root(_per(loud >= 2, first) / w1), root(_per(marked, first) / w1), distinct / w1, root(same_lines / np.maximum(lines, 1)), np.log1p(n / np.maximum(lines, 1)), np.log1p(n / np.maximum(sentence, 1)),
            root(repeated_pairs / w1), root(top / w1), root(share["blank"]),
        ]
    )


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of the whole text; null and empty texts have those of no words."""

    def run(batches):
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            for i, j in steps(off):
                x = statistics(data[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


class Discriminant:
    """Class means and shrunk covariances; log densities by cached Cholesky factors."""

    def __init__(self, n: np.ndarray, total: np.ndarray, square: np.ndarray, shrink: float, pool: float):
        d = total.shape[1]
        self.known = bool((n >= 2).all())
        rate = (n[1] + 1) / (n.sum() + 2) if len(n) == 2 else 0.5
        self.prior = float(np.log(rate / (1 - rate)))
        if not self.known:
            return
        grand = n.sum()
        self.centre = total.sum(0) / grand
        self.scale = np.sqrt(np.maximum(np.diag(square.sum(0)) / grand - self.centre**2, 1e-8))
        mean = total / n[:, None]
        own = [(square[c] / n[c] - np.outer(mean[c], mean[c])) / np.outer(self.scale, self.scale) for c in (0, 1)]
        common = (n[0] * own[0] + n[1] * own[1]) / grand
        self.mean = (mean - self.centre) / self.scale
        self.factor, self.log_det = [], []
        for c in (0, 1):
            s = (1 - pool) * own[c] + pool * common
            s = (1 - shrink) * s + shrink * (np.trace(s) / d) * np.eye(d) + 1e-6 * np.eye(d)
            low = np.linalg.cholesky(s)
            self.factor.append(np.linalg.inv(low))
            self.log_det.append(2 * np.log(np.diag(low)).sum())

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.full(len(x), 1 / (1 + np.exp(-self.prior)))
        z = np.clip((x - self.centre) / self.scale, -12, 12)
        log = [-0.5 * ((((z - self.mean[c]) @ self.factor[c].T) ** 2).sum(1) + self.log_det[c]) for c in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0] + self.prior, -60, 60)))


def fit_discriminant(labelled: DataFrame, shrink: float = 0.05, pool: float = 0.2) -> Discriminant:
    """From (x, y in 0/1): executors sum x and x x' by class, the driver adds up one small matrix a partition and class."""
    d = len(FEATURES)

    def run(batches):
        n, total, square = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for b in batches:
            if len(b):
                x, y = np.vstack(b["x"].to_numpy()), b["y"].to_numpy()
                for c in (0, 1):
                    z = x[y == c]
                    n[c] += len(z)
                    total[c] += z.sum(0)
                    square[c] += z.T @ z
        yield pd.DataFrame({"y": [0, 1], "n": n, "v": [np.r_[total[c], square[c].ravel()] for c in (0, 1)]})

    sums = labelled.mapInPandas(run, "y int, n double, v array<double>")
    at = sums.select("y", "n", F.posexplode("v").alias("i", "v")).groupBy("y", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toPandas()
    n, v = np.zeros(2), np.zeros((2, d + d * d))
    v[at["y"], at["i"]] = at["v"]
    n[at["y"]] = at["n"]
    return Discriminant(n, v[:, :d], v[:, d:].reshape(2, d, d), shrink, pool)


def score_quality(docs: DataFrame, labels: DataFrame, shrink: float = 0.05, pool: float = 0.2, threshold: float = 0.7) -> DataFrame:
    """Scores every whole text of docs(doc_id, text) for quality, learnt from labels(doc_id, quality) of rows not held out.

    A row is held out when crc32(doc_id as text) mod 4 is 2 (a null doc_id never is, and has no label). Null labels are left
    out; of repeated labels each counts. Null and empty texts get the score of a text without words. Without two labelled
    rows of each class every score is the base rate. An empty table gives no rows; other columns are ignored.
    Returns doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).
    """
    stats = written(document_statistics(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1))
    model = fit_discriminant(stats.where(~held).join(known, "doc_id").select("x", "y"), shrink, pool)

    def run(batches):
        for b in batches:
            if len(b):
                s = model.scores(np.vstack(b["x"].to_numpy()))
                yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": s, "predicted": (s >= threshold).astype("int32")})

    return stats.withColumn("held_out", held).mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")
