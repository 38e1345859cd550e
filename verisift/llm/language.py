"""Language: TF-IDF byte n-gram vectors against several centroids per language by cosine, rejecting what is far from all."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _LOWER, steps, text_buffer

#: Hashed n-grams; rows per language that the centroids are fitted on at most; centroids per language.
GRAMS, SAMPLE, CENTROIDS = 4096, 500, 4
_FOLD = _LOWER.copy()
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32


def gram_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts by hashed n-grams of two and three bytes; what is no letter counts as one blank."""
    n = len(off) - 1
    b = _FOLD[data].astype(np.uint32)
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
    keep[off[:-1][off[:-1] < len(b)]] = True  # what stands before a text is no part of it
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(off))[keep] * GRAMS
    b = b[keep]
    out = np.zeros(n * GRAMS)
    for k in (2, 3):
        if len(b) >= k:
            code = b[: len(b) - k + 1].copy()
            for j in range(1, k):
                code = (code << np.uint32(8)) | b[j : len(b) - k + 1 + j]
            code = ((code * np.uint32(2654435761)) ^ np.uint32(k)) >> np.uint32(20)
            same = doc[: len(code)] == doc[k - 1 :]
            out += np.bincount((doc[: len(code)] + code)[same], minlength=n * GRAMS)
    return out.reshape(n, GRAMS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from the rows farthest from those chosen."""
    c = [x.mean(0)]
    c[0] /= max(np.linalg.norm(c[0]), 1e-12)
    near = x @ c[0]
    seeds = []
    for _ in range(min(k, len(x))):
        i = int(near.argmin())
        seeds.append(x[i])
        near = np.maximum(near, x @ x[i])
    c = np.array(seeds)
    for _ in range(rounds):
        who = (x @ c.T).argmax(1)
        c = np.array([x[who == i].mean(0) if (who == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _counted(docs: DataFrame, emit, schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            for i, j in steps(off, 1 << 19):
                for k in range(i, j, 256):
                    m = min(j, k + 256)
                    yield from emit(batch.slice(k, m - k), gram_counts(data[off[k] : off[m]], off[k : m + 1] - off[k]))

    return docs.mapInArrow(run, schema)


def identify_languages(docs: DataFrame, sample: int = SAMPLE, per_language: int = CENTROIDS) -> DataFrame:
    """The language of every whole text of docs(doc_id, text, lang), learnt from rows that are not held out.

    A row is held out when crc32(doc_id as text) mod 3 is 1 (a null doc_id never is, but teaches nothing). Null langs teach
    nothing. Document frequencies come from all rows that teach; the centroids are fitted on at most `sample` rows per
    language, those with the smallest hash of their id. Texts that are null or have no letter are `und` with score 0, as is
    every text if nothing teaches. Equal scores go to the first language by name. An empty table gives no rows; repeated
    doc_ids keep their rows; other columns are ignored.
    Returns doc_id, held_out, lang_pred, score (cosine to the nearest centroid), rejected (nearest centroid farther than all
    but the farthest 0.5 % of its language's own rows, by half as much again).
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", held)
    teach = rows.where(~F.col("held_out") & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())

    def present(batch, counts):
        yield pa.RecordBatch.from_pydict({"n": [counts.shape[0]], "df": [(counts > 0).sum(0).astype(np.int64)]})

    grams = _counted(teach.select("doc_id", "text"), present, "n long, df array<long>")
    df = grams.select("n", F.posexplode("df").alias("gram", "df")).groupBy("gram").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).toPandas()
    idf = np.ones(GRAMS)
    if len(df):
        idf[df["gram"]] = np.log((1 + df["n"]) / (1 + df["df"])) + 0.05

    # a language's rows may be a third of all: only those with small hashes, about four times the sample, are ranked; the counts,
    # one row per language as the model has several, are broadcast, else every row would go to its language's task first
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 24)
    sizes = teach.groupBy("lang").agg(F.count("*").alias("taught"))
    near = teach.select("doc_id", "lang").join(F.broadcast(sizes), "lang").where(place <= F.lit(float(1 << 40)) * 4 * sample / F.col("taught"))
    first = Window.partitionBy("lang").orderBy(place, "doc_id")
    some = near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= sample).select("doc_id").distinct()

    def sparse(batch, counts):
        at = [np.flatnonzero(c) for c in counts]
        yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), batch.column(4), pa.array(at, pa.list_(pa.int32())), pa.array([c[i] for c, i in zip(counts, at, strict=True)], pa.list_(pa.float32()))], names=["lang", "place", "h", "gram", "count"])

    chosen = teach.join(F.broadcast(some), "doc_id").select("doc_id", "text", "lang", place.alias("place"), F.xxhash64("doc_id", "text").alias("h"))
    taken = _counted(chosen, sparse, "lang string, place long, h long, gram array<int>, count array<float>")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["place", "h"], kind="stable").head(sample)  # repeated ids may bring more
        x = np.zeros((len(part), GRAMS))
        for r, (g, c) in enumerate(zip(part["gram"], part["count"], strict=True)):
            x[r, g] = c
        x = vectors(x, idf)
        x = x[np.linalg.norm(x, axis=1) > 0]
        if not len(x):
            return pd.DataFrame({"lang": [], "limit": [], "c": []})
        c = centroids(x, per_language)
        limit = 1.5 * np.quantile(1 - (x @ c.T).max(1), 0.995)
        return pd.DataFrame({"lang": part["lang"].iloc[0], "limit": limit, "c": list(c)})

    model = taken.groupBy("lang").applyInPandas(fit, "lang string, limit double, c array<double>").toPandas().sort_values("lang", kind="stable")
    names, limits = model["lang"].to_numpy(), model["limit"].to_numpy()
    c = np.vstack(model["c"].to_numpy()).astype(np.float32) if len(model) else np.zeros((0, GRAMS), np.float32)
    weight = idf.astype(np.float32)

    def predict(batch, counts):
        texts = batch.column(1).to_pylist()
        letter = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
        best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        if len(c):
            s = vectors(counts.astype(np.float32), weight) @ c.T
            best, score = s.argmax(1), np.clip(s.max(1), 0, 1).astype(float)
        else:
            letter[:] = False
        score[~letter] = 0
        said = ["und" if not ok else names[b] for ok, b in zip(letter, best, strict=True)]
        far = ~letter if not len(c) else ~letter | (1 - score > limits[best])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(said, pa.string()), pa.array(score), pa.array(far)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return _counted(rows.select("doc_id", "text", "held_out"), predict, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
