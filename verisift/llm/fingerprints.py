"""Fingerprints by locally consistent parsing: deterministic coin tossing names phrases of phrases, whatever their offset."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_of_runs, mix, range_hashes

#: Slots of a fingerprint; levels of phrases, of which the last two are sketched; rounds of coin tossing in each.
SLOTS, LEVELS, ROUNDS = 64, 3, 3
_EMPTY = 0xFFFF
#: Runs of the descending order per partition; several even out how the runs' hashes fall.
RUNS_PER_PARTITION = 8


def _names(symbols: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A name for each run of symbols that begins at a cut."""
    return range_hashes(symbols, cuts, np.r_[cuts[1:], len(symbols)])


def phrases(symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: (names, texts) of the phrases.

    Runs of one symbol become one symbol. Then each symbol gets twice the lowest bit in which it differs from the one
    before, plus that bit; after a few rounds the labels are few, neighbours still differ, and phrases begin at their local
    minima. A label depends on a few symbols before it alone, so equal substrings fall into equal phrases but at their rims.
    """
    edge = np.ones(len(symbols), bool)
    edge[1:] = (symbols[1:] != symbols[:-1]) | (doc[1:] != doc[:-1])
    run = np.flatnonzero(edge)
    length = np.diff(np.r_[run, len(symbols)]).astype(np.uint64)
    x, doc = symbols[run], doc[run]
    x = np.where(length > 1, mix(x + length * np.uint64(0x9E3779B97F4A7C15)), x)
    head = np.ones(len(x), bool)
    head[1:] = doc[1:] != doc[:-1]
    a = x
    for _ in range(ROUNDS):
        d = a.copy()
        d[1:] ^= a[:-1]
        low = d & (~d + np.uint64(1))
        at = np.bitwise_count(low - np.uint64(1)).astype(np.uint64)
        at[(d == 0) | head] = 0
        a = (at << np.uint64(1)) | ((a >> at) & np.uint64(1))
    begin = head.copy()
    if len(a) > 2:
        begin[1:-1] |= (a[1:-1] < a[:-2]) & (a[1:-1] <= a[2:]) & ~head[2:]
    cuts = np.flatnonzero(begin)
    return _names(x, cuts), doc[cuts]


def sketches(texts: list[str]) -> np.ndarray:
    """texts by SLOTS: the least hash of the phrase names that fall into a slot, 16 bits, or _EMPTY."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(len(texts) * SLOTS, np.uint64(0xFFFFFFFFFFFFFFFF))
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in texts])
    x = mix(chars.astype(np.uint64) + np.uint64(1))
    held = []
    for level in range(LEVELS):
        if not len(x):
            break
        x, doc = phrases(x, doc)
        if level >= LEVELS - 2:
            held.append((mix(x ^ np.uint64(level + 1)), doc))
    if held:
        h, d = (np.concatenate(v) for v in zip(*held, strict=True))
        key = d * SLOTS + (h & np.uint64(SLOTS - 1)).astype(np.int64)
        o = np.lexsort((h, key))
        at = first_of_runs(key[o])
        out[key[o][at]] = h[o][at]
    low = ((out >> np.uint64(8)) % np.uint64(_EMPTY)).astype(np.uint16)
    low[out == np.uint64(0xFFFFFFFFFFFFFFFF)] = _EMPTY
    return low.reshape(len(texts), SLOTS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the slots that either fills in which both agree; 1 for two empty fingerprints."""
    used = (a != _EMPTY) | (b != _EMPTY)
    same = used & (a == b)
    n = used.sum(1)
    return np.where(n > 0, same.sum(1) / np.maximum(n, 1), 1.0)


def fingerprint_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u2").tobytes().hex()


def _neighbours(docs: DataFrame) -> DataFrame:
    """docs dealt into runs of the descending order of doc_id, each run ended by a copy (`extra`) of the row that follows it.

    One exchange of the texts. The driver holds the runs' bounds and largest ids, one each per partition.
    """
    spark = docs.sparkSession
    n = RUNS_PER_PARTITION * (parts := int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("at", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))))
    cuts = rows.where("doc_id is not null").approxQuantile("at", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    bounds = [float("-inf"), *(sorted({c for c in cuts or [] if c is not None}) or [0.0]), float("inf")]
    rows = Bucketizer(splits=bounds, inputCol="at", outputCol="run").transform(rows).withColumn("run", F.col("run").cast("int"))
    rows = rows.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    tops = {r["run"]: r["top"] for r in rows.groupBy("run").agg(F.max("id").alias("top")).collect()}
    there = sorted(tops)
    if not there:
        return rows.select("run", F.lit(False).alias("extra"), "id", "doc_id", "text")
    above = {r: there[(i + 1) % len(there)] for i, r in enumerate(there)}
    size = len(bounds) - 1
    top = F.array(*[F.lit(tops.get(r, 0)).cast("long") for r in range(size)])
    to = F.array(*[F.lit(above.get(r, 0)) for r in range(size)])
    own = F.struct(F.col("run"), F.lit(False).alias("extra"))
    copy = F.struct(to[F.col("run")].alias("run"), F.lit(True).alias("extra"))
    placed = F.when(F.col("id") == top[F.col("run")], F.array(own, copy)).otherwise(F.array(own))
    dealt = rows.select(F.explode(placed).alias("p"), "id", "doc_id", "text").select("p.run", "p.extra", "id", "doc_id", "text")
    return dealt.repartition(parts, "run").sortWithinPartitions("run", "extra", F.col("id").desc(), F.col("text").asc_nulls_first())


def fingerprint_documents(docs: DataFrame, batch_chars: int = 1 << 19) -> DataFrame:
    """Fingerprints of every whole text of docs(doc_id, text), of its edited text, and their likeness.

    The next document is the one with the next smaller doc_id, after the last the first (a single row is its own next);
    null doc_ids come last, repeated ones are ordered by text. In the edited text the last floor(n_chars / 2) code points
    are replaced by the first as many (or all) of the next document. Null texts are empty; fingerprints of empty texts are
    all blank slots and alike. An empty table gives no rows; other columns are ignored.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def emit(rows, following):
        texts = [t for _, t in rows] + [following]
        edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts[:-1], texts[1:], strict=True)]
        own, other = sketches(texts), sketches(edited)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _ in rows], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                pa.array(map(fingerprint_text, own[:-1])), pa.array(map(fingerprint_text, other)), pa.array(likeness(own[:-1], other)), pa.array(likeness(own[:-1], own[1:])),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches):
        rows, chars, now, ended = [], 0, None, True
        for batch in batches:
            for at, extra, key, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                text = text or ""
                if at != now:
                    now, ended = at, False
                if ended:
                    continue
                if rows and (extra or chars >= batch_chars):
                    yield emit(rows, text)
                    rows, chars = [], 0
                if extra:
                    ended = True
                else:
                    rows.append((key, text))
                    chars += len(text)

    return _neighbours(docs).mapInArrow(run, schema)
