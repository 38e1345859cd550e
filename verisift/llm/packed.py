"""Packed shuffles: groups of documents send sorted keys to buckets as binary rows, buckets answer with the repeated keys.

A group is all documents whose id hashes to it, about GROUP_BYTES of text, so rows of one id lie in one group. Each group
sends a key once at most, so a key that a third of all documents hold reaches its bucket once per group. Buckets cut the
hash range evenly and are as many as the groups, so that a bucket's size does not grow with the input.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, first_of_runs, key_of, pack40, quoted, text_buffer, unpack40


def dealt(docs: DataFrame, groups: int, keep_columns: bool = False) -> DataFrame:
    """(g, doc_id, text), and the other columns by place (c0, c1, ...) as a struct `rest`; a null doc_id is dealt by its text."""
    h = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    rest = [F.struct(F.lit(0).alias("none"), *[quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]).alias("rest")] if keep_columns else []
    return docs.select(F.pmod(h, F.lit(groups)).cast("int").alias("g"), F.col("doc_id").cast("long").alias("doc_id"), "text", *rest)


class Group:
    """A group's rows in a fixed order: by doc_id (nulls last), then text."""

    def __init__(self, table: pa.Table):
        self.g = table.column("g")[0].as_py() if table.num_rows else -1
        ids = table.column("doc_id")
        self.null = np.asarray(ids.is_null())
        self.ids = ids.fill_null(0).to_numpy().astype(np.int64)
        order = np.lexsort((self.ids, self.null))
        sorted_ids, sorted_null = self.ids[order], self.null[order]
        if (((sorted_ids[1:] == sorted_ids[:-1]) & (sorted_null[1:] == sorted_null[:-1])).any()) if len(order) > 1 else False:
            texts = table.column("text").to_pylist()
            order = np.array(sorted(range(len(texts)), key=lambda i: (self.null[i], self.ids[i], texts[i] is not None, texts[i] or "")))
        if (order != np.arange(len(order))).any():
            table = table.take(pa.array(order))
        self.ids, self.null, self.table = self.ids[order], self.null[order], table
        self.data, self.off = text_buffer(table.column("text"))


def sent(g: int, h: np.ndarray, columns: dict[str, np.ndarray], buckets: int) -> pa.Table:
    """Rows (b, g, keys, columns...) for distinct ascending hashes h."""
    b = bucket_of(h, buckets).astype(np.int64)
    at = first_of_runs(b)
    ends = np.r_[at[1:], len(b)].astype(np.int64)[: len(at)]
    packed = {"keys": (pack40(h & np.uint64((1 << 40) - 1)), 5)} | {k: (np.ascontiguousarray(v).tobytes(), v.dtype.itemsize) for k, v in columns.items()}
    cut = {k: pa.array([raw[i * w : j * w] for i, j in zip(at.tolist(), ends.tolist(), strict=True)], pa.binary()) for k, (raw, w) in packed.items()}
    return pa.table({"b": pa.array(b[at].astype(np.int32) if len(at) else [], pa.int32()), "g": pa.array([g] * len(at), pa.int32()), **cut})


def answered(rows: DataFrame, kinds: dict[str, str], decide: Callable, answer: str = "flags") -> DataFrame:
    """Rows (g, b, keys, flags): what decide says of each bucket's keys, for those keys of each group that it does not call 0.

    decide(starts, groups, columns) gets the entries in key order, the first entry of each key, and how many groups sent it;
    it returns one uint8 per key."""

    def run(table: pa.Table) -> pa.Table:
        b = table.column("b")[0].as_py()
        gs = table.column("g").to_numpy()
        keys = [unpack40(x.as_buffer()) for x in table.column("keys")]
        sizes = np.array([len(k) for k in keys])
        key = np.concatenate(keys)
        owner = np.repeat(np.arange(len(gs)), sizes)
        order = np.argsort(key, kind="stable")
        starts = first_of_runs(key[order])
        per = np.diff(np.r_[starts, len(key)])
        columns = {k: np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table.column(k)])[order] for k, t in kinds.items()}
        said = np.empty(len(key), np.uint8)
        said[order] = np.repeat(decide(starts, per, columns), per)
        keep = said > 0
        key, said = key[keep], said[keep]
        kept = np.bincount(owner[keep], minlength=len(gs))
        ends = np.cumsum(kept)
        raw, flag = pack40(key), said.tobytes()
        out = [(g, raw[5 * (e - n) : 5 * e], flag[e - n : e]) for g, n, e in zip(gs.tolist(), kept.tolist(), ends.tolist(), strict=True) if n]
        return pa.table({"g": pa.array([x[0] for x in out], pa.int32()), "b": pa.array([b] * len(out), pa.int32()), "keys": pa.array([x[1] for x in out], pa.binary()), answer: pa.array([x[2] for x in out], pa.binary())})

    return rows.groupBy("b").applyInArrow(run, f"g int, b int, keys binary, {answer} binary")


class Answers:
    """The keys that came back to a group, for lookup by hash."""

    def __init__(self, table: pa.Table, buckets: int, answer: str = "flags"):
        self.buckets = buckets
        if not table.num_rows:
            self.keys, self.flags = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
            return
        keys = np.concatenate([unpack40(k.as_buffer()) | np.uint64(b << 40) for b, k in zip(table.column("b").to_pylist(), table.column("keys"), strict=True)])
        flags = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column(answer)])
        order = np.argsort(keys)
        self.keys, self.flags = keys[order], flags[order]

    def of(self, h: np.ndarray) -> np.ndarray:
        """The answer for each hash, 0 where its key did not come back."""
        if not len(self.keys) or not len(h):
            return np.zeros(len(h), np.uint8)
        want = key_of(h, self.buckets)
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.flags[at], 0).astype(np.uint8)
