"""Substring deduplication by de Bruijn compaction.

Windows of `span` words are the edges of a de Bruijn graph over the corpus. Edges that one document alone holds take no part.
Of the others each learns whether all its occurrences share one successor and one predecessor, text ends counting as such.
Edges linked without a branch compact into paths; since every document that enters a path runs through all of it, a path is
a run of linked edges in each of its documents, and its words lie at source coordinates (text, first word, length). The
digest of the words at these coordinates verifies the path, and the smallest doc_id per digest keeps its words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import group_count, steps, text_bytes, windows, words, written
from .packed import Answers, Group, answered, dealt, sent

SPAN, MINIMIZER = 13, 6
#: A digest's path rows are joined in parts of so many groups.
SALT_GROUPS = 16
_END, _MANY = np.uint64(1), np.uint64(0)
_REPEATED, _ONE_NEXT, _ONE_PREVIOUS = 1, 2, 4


class _Edges:
    """The windows of a step's texts: position of the first word, text, hash and minimizer."""

    def __init__(self, data, off, span):
        self.h, self.start, self.stop, self.first = words(data, off)
        n = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(self.h))
        last = self.first[1:][self.doc] if len(n) else at
        self.at = at[at + span <= last]
        self.last = last[self.at]
        self.span = span

    def edges(self, at):
        return windows(self.h, self.span)[at]

    def minimizers(self):
        """The least hash of MINIMIZER words in each window. A window that repeats brings its minimizer along."""
        k = min(MINIMIZER, self.span)
        small = windows(self.h, k)
        m = len(self.h) - self.span + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        out = small[:m].copy()
        for j in range(1, self.span - k + 1):
            np.minimum(out, small[j : m + j], out=out)
        return out[self.at]


def _distinct(h: np.ndarray, ids: np.ndarray, *more: np.ndarray):
    """Distinct hashes, whether two ids hold one, and each further column where it is the same throughout, else _MANY."""
    order = np.argsort(h, kind="stable")
    h, ids = h[order], ids[order]
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    if not len(at):
        return (h, np.zeros(0, np.uint8), *[np.zeros(0, np.uint64) for _ in more])
    low = lambda v: np.minimum.reduceat(v, at)
    high = lambda v: np.maximum.reduceat(v, at)
    return (h[at], (low(ids) != high(ids)).astype(np.uint8), *[np.where(low(v[order]) == high(v[order]), low(v[order]), _MANY) for v in more])


def _each(group: Group, span: int):
    """(first row, edges, ids of the windows) of a group's steps; rows without id have no windows."""
    for i, j in steps(group.off):
        e = _Edges(group.data[group.off[i] : group.off[j]], group.off[i : j + 1] - group.off[i], span)
        known = ~group.null[i:j][e.doc[e.at]]
        e.at, e.last = e.at[known], e.last[known]
        yield i, e, group.ids[i:j][e.doc[e.at]]


def repeated_spans(docs: DataFrame, span: int = SPAN, groups: int | None = None, keep_columns: bool = False) -> tuple[DataFrame, DataFrame]:
    """(dealt documents, paths). A path row: g, digest, keeper (the smallest doc_id that holds its words), places.

    places: per occurrence in g three 32-bit numbers: the row of the group in the order of Group, first word, words."""
    groups = groups or group_count(text_bytes(docs))
    rows = dealt(docs, groups, keep_columns)

    def send_minimizers(table):
        group = Group(table)
        parts = [(e.minimizers(), ids) for _, e, ids in _each(group, span)]
        h, many = _distinct(np.concatenate([p[0] for p in parts] or [np.zeros(0, np.uint64)]), np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int64)]))
        return sent(group.g, h, {"many": many}, groups)

    minimizers = rows.groupBy("g").applyInArrow(send_minimizers, "b int, g int, keys binary, many binary")
    again = lambda starts, per, c: ((per > 1) | (np.maximum.reduceat(c["many"], starts) > 0)).astype(np.uint8)
    candidates = answered(minimizers, {"many": "u1"}, again)

    def send_edges(table, back):
        group, known = Group(table), Answers(back, groups)
        parts = []
        for _, e, ids in _each(group, span):
            hit = known.of(e.minimizers()) > 0
            at, last, ids = e.at[hit], e.last[hit], ids[hit]
            head = e.first[:-1][e.doc[at]]
            after = np.where(at + span < last, e.h[np.minimum(at + span, len(e.h) - 1)] | np.uint64(2), _END) if len(at) else np.zeros(0, np.uint64)
            before = np.where(at > head, e.h[np.maximum(at - 1, 0)] | np.uint64(2), _END) if len(at) else np.zeros(0, np.uint64)
            parts.append((e.edges(at), ids, after, before))
        parts = parts or [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
        h, many, after, before = _distinct(*[np.concatenate(x) for x in zip(*parts, strict=True)])
        return sent(group.g, h, {"many": many, "after": after, "before": before}, groups)

    def degrees(starts, per, c):
        one = {}
        for k in ("after", "before"):
            low = np.minimum.reduceat(c[k], starts)
            one[k] = (low == np.maximum.reduceat(c[k], starts)) & (low != _MANY)
        out = _REPEATED + _ONE_NEXT * one["after"] + _ONE_PREVIOUS * one["before"]
        return np.where((per > 1) | (np.maximum.reduceat(c["many"], starts) > 0), out, 0).astype(np.uint8)

    edges = rows.groupBy("g").cogroup(candidates.groupBy("g")).applyInArrow(send_edges, "b int, g int, keys binary, many binary, after binary, before binary")
    repeated = answered(edges, {"many": "u1", "after": "u8", "before": "u8"}, degrees)

    def compact(table, back):
        group, known = Group(table), Answers(back, groups)
        found: dict[bytes, list] = {}
        for i, e, ids in _each(group, span):
            flags = known.of(e.edges(e.at))
            hit = np.flatnonzero(flags & _REPEATED)
            if not len(hit):
                continue
            at, f, d = e.at[hit], flags[hit], e.doc[e.at[hit]]
            joined = (at[1:] == at[:-1] + 1) & (d[1:] == d[:-1]) & (f[:-1] & _ONE_NEXT > 0) & (f[1:] & _ONE_PREVIOUS > 0)
            begin = np.flatnonzero(np.r_[True, ~joined])
            end = np.r_[begin[1:], len(at)] - 1
            base = group.off[i]
            lo, hi = at[begin], at[end] + span
            bytes_ = group.data[base : group.off[-1]]
            for a, z, r, k in zip(lo.tolist(), hi.tolist(), d[begin].tolist(), ids[hit[begin]].tolist(), strict=True):
                digest = hashlib.md5(b" ".join(bytes_[e.start[a] : e.stop[z - 1]].tobytes().split())).digest()
                x = found.setdefault(digest, [k, k, []])
                x[0], x[1] = min(x[0], k), max(x[1], k)
                x[2] += (i + r, a - int(e.first[r]), z - a)
        return pa.table({
            "g": pa.array([group.g] * len(found), pa.int32()), "digest": pa.array(list(found), pa.binary()), "low": pa.array([x[0] for x in found.values()], pa.int64()), "high": pa.array([x[1] for x in found.values()], pa.int64()),
            "places": pa.array([np.array(x[2], np.int32).tobytes() for x in found.values()], pa.binary()),
        })

    paths = rows.groupBy("g").cogroup(repeated.groupBy("g")).applyInArrow(compact, "g int, digest binary, low long, high long, places binary")
    return rows, _kept_by_first(written(paths))


def _kept_by_first(paths: DataFrame) -> DataFrame:
    """(g, digest, keeper, places) of the path rows in which a larger doc_id than the keeper occurs.

    A digest that a third of all documents hold has a row in every group. It is split by SALT_GROUPS groups each: what is known
    of a part (one small row) learns the smallest doc_id of the digest, and only then are the places, as many as the
    occurrences, joined, by digest and part."""
    paths = paths.withColumn("part", F.floor(F.col("g") / SALT_GROUPS).cast("int"))
    parts = paths.groupBy("digest", "part").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    whole = Window.partitionBy("digest")
    keepers = parts.select("digest", "part", F.min("low").over(whole).alias("keeper"), F.max("high").over(whole).alias("top")).where("top > keeper")
    return paths.join(keepers.drop("top"), ["digest", "part"]).where(F.col("high") > F.col("keeper")).select("g", "digest", "keeper", "places")


def _marked(group: Group, back: pa.Table) -> dict[int, list[tuple[int, int]]]:
    out: dict[int, list[tuple[int, int]]] = {}
    for keeper, raw in zip(back.column("keeper").to_pylist(), back.column("places"), strict=True):
        for r, a, n in np.frombuffer(raw.as_buffer(), np.int32).reshape(-1, 3).tolist():
            if group.ids[r] > keeper:
                out.setdefault(r, []).append((a, n))
    return out


def dedup_substrings(docs: DataFrame, span: int = SPAN, groups: int | None = None, with_text: bool = False, keep_columns: bool = False) -> DataFrame:
    """Removes each word of docs(doc_id, text) under a window of `span` words that a document with a smaller doc_id holds as well.

    Words are [^\\x20\\x09-\\x0D]+, unchanged. Null and empty texts, and texts of fewer than `span` words, lose nothing. Rows
    with a null doc_id neither lose words nor cost others theirs; rows of one doc_id do not act on each other. An empty table
    gives no rows; other columns are ignored. Returns doc_id, n_words, n_removed, kept_sha256 (kept words joined by one
    space); with_text adds kept_text: the kept words so joined, or the text itself where no word was removed;
    keep_columns adds the other columns, by their places, as a struct `rest`.
    """
    rows, paths = repeated_spans(docs, span, groups, keep_columns)

    def remove(table, back):
        group = Group(table)
        marked = _marked(group, back)
        texts = group.table.column("text").to_pylist()
        out = []
        for r, text in enumerate(texts):
            w = (text or "").encode().split()
            n = len(w)
            if r in marked:
                gone = np.zeros(n + 1, np.int32)
                for a, k in marked[r]:
                    gone[a] += 1
                    gone[a + k] -= 1
                w = [x for x, g in zip(w, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]
            kept = b" ".join(w)
            row = (None if group.null[r] else int(group.ids[r]), n, n - len(w), hashlib.sha256(kept).hexdigest())
            out.append((*row, kept.decode() if n > len(w) else text) if with_text else row)
        kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()} | ({"kept_text": pa.string()} if with_text else {})
        table = pa.table({k: pa.array([x[i] for x in out], t) for i, (k, t) in enumerate(kinds.items())})
        return table.append_column("rest", group.table.column("rest")) if keep_columns else table

    schema = StructType().add("doc_id", "long").add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    schema = schema.add("kept_text", "string") if with_text else schema
    schema = schema.add(rows.schema["rest"]) if keep_columns else schema
    return rows.groupBy("g").cogroup(paths.groupBy("g")).applyInArrow(remove, schema)


def keep_first_spans(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """docs with all its columns, whatever their names, repeated spans taken out of `text`, and `n_chars` set anew where there is such
    a column.

    Texts without a removed word stay as they are, null and empty ones too; rows that lose every word go. Rows with a null doc_id
    lose nothing; rows of one doc_id, repeated ones too, do not act on each other. An empty table stays empty."""
    done = dedup_substrings(docs, span, with_text=True, keep_columns=True).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))

    def value(i: int, c: str):
        if c in ("doc_id", "text"):
            return F.col("doc_id" if c == "doc_id" else "kept_text").cast(docs.schema[i].dataType)
        own = F.col(f"rest.c{i}")
        return F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema[i].dataType)).otherwise(own) if c == "n_chars" else own

    return done.select(*[value(i, c).alias(c) for i, c in enumerate(docs.columns)])
