"""Byte-level BPE by ranks, over overlapping chunks.

A long text is cut into chunks that overlap. Chunks are pre-tokenised in parallel; a chunk but the first begins anywhere, so
its first boundaries may be wrong, and those near its cut end too. A boundary of the chunk before, far enough from that
chunk's end, at which this chunk has one as well, is where both agree: the pattern looks only ahead, so what follows a
boundary depends on the text behind it alone. There the text is stitched: the pieces between such places are encoded in
parallel, each match of the pattern by itself, and their ids follow each other. Where an overlap has no such place (one
match longer than it), the chunks from there on to the text's end are one piece. Decoding concatenates the bytes of ids.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KEPT, STEP_BYTES, written
from .tokens import MEMORY_BYTES, UNIT_BYTES, text_steps

#: Code points of a chunk, and by how many it reaches into the next one.
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: Matches that end so near to a chunk's cut end may be other ones in the text: the longest literal of the pattern, and one code point of lookahead.
MARGIN = 4
#: Matches of more bytes are merged with a heap, shorter ones by looking at all of their pairs.
SHORT_BYTES = 48


def read_ranks(path: str) -> dict[bytes, int]:
    """The token bytes and their ranks of a file with lines `base64 rank`."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class RankBPE:
    """Merges bytes by rank: of all neighbours whose joint bytes have a rank, those with the least rank merge, the leftmost first."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        size = max(self.ranks.values(), default=-1) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"no rank for bytes {missing[:5]}")
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def merge(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        return self._merge_short(piece) if len(piece) <= SHORT_BYTES else self._merge_long(piece)

    def _merge_short(self, piece: bytes) -> list[int]:
        none = len(self.tokens)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = [self.ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = self.ranks.get(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = self.ranks.get(parts[i] + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with links to the neighbours and a heap of (rank, place); a stale entry's bytes are no longer those of its rank."""
        n = len(piece)
        end, before, ranks = list(range(1, n + 1)), list(range(-1, n - 1)), self.ranks
        live = bytearray(b"\1") * n
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and end[i] < n and (r := ranks.get(piece[i : end[end[i]]])) is not None:
                heapq.heappush(heap, (r, i))

        while heap:
            rank, i = heapq.heappop(heap)
            if not live[i] or (j := end[i]) >= n or piece[i : end[j]] != self.tokens[rank]:
                continue
            live[j] = 0
            end[i] = end[j]
            if end[i] < n:
                before[end[i]] = i
            offer(before[i])
            offer(i)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text, or of a part between two of its boundaries, as little-endian unsigned 32-bit integers."""
        words = self.pattern.findall(text)
        known = self.known
        if new := set(words).difference(known):
            made = {w: np.array(self.merge(w.encode()), "<u4").tobytes() for w in new}
            size = UNIT_BYTES * len(made) + sum(map(len, made)) + sum(map(len, made.values()))
            if self.held + size > MEMORY_BYTES:
                return b"".join([x if (x := known.get(w)) is not None else made[w] for w in words])
            self.held += size
            known.update(made)
        return b"".join(map(known.__getitem__, words))

    def bounds(self, text: str) -> np.ndarray:
        """Where matches end, in code points; they cover the text."""
        return np.cumsum(np.fromiter(map(len, self.pattern.findall(text)), np.int64))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def _coder(path: str, pattern: str) -> RankBPE:
    """One per worker, with what it remembers of matches (MEMORY_BYTES at most); the next operator drops it."""
    KEPT[:] = [_coder.cache_clear]
    return RankBPE(path, pattern)


def chunks_of(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, bool, str]]:
    """(number, whether it is the last, code points) of the chunks of a text; each but the last reaches `overlap` into the next ones."""
    last = max(0, -(-len(text) // chunk) - 1)
    for k in range(last + 1):
        yield k, k == last, text[k * chunk : (k + 1) * chunk + overlap]


def sync_marks(bounds: np.ndarray, length: int, last: bool, chunk: int, overlap: int, margin: int = MARGIN) -> tuple[np.ndarray, np.ndarray]:
    """(head, tail) of a chunk: its boundaries in the first `overlap` code points, and those in the next chunk's first ones that
    its cut end can't have moved, counted from that chunk's start."""
    head = np.r_[0, bounds[bounds <= overlap]]
    end = length if last else length - margin
    tail = bounds[(bounds >= chunk) & (bounds <= end)] - chunk
    return head.astype(np.int32), tail.astype(np.int32)


def _long_ids(long: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(doc_id, ids) of long texts: their chunks are rows of their own."""

    def cut(batches):
        for batch in batches:
            for i, texts in text_steps(batch.column(2), STEP_BYTES):
                for key, digest, text in zip(batch.column(0).slice(i, len(texts)).to_pylist(), batch.column(1).slice(i, len(texts)).to_pylist(), texts, strict=True):
                    rows = list(chunks_of(text, chunk, overlap))
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(rows), pa.int64()), pa.array([digest] * len(rows), pa.string()), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.string()), strict=True))], names=["doc_id", "digest", "k", "last", "chunk"])

    def mark(batches):
        for batch in batches:
            coder = _coder(path, pattern)
            marks = [sync_marks(coder.bounds(t), len(t), end, chunk, overlap) for t, end in zip(batch.column(5).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([m[j] for m in marks], pa.list_(pa.int32())) for j in (0, 1))], names=[*batch.schema.names, "head", "tail"])

    parts = long.mapInArrow(cut, "doc_id long, digest string, k int, last boolean, chunk string")
    # equal rows are one text with a count; whatever its id, a text's chunks are dealt evenly
    parts = parts.groupBy("doc_id", "digest", "k").agg(F.first("last").alias("last"), F.count("*").alias("copies"), F.first("chunk").alias("chunk"))
    parts = parts.select("doc_id", "digest", "k", "last", "copies", "chunk")
    marked = written(parts.mapInArrow(mark, "doc_id long, digest string, k int, last boolean, copies long, chunk string, head array<int>, tail array<int>"))
    text = Window.partitionBy("doc_id", "digest").orderBy("k")
    so_far = text.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    agreed = F.array_min(F.array_intersect("head", F.lag("tail").over(text)))
    sync = marked.select("doc_id", "digest", "k", F.when(F.col("k") == 0, 0).otherwise(agreed).alias("sync"))
    sync = sync.withColumn("lost", F.max(F.col("sync").isNull()).over(so_far))
    # run: the last chunk that is stitched; it takes in all chunks behind the first place that isn't
    sync = sync.withColumn("run", F.max(F.when(~F.col("lost"), F.col("k"))).over(so_far))
    sync = sync.withColumn("stop", F.lead(F.when(~F.col("lost"), F.col("sync"))).over(text))
    sync = sync.withColumn("lost_next", F.lead("lost").over(text)).select("doc_id", "digest", "k", "run", F.when(~F.col("lost"), F.col("sync")).alias("start"), F.when(~F.coalesce("lost_next", F.lit(False)), F.col("stop")).alias("stop"))
    same_text = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("doc_id", "digest", "k")]
    pieces = marked.drop("head", "tail").alias("l").join(sync.alias("r"), same_text).select("l.doc_id", "l.digest", "r.run", "l.k", "l.last", "l.copies", "l.chunk", "r.start", "r.stop")

    def encode(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        rows = table.to_pylist()
        # chunks of a run without their overlaps, but for the last, which gives what its stitch says
        body = [r["chunk"][:chunk] for r in rows[:-1]]
        tail = rows[-1]["chunk"]
        tail = tail if rows[-1]["last"] else tail[: chunk + rows[-1]["stop"]]
        text = "".join([*body, tail])[rows[0]["start"] :]
        first = table.slice(0, 1)
        return pa.table([first["doc_id"], first["digest"], first["run"], first["copies"], pa.array([_coder(path, pattern).encode(text)], pa.binary())], names=["doc_id", "digest", "run", "copies", "ids"])

    encoded = pieces.groupBy("doc_id", "digest", "run").applyInArrow(encode, "doc_id long, digest string, run int, copies long, ids binary")

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("run")
        ids = b"".join(table["ids"].to_pylist())
        first = table.slice(0, 1)
        return pa.table([first["doc_id"], first["copies"], pa.array([ids], pa.binary())], names=["doc_id", "copies", "ids"])

    whole = encoded.groupBy("doc_id", "digest").applyInArrow(join, "doc_id long, copies long, ids binary")
    return whole.select("doc_id", "ids", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", "ids")


def encode_chunked(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Byte-level BPE of every whole text of docs(doc_id, text) by the ranks in `path`, each match of `pattern` by itself.

    pattern must match at every place of a text, have no lookbehind, look at most one code point ahead of a match, and no
    literal of more than MARGIN - 1 code points. Texts of more than `chunk` code points are encoded in chunks that overlap by
    `overlap`; the others are one chunk. Null and empty texts have no ids. Null and repeated doc_ids and repeated rows give a
    row each, an empty table none; other columns are ignored. Returns doc_id, n_tokens, ids (binary: little-endian unsigned
    32-bit integers).
    """
    if not MARGIN < overlap <= chunk:
        raise ValueError(f"overlap must be more than {MARGIN} and at most chunk")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))

    def short(batches):
        for batch in batches:
            for i, texts in text_steps(batch.column(1), STEP_BYTES):
                coder = _coder(path, pattern)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(texts)), pa.array([coder.encode(t) for t in texts], pa.binary())], names=["doc_id", "ids"])

    near = rows.where(~is_long).mapInArrow(short, "doc_id long, ids binary")
    far = _long_ids(rows.where(is_long).select("doc_id", F.sha2("text", 256).alias("digest"), "text"), path, pattern, chunk, overlap)
    return near.union(far).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def decode_ids(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """rows(doc_id, n_tokens, ids) of encode_chunked with `decoded`: the bytes that the ids stand for, in a row; null ids stay null."""

    def run(batches):
        for batch in batches:
            ids = batch.column(2)
            for i in range(0, batch.num_rows, 256):
                coder = _coder(path, pattern)
                back = [None if x is None else coder.decode(x) for x in ids.slice(i, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 256).columns, pa.array(back, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return rows.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
