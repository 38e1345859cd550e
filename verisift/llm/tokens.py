"""Byte-level BPE: encoding by a pair occurrence index, decoding, and cached encoding of the units between single spaces."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import KEPT, STEP_BYTES

#: The byte-level pre-tokeniser's pattern; fixed by the vocabulary's format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a step: a step's new units are encoded at once.
STEP_CHARS = 4 << 20
#: Bytes of units and their ids that a worker remembers about; further units are encoded anew.
MEMORY_BYTES = 64 << 20
#: What Python needs for a remembered unit besides its characters and ids.
UNIT_BYTES = 200
#: Characters of units that the library encodes as one run.
RUN_CHARS = 1 << 10


def byte_symbols() -> dict[int, str]:
    """The printable symbol that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PairIndexBPE:
    """Encodes many words at once.

    All words lie in one array of symbols with links to the neighbours. An index maps each rank to the positions at which
    its pair stands. Active ranks are taken in ascending order from a heap; a rank's positions that still hold its pair
    merge from left to right, and the pairs that this makes are filed under their ranks. A new pair holds the symbol just
    made, which in a trained vocabulary only later ranks use, so no rank comes back; other vocabularies are refused.
    """

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        symbols = byte_symbols()
        vocab = spec["model"]["vocab"]
        back = {s: b for b, s in symbols.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: bytes(back[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.added.items()}
        self.first = np.array([vocab[symbols[b]] for b in range(256)], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        used = np.full(max(self.bytes) + 1, len(merges))
        np.minimum.at(used, np.r_[left, right], np.r_[np.arange(len(merges)), np.arange(len(merges))])
        if (used[self.made] <= np.arange(len(merges))).any():
            raise ValueError("a merge uses a symbol that a later one makes")
        self.left, self.right = left.tolist(), right.tolist()
        pairs = (left << 32) | right
        self.by_pair = np.argsort(pairs, kind="stable")
        self.pairs = pairs[self.by_pair]
        self.word = regex.compile(PATTERN)
        self.split = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.kind = np.dtype("<u2" if max(self.bytes) < 1 << 16 else "<u4")
        self.decimal = {i: str(i) for i in self.bytes}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it has none."""
        want = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pairs, want), len(self.pairs) - 1)
        return np.where(self.pairs[at] == want, self.by_pair[at], -1)

    def encode_words(self, items: list[bytes]) -> list[list[int]]:
        raw = np.frombuffer(b"".join(items), np.uint8)
        n = len(raw)
        if not n:
            return [[] for _ in items]
        ends = np.cumsum([len(x) for x in items])
        sym = self.first[raw]
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[ends[ends > 0] - 1] = -1
        starts = np.r_[0, ends[:-1]]
        prv[starts[starts < n]] = -1
        index: dict[int, list[np.ndarray]] = defaultdict(list)
        heap: list[int] = []

        def file(pos: np.ndarray) -> None:
            """Files the pairs that begin at these positions under their ranks."""
            r = self.ranks(sym[pos], sym[nxt[pos]])
            pos, r = pos[r >= 0], r[r >= 0]
            if not len(r):
                return
            o = np.argsort(r, kind="stable")
            pos, r = pos[o], r[o]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            for k, p in zip(r[np.r_[0, cut]].tolist(), np.split(pos, cut), strict=True):
                if k not in index:
                    heapq.heappush(heap, k)
                index[k].append(p)

        file(np.flatnonzero(nxt >= 0))
        while heap:
            k = heapq.heappop(heap)
            found = index.pop(k)
            a, b = self.left[k], self.right[k]
            pos = np.unique(found[0] if len(found) == 1 else np.concatenate(found))
            to = nxt[pos]
            pos = pos[(sym[pos] == a) & (to >= 0) & (sym[to] == b)]
            if a == b and len(pos) > 1:  # in a run of one symbol every other pair merges, from the left
                keep, last = [], -1
                for p, q in zip(pos.tolist(), nxt[pos].tolist(), strict=True):
                    if p != last:
                        keep.append(p)
                        last = q
                pos = np.array(keep)
            if not len(pos):
                continue
            gone = nxt[pos]
            after = nxt[gone]
            sym[pos] = self.made[k]
            sym[gone] = -1
            nxt[pos] = after
            inner = after >= 0
            prv[after[inner]] = pos[inner]
            before = prv[pos]
            file(np.unique(np.concatenate([pos[inner], before[before >= 0]])))
        live = sym >= 0
        ids, per = sym[live], np.add.reduceat(live, starts[starts < n]) if n else []
        full = iter(np.split(ids, np.cumsum(per)[:-1]))
        return [next(full).tolist() if x else [] for x in items]

    def encode_units(self, units: list[str]) -> list[list[int]]:
        """Ids of each unit: added tokens stand for themselves, the rest falls into words, each distinct word is encoded once."""
        known: dict[str, int] = {}
        plan = []
        special = any(t in u for t in self.added for u in units)
        for u in units:
            seq = []
            for i, part in enumerate(self.split.split(u) if special and any(t in u for t in self.added) else (u,)):
                if i % 2:
                    seq.append(-1 - self.added[part])
                else:
                    seq += [known.setdefault(w, len(known)) for w in self.word.findall(part)]
            plan.append(seq)
        ids = self.encode_words([w.encode() for w in known])
        return [[x for s in seq for x in ((-1 - s,) if s < 0 else ids[s])] for seq in plan]

    def decode(self, ids) -> str:
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")


class LibraryBPE:
    """The same units by the tokenizers library. Units that may stand next to each other are encoded as one run, and the bytes
    that the ids stand for tell where each unit ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        held = {i: len(s) for s, i in spec["model"]["vocab"].items()} | {t["id"]: len(t["content"].encode()) for t in spec["added_tokens"]}
        self.size = np.zeros(max(held) + 1, np.int64)
        self.size[list(held)] = list(held.values())
        self.kind = np.dtype("<u2" if len(self.size) <= 1 << 16 else "<u4")

    def encode_units(self, units: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(units)
        runs, run, n = [], [], 0
        for i, u in enumerate(units):
            if not u or u[0] != " " or u[-1].isspace():  # white space at an edge would join that of a neighbour
                runs.append([i])
                continue
            run.append(i)
            n += len(u)
            if n >= RUN_CHARS:
                runs.append(run)
                run, n = [], 0
        if run:
            runs.append(run)
        found = self.model.encode_batch_fast(["".join([units[i] for i in r]) for r in runs], add_special_tokens=False)
        for r, e in zip(runs, found, strict=True):
            ids = np.array(e.ids, self.kind)
            if len(r) == 1:
                out[r[0]] = ids
                continue
            ends = np.cumsum(self.size[ids])
            want = np.cumsum([len(units[i].encode()) for i in r])
            cut = np.searchsorted(ends, want)
            if not np.array_equal(ends[cut], want):
                raise ValueError("a token reaches over the end of a unit")
            lo = 0
            for i, hi in zip(r, (cut + 1).tolist(), strict=True):
                out[i] = ids[lo:hi]
                lo = hi
        return out


_EDGE = re.compile(r"\s\s")
_UNIT = re.compile(r"(?<=\S) (?=\S)")


def split_units(text: str) -> list[str]:
    """Parts between the single spaces that have no white space beside them; each part but the first begins with its space when
    encoded. No word of the pre-tokeniser reaches over such a space, so the parts' ids in a row are the text's ids."""
    if not text:
        return []
    if text[0].isspace() or text[-1].isspace() or _EDGE.search(text):
        return _UNIT.split(text)
    return text.split(" ")


class Memory(dict):
    """What a worker remembers of units, and about how many bytes that takes. Once it is full, further ones stand in `more` for one step."""

    def __init__(self):
        self.more, self.held = {}, 0

    def __missing__(self, unit):
        return self.more[unit]


@lru_cache(maxsize=4)
def coder(kind: str, path: str):
    """One per worker and kind (pairs..., or library...), with its memories of first units and of those after a space. The next operator drops it."""
    import os

    KEPT[:] = [coder.cache_clear]

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return (PairIndexBPE if kind.startswith("pairs") else LibraryBPE)(path), Memory(), Memory()


def encode_texts(kind: str, path: str, texts: list[str], render, limit: int = MEMORY_BYTES) -> list[list]:
    """For each text the list of its units' ids as bytes. render(model, ids) makes what is remembered; it is one for a kind."""
    model, heads, tails = coder(kind, path)
    parts = [split_units(t) for t in texts]
    rest = [p[1:] for p in parts]
    first = list({p[0] for p in parts if p}.difference(heads))
    after = list(set().union(*rest).difference(tails))
    made = [render(model, ids) for ids in model.encode_units(first + [" " + u for u in after])]
    size = UNIT_BYTES * len(made) + sum(map(len, made)) + sum(map(len, first)) + sum(map(len, after))
    full = heads.held + size > limit
    heads.held += 0 if full else size
    heads.more, tails.more = {}, {}
    (heads.more if full else heads).update(zip(first, made))
    (tails.more if full else tails).update(zip(after, made[len(first) :], strict=True))
    tail = tails.__getitem__
    out = [[heads[p[0]], *map(tail, r)] if p else [] for p, r in zip(parts, rest, strict=True)]
    heads.more, tails.more = {}, {}
    return out


def text_steps(column: pa.Array, limit: int = STEP_BYTES):
    """Ranges of a string column of about `limit` characters."""
    texts = column.to_pylist()
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j] or "") <= limit):
            n += len(texts[j] or "")
            j += 1
        yield i, [t or "" for t in texts[i:j]]
        i = j


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Byte-level BPE of every whole text of docs(doc_id, text), and back.

    Null and empty texts have no tokens. Rows with null or repeated doc_ids, and an empty table, are as any other; other
    columns are ignored. Returns doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (UTF-8 of the
    decoded text); with_ids adds ids (array<int>) and decoded (string).
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def render(model, ids):
        return np.array(ids, model.kind).tobytes()

    def run(batches):
        model = coder("pairs", path)[0]
        for batch in batches:
            keys = batch.column(0)
            for i, texts in text_steps(batch.column(1), STEP_CHARS):
                rows, found, back = [], [], []
                for units in encode_texts("pairs", path, texts, render):
                    ids = np.frombuffer(b"".join(units), model.kind)
                    each = ids.tolist()
                    text = b"".join(map(model.bytes.__getitem__, each)).decode("utf-8", "replace")
                    rows.append((len(each), hashlib.sha256(",".join(map(model.decimal.__getitem__, each)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
                    if with_ids:
                        found.append(ids)
                        back.append(text)
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
                if with_ids:
                    ends = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)
                    columns += [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32))), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays([keys.slice(i, len(texts)).cast(pa.int64()), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 1 + len(columns)])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
