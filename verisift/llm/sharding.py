"""Minimax contiguous partition: the smallest shard capacity over ordered atomic groups, checked greedily, then cut there."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: The order is by 60 bits of a hash. The driver first holds the sums of 2 ** 14 intervals of it, then those of
#: 2 ** 10 parts of each interval in which a cut can fall, until few enough groups lie in such parts to list them.
BITS, FIRST_BITS, NEXT_BITS = 60, 14, 10
LISTED = 100_000


def _walk(sizes: np.ndarray, capacity: int, shards: int) -> np.ndarray | None:
    """Greedy: first index of each shard's successor, or None if `shards` do not hold everything."""
    ends = np.cumsum(sizes)
    out, at, base = [], 0, 0
    for _ in range(shards):
        at = int(np.searchsorted(ends, base + capacity, side="right"))
        out.append(at)
        if at >= len(sizes):
            return np.array(out + [len(sizes)] * (shards - len(out)))
        base = int(ends[at - 1]) if at else 0
    return None


def minimax_cuts(sizes: np.ndarray, shards: int) -> tuple[int, np.ndarray]:
    """(smallest capacity, cuts) for ordered sizes in one list: binary search, each candidate checked greedily."""
    if not len(sizes):
        return 0, np.zeros(shards, np.int64)
    low, high = max(int(sizes.max()), -(-int(sizes.sum()) // shards)), int(sizes.sum())
    while low < high:
        mid = (low + high) // 2
        if _walk(sizes, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low, _walk(sizes, low, shards)


def even_cuts(sizes: np.ndarray, shards: int) -> tuple[int, np.ndarray]:
    """minimax_cuts, with each cut moved as near to an even share as the smallest capacity allows."""
    capacity, greedy = minimax_cuts(sizes, shards)
    back = _walk(sizes[::-1], capacity, shards) if len(sizes) else None
    if back is None:
        return capacity, greedy
    n, ends = len(sizes), np.r_[0, np.cumsum(sizes)]
    earliest = n - back[::-1]
    out = [0]
    for k in range(1, shards):
        want = int(np.searchsorted(ends, ends[-1] * k / shards))
        if want and ends[want] - ends[-1] * k / shards > ends[-1] * k / shards - ends[want - 1]:
            want -= 1
        reach = int(np.searchsorted(ends, ends[out[-1]] + capacity, side="right")) - 1
        out.append(max(out[-1], min(max(want, int(earliest[k])), reach)))
    cuts = np.array([*out[1:], n])
    return capacity, cuts if np.diff(ends[np.r_[0, cuts]]).max() <= capacity else greedy


def _bounds(cell_sum: np.ndarray, largest: int, shards: int) -> tuple[int, int, np.ndarray]:
    """(lowest, highest possible capacity, cells in which a cut of such a capacity can fall).

    Cutting only before cells needs at least the true capacity; letting a cut fall anywhere needs at most it."""
    high, _ = minimax_cuts(cell_sum, shards)
    low = max(largest, -(-int(cell_sum.sum()) // shards))
    ends = np.cumsum(cell_sum)
    inside = np.zeros(len(cell_sum), bool)
    near = far = 0
    for _ in range(shards):
        # the smallest capacity, losing up to one cell at each cut, and the largest capacity, losing nothing
        i = int(np.searchsorted(ends, near + low, side="right"))
        j = int(np.searchsorted(ends, far + high, side="right"))
        inside[i : j + 1] = True
        near, far = (int(ends[i - 1]) if i else 0), far + high
    return low, high, inside


def shard_by_bytes(docs: DataFrame, shards: int = 16, listed: int = LISTED) -> DataFrame:
    """Every row of docs(doc_id, text) with its shard; rows of equal text share one, sizes are as near equal as order and groups allow.

    A row's size is its UTF-8 bytes (null text: none) plus 1. Groups of equal texts are ordered by the text's hash; the
    shards are contiguous runs of that order. The driver holds sums of a fixed number of intervals of the order and at
    most `listed` single groups, those near which a cut can fall. Null texts form one group, empty texts another; null or
    repeated doc_ids keep their rows; an empty table gives no rows; other columns are ignored.
    Returns doc_id, size, text_crc32 (null text: 0), law, shard, slot (gapless from 0 in each shard), grown_shard (null).
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).alias("text_crc32"),
        F.coalesce(F.md5(F.encode("text", "UTF-8")), F.lit("null")).alias("h"),
    ).withColumn("pos", F.conv(F.substring(F.md5("h"), 1, BITS // 4), 16, 10).cast("long"))
    rows = written(rows)
    groups = rows.groupBy("pos", "h").agg(F.sum("size").alias("size"))

    def parts(width: int, within: list[int] | None, of: int) -> pd.DataFrame:
        some = groups if within is None else groups.where(F.shiftright("pos", of).isin(within))
        cell = F.shiftright("pos", width).alias("cell")
        return some.groupBy(cell).agg(F.sum("size").alias("size"), F.max("size").alias("top"), F.count("*").alias("n")).toPandas().assign(h="", width=width).assign(pos=lambda x: x["cell"].astype("int64") * (1 << width))

    width = BITS - FIRST_BITS
    order = parts(width, None, 0)
    largest = int(order["top"].max()) if len(order) else 0
    while len(order):
        order = order.sort_values(["pos", "h"], ignore_index=True)
        _, _, inside = _bounds(order["size"].to_numpy("int64"), largest, shards)
        inside &= (order["n"] > 1).to_numpy() & (order["width"] == width).to_numpy()
        if not inside.any():
            break
        cells = (order["pos"][inside] // (1 << width)).tolist()
        if order["n"][inside].sum() <= listed or width <= NEXT_BITS:
            finer = groups.where(F.shiftright("pos", width).isin(cells)).toPandas().assign(n=1, top=0, width=0)
            order = pd.concat([order[~inside], finer]).sort_values(["pos", "h"], ignore_index=True)
            break
        finer = parts(width - NEXT_BITS, cells, width)
        order, width = pd.concat([order[~inside], finer]), width - NEXT_BITS
    _, cuts = even_cuts(order["size"].to_numpy("int64"), shards)
    starts = [(int(order["pos"][c]), order["h"][c]) for c in cuts[:-1] if c < len(order)]
    shard = F.lit(0)
    for pos, h in starts:  # the first group of every later shard
        shard = shard + F.when((F.col("pos") > pos) | ((F.col("pos") == pos) & (F.col("h") >= h)), 1).otherwise(0)
    return _slots(rows.withColumn("shard", shard).drop("pos", "h"))


def _slots(rows: DataFrame) -> DataFrame:
    """Numbers each shard's rows from 0: a task that writes rows counts those of each shard and writes, beside every row, its own
    number and the count so far; the rows of a shard in tasks before are a prefix sum. Both are read from what was written once,
    so nothing depends on how a table is split when it is read."""
    names = ["doc_id", "size", "text_crc32", "shard", "part", "at"]

    def count(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(0, np.int64)
        for batch in batches:
            shard = batch.column(3).to_numpy().astype(np.int64)
            n = np.bincount(shard, minlength=len(seen))
            seen = np.r_[seen, np.zeros(len(n) - len(seen), np.int64)]
            order = np.argsort(shard, kind="stable")
            at = np.empty(len(shard), np.int64)
            at[order] = np.arange(len(shard)) - (np.cumsum(n) - n)[shard[order]] + seen[shard[order]]
            seen = seen + n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(shard), part, np.int32)), pa.array(at)], names=names)

    counted = rows.select("doc_id", F.col("size").cast("long").alias("size"), F.col("text_crc32").cast("long").alias("text_crc32"), F.col("shard").cast("int").alias("shard"))
    placed = written(counted.mapInArrow(count, "doc_id long, size long, text_crc32 long, shard int, part int, at long"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = placed.groupBy("part", "shard").agg(F.count("*").alias("n")).select("part", "shard", before.alias("base"))
    slot = (F.col("base") + F.col("at")).alias("slot")
    return placed.join(bases, ["part", "shard"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard"))
