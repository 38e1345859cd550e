"""Shared helpers: the shared folder, written intermediates, and numpy text kernels over Arrow buffers."""

from __future__ import annotations

import math
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 text that one group of documents aims at; groups are the unit of the packed shuffles.
GROUP_BYTES = 4 << 20
#: UTF-8 text that one numpy step takes at most, unless a single text is longer.
STEP_BYTES = 1 << 20
#: UTF-8 text that is hashed at once, unless a single word is longer.
HASH_BYTES = (1 << 18) - 1


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every machine sees; an own one only where it is unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        else:
            import tempfile

            base = "file://" + tempfile.mkdtemp(prefix="shared-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: With it the shuffle files of a write go when the write has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder. The shuffle files behind it are dropped once it is written."""
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts: one number."""
    return int(docs.agg(F.sum(F.octet_length(F.col(column))).alias("b")).first()["b"] or 0)


def group_count(total_bytes: int, group_bytes: int = GROUP_BYTES) -> int:
    return max(1, math.ceil(total_bytes / group_bytes))


def quoted(name: str):
    """The column of this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, stem: str) -> str:
    """A name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def lookup_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a worker keeps between tasks of one operator: functions that drop it. Workers outlive operators, and their memory is shared.
KEPT: list = []


def release() -> None:
    """Drops what an earlier operator keeps in this worker, and gives its memory back."""
    import ctypes
    import gc

    while KEPT:
        KEPT.pop()()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


# --- Arrow text -> numpy -------------------------------------------------------------------


def text_buffer(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, offsets from 0; null texts are empty."""
    if KEPT:
        release()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    if column.null_count:
        lens = np.diff(off)
        if lens[~np.asarray(column.is_valid())].any():  # a null may lie over bytes
            return text_buffer(column.fill_null(""))
    return data[off[0] : off[-1]], off - off[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES):
    """Ranges [i, j) of texts of about `limit` bytes together."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _new_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _R), np.full(n, _RINV)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(maxsize=1)
def _block_powers() -> tuple[np.ndarray, np.ndarray]:
    return _new_powers(HASH_BYTES + 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n; those of a block are kept, those of a longer word are not."""
    return _block_powers() if n <= HASH_BYTES else _new_powers(n + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def range_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the bytes, or 64-bit symbols, of ascending ranges [start, stop), by blocks of HASH_BYTES, so that memory doesn't grow with a text."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(stop, start[i] + HASH_BYTES, side="right")))
        a, z = int(start[i]), int(stop[j - 1])
        up, down = _powers(z - a)
        s = np.zeros(z - a + 1, np.uint64)
        values = data[a:z] if data.dtype == np.uint64 else _BYTE[data[a:z]]
        np.cumsum(values * up[: z - a], out=s[1:])
        lo, hi = start[i:j] - a, stop[i:j] - a
        out[i:j] = mix((s[hi] - s[lo]) * down[lo] + (hi - lo).astype(np.uint64))
        i = j
    return out


def words(data: np.ndarray, off: np.ndarray, lower: bool = False):
    """Words [^\\x20\\x09-\\x0D]+ of the texts: (hash, start, end, first), where first[d]:first[d + 1] are those of text d."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(off), np.int64)
    if lower:
        data = _LOWER[data]
    solid = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | cut[1:n]
    end[:-1] &= ~solid[1:] | cut[1:n]
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return range_hashes(data, start, stop), start, stop, np.searchsorted(start, off).astype(np.int64)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive word hashes, also those that reach into the next text."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m].copy()
    for j in range(1, k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[j : m + j]
    return mix(out)


# --- packed keys: (bucket, 40 bits) ---------------------------------------------------------


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket from the upper 32 bits; grows with h."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def key_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """bucket << 40 | the lower 40 bits. Buckets hold a bounded number of keys, so 40 bits keep false hits rare at any size."""
    return (bucket_of(h, buckets) << np.uint64(40)) | (h & np.uint64((1 << 40) - 1))


def pack40(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack40(b) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view("<u8").ravel()


def first_of_runs(sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
