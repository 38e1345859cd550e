"""Embedding whitening by TSQR: no covariance of the vectors is formed.

Entries become integers, so sums are exact whatever the order. Rows are centred by the exact sums, each partition keeps the R
factor of its rows (a block of rows at a time), R factors are merged in a tree, and the singular values and right vectors of
the last R give the eigenvalues and components of the covariance.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries whose |SCALE * c| is larger are no numbers to whiten by: their rows go, as those with non-finite ones do.
LARGEST = 1 << 31
COMPONENTS = 32
#: Matrices that one task merges, and rows that are factored at once.
FAN, BLOCK_ROWS = 16, 4096


@dataclass(frozen=True)
class Whitening:
    """What whitens a vector: n, exact sums of the fit list, components as columns, eigenvalues, and the trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def dimension(self) -> int:
        return len(self.sums)

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit integers where they suffice, else Python's."""
        lead = max([abs(s) for s in self.sums] + [int(np.abs(x).max(initial=0)) * self.n])
        if 2 * lead < 1 << 63:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.offsets(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n * x - S) squared, exact."""
        d = self.offsets(x)
        if d.dtype != object and self.dimension * int(np.abs(d).max(initial=0)) ** 2 < 1 << 63:
            return (d * d).sum(axis=1).tolist()
        return [sum(v * v for v in row) for row in d.tolist()]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)


def _lists(batch: pa.RecordBatch, dimension: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that hold a usable vector, lengths of the rows' vectors, the integers of all entries of the usable ones in a row)."""
    column = batch.column(batch.num_columns - 1)
    offsets = np.asarray(column.offsets)
    offsets, values = offsets - offsets[0], column.flatten() if not column.null_count else None
    if values is None:  # a null list may lie over values: take the slots as they stand
        values = column.values.slice(column.offsets[0].as_py(), int(offsets[-1]))
    lengths = np.diff(offsets)
    entries = values.to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(invalid="ignore"):
        scaled = entries * SCALE
        bad = ~(np.abs(scaled) <= LARGEST)  # NaN stands for null too
    total = np.r_[0, np.cumsum(bad)]
    usable = np.asarray(column.is_valid()) & (total[offsets[1:]] == total[offsets[:-1]])
    if dimension is not None:
        usable &= lengths == dimension
    inside = np.repeat(usable, lengths)
    return usable, lengths, np.floor(scaled[inside]).astype(np.int64) + SHIFT


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """(n, exact sums per dimension) of the usable rows. Vectors of another length than most have (ties: the longer) are not usable."""

    def partial(batches):
        held: dict[int, list] = {}
        for batch in batches:
            usable, lengths, x = _lists(batch, None)
            lengths = lengths[usable]
            owner = np.repeat(lengths, lengths)
            for d in np.unique(lengths).tolist():
                part = x[owner == d].reshape(-1, d) if d else np.zeros((int((lengths == 0).sum()), 0), np.int64)
                n = held.setdefault(d, [0, np.zeros(d, np.int64)])
                n[0] += len(part)
                n[1] = n[1] + part.sum(axis=0)
        for d, (n, sums) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * (d + 1), pa.int32()), pa.array(range(-1, d), pa.int32()), pa.array([n, *sums.tolist()], pa.int64())], names=["length", "at", "s"])

    # a task's int64 sums hold 2 ** 31 rows; across tasks they are decimals
    parts = rows.mapInArrow(partial, "length int, at int, s long")
    sums = parts.groupBy("length", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    counts = sums.where("at = -1 and length > 0").agg(F.max(F.struct("s", "length")).alias("b")).first()["b"]
    if counts is None:
        return 0, []
    found = {r["at"]: int(r["s"]) for r in sums.where((F.col("length") == counts["length"]) & (F.col("at") >= 0)).collect()}
    return int(counts["s"]), [found[i] for i in range(counts["length"])]


def tree_merged(parts: DataFrame, merge: Callable[[list[np.ndarray]], np.ndarray], tasks: int, fan: int = FAN) -> np.ndarray | None:
    """One matrix of the rows (id, matrix binary, columns) of parts: `fan` neighbours by id meet in a task, level by level; the
    driver merges the at most `fan` of the last level. None without rows."""
    schema = "id long, matrix binary, columns int"

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        out = merge([_matrix(m, c) for m, c in zip(table["matrix"].to_pylist(), table["columns"].to_pylist(), strict=True)])
        return pa.table({"id": pa.array([table["id"][0].as_py() // fan], pa.int64()), "matrix": pa.array([out.tobytes()], pa.binary()), "columns": pa.array([out.shape[1]], pa.int32())})

    while tasks > fan:
        parts = parts.groupBy(F.floor(F.col("id") / fan)).applyInArrow(meet, schema)
        tasks = math.ceil(tasks / fan)
    last = parts.orderBy("id").collect()
    return merge([_matrix(r["matrix"], r["columns"]) for r in last]) if last else None


def _matrix(raw: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, columns)


def _task_matrix(make: Callable[[Iterator[np.ndarray]], np.ndarray | None], dimension: int):
    """A mapInArrow function: make() turns the blocks of integers of a task's usable rows into the task's one matrix."""

    def run(batches):
        def blocks():
            for batch in batches:
                x = _lists(batch, dimension)[2].reshape(-1, dimension)
                for i in range(0, len(x), BLOCK_ROWS):
                    yield x[i : i + BLOCK_ROWS]

        out = make(blocks())
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([out.tobytes()], pa.binary()), pa.array([out.shape[1]], pa.int32())], names=["id", "matrix", "columns"])

    return run


def _r_factor(parts: list[np.ndarray]) -> np.ndarray:
    return np.ascontiguousarray(np.linalg.qr(np.concatenate(parts), mode="r"))


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of rows whose last column is the vector (array of numbers); None without a usable row.

    The driver holds sums and R factors of the last level: D numbers and at most FAN matrices of D x D for D dimensions.
    Components without variance (constant vectors, fewer rows than dimensions) are left out, as nothing can scale them to 1.
    """
    n, sums = _sums(rows)
    if not n:
        return None
    dimension = len(sums)
    centre = Whitening(n, sums, np.zeros((dimension, 0)), np.zeros(0), 0.0)

    def factor(blocks):
        r = None
        for x in blocks:
            y = centre.centred(x)
            r = _r_factor([y] if r is None else [r, y])
        return r

    tasks = rows.rdd.getNumPartitions()
    r = tree_merged(rows.mapInArrow(_task_matrix(factor, dimension), "id long, matrix binary, columns int"), _r_factor, tasks)
    _, singular, right = np.linalg.svd(r, full_matrices=False)
    some = singular > singular.max(initial=0) * max(n, dimension) * np.finfo(float).eps
    keep = np.flatnonzero(some)[:components]
    return Whitening(n, sums, np.ascontiguousarray(right[keep].T), singular[keep] ** 2 / n, float((singular**2).sum() / n))


def identity_error(rows: DataFrame, fit: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity: moments by task, each centred on its own
    mean, merged in the same tree. 0 without components."""
    k = fit.components.shape[1]
    if not k:
        return 0.0

    def moments(n: int, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
        return np.vstack([np.full(k, float(n)), mean, spread])

    def merge(parts: list[np.ndarray]) -> np.ndarray:
        n = sum(p[0, 0] for p in parts)
        mean = sum(p[0, 0] * p[1] for p in parts) / n
        return moments(n, mean, sum(p[2:] + p[0, 0] * np.outer(p[1] - mean, p[1] - mean) for p in parts))

    def own(blocks):
        out = None
        for x in blocks:
            z = fit.whiten(x)
            mean = z.mean(axis=0)
            part = moments(len(z), mean, (z - mean).T @ (z - mean))
            out = part if out is None else merge([out, part])
        return out

    got = tree_merged(rows.mapInArrow(_task_matrix(own, fit.dimension), "id long, matrix binary, columns int"), merge, rows.rdd.getNumPartitions())
    return float(np.abs(got[2:] / fit.n - np.eye(k)).max())


def whiten_embeddings(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitens the vectors of a table by their own covariance.

    An entry c becomes x = floor(64 * c) + 1000000. Rows go whose vector is null, empty, of another length than most, or holds
    a null, non-finite or huge (|64 c| above 2 ** 31) entry. Null and repeated ids and repeated rows give rows of their own; an
    empty table, or one of equal vectors, gives no rows; other columns are ignored. One row per vector and component: the id,
    component (from 1, by falling eigenvalue), n, deviation decimal(38,0) (exact sum of (n * x - S) ** 2), whitened, explained
    (share of the trace), identity_error (one value for all).
    """
    vector = quoted(vector_column)
    if dict(table.dtypes)[vector_column] not in ("array<float>", "array<double>"):  # those two are widened in the tasks
        vector = vector.cast("array<double>")
    rows = table.select(quoted(id_column).cast("long").alias("vec_id"), vector.alias("vector"))
    fit = fit_whitening(rows.select("vector"), components)
    schema = "vec_id long, deviation string, whitened array<double>"
    if fit is None:
        done, error, explained, n = table.sparkSession.createDataFrame([], schema), 0.0, [], 0
    else:
        error, explained, n = identity_error(rows.select("vector"), fit), (fit.eigenvalues / fit.trace).tolist() if fit.trace else [], fit.n

        def run(batches):
            for batch in batches:
                usable, _, x = _lists(batch, fit.dimension)
                x = x.reshape(-1, fit.dimension)
                ids = batch.column(0).filter(pa.array(usable))
                for i in range(0, len(x), BLOCK_ROWS):
                    part = x[i : i + BLOCK_ROWS]
                    z = fit.whiten(part)
                    cut = np.arange(len(part) + 1, dtype=np.int32) * np.int32(z.shape[1])
                    yield pa.RecordBatch.from_arrays([ids.slice(i, len(part)), pa.array([str(d) for d in fit.deviations(part)], pa.string()), pa.ListArray.from_arrays(pa.array(cut), pa.array(z.ravel()))], names=["vec_id", "deviation", "whitened"])

        done = rows.mapInArrow(run, schema)
    each = done.select("vec_id", F.col("deviation").cast("decimal(38,0)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*[F.lit(x) for x in explained]) if explained else F.array().cast("array<double>")
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
