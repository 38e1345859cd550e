"""IO6 and IO7: feature arrays in NPY files as a Spark data source.

A split is a folder with `visual_features.npy`, `text_features.npy` (rows x dimensions), `labels.npy` and, if there are any,
`perturbation_ratios.npy`. Reading cuts the rows of a split into partitions, each of which maps its byte range alone. Writing
puts each row at its place: a row's bytes are as many in every row, so tasks fill their parts of one file side by side, and a
task that runs twice writes the same bytes again. Headers and final names come with the commit; until then the files lie in a draft folder. The folder lies on a file
system that all machines mount.
"""

from __future__ import annotations

import contextlib
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "split string, row long, visual array<float>, text array<float>, label int, perturbation_ratio float"
#: Column, file, and type on disk.
FILES = {"visual": ("visual_features.npy", "<f4"), "text": ("text_features.npy", "<f4"), "label": ("labels.npy", "<i8"), "perturbation_ratio": ("perturbation_ratios.npy", "<f4")}
#: Rows of a partition, unless the option `rows` says otherwise.
ROWS = 65_536
#: A header of the first NPY version padded to this size leaves room for any shape.
HEADER_BYTES = 128


def local_path(path: str) -> str:
    """The folder as the operating system names it."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"NPY files are mapped, so their folder must be mounted: {path}")
    return unquote(parts.path) if parts.scheme else path


@dataclass(frozen=True)
class NpyFile:
    """Where the rows of a file begin, and what a row holds."""

    path: str
    dtype: np.dtype
    rows: int
    width: tuple[int, ...]
    offset: int

    @classmethod
    def open(cls, path: str) -> NpyFile:
        with open(path, "rb") as f:
            version = np.lib.format.read_magic(f)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            shape, fortran, dtype = read(f)
            if dtype.hasobject or not shape or len(shape) > 2 or (fortran and len(shape) > 1):
                raise ValueError(f"{path}: need one or two dimensions of numbers, row by row")
            return cls(path, dtype, shape[0], shape[1:], f.tell())

    def block(self, first: int, last: int) -> np.ndarray:
        """Rows [first, last), mapped."""
        size = int(np.prod(self.width, dtype=np.int64)) * self.dtype.itemsize
        if last <= first or not size:
            return np.zeros((max(0, last - first), *self.width), self.dtype)
        return np.memmap(self.path, self.dtype, "r", self.offset + first * size, (last - first, *self.width))


class Block(InputPartition):
    def __init__(self, split: str, first: int, last: int):
        self.split, self.first, self.last = split, first, last


class NpyReader(DataSourceReader):
    def __init__(self, root: str, rows: int, split: str | None = None):
        self.root, self.rows, self.split = root, rows, split

    def files(self, split: str) -> dict[str, NpyFile]:
        found = {c: NpyFile.open(p) for c, (name, _) in FILES.items() if c != "perturbation_ratio" or os.path.exists(os.path.join(self.root, split, name)) if (p := os.path.join(self.root, split, name))}
        if len({f.rows for f in found.values()}) > 1:
            raise ValueError(f"arrays of split {split} differ in length: { {c: f.rows for c, f in found.items()} }")
        return found

    def partitions(self) -> list[Block]:
        names = sorted(d for d in os.listdir(self.root) if os.path.exists(os.path.join(self.root, d, FILES["label"][0])))
        out = []
        for split in names:
            if self.split in (None, split):
                n = self.files(split)["label"].rows
                out += [Block(split, i, min(n, i + self.rows)) for i in range(0, n, self.rows)]
        return out or [Block("", 0, 0)]

    def read(self, part: Block) -> Iterator[pa.RecordBatch]:
        if part.last <= part.first:
            return
        files, step = self.files(part.split), 4096
        for a in range(part.first, part.last, step):
            z = min(part.last, a + step)
            n = z - a
            lists = [self._lists(files[c].block(a, z)) for c in ("visual", "text")]
            ratio = np.asarray(files["perturbation_ratio"].block(a, z), np.float32) if "perturbation_ratio" in files else np.zeros(n, np.float32)
            label = np.asarray(files["label"].block(a, z)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([part.split] * n, pa.string()), pa.array(np.arange(a, z)), *lists, pa.array(label), pa.array(ratio)], names=["split", "row", "visual", "text", "label", "perturbation_ratio"])

    @staticmethod
    def _lists(block: np.ndarray) -> pa.Array:
        values = np.ascontiguousarray(block, np.float32)
        width = values.shape[1] if values.ndim == 2 else 1
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * np.int32(width)), pa.array(values.ravel()))


@dataclass
class Placed(WriterCommitMessage):
    """What a task wrote: rows, largest place and dimensions by split."""

    rows: dict[str, int]
    last: dict[str, int]
    widths: dict[str, tuple[int, int]]


class NpyWriter(DataSourceArrowWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.draft = root, overwrite, os.path.join(root, f"_writing-{uuid.uuid4().hex}")
        os.makedirs(self.draft)

    def _path(self, split: str, column: str, final: bool = False) -> str:
        if not split or split in (".", "..") or "/" in split:
            raise ValueError(f"no folder can bear the split {split!r}")
        return os.path.join(self.root if final else self.draft, split, FILES[column][0])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Placed:
        out = Placed({}, {}, {})
        for batch in iterator:
            table = pa.Table.from_batches([batch])
            if any(table[c].null_count for c in ("split", "row", "visual", "text", "label")):
                raise ValueError("split, row, visual, text and label must not be null")
            splits = np.array(table["split"].to_pylist(), object)
            for split in sorted(set(splits)):
                some = table.filter(pa.array(splits == split)).sort_by("row")
                place = some["row"].to_numpy()
                arrays = {"visual": self._matrix(some["visual"]), "text": self._matrix(some["text"]), "label": some["label"].to_numpy(), "perturbation_ratio": some["perturbation_ratio"].fill_null(0).to_numpy()}
                widths = (arrays["visual"].shape[1], arrays["text"].shape[1])
                if out.widths.setdefault(split, widths) != widths:
                    raise ValueError(f"vectors of split {split} differ in length")
                out.rows[split] = out.rows.get(split, 0) + len(place)
                out.last[split] = max(out.last.get(split, -1), int(place[-1]))
                with contextlib.suppress(FileExistsError):  # the draft itself is gone once the write is given up
                    os.mkdir(os.path.dirname(self._path(split, "label")))
                runs = np.split(np.arange(len(place)), np.flatnonzero(np.diff(place) != 1) + 1)
                for column, values in arrays.items():
                    values = np.ascontiguousarray(values, FILES[column][1])
                    size = values.itemsize * (values.shape[1] if values.ndim == 2 else 1)
                    fd = os.open(self._path(split, column), os.O_WRONLY | os.O_CREAT)
                    try:
                        for run in runs:
                            self._put(fd, values[run[0] : run[-1] + 1].tobytes(), HEADER_BYTES + int(place[run[0]]) * size)
                    finally:
                        os.close(fd)
        return out

    @staticmethod
    def _put(fd: int, data: bytes, at: int) -> None:
        view = memoryview(data)
        while view:
            done = os.pwrite(fd, view, at)
            view, at = view[done:], at + done

    @staticmethod
    def _matrix(column: pa.ChunkedArray) -> np.ndarray:
        lists = column.combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = np.diff(np.asarray(lists.offsets))
        if len(set(sizes.tolist())) > 1 or lists.flatten().null_count:
            raise ValueError("vectors must have one length and no null entries")
        return lists.flatten().to_numpy().reshape(len(sizes), -1)

    def commit(self, messages: list[Placed | None]) -> None:
        done = [m for m in messages if m is not None]
        for split in sorted({s for m in done for s in m.rows}):
            n = sum(m.rows.get(split, 0) for m in done)
            widths = {m.widths[split] for m in done if split in m.widths}
            if len(widths) > 1 or max(m.last.get(split, -1) for m in done) + 1 != n:
                self.abort(messages)
                raise ValueError(f"rows of split {split} must be numbered from 0 without gaps, and its vectors have one length")
            if not self.overwrite and os.path.exists(self._path(split, "label", True)):
                self.abort(messages)
                raise ValueError(f"split {split} is there already")
        for split in sorted({s for m in done for s in m.rows}):
            os.makedirs(os.path.join(self.root, split), exist_ok=True)
            n, widths = sum(m.rows.get(split, 0) for m in done), next(m.widths[split] for m in done if split in m.widths)
            for column, shape in zip(FILES, ((n, widths[0]), (n, widths[1]), (n,), (n,)), strict=True):
                text = repr({"descr": FILES[column][1], "fortran_order": False, "shape": shape}).encode()
                head = np.lib.format.magic(1, 0) + (HEADER_BYTES - 10).to_bytes(2, "little")
                with open(self._path(split, column), "r+b") as f:
                    f.write(head + text.ljust(HEADER_BYTES - 11) + b"\n")
                os.replace(self._path(split, column), self._path(split, column, True))

        shutil.rmtree(self.draft)

    def abort(self, messages: list[Placed | None]) -> None:
        """Tasks may still run: under its new name they don't find the draft."""
        with contextlib.suppress(FileNotFoundError):
            os.rename(self.draft, f"{self.draft}-gone")
        shutil.rmtree(f"{self.draft}-gone", ignore_errors=True)


class NpyFeatures(DataSource):
    """`spark.read.format("npy_features").option("rows", n).option("split", name).load(folder)`, `df.write.format("npy_features").mode(...).save(folder)`."""

    @classmethod
    def name(cls) -> str:
        return "npy_features"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(local_path(self.options["path"]), int(self.options.get("rows", ROWS)), self.options.get("split"))

    def writer(self, schema: StructType, overwrite: bool) -> NpyWriter:
        return NpyWriter(local_path(self.options["path"]), overwrite)


def read_npy(spark: SparkSession, path: str, split: str | None = None, rows: int = ROWS) -> DataFrame:
    """IO6: split, row, visual, text, label, perturbation_ratio (0 where the file is absent) of one split below `path`, or of all,
    `rows` of them in a partition."""
    spark.dataSource.register(NpyFeatures)
    reader = spark.read.format("npy_features").option("rows", rows)
    return (reader if split is None else reader.option("split", split)).load(path)


def write_npy(df: DataFrame, path: str, mode: str = "append") -> None:
    """IO7: df(split, row, visual, text, label, perturbation_ratio), rows numbered from 0 in each split, to `path`. Null ratios are
    0; other nulls, gaps and vectors of several lengths are refused, and then nothing of this write stays. append refuses a
    split that is there, overwrite replaces it; other splits and columns are left alone."""
    df.sparkSession.dataSource.register(NpyFeatures)
    typed = df.select(*[F.col(c).cast(t).alias(c) for c, t in (x.split(" ") for x in SCHEMA.split(", "))])
    typed.write.format("npy_features").mode(mode).save(path)
