"""IO15: tar and tar.gz archives, read member by member in parallel.

A compressed stream can be entered only where one of its gzip members begins, a plain tar at any header. One pass over an
archive lists its files and the places where reading can begin anew ahead of one of them; between two such places lies a part.
Parts are read in parallel, and a part holds its files one at a time. An archive that is one gzip member is one part; those
that write_archives makes begin a new one every few megabytes.
"""

from __future__ import annotations

import io
import tarfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of files between two places of a written archive where reading can begin.
PART_BYTES = 4 << 20
_READ = 1 << 20
INDEX = "archive string, start long, files long, bytes long, error string"
MEMBERS = "archive string, path string, size long, modified timestamp, content binary"


def _opened(uri: str):
    store, path = pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)
    return store.open_input_file(path)


class Inflated(io.RawIOBase):
    """The plain bytes of a file from one of its gzip members on, and where each further member begins: in the file, and in them.

    `end`: stop before the gzip member that begins there."""

    def __init__(self, file, start: int = 0, end: int | None = None):
        self.file, self.end, self.at, self.out = file, end, 0, b""
        file.seek(start)
        self.begun, self.plain, self.held, self.place = [(start, 0)], 0, b"", start
        self.inflater = zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def _more(self) -> bool:
        if not self.held:
            self.held = self.file.read(_READ)
            if not self.held:
                if not self.inflater.eof and self.plain:
                    raise EOFError("the gzip stream is cut off")
                return False
        if self.inflater.eof:
            self.held = self.held.lstrip(b"\0") if self.held[:1] == b"\0" else self.held
            begin = self.file.tell() - len(self.held)
            if not self.held:
                return True
            if self.end is not None and begin >= self.end:
                return False
            self.begun.append((begin, self.plain))
            self.inflater = zlib.decompressobj(31)
        self.out = self.inflater.decompress(self.held, _READ)
        self.held = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
        self.plain += len(self.out)
        return True

    def readinto(self, into) -> int:
        while not self.out:
            if not self._more():
                return 0
        n = min(len(into), len(self.out))
        into[:n], self.out = self.out[:n], self.out[n:]
        return n


class Plain(io.RawIOBase):
    """A tar that isn't compressed: each header is a place where reading can begin."""

    def __init__(self, file, start: int = 0):
        self.file, self.begun = file, None
        file.seek(start)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.file.read(len(into))
        into[: len(data)] = data
        return len(data)


def _stream(file, start: int = 0, end: int | None = None):
    file.seek(0)
    return Inflated(file, start, end) if file.read(2) == b"\x1f\x8b" else Plain(file, start)


def _members(stream) -> Iterator[tuple[tarfile.TarFile, tarfile.TarInfo]]:
    """Files of a tar stream; folders, links and devices are left out."""
    with tarfile.open(fileobj=io.BufferedReader(stream, _READ), mode="r|") as tar:
        for member in tar:
            if member.isreg():
                yield tar, member
            tar.members = []  # else every header stays in memory


def parts_of(uri: str, least: int = PART_BYTES) -> list[tuple[int, int, int]]:
    """(start, files, bytes) of the parts of an archive: one begins where it can, once the part before has `least` bytes or more."""
    with _opened(uri) as file:
        stream = _stream(file)
        out: list[list[int]] = []
        seen = 0
        for _, member in _members(stream):
            begins = member.offset if stream.begun is None else None
            if stream.begun is not None:  # the last gzip member that begins at this header or before, and behind the file before it
                while seen < len(stream.begun) and stream.begun[seen][1] <= member.offset:
                    begins = stream.begun[seen][0] if stream.begun[seen][1] == member.offset else begins
                    seen += 1
            if not out or (begins is not None and out[-1][2] >= least):
                out.append([begins if out else 0, 0, 0])
            out[-1][1] += 1
            out[-1][2] += member.size
        return [tuple(x) for x in out]


def archive_index(archives: DataFrame, column: str = "archive", least: int = PART_BYTES) -> DataFrame:
    """(archive, start, files, bytes, error) of the parts of each archive, a file system path in a column; an archive a task reads.

    One that can't be read to its end gives a row with the error and null elsewhere; one without files gives none."""

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                try:
                    rows = [(uri, *p, None) for p in parts_of(uri, least)]
                except (OSError, EOFError, tarfile.TarError, zlib.error) as e:
                    rows = [(uri, None, None, None, f"{type(e).__name__}: {e}")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["archive", "start", "files", "bytes", "error"])

    named = archives.where(F.col(f"`{column}`").isNotNull()).select(F.col(f"`{column}`").alias("archive")).distinct()
    return named.mapInArrow(run, INDEX)


def read_members(index: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """(archive, path, size, modified, content) of the files of an index; the content of files above `most_bytes` is null.

    Parts are dealt out evenly, whatever archive they belong to; rows with an error are left out."""
    end = F.lead("start").over(Window.partitionBy("archive").orderBy("start"))
    parts = index.where("error is null").select("archive", "start", "files", end.alias("end")).repartition(F.col("archive"), F.col("start"))

    def run(batches):
        for batch in batches:
            for uri, start, files, end in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                with _opened(uri) as file:
                    rows, held = [], 0
                    for n, (tar, member) in enumerate(_members(_stream(file, start, end))):
                        if n >= files:
                            break
                        content = tar.extractfile(member).read() if member.size <= most_bytes else None
                        rows.append((uri, member.name, member.size, int(member.mtime * 1_000_000), content))
                        held += len(content or b"")
                        if held >= PART_BYTES:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    return parts.mapInArrow(run, MEMBERS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["archive", "path", "size", "modified", "content"])


def read_archives(spark: SparkSession, paths: list[str], least: int = PART_BYTES, most_bytes: int = 64 << 20) -> DataFrame:
    """The files of the archives at these paths."""
    return read_members(archive_index(spark.createDataFrame([(p,) for p in paths], "archive string"), "archive", least), most_bytes)


def write_archives(df: DataFrame, folder: str, least: int = PART_BYTES) -> DataFrame:
    """Packs df(path, content) into a tar.gz a task below `folder`, and returns their (archive, files). A null content is an empty
    file; rows without a path are refused. A task that runs twice replaces its archive as a whole."""
    spark = df.sparkSession

    def run(batches):
        store, base = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}.tar.gz"
        draft, n, held = f"{base}/.{name}.{context.taskAttemptId()}", 0, least
        with store.open_output_stream(draft) as out:
            packer = None
            for batch in batches:
                for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if path is None:
                        raise ValueError("a file needs a path")
                    if held >= least:
                        if packer is not None:
                            out.write(packer.flush())
                        packer, held = zlib.compressobj(6, zlib.DEFLATED, 31), 0
                    content = content or b""
                    info = tarfile.TarInfo(path)
                    info.size = len(content)
                    out.write(packer.compress(info.tobuf(tarfile.PAX_FORMAT) + content + b"\0" * (-len(content) % tarfile.BLOCKSIZE)))
                    held += len(content)
                    n += 1
            packer = packer or zlib.compressobj(6, zlib.DEFLATED, 31)
            out.write(packer.compress(b"\0" * 2 * tarfile.BLOCKSIZE) + packer.flush())
        store.move(draft, f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{name}"]), pa.array([n], pa.int64())], names=["archive", "files"])

    done = df.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content")).mapInArrow(run, "archive string, files long")
    return spark.createDataFrame(done.collect(), "archive string, files long")  # a row a task
