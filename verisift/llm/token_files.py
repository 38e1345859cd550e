"""Flat unsigned integer token files with 64-bit document offsets, written in ascending doc_id order and memory-mapped back."""

from __future__ import annotations

import json
import uuid
import zlib
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir
from .tokens import MEMORY_BYTES, STEP_CHARS, encode_texts, text_steps

#: Bytes of units that a writing worker remembers: it keeps no tables of its own.
UNIT_MEMORY = 2 * MEMORY_BYTES
#: Ids that reading back holds at once.
READ_IDS = 4_000_000


def _store(folder: str):
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder
    if urlparse(folder).scheme == "file":
        return pafs.LocalFileSystem(), urlparse(folder).path
    return pafs.FileSystem.from_uri(folder)


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = 0, partitions: int | None = None) -> None:
    """Encodes docs(doc_id, text) with the tokenizers library and writes the format below `folder`, which all machines see.

    Format: <part>.bin holds the ids of a run of documents as flat little-endian unsigned integers (16 bits where the
    vocabulary allows it, else 32); <part>.idx holds the number of documents n, then n doc_ids, n bytes that are 1 where the doc_id is null,
    and n + 1 offsets into the ids, all 64-bit but the n bytes; index.json lists the parts in ascending doc_id order with
    `base`, the number of ids in all parts before, a prefix sum over the parts. Null doc_ids come first; repeated doc_ids
    are ordered by text. Null texts are empty: they hold the end id alone.
    Tasks write to names of their own and rename, so a task that runs twice leaves one file.
    """
    spark = docs.sparkSession
    parts = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = _id_kind(path, end_id)
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = held.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    end = np.array([end_id], kind).tobytes()

    def run(batches):
        part = TaskContext.get().partitionId()
        store, at = _store(folder)
        store.create_dir(at, recursive=True)
        own = f"{at}/.{part}-{uuid.uuid4().hex}"
        keys, nulls, sizes = [], [], []
        with store.open_output_stream(f"{own}.bin") as out:
            for batch in batches:
                for i, texts in text_steps(batch.column(1), STEP_CHARS):
                    for units in encode_texts(f"library {kind.str}", path, texts, lambda _, ids: np.asarray(ids, kind).tobytes(), UNIT_MEMORY):
                        blob = b"".join(units) + end
                        sizes.append(len(blob) // kind.itemsize)
                        out.write(blob)
                    ids = batch.column(0).slice(i, len(texts))
                    keys.append(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                    nulls.append(ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
        if not sizes:
            store.delete_file(f"{own}.bin")
            return
        with store.open_output_stream(f"{own}.idx") as out:
            out.write(np.array([len(sizes)], "<i8").tobytes() + np.concatenate(keys).tobytes() + np.concatenate(nulls).tobytes() + np.r_[0, np.cumsum(sizes)].astype("<i8").tobytes())
        for tail in (".bin", ".idx"):
            store.move(f"{own}{tail}", f"{at}/{part:08d}{tail}")
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [len(sizes)], "ids": [int(sum(sizes))]})

    found = ordered.mapInArrow(run, "part long, docs long, ids long").toPandas().sort_values("part", ignore_index=True)
    found["base"] = found["ids"].cumsum() - found["ids"]
    store, at = _store(folder)
    store.create_dir(at, recursive=True)
    with store.open_output_stream(f"{at}/index.json") as out:
        out.write(json.dumps({"dtype": kind.str, "parts": found.to_dict("records")}).encode())


def _id_kind(path: str, end_id: int) -> np.dtype:
    spec = json.load(open(path, encoding="utf-8"))
    top = max([end_id, *spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    return np.dtype("<u2" if top < 1 << 16 else "<u4")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    store, at = _store(folder)
    with store.open_input_stream(f"{at}/index.json") as f:
        index = json.loads(f.read())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not index["parts"]:
        return spark.createDataFrame([], schema)
    kind = np.dtype(index["dtype"])
    parts = spark.createDataFrame(pd.DataFrame(index["parts"])[["part", "base"]]).repartition(len(index["parts"]))

    def run(batches):
        store, at = _store(folder)
        for batch in batches:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = f"{at}/{part:08d}"
                with store.open_input_file(f"{name}.idx") as f:
                    raw = f.read()
                n = int(np.frombuffer(raw, "<i8", 1)[0])
                keys, nulls, off = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, np.uint8, n, 8 + 8 * n), np.frombuffer(raw, "<i8", n + 1, 8 + 9 * n)
                local = isinstance(store, pafs.LocalFileSystem)
                ids = np.memmap(f"{name}.bin", kind, "r") if local else None
                file = None if local else store.open_input_file(f"{name}.bin")
                crc = np.empty(n, np.int64)
                for d in range(n):
                    c = 0
                    for i in range(off[d], off[d + 1], READ_IDS):
                        j = min(off[d + 1], i + READ_IDS)
                        piece = ids[i:j] if local else np.frombuffer(file.read_at((j - i) * kind.itemsize, i * kind.itemsize), kind)
                        c = zlib.crc32(piece.astype("<u4").tobytes(), c)
                    crc[d] = c
                for i in range(0, n, 20_000):
                    s = slice(i, min(n, i + 20_000))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[s], mask=nulls[s].astype(bool)), pa.array(base + off[:-1][s]), pa.array(np.diff(off)[s]), pa.array(crc[s])], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return parts.mapInArrow(run, schema)


def token_files(docs: DataFrame, path: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Writes the files of docs(doc_id, text) and reads them back; an empty table gives no rows."""
    folder = folder or f"{shared_dir(docs.sparkSession)}-tokens"
    write_token_files(docs, path, folder, end_id)
    return read_token_files(docs.sparkSession, folder)
