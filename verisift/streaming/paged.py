"""IO13, IO14, ST1: rows of a paged listing as a stream with offsets of its own.

A listing is a sequence of pages, each with names of items and whether a page follows; an item holds rows. An offset says how
many items of which page have been given out, so a batch between two offsets can be read again after a crash, and its items
are read in parallel. A remote source overrides `page` and `rows` of PagedListing; FolderListing reads both from a folder.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..sources.npy import local_path

SCHEMA = "item string, line long, value string"


class PagedListing:
    """What a source offers. Pages are numbered from 0; one that is not there yet is None. Pages and items don't change."""

    def page(self, number: int) -> tuple[list[str], bool] | None:
        """(names of items, whether a page follows)."""
        raise NotImplementedError

    def rows(self, item: str) -> Iterator[str]:
        raise NotImplementedError


class FolderListing(PagedListing):
    """Pages `<number>.json` = {"items": [...], "more": bool} in a folder, items as text files beside them, a row a line."""

    def __init__(self, folder: str):
        self.folder = local_path(folder)

    def page(self, number: int) -> tuple[list[str], bool] | None:
        try:
            with open(os.path.join(self.folder, f"{number}.json"), encoding="utf-8") as f:
                page = json.load(f)
        except FileNotFoundError:
            return None
        return page["items"], page["more"]

    def rows(self, item: str) -> Iterator[str]:
        with open(os.path.join(self.folder, item), encoding="utf-8", newline="") as f:
            for line in f:
                yield line.removesuffix("\n").removesuffix("\r")


class Item(InputPartition):
    def __init__(self, name: str):
        self.name = name


def forward(listing: PagedListing, at: dict, most: int | None) -> tuple[dict, list[str]]:
    """(offset, items) of up to `most` items behind an offset {page, taken}; only pages that are there."""
    page, taken, items = at["page"], at["taken"], []
    while most is None or len(items) < most:
        got = listing.page(page)
        if got is None:
            break
        names, more = got
        some = names[taken:] if most is None else names[taken : taken + most - len(items)]
        items += some
        taken += len(some)
        if taken < len(names) or not more:
            break
        page, taken = page + 1, 0
    return {"page": page, "taken": taken}, items


def between(listing: PagedListing, start: dict, end: dict) -> list[str]:
    """The items from one offset to another."""
    out = []
    for number in range(start["page"], end["page"] + 1):
        names, _ = listing.page(number) or ([], False)
        out += names[start["taken"] if number == start["page"] else 0 : end["taken"] if number == end["page"] else None]
    return out


class PagedReader(DataSourceReader):
    def __init__(self, listing: PagedListing):
        self.listing = listing

    def partitions(self) -> list[Item]:
        return [Item(x) for x in forward(self.listing, {"page": 0, "taken": 0}, None)[1]] or [Item("")]

    def read(self, part: Item) -> Iterator[tuple]:
        for i, value in enumerate(self.listing.rows(part.name) if part.name else ()):
            yield part.name, i, value


class PagedStreamReader(DataSourceStreamReader):
    """Batches of at most `most` items. Spark doesn't tell a reader that starts again how far it came, so `after`, an offset, does."""

    def __init__(self, listing: PagedListing, most: int | None, after: dict | None):
        self.listing, self.most, self.at = listing, most, after or self.initialOffset()

    def initialOffset(self) -> dict:
        return {"page": 0, "taken": 0}

    def latestOffset(self) -> dict:
        self.at, _ = forward(self.listing, self.at, self.most)
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Item]:
        return [Item(x) for x in between(self.listing, start, end)]

    def read(self, part: Item) -> Iterator[tuple]:
        for i, value in enumerate(self.listing.rows(part.name)):
            yield part.name, i, value


class PagedSource(DataSource):
    """Format `paged`: item, line (from 0), value. Options: path, items (a batch's most), after (an offset as JSON)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def listing(self) -> PagedListing:
        return FolderListing(self.options["path"])

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.listing())

    def streamReader(self, schema: StructType) -> PagedStreamReader:
        most, after = self.options.get("items"), self.options.get("after")
        return PagedStreamReader(self.listing(), int(most) if most else None, json.loads(after) if after else None)


def read_paged(spark: SparkSession, path: str, source: type[PagedSource] = PagedSource) -> DataFrame:
    """IO13: all rows of the listing at `path`."""
    spark.dataSource.register(source)
    return spark.read.format(source.name()).load(path)


def planned_offset(spark: SparkSession, checkpoint: str) -> str | None:
    """The end, as JSON, of the last batch that a stream with this checkpoint has planned: None before the first one."""
    offsets = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/offsets")
    store = offsets.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(offsets):
        return None
    batches = [int(n) for s in store.listStatus(offsets) if (n := s.getPath().getName()).isdigit()]
    if not batches:
        return None
    # a log entry is its version, the batch's settings, and one line for each source
    return spark.read.text(f"{checkpoint}/offsets/{max(batches)}", wholetext=True).first()[0].rstrip("\n").split("\n")[-1]


def stream_paged(spark: SparkSession, path: str, checkpoint: str, items: int, source: type[PagedSource] = PagedSource) -> DataFrame:
    """IO14: the listing at `path` as a stream, at most `items` items a batch, going on behind what `checkpoint` has planned."""
    spark.dataSource.register(source)
    reader = spark.readStream.format(source.name()).option("items", items)
    after = planned_offset(spark, checkpoint)
    return (reader.option("after", after) if after else reader).load(path)


def run_paged(spark: SparkSession, path: str, put: Callable[[DataFrame, int], None], checkpoint: str, items: int, source: type[PagedSource] = PagedSource) -> None:
    """Hands all there is to put(rows, batch) in bounded batches. A batch that runs again has its number and rows again."""
    query = stream_paged(spark, path, checkpoint, items, source).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
