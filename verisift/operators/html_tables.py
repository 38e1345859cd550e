"""HTML tables to long records: T1 to T9. Cells with spans need a parser, which runs in Arrow batches; the rest are array functions."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


class _Cells(HTMLParser):
    """Rows of (text, colspan, rowspan) of the first table, nested rows included."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.done, self.rows, self.cell = 0, False, [], None

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if tag == "table":
            self.depth += 1
        elif self.depth and tag == "tr":
            self.rows.append([])
        elif self.depth and tag in ("td", "th") and self.rows:
            a = dict(attrs)
            span = lambda k: int(v) if (v := (a.get(k) or "1").strip()).isdigit() and int(v) > 0 else 1
            self.cell = ["", min(span("colspan"), 1000), min(span("rowspan"), 10_000)]
            self.rows[-1].append(self.cell)

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            self.depth -= 1
            self.done = self.depth == 0
        elif tag in ("td", "th", "tr"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None and not self.done:
            self.cell[0] += data


def grid(html: str | None) -> list[list[str]]:
    """T4: the cells' texts with column spans repeated and row spans carried down; empty rows dropped; bad spans count as 1."""
    parser = _Cells()
    parser.feed(html or "")
    out, carried = [], {}
    for row in parser.rows:
        line, col = [], 0

        def carry():
            nonlocal col
            while col in carried:
                value, left = carried.pop(col)
                line.append(value)
                if left > 1:
                    kept[col] = (value, left - 1)
                col += 1

        kept: dict[int, tuple[str, int]] = {}
        for value, across, down in row:
            carry()
            value = " ".join(value.split())
            for _ in range(across):
                line.append(value)
                if down > 1:
                    kept[col] = (value, down - 1)
                col += 1
        carry()
        carried = {**{k: v for k, v in carried.items() if k >= col}, **kept}
        if line:
            out.append(line)
    return out


def table_rows(tables: DataFrame, html: str = "html") -> DataFrame:
    """Adds `rows` (array of arrays of cleaned cells) to each table."""

    @F.pandas_udf("array<array<string>>")
    def rows(s: pd.Series) -> pd.Series:
        return s.map(grid)

    return tables.withColumn("rows", F.transform(rows(html), lambda r: F.transform(r, t.clean_cell)))


def header_size(rows: Column) -> Column:
    """The first row after row 0 with a number in a cell but the first begins the data; else row 1."""
    numeric = F.transform(rows, lambda r, i: (i > 0) & F.exists(F.slice(r, 2, F.greatest(F.size(r), F.lit(1))), lambda c: t.cell_number(c)["value"].isNotNull()))
    at = F.array_position(numeric, F.lit(True))
    return F.when(at > 0, at.cast("int") - 1).otherwise(1)


def merged_header(header: Column) -> Column:
    """One header row as it is; several joined per column by ` / `, adjacent equal ones once."""
    width = F.array_max(F.transform(header, F.size))
    column = lambda c: F.filter(F.transform(header, lambda r: F.trim(F.coalesce(F.get(r, c), F.lit("")))), lambda x: x != "")
    once = lambda xs: F.filter(xs, lambda x, i: (i == 0) | (x != F.get(xs, i - 1)))
    return F.when(F.size(header) == 1, F.get(header, 0)).otherwise(F.transform(F.sequence(F.lit(0), width - 1), lambda c: F.array_join(once(column(c)), " / ")))


def records_of(tables: DataFrame) -> DataFrame:
    """tables(…, rows) to (…, row_idx, col_idx, entity, metric, value, unit, raw_text)."""
    cut = tables.where(F.size("rows") >= 2).withColumn("_h", header_size(F.col("rows"))).withColumn("headers", merged_header(F.slice("rows", 1, F.col("_h"))))
    each = cut.select("*", F.posexplode(F.slice("rows", F.col("_h") + 1, F.size("rows"))).alias("row_idx", "_row")).where(F.trim(F.coalesce(F.get("_row", 0), F.lit(""))) != "")
    cells = each.select("*", F.posexplode("_row").alias("col_idx", "raw_text")).where((F.col("col_idx") > 0) & ~F.trim("raw_text").isin("", "-", "—"))
    head = F.coalesce(F.get("headers", F.col("col_idx")), F.concat(F.lit("col_"), F.col("col_idx").cast("string")))
    number = t.cell_number(F.col("raw_text"))
    keep = [c for c in tables.columns if c != "rows"]
    return cells.select(*keep, "row_idx", "col_idx", F.get("_row", 0).alias("entity"), head.alias("metric"), number["value"].alias("value"), number["unit"].alias("unit"), "raw_text")
