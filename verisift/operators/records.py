"""Papers to tables, the keyed index, and joins by key or place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.text import record_name

#: The three maps of a paper in their order.
TABLE_MAPS = ("tables", "table_set", "supplementary_table_set")


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def unnest_papers(papers: DataFrame) -> DataFrame:
    """One row per entry of the three maps id -> (table_html, html, caption, capture, label): paper_id, table_ord (maps in
    their order, entries by id), table_id, html, caption. Null maps and null entries give none."""

    def tagged(name: str) -> Column:
        entries = F.array_sort(F.map_entries(F.coalesce(name, F.create_map().cast(papers.schema[name].dataType))))
        return F.transform(entries, lambda e: F.struct(F.lit(name).alias("kind"), e["key"].alias("table_id"), e["value"].alias("t")))

    each = papers.select("paper_id", F.posexplode(F.filter(F.concat(*map(tagged, TABLE_MAPS)), lambda e: e["t"].isNotNull())).alias("table_ord", "e"))
    t = F.col("e.t")
    main, other = first_text(t["table_html"], t["html"]), first_text(t["html"], t["table_html"])
    return each.select("paper_id", "table_ord", "e.table_id", F.when(F.col("e.kind") == TABLE_MAPS[0], main).otherwise(other).alias("html"), first_text(t["caption"], t["capture"], t["label"]).alias("caption"))


def with_records(tables: DataFrame, records: DataFrame) -> DataFrame:
    """The tables that have a record."""
    return tables.join(records.select("paper_id", "table_ord").distinct(), ["paper_id", "table_ord"], "left_semi")


def canonical_unit(unit: Column) -> Column:
    """The unit that an alias stands for, else the unit."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in fixed.UNIT_ALIASES.items() for x in kv]), unit), unit)


def corpus_statistics(papers: DataFrame, records: DataFrame) -> DataFrame:
    """papers(paper_id, bad): counts, parse errors, and averages rounded to two places; null averages without tables."""
    per = records.groupBy("paper_id").agg(F.count_distinct("table_ord").alias("tables"), F.count("*").alias("records"))
    a = papers.join(per, "paper_id", "left").agg(
        F.count("*").alias("papers"), F.count_if("bad").alias("parse_errors"), F.count("tables").alias("with_tables"), F.count_if(~F.col("bad") & F.col("tables").isNull()).alias("without_tables"),
        F.coalesce(F.sum("tables"), F.lit(0)).alias("tables"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
    )
    return a.withColumns({"tables_per_paper": F.round(F.try_divide("tables", "with_tables"), 2), "records_per_table": F.round(F.try_divide("records", "tables"), 2)})


def build_index(lines: DataFrame, *ties: str) -> tuple[DataFrame, DataFrame]:
    """(records of the last line with text per paper, counters over all lines). lines: paper_id, line_no, records (array of
    structs with `entity`, null for a blank line). Records without an entity go, from counters too; papers are counted per line.

    Of a paper's lines with one number the first by the columns `ties` counts; without them line numbers must differ."""
    full = lines.where(F.col("records").isNotNull()).withColumn("records", F.filter("records", lambda r: F.coalesce(r["entity"], F.lit("")) != ""))
    last = Window.partitionBy("paper_id").orderBy(F.desc("line_no"), *ties)
    kept = full.withColumn("_r", F.row_number().over(last)).where("_r = 1").select("paper_id", F.posexplode("records").alias("rec_ord", "r"))
    return kept.select("paper_id", "rec_ord", "r.*", record_name(F.col("r.entity")).alias("entity_norm")), full.agg(F.count("*").alias("lines"), F.coalesce(F.sum(F.size("records")), F.lit(0)).alias("records"))


def coverage_ratio(samples: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Samples, those whose key is among ids, and their share (0 without samples)."""
    known = ids.select(key).distinct().withColumn("_in", F.lit(1))
    a = samples.select(key).join(known, key, "left").agg(F.count("*").alias("samples"), F.count("_in").alias("covered"))
    return a.withColumn("ratio", F.coalesce(F.try_divide("covered", "samples"), F.lit(0.0)))


def zip_by_place(frames: list[DataFrame], place: str = "place") -> DataFrame:
    """Rows of equal place side by side; what is longer than the shortest frame goes."""
    return reduce(lambda a, b: a.join(b, place), frames)


def positional_agreement(a: DataFrame, b: DataFrame, label: str, place: str = "place") -> DataFrame:
    """Places that both frames have and the share of equal labels (null equals null)."""
    both = zip_by_place([a.select(place, F.col(label).alias("_a")), b.select(place, F.col(label).alias("_b"))], place)
    return both.agg(F.count("*").alias("n"), F.avg(F.col("_a").eqNullSafe(F.col("_b")).cast("double")).alias("agreement"))


def in_seed_order(rows: DataFrame, seeds: DataFrame, key: str, line: str, place: str = "place") -> DataFrame:
    """The last row per key, for the keys of seeds(key, place) that exist, in their order."""
    last = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(line)))).where("_r = 1").drop("_r")
    return seeds.select(key, place).join(last, key).orderBy(place)


def first_existing(samples: DataFrame, files: DataFrame, cached: DataFrame, most: int | None = None) -> DataFrame:
    """Per paper the first path (by sample, then place in the sample) that is among files(path), at most `most` papers by
    paper_id, and `to_build`: whether it is not among cached(paper_id). samples: paper_id, sample_ord, paths."""
    each = samples.select("paper_id", "sample_ord", F.posexplode("paths").alias("path_ord", "path")).join(files.select("path").distinct(), "path", "left_semi")
    first = each.groupBy("paper_id").agg(F.min_by("path", F.struct("sample_ord", "path_ord")).alias("path"))
    first = first.orderBy("paper_id").limit(most) if most else first
    return first.join(cached.select("paper_id").distinct().withColumn("_c", F.lit(True)), "paper_id", "left").select("paper_id", "path", F.col("_c").isNull().alias("to_build"))
