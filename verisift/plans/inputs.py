"""Queries over what a table holds in another form: feature arrays, listings, archives, pictures, batches of ids; and a grid of settings."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import collation as co
from ..operators import images as im
from ..operators.grid import run_grid
from ..operators.sampling import numbered
from ..sources.archives import read_archives, write_archives
from ..sources.evidence import table
from ..sources.npy import local_path, read_npy, write_npy
from ..sources.shared import shared_folder
from ..streaming.ingest import ingest_listing
from ..streaming.paged import read_paged
from .registry import H, query


@query(
    f"""SELECT split, row_number() OVER (PARTITION BY split ORDER BY {H.format(k='vec_id')}, vec_id) - 1 AS row, label, CAST(vec_id % 20 AS FLOAT) / 16 AS ratio, len(embedding) AS width, embedding[1] AS first, embedding[1] + embedding[2] AS sum
    FROM (SELECT *, CASE WHEN vec_id % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM embeddings)"""
)
def io6_io7_npy_features(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("split", F.when(F.col("vec_id") % 5 == 0, "val").otherwise("train"))
    parts = [numbered(e.where(F.col("split") == s), "vec_id")[0].withColumnRenamed("place", "row") for s in ("train", "val")]
    rows = parts[0].unionByName(parts[1]).select("split", "row", F.col("embedding").alias("visual"), F.slice(F.col("embedding"), 1, 2).alias("text"), "label", ((F.col("vec_id") % 20).cast("float") / 16).alias("perturbation_ratio"))
    write_npy(rows, folder := shared_folder(spark, "npy"))
    back = read_npy(spark, folder)
    return back.select("split", "row", "label", F.col("perturbation_ratio").alias("ratio"), F.size("visual").alias("width"), F.get("visual", 0).alias("first"), (F.get("text", 0) + F.get("text", 1)).alias("sum"))


def _listed(spark, sf_dir, name: str, key: str, a_page: int = 3) -> str:
    """A listing, in pages of a few items, of text files with the keys of a table."""
    folder = shared_folder(spark, "listing")
    table(spark, sf_dir, name).select(F.col(key).cast("string")).write.text(f"{folder}/items")
    items = sorted(f"items/{f}" for f in os.listdir(f"{local_path(folder)}/items") if f.startswith("part-"))
    for number, at in enumerate(range(0, max(1, len(items)), a_page)):
        with open(f"{local_path(folder)}/{number}.json", "w", encoding="utf-8") as page:
            json.dump({"items": items[at : at + a_page], "more": at + a_page < len(items)}, page)
    return folder


@query("SELECT user_id FROM events")
def io13_paged_listing(spark, sf_dir):
    return read_paged(spark, _listed(spark, sf_dir, "events", "user_id")).select(F.col("value").cast("long").alias("user_id"))


@query("SELECT doc_id FROM documents WHERE doc_id % 10 <> 3")
def io14_st1_listing_stream(spark, sf_dir):
    """Every batch of the stream, its bad rows (ids that end in 3) apart."""
    folder = shared_folder(spark, "stream")
    ingest_listing(spark, _listed(spark, sf_dir, "documents", "doc_id"), f"{folder}/out", f"{folder}/checkpoint", "value not like '%3'", 1 << 62, items=2)
    return spark.read.parquet(f"{folder}/out").select(F.col("value").cast("long").alias("doc_id"))


@query("SELECT 'pages/' || page_id || '.html' AS path, octet_length(encode(html)) AS size, md5(html) AS md5 FROM pages")
def io15_archives(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    done = write_archives(pages, shared_folder(spark, "archives"))
    return read_archives(spark, [r["archive"] for r in done.collect()]).select("path", "size", F.md5("content").alias("md5"))


@query(
    """WITH p AS (SELECT vec_id, len(embedding) AS n, list_transform(embedding, lambda x: CAST(greatest(0, least(255, floor((x::DOUBLE + 1) * 100))) AS BIGINT)) AS v FROM embeddings)
    SELECT vec_id, 'ok' AS reason, 8 AS width, n // 8 AS height, list_sum(v) * 3 AS total, v[1] AS first, v[n] AS last FROM p"""
)
def io16_image_scan(spark, sf_dir):
    """A grey picture of each vector, eight pixels a row, packed with each of the five filters in turn, and scanned."""

    def pictures(batches):
        for batch in batches:
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pixels = np.clip(np.floor((np.array(vector, np.float64) + 1) * 100), 0, 255).astype(np.uint8).reshape(-1, 8)
                yield pa.RecordBatch.from_arrays([pa.array([str(key)]), pa.array([im.encode_png(pixels, key % 5)], pa.binary())], names=["path", "content"])

    files = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(pictures, "path string, content binary").withColumn("length", F.octet_length("content"))
    number = lambda at: F.conv(F.hex(F.substring(F.col("pixels"), at, 1)), 16, 10).cast("long")
    bytes_ = F.transform(F.sequence(F.lit(1), F.octet_length("pixels")), lambda i: F.conv(F.hex(F.call_function("substring", "pixels", i, F.lit(1))), 16, 10).cast("long"))
    total = F.aggregate(bytes_, F.lit(0).cast("long"), lambda a, x: a + x)
    return im.scan_images(files).select(F.col("path").cast("long").alias("vec_id"), "reason", "width", "height", total.alias("total"), number(1).alias("first"), number(-1).alias("last"))


@query(
    f"""WITH m AS (SELECT conv_id, turn, role, 2 + len(list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '')) AS n FROM conversations),
    s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 2 AS told FROM m),
    c AS (SELECT conv_id, least(sum(n), 512) AS n, max(CASE WHEN role = 'assistant' AND told <= 512 THEN told END) AS prompt FROM s GROUP BY 1),
    b AS (SELECT conv_id, n, n - coalesce(prompt, floor(n * 0.8::DOUBLE)) AS taught, (row_number() OVER (ORDER BY n, {H.format(k='conv_id')}, conv_id) - 1) // 32 AS batch FROM c)
    SELECT conv_id, n, taught, batch, max(n) OVER (PARTITION BY batch) AS width FROM b"""
)
def m5_collation(spark, sf_dir):
    """Each conversation as ids: two that mark a message and its role, then one for each word; only the last answer is taught."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), " ", -1), lambda w: w != "")
    message = F.concat(F.array(F.lit(1), F.when(F.col("role") == "assistant", 2).otherwise(3)), F.transform(words, lambda w: (F.pmod(F.xxhash64(w), F.lit(50_000)) + 4).cast("int")))
    said = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", message.alias("ids")))).alias("m"))
    ids = F.slice(F.flatten(F.transform("m", lambda x: x["ids"])), 1, 512)
    rows = said.select("conv_id", ids.alias("ids")).withColumn("labels", co.masked_labels(F.col("ids"), [1, 2]))
    out = co.padded(co.length_batches(rows, "conv_id", "ids", 32, 512), "ids", "labels")
    real = F.aggregate("attention", F.lit(0), lambda a, x: a + x)
    return out.select("conv_id", real.alias("n"), F.size(F.filter("labels", lambda x: x != co.IGNORED)).alias("taught"), "batch", F.size("ids").alias("width"))


@query(
    """WITH g AS (SELECT gate, scale, count(*) FILTER (value >= gate)::DOUBLE AS n, avg(value * scale) FILTER (value >= gate) AS mean FROM events, (VALUES (1), (50), (90)) a(gate), (VALUES (1), (10)) b(scale) GROUP BY 1, 2)
    SELECT 'gate=' || gate || ',scale=' || scale AS run, unnest(['n', 'mean']) AS figure, unnest([n, round(mean, 6)]) AS value FROM g"""
)
def m9_grid_summary(spark, sf_dir):
    measure = lambda gate, scale: {"n": F.count_if(F.col("value") >= gate), "mean": F.avg(F.when(F.col("value") >= gate, F.col("value") * scale))}
    out = run_grid(table(spark, sf_dir, "events"), {"gate": [1, 50, 90], "scale": [1, 10]}, measure, shared_folder(spark, "grid"))
    return out.select("run", "figure", F.round("value", 6).alias("value"))
