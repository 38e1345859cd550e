"""Queries over what a table is after it went through files, resumed work or a stream, and came back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import responses as r
from ..sources import files as f
from ..sources.evidence import table
from ..sources.shared import shared_folder
from ..streaming import ingest as st
from .registry import query


@query(
    """SELECT CASE WHEN doc_id % 10 <> 7 THEN doc_id END AS doc_id, CASE WHEN doc_id % 10 <> 7 THEN md5(text) END AS md5, doc_id % 10 = 7 AS bad
    FROM documents WHERE doc_id % 10 <> 8"""
)
def io1_json_lines(spark, sf_dir):
    """Every document as a line of JSON; lines of ids that end in 7 are torn, those of ids that end in 8 are blank."""
    last, line = F.pmod("doc_id", F.lit(10)), F.to_json(F.struct("doc_id", "text"))
    torn = F.substring(line, F.lit(1), (F.length(line) / 2).cast("int"))
    lines = table(spark, sf_dir, "documents").select(F.when(last == 7, torn).when(last == 8, "").otherwise(line).alias("value"))
    lines.write.text(path := shared_folder(spark, "lines"))
    back = f.read_json_lines(spark, path, "doc_id long, text string")
    return back.select("doc_id", F.md5("text").alias("md5"), F.col("_corrupt").isNotNull().alias("bad"))


@query(
    """(SELECT 'accepted' AS kind, doc_id FROM documents WHERE length(text) >= 500 ORDER BY doc_id LIMIT 100)
    UNION ALL SELECT 'within', doc_id FROM documents WHERE doc_id < 150 AND length(text) >= 500 UNION ALL SELECT 'all', doc_id FROM documents WHERE length(text) >= 500"""
)
def io3_io4_bounded_scans(spark, sf_dir):
    """A limit after the test, a limit before it, and none."""
    d, long = table(spark, sf_dir, "documents").select("doc_id", "text"), "length(text) >= 500"
    kinds = {"accepted": f.first_accepted(d, long, "doc_id", 100), "within": f.within_first(d, "doc_id", 150, long), "all": f.within_first(d, "doc_id", 0, long)}
    a, b, c = (rows.select(F.lit(kind).alias("kind"), "doc_id") for kind, rows in kinds.items())
    return a.unionByName(b).unionByName(c)


@query("SELECT source, lang, count(*) AS n, sum(coalesce(length(text), 0))::BIGINT AS chars FROM documents GROUP BY 1, 2")
def io5_cached(spark, sf_dir):
    """Counts by source and language: worked out and written by the first call, read by the second, which has nothing to build."""
    path = shared_folder(spark, "cache")
    f.cached(spark, path, lambda: table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars")))
    return f.cached(spark, path, lambda: spark.createDataFrame([], "source string, lang string, n long, chars long"))


@query("SELECT o_orderkey, round(o_totalprice * 2, 2) AS doubled, CASE WHEN o_orderkey % 3 = 0 THEN 'first' ELSE 'second' END AS run FROM orders")
def io9_st5_resumed_results(spark, sf_dir):
    """A run that stops after a third of the orders in the middle of a line, and one over all of them that goes on."""
    orders, path, schema = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), shared_folder(spark, "results"), "o_orderkey long, doubled double, run string"
    work = lambda name: lambda left: left.select("o_orderkey", F.round(F.col("o_totalprice") * 2, 2).cast("double").alias("doubled"), F.lit(name).alias("run"))
    f.append_results(orders.where("o_orderkey % 3 = 0"), "o_orderkey", work("first"), path, schema)
    orders.where("o_orderkey % 3 = 1").limit(1).select(F.concat(F.lit('{"o_orderkey":'), "o_orderkey", F.lit(',"doub'))).write.mode("append").text(path)
    f.append_results(orders, "o_orderkey", work("second"), path, schema)
    return f.finished(spark, path, schema)


@query("SELECT p_partkey, trim(p_name) AS p_name, CASE WHEN p_partkey % 5 > 0 THEN p_retailprice END AS p_retailprice, NULL::VARCHAR AS remark FROM part")
def io10_csv(spark, sf_dir):
    """Parts as CSV in another order of columns, with outer blanks and, for every fifth part, a price that is no number."""
    price = F.when(F.col("p_partkey") % 5 == 0, "n/a").otherwise(F.col("p_retailprice").cast("double").cast("string"))
    out = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("\ufeffp_partkey"), price.alias("p_retailprice"), F.concat(F.lit("  "), "p_name", F.lit(" ")).alias(" p_name"))
    out.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path := shared_folder(spark, "csv"))
    return f.read_csv(spark, path, "p_partkey long, p_name string, p_retailprice double, remark string")


@query(
    """WITH d AS (SELECT doc_id, coalesce(length(text) >= 200 AND lang <> 'de', false) AS good FROM documents)
    SELECT CASE WHEN good THEN 'manifest' ELSE 'missing' END AS kind, doc_id AS value FROM d UNION ALL SELECT 'rows', count(*) FROM d
    UNION ALL SELECT 'usable', count(*) FILTER (good) FROM d UNION ALL SELECT 'not usable', count(*) FILTER (NOT good) FROM d"""
)
def io8_io11_io12_three_way(spark, sf_dir):
    """Usable documents, others, and the report of their counts, as read back from the three sinks."""
    f.write_three_way(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "length(text) >= 200 and lang <> 'de'", path := shared_folder(spark, "three"))
    sides = [spark.read.schema("doc_id long").json(f"{path}/{kind}").select(F.lit(kind).alias("kind"), F.col("doc_id").alias("value")) for kind in ("manifest", "missing")]
    meta = spark.read.schema("rows long, usable long, missing long").json(f"{path}/meta")
    counts = meta.select(F.inline(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value")) for kind, c in (("rows", "rows"), ("usable", "usable"), ("not usable", "missing"))])))
    return sides[0].unionByName(sides[1]).unionByName(counts)


@query("SELECT CASE WHEN o_totalprice > 100000 AND o_orderstatus <> 'P' THEN 'taken' ELSE 'rejected' END AS kind, o_orderkey FROM orders")
def st1_ingest(spark, sf_dir):
    """All orders as a stream in batches of two files, with rejects apart; a second run finds nothing new."""
    folder = shared_folder(spark, "ingest")
    table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderstatus").write.parquet(f"{folder}/in")
    for _ in range(2):
        st.ingest(spark, f"{folder}/in", "o_orderkey long, o_totalprice double, o_orderstatus string", f"{folder}/out", f"{folder}/checkpoint", "o_totalprice > 100000 and o_orderstatus <> 'P'", 2)
    taken, rejected = (spark.read.parquet(f"{folder}/{name}").select(F.lit(kind).alias("kind"), "o_orderkey") for name, kind in (("out", "taken"), ("out-rejected", "rejected")))
    return taken.unionByName(rejected)


@query("SELECT event_id // 1000 AS shard, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1")
def st2_shards(spark, sf_dir):
    f.write_shards(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", path := shared_folder(spark, "shards"), 1000)
    return spark.read.parquet(path).groupBy("shard").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("SELECT count(*) AS rows, 1 AS stages FROM events")
def st3_once_reached(spark, sf_dir):
    """A stage that a stream of events sets off once; a second run, with the marker there, does not."""
    folder = shared_folder(spark, "count")
    table(spark, sf_dir, "events").select("event_id").write.parquet(f"{folder}/in")
    stage = lambda: spark.createDataFrame([(1,)], "ran int").coalesce(1).write.mode("append").json(f"{folder}/stages")
    for _ in range(2):
        st.once_reached(spark.readStream.schema("event_id long").parquet(f"{folder}/in"), 1, stage, f"{folder}/marker", f"{folder}/checkpoint")
    stages = spark.read.schema("ran int").json(f"{folder}/stages").agg(F.count("*").alias("stages"))
    return spark.read.schema("rows long").json(f"{folder}/marker").join(stages)


@query(
    """SELECT doc_id, CASE WHEN doc_id % 10 NOT IN (3, 4) THEN md5(coalesce(text, '')) END AS reply, CASE WHEN doc_id % 10 IN (3, 4) THEN 3 ELSE 1 END AS attempts,
    CASE doc_id % 10 WHEN 3 THEN 'ValueError' WHEN 4 THEN 'bad reply' END AS error FROM documents"""
)
def st6_calls(spark, sf_dir):
    """A call per document: for ids that end in 3 it raises, for those in 4 it answers nothing."""

    def call(prompt: str) -> str:
        import hashlib

        last, _, text = prompt.partition(" ")
        if last == "3":
            raise ValueError("no answer")
        return "" if last == "4" else hashlib.md5(text.encode()).hexdigest()

    prompts = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.pmod("doc_id", F.lit(10)).cast("string"), F.lit(" "), F.coalesce("text", F.lit(""))).alias("prompt"))
    return st.called(prompts, "doc_id", "prompt", call, parallel=8, wait_s=0.0)


@query(
    r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Here it is: ["' || text || '", [1]] as asked' WHEN doc_id % 3 = 1 THEN 'no list: [' || text ELSE text END AS raw FROM documents)
    SELECT doc_id, md5(nullif(regexp_extract(raw, '(?s)\[.*\]', 0), '')) AS md5 FROM d"""
)
def c27_bracketed(spark, sf_dir):
    """A list between other words, an opening bracket alone, and the text as it is."""
    text = F.col("text")
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('Here it is: ["'), text, F.lit('", [1]] as asked'))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("no list: ["), text)).otherwise(text)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(r.bracketed(raw)).alias("md5"))
