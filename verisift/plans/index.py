"""Queries over papers and their tables, the keyed index, joins by place, messages and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import messages as ms
from ..operators import records as rc
from ..sources.evidence import RECORDS_SQL, fact_records, table
from .registry import query

ENTRY = "struct<table_html:string,html:string,caption:string,capture:string,label:string>"


def _papers(spark, sf_dir):
    """A paper per customer: up to one table in each of the three maps, with fields that are missing or empty in turn."""
    k = F.col("c_custkey")
    text = lambda x: F.concat(F.lit(x), k.cast("string"))
    entry = lambda i: F.struct(
        F.when((k + i) % 3 == 0, "").when((k + i) % 3 == 1, text("T")).alias("table_html"), F.when((k + i) % 4 == 0, "").otherwise(text("H")).alias("html"),
        F.when((k + i) % 2 == 0, "").otherwise(text("cap")).alias("caption"), F.when((k + i) % 5 == 0, text("capture")).alias("capture"), F.lit("label").alias("label"),
    )
    kind = f"map<string,{ENTRY}>"
    one = lambda i: F.when(k % (i + 2) != 1, F.create_map(text(f"m{i}-"), entry(i))).cast(kind)
    return table(spark, sf_dir, "customer").select(k.alias("paper_id"), one(0).alias("tables"), one(1).alias("table_set"), one(2).alias("supplementary_table_set"))


def _papers_sql() -> str:
    part = """SELECT k AS paper_id, {i} AS map_ord, 'm{i}-' || k AS table_id, CASE (k + {i}) % 3 WHEN 0 THEN '' WHEN 1 THEN 'T' || k END AS t, CASE WHEN (k + {i}) % 4 = 0 THEN '' ELSE 'H' || k END AS h,
      CASE WHEN (k + {i}) % 2 = 0 THEN '' ELSE 'cap' || k END AS caption, CASE WHEN (k + {i}) % 5 = 0 THEN 'capture' || k END AS capture FROM (SELECT c_custkey AS k FROM customer) WHERE k % {m} <> 1"""
    return "e AS (" + " UNION ALL ".join(part.format(i=i, m=i + 2) for i in range(3)) + ")"


@query(
    f"""WITH {_papers_sql()}, r AS (SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY map_ord, table_id) - 1 AS table_ord, table_id, CASE WHEN map_ord = 0 THEN coalesce(nullif(t, ''), nullif(h, ''), '') ELSE coalesce(nullif(h, ''), nullif(t, ''), '') END AS html,
      coalesce(nullif(caption, ''), nullif(capture, ''), 'label') AS caption FROM e) SELECT * FROM r WHERE html <> ''"""
)
def t1_t2_t3_paper_tables(spark, sf_dir):
    """Tables whose markup is not empty count as those with records."""
    tables = rc.unnest_papers(_papers(spark, sf_dir))
    return rc.with_records(tables, tables.where("html <> ''").select("paper_id", "table_ord"))


@query("SELECT n_nationkey AS k, CASE n_nationkey % 4 WHEN 0 THEN '%' WHEN 1 THEN '%' WHEN 2 THEN 'dB' ELSE 'furlong' END AS unit FROM nation")
def t11_canonical_unit(spark, sf_dir):
    k = F.col("n_nationkey")
    unit = F.when(k % 4 == 0, "percent").when(k % 4 == 1, "\\%").when(k % 4 == 2, "dB").otherwise("furlong")
    return table(spark, sf_dir, "nation").select(k.alias("k"), rc.canonical_unit(unit).alias("unit"))


@query(
    f"""WITH {RECORDS_SQL}, p AS (SELECT paper_id, count(DISTINCT table_ord) AS tables, count(*) AS records FROM records GROUP BY 1), a AS (SELECT n_name AS paper_id, false AS bad FROM nation UNION ALL SELECT r_name, r_regionkey % 2 = 0 FROM region)
    SELECT count(*) AS papers, count(*) FILTER (bad) AS parse_errors, count(tables) AS with_tables, count(*) FILTER (NOT bad AND tables IS NULL) AS without_tables, sum(tables)::BIGINT AS tables, sum(records)::BIGINT AS records,
      round(sum(tables) / count(tables)::DOUBLE, 2) AS tables_per_paper, round(sum(records) / sum(tables)::DOUBLE, 2) AS records_per_table FROM a LEFT JOIN p USING (paper_id)"""
)
def t10_corpus_statistics(spark, sf_dir):
    papers = table(spark, sf_dir, "nation").select(F.col("n_name").alias("paper_id"), F.lit(False).alias("bad"))
    more = table(spark, sf_dir, "region").select(F.col("r_name").alias("paper_id"), (F.col("r_regionkey") % 2 == 0).alias("bad"))
    return rc.corpus_statistics(papers.unionByName(more), fact_records(spark, sf_dir))


def _lines(spark, sf_dir):
    """A line per lineitem row; those of quantity over 45 are blank; every third record has no entity. An order may have several rows
    of one line number: `place` is the row's place in the table's files, by name."""
    blank = F.col("l_quantity") > 45
    record = F.struct(F.when(F.col("l_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("Part-"), F.col("l_partkey").cast("string"))).alias("entity"), F.col("l_quantity").cast("double").alias("value"))
    other = F.struct(F.lit("All parts").alias("entity"), F.lit(1.0).alias("value"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("line_no"), F.struct("_metadata.file_path", "_metadata.row_index").alias("place"), F.when(~blank, F.array(record, other)).alias("records"))


LINES_SQL = "l AS (SELECT l_orderkey AS paper_id, l_linenumber AS line_no, l_partkey AS p, l_quantity AS q FROM lineitem WHERE l_quantity <= 45)"


@query(
    f"""WITH {LINES_SQL}, w AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY line_no DESC) = 1)
    SELECT paper_id, 0 AS rec_ord, 'Part-' || p AS entity, q::DOUBLE AS value, 'part' || p AS entity_norm FROM w WHERE p % 3 <> 0 UNION ALL SELECT paper_id, CASE WHEN p % 3 = 0 THEN 0 ELSE 1 END, 'All parts', 1.0::DOUBLE, 'allparts' FROM w"""
)
def j1_build_index(spark, sf_dir):
    return rc.build_index(_lines(spark, sf_dir), "place")[0]


@query(f"WITH {LINES_SQL} SELECT count(*) AS lines, sum(CASE WHEN p % 3 = 0 THEN 1 ELSE 2 END)::BIGINT AS records FROM l")
def j1_index_counters(spark, sf_dir):
    return rc.build_index(_lines(spark, sf_dir), "place")[1]


@query("SELECT count(*) AS samples, count(l.doc_id) AS covered, count(l.doc_id) / greatest(count(*), 1)::DOUBLE AS ratio FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def j4_coverage_ratio(spark, sf_dir):
    return rc.coverage_ratio(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT s_suppkey AS place, s_name, c_name, p_type FROM supplier JOIN customer ON c_custkey = s_suppkey JOIN part ON p_partkey = s_suppkey")
def j12_zip(spark, sf_dir):
    s, c, p = (table(spark, sf_dir, t) for t in ("supplier", "customer", "part"))
    return rc.zip_by_place([s.select(F.col("s_suppkey").alias("place"), "s_name"), c.select(F.col("c_custkey").alias("place"), "c_name"), p.select(F.col("p_partkey").alias("place"), "p_type")])


@query("SELECT count(*) AS n, avg(CASE WHEN a.quality = (CASE WHEN b.label > 3 THEN 1 ELSE 0 END) THEN 1.0 ELSE 0.0 END)::DOUBLE AS agreement FROM labels a JOIN embeddings b ON a.doc_id = b.vec_id")
def j13_positional_agreement(spark, sf_dir):
    a = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("place"), F.col("quality").alias("label"))
    b = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("place"), F.when(F.col("label") > 3, 1).otherwise(0).alias("label"))
    return rc.positional_agreement(a, b, "label")


@query("WITH last AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1) SELECT conv_id, n_nationkey AS place, turn, role FROM last JOIN nation ON conv_id = 24 - n_nationkey")
def j14_seed_order(spark, sf_dir):
    seeds = table(spark, sf_dir, "nation").select((24 - F.col("n_nationkey")).alias("conv_id"), F.col("n_nationkey").alias("place"))
    return rc.in_seed_order(table(spark, sf_dir, "conversations"), seeds, "conv_id", "turn").select("conv_id", "place", "turn", "role")


@query(
    """WITH e AS (SELECT o_custkey AS paper_id, o_orderkey AS s, unnest([0, 1]) AS i, unnest(['img' || o_orderkey % 701, 'img' || o_orderkey % 89]) AS path FROM orders), f AS (SELECT 'img' || p_partkey AS path FROM part WHERE p_partkey % 2 = 0),
    w AS (SELECT paper_id, arg_min(path, (s, i)) AS path FROM e WHERE path IN (SELECT path FROM f) GROUP BY 1)
    SELECT paper_id, path, paper_id % 4 <> 0 AS to_build FROM w ORDER BY paper_id LIMIT 60"""
)
def j15_first_path(spark, sf_dir):
    o = F.col("o_orderkey")
    path = lambda n: F.concat(F.lit("img"), (o % n).cast("string"))
    samples = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("paper_id"), o.alias("sample_ord"), F.array(path(701), path(89)).alias("paths"))
    files = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("img"), F.col("p_partkey").cast("string")).alias("path"))
    cached = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("paper_id"))
    return rc.first_existing(samples, files, cached, 60)


# --- messages -------------------------------------------------------------------------------

@query(
    """SELECT n_nationkey AS k, CASE n_nationkey % 3 WHEN 0 THEN 'what does nation ' || n_nationkey || ' show?' WHEN 1 THEN 'plain ' || n_name ELSE 'nothing marked' END AS question,
      CASE n_nationkey % 3 WHEN 0 THEN 'about ' || n_name || '. part of region ' || n_regionkey || '.' ELSE '' END AS evidence, CASE WHEN n_nationkey % 2 = 0 THEN 'It shows ' || n_name ELSE '' END AS answer FROM nation"""
)
def c20_parse_messages(spark, sf_dir):
    n, k = F.col("n_name"), F.col("n_nationkey")
    full = F.concat(F.lit("Question: what does nation "), k.cast("string"), F.lit(" show? \n\nCaption: about "), n, F.lit(".\n\nContext: part of region "), F.col("n_regionkey").cast("string"), F.lit("."))
    said = lambda role, text, many: F.struct(F.lit(role).alias("role"), text.alias("text"), many.alias("is_list"))
    user = said("user", F.when(k % 3 == 0, full).when(k % 3 == 1, F.concat(F.lit("plain "), n)).otherwise("nothing marked"), k % 3 != 1)
    messages = F.filter(F.array(said("system", F.lit("Question: no"), F.lit(True)), user, F.when(k % 2 == 0, said("assistant", F.concat(F.lit("It shows "), n), F.lit(False)))), lambda m: m.isNotNull())
    p = ms.parse_messages(messages)
    return table(spark, sf_dir, "nation").select(k.alias("k"), p["question"].alias("question"), p["evidence"].alias("evidence"), p["answer"].alias("answer"))


@query(
    """WITH s AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 = 3 THEN '' ELSE n_name END AS c, n_nationkey % 3 AS m FROM nation)
    SELECT k, concat_ws(' ', CASE WHEN m > 0 THEN 'look' END, CASE WHEN m > 1 THEN 'compare' END, nullif(c, '')) AS reasoning_first, concat_ws(' ', nullif(c, ''), CASE WHEN m > 0 THEN 'look' END, CASE WHEN m > 1 THEN 'compare' END) AS conclusion_first,
      concat_ws(chr(10) || chr(10), CASE m WHEN 1 THEN 'Thinking:' || chr(10) || 'Step 1: look' WHEN 2 THEN 'Thinking:' || chr(10) || 'Step 1: look' || chr(10) || 'compare' END, 'Answer: ' || nullif(c, '')) AS blocks FROM s"""
)
def c19_answer_text(spark, sf_dir):
    k = F.col("n_nationkey")
    step = lambda a, b: F.struct(F.lit(a).cast("string").alias("step"), F.lit(b).alias("reasoning"))
    steps = F.when(k % 3 == 1, F.array(step("1", "look"))).when(k % 3 == 2, F.array(step("1", "look"), step("", "compare")))
    end = F.when(k % 4 == 3, "").otherwise(F.col("n_name"))
    return table(spark, sf_dir, "nation").select(k.alias("k"), *[ms.answer_text(steps, end, f).alias(f) for f in ("reasoning_first", "conclusion_first", "blocks")])


@query(
    """SELECT doc_id, 4 + 0 * doc_id - 1 AS messages, 'user' AS role, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS parts, CASE WHEN text <> '' THEN 'Context: ' || left(text, 2000) || chr(10) || chr(10) ELSE '' END || 'Question: why?' AS asked, left(text, 100) AS claim, left(text, 150) AS detail FROM documents"""
)
def c21_c24_build_messages(spark, sf_dir):
    images = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a.png")))
    d = table(spark, sf_dir, "documents").withColumn("m", ms.build_messages(F.lit("why?"), F.lit(""), F.col("text"), images, F.lit("so"), "be brief"))
    user = F.get("m", 1)
    return d.select("doc_id", F.size("m").alias("messages"), user["role"].alias("role"), F.size(user["content"]).alias("parts"), F.element_at(user["content"], -1)["value"].alias("asked"), ms.cut(F.col("text"), "claim").alias("claim"), ms.cut(F.col("text"), "detail").alias("detail"))


@query("SELECT doc_id, word, CASE WHEN doc_id % 6 IN (0, 1) THEN 0 WHEN doc_id % 6 IN (2, 3, 4) THEN 2 ELSE 1 END AS label FROM (SELECT doc_id, ['Supported', ' entailment ', 'contradicts', 'REFUTED ', 'refutes', 'not supported'][doc_id % 6 + 1] AS word FROM labels)")
def c28_label_of(spark, sf_dir):
    words = F.array(*map(F.lit, ("Supported", " entailment ", "contradicts", "REFUTED ", "refutes", "not supported")))
    said = table(spark, sf_dir, "labels").select("doc_id", F.get(words, (F.col("doc_id") % 6).cast("int")).alias("word"))
    return said.withColumn("label", t.label_of(F.col("word")))


@query("""SELECT item_id, 'Evidence:' || chr(10) || left(text, 1500) || chr(10) || chr(10) || 'Statement:' || chr(10) || left(lower(text), 500) || chr(10) || chr(10) || 'How well does the evidence support the statement? Reply with JSON: {"score": 0 to 10}' AS prompt FROM benchmark""")
def c25_judge_prompt(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", ms.judge_prompt(F.lower("text"), F.col("text")).alias("prompt"))


@query("SELECT doc_id, i, start, start + length(sentence) AS \"end\", sentence FROM (SELECT doc_id, 0 AS i, 0 AS start, 'Here stands number ' || doc_id || '.' AS sentence FROM documents UNION ALL SELECT doc_id, 1, length('Here stands number ' || doc_id || '.  '), 'The same words again. ' || 'x' FROM documents WHERE false UNION ALL SELECT doc_id, 1, length('Here stands number ' || doc_id || '.  Short. '), 'Here stands number ' || doc_id || '.' FROM documents)")
def c3_sentence_spans(spark, sf_dir):
    """A sentence, a short one that is left out, and the first one again: the second span lies behind the first."""
    one = F.concat(F.lit("Here stands number "), F.col("doc_id").cast("string"), F.lit("."))
    text = F.concat(one, F.lit("  Short. "), one)
    d = table(spark, sf_dir, "documents").select("doc_id", text.alias("text")).select("doc_id", "text", F.posexplode(ms.sentence_spans(F.col("text"))).alias("i", "s"))
    return d.select("doc_id", "i", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.expr("substr(text, s.start + 1, s.end - s.start)").alias("sentence"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE '/data/' || page_id || '.png' END AS full_path, CASE WHEN page_id % 3 = 0 THEN false ELSE page_id % 2 = 0 END AS \"exists\" FROM pages")
def c29_resolved_paths(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.concat(F.col("page_id").cast("string"), F.lit(".png"))).alias("path"))
    files = table(spark, sf_dir, "pages").where("page_id % 2 = 0").select(F.concat(F.lit("/data/"), F.col("page_id").cast("string"), F.lit(".png")).alias("path"))
    return ms.resolved(p, "path", files, "/data").select("page_id", "full_path", "exists")
