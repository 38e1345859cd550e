"""One query per operator over its whole table, by production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunked_bpe import decode_ids, encode_chunked
from .common import lookup_table
from .decontamination import find_contamination
from .fill_in_middle import fill_in_middle, restore_texts
from .fingerprints import fingerprint_documents
from .language import identify_languages
from .ngram_join import jaccard_components
from .quality import score_quality
from .sharding import shard_by_bytes
from .substring_dedup import dedup_substrings
from .token_files import token_files
from .tokens import encode_documents
from .toxicity import score_toxicity
from .whitening import whiten_embeddings


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The vocabulary of the installed public tokenizers; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(lookup_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(lookup_table(spark, sf_dir, "documents"), lookup_table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(lookup_table(spark, sf_dir, "documents"), lookup_table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(lookup_table(spark, sf_dir, "documents"), lookup_table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(lookup_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(lookup_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(lookup_table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(lookup_table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(lookup_table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(lookup_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    done = decode_ids(encode_chunked(lookup_table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = whiten_embeddings(lookup_table(spark, sf_dir, "embeddings"))
    return done.withColumn("deviation", F.col("deviation").cast("long"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = restore_texts(fill_in_middle(lookup_table(spark, sf_dir, "documents")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


_OPERATORS = (op1_sharding, op2_quality, op3_toxicity, op4_decontamination, op5_substring_dedup, op6_bpe, op7_ngram_jaccard, op8_fingerprints, op9_language, op10_token_files, op11_chunked_bpe, op12_whitening, op13_fill_in_middle)
QUERIES = {f.__name__: f for f in _OPERATORS}
ORACLES: dict[str, str] = {
    "op5_substring_dedup": r"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        k AS (SELECT r, doc_id, p, md5(array_to_string(w[p:p + 12], ' ')) AS h FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE doc_id IS NOT NULL)),
        f AS (SELECT h, min(doc_id) AS least FROM k GROUP BY 1),
        gone AS (SELECT DISTINCT r, unnest(range(p, p + 13)) AS i FROM k JOIN f USING (h) WHERE least < doc_id),
        kept AS (SELECT r, i, x FROM (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d) ANTI JOIN gone USING (r, i)),
        text AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM kept GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN text USING (r)
    """,
    "op7_ngram_jaccard": r"""
        WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT r, doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
        x AS (SELECT r, len(g) AS n, md5(unnest(g)) AS g FROM s),
        links AS (SELECT a.r AS a, b.r AS b FROM x a JOIN x b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(r, c) AS (SELECT r, r FROM s UNION SELECT e.b, c FROM reach JOIN edges e ON e.a = reach.r)
        SELECT o.doc_id, len(o.g) AS n_shingles, (SELECT min(t.doc_id) FROM reach JOIN s t ON t.r = reach.c WHERE reach.r = o.r) AS component_id FROM s o
    """,
    "op13_fill_in_middle": """
        WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
        g AS (SELECT *, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM h),
        c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS z,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
        p AS (SELECT doc_id, t, n, form, a, z - a AS m, left(t, a) AS prefix, substring(t, a + 1, z - a) AS middle, substring(t, z + 1) AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
            sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
        FROM p
    """,
}
