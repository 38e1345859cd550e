"""The corpus pipeline: toxic documents go, near duplicates go, repeated spans go, benchmark leaks go, the rest is tokenised."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verisift.llm.common import lookup_table, shared_dir
from verisift.llm.decontamination import drop_contaminated
from verisift.llm.ngram_join import keep_one_per_component
from verisift.llm.queries import tokenizer_path
from verisift.llm.substring_dedup import keep_first_spans
from verisift.llm.tokens import encode_documents
from verisift.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows called toxic by the model learnt from `labels` go.

    Null and empty texts stay; rows with null or repeated doc_ids, and repeated rows, are judged each by its text; without usable
    labels nothing goes; an empty table stays empty; other columns stay as they are, whatever their names."""
    return drop_toxic(docs, lookup_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates stays: the first by doc_id (null last) and the text's digest, which settles ties.

    Rows without words (null, empty, blank texts) stay, of equal ones one; null and repeated doc_ids are rows like others; an
    empty table stays empty; other columns stay as they are, whatever their names."""
    return keep_one_per_component(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that a smaller doc_id holds too are cut out of `text`; rows that lose every word go.

    Null and empty texts stay; rows with a null doc_id lose nothing and cost others nothing; rows of one doc_id, repeated ones too,
    do not act on each other; an empty table stays empty; other columns stay as they are, but for `n_chars`."""
    return keep_first_spans(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold an item of `benchmark` go.

    Null and empty texts hold none; rows with null or repeated doc_ids are judged each by its text, equal ones alike; items
    without text are none; an empty table on either side takes nothing out; other columns stay as they are."""
    return drop_contaminated(docs, lookup_table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The end product: doc_id, n_tokens, ids (array<int>), and digests of the ids and of the text decoded from them.

    Null and empty texts have no ids; null and repeated doc_ids, and repeated rows, give a row each; an empty table gives none;
    other columns end here."""
    return encode_documents(docs, tokenizer_path(), with_ids=True).drop("decoded")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("substrings", substrings), ("decontamination", decontamination), ("tokenise", tokenise)]
#: The stages learn a model, find components and merge byte pairs, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read back."""
    docs = lookup_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = shared_dir(spark)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
