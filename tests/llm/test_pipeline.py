"""run() over a small folder, whose survivors and their texts are known by how they were made."""

import hashlib
import random

import pytest

import corpus_pipeline
from verisift.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    g = random.Random(5)
    word = lambda: "".join(g.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    words = lambda n: [word() for _ in range(n)]
    bad = ["zorgblat", "mirkfang", "drooltusk"]
    texts, want, labels = {}, {}, []
    for i in range(60):
        texts[i] = want[i] = " ".join(words(80))
        labels.append((i, 1, 0))
    for i in range(100, 140):
        mixed = words(70) + [g.choice(bad) for _ in range(10)]
        g.shuffle(mixed)
        texts[i] = " ".join(mixed)
        labels.append((i, 1, 1))
    texts[200] = " ".join(words(40) + bad * 4 + words(20))  # toxic, without a label
    texts[300] = texts[301] = texts[302] = want[300] = " ".join(words(80))
    texts[310] = want[310] = " ".join(words(80))
    texts[311] = texts[310] + " " + word()
    shared, own, rest = words(30), words(40), words(50)
    texts[320] = want[320] = " ".join(words(45) + shared)
    texts[321], want[321] = " ".join(own + shared + rest), " ".join(own + rest)
    item = words(25)
    texts[330] = " ".join(words(30) + item + words(30))
    texts[340], texts[341], want[340], want[341] = None, "", "", ""
    path = str(tmp_path_factory.mktemp("corpus"))
    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    save("documents", [(i, t, "en", "s", len(t or ""), "clash") for i, t in texts.items()], DOCS)
    save("labels", labels, "doc_id long, quality int, toxic int")
    save("benchmark", [(1, " ".join(item)), (None, "short"), (3, None)], "item_id long, text string")
    return path, want


def test_run_keeps_what_it_should(spark, folder):
    from tokenizers import Tokenizer

    path, want = folder
    encode = Tokenizer.from_file(tokenizer_path())
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, path).collect()}
    assert sorted(rows) == sorted(want)
    for i, text in want.items():
        ids = encode.encode(text, add_special_tokens=False).ids
        assert (rows[i]["ids"], rows[i]["n_tokens"]) == (ids, len(ids))
        assert rows[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_each_stage_acts_on_its_own(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    gone = {"toxicity": {*range(100, 140), 200}, "near_duplicates": {301, 302, 311}, "substrings": {301, 302}, "decontamination": {330}, "tokenise": set()}
    everything = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        left = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert everything - left == gone[name], name
        assert name == "tokenise" or out.columns == docs.columns


def test_run_over_no_documents(spark, folder, tmp_path):
    path, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
