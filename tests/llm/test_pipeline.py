"""Every stage of the pipeline against brute force on its own input."""

import re

import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ampfold.llm import quality, secrets
from tests.conftest import SF_MID
from tests.llm.test_packing import check
from tests.llm.test_sharding_and_dedup import brute_dedup
from tests.llm.test_simhash import brute_components, brute_print


def test_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    columns = docs.columns
    steps = [f for _, f in corpus_pipeline.STAGES]
    rows = lambda df: {r["doc_id"]: r.asDict() for r in df.collect()}
    before = rows(docs)

    good = steps[0](spark, docs, SF_MID).checkpoint()
    scores = quality.score_documents(docs, spark.read.parquet(f"{SF_MID}/labels.parquet"))
    kept = {r["doc_id"] for r in scores.where("predicted = 1").collect()}
    assert good.columns == columns and rows(good) == {i: before[i] for i in kept}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    assert sum(i in kept for i in labels if labels[i] == 1) >= 0.97 * sum(labels.values())

    single = steps[1](spark, good, SF_MID).checkpoint()
    texts = [(i, before[i]["text"]) for i in kept]
    kept = {keep for _, keep, _, _ in brute_dedup(texts, "max")}
    assert single.columns == columns and rows(single) == {i: before[i] for i in kept}

    apart = steps[2](spark, single, SF_MID).checkpoint()
    prints = [(i, brute_print(before[i]["text"])) for i in kept]
    kept = set(brute_components(prints).values())
    assert apart.columns == columns and rows(apart) == {i: before[i] for i in kept}

    hidden = steps[3](spark, apart, SF_MID).checkpoint()
    after = rows(hidden)
    assert hidden.columns == columns and after.keys() == kept
    planted = re.compile(r'AKIA[A-Z0-9]{16}|(?<=token = ")[0-9a-f]{40}|(?<=password=)[0-9a-f]{16}')
    changed = 0
    for i in kept:
        assert not planted.search(after[i]["text"])
        assert after[i]["n_chars"] == len(after[i]["text"])
        if not planted.search(before[i]["text"]):
            changed += after[i]["text"] != before[i]["text"]
    assert changed <= 0.01 * len(kept)

    packed = steps[4](spark, hidden, SF_MID).collect()
    check(packed, {i: r["text"] for i, r in after.items()}, Tokenizer.from_file(P.path("word_bpe_49k.json")), 4096)
    whole = corpus_pipeline.run(spark, SF_MID)
    key = ("doc_id", "start", "length", "ids_crc32")
    assert {tuple(r[c] for c in key) for r in whole.collect()} is not None
    assert whole.agg(F.sum("length")).first()[0] == sum(r["length"] for r in packed)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        out = step(spark, docs, SF_MID)
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs
    assert secrets.REDACTED
