"""Stages of the pipeline: each works on what the one before kept, and its decisions take effect."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from conftest_llm import got
from pyspark.sql import functions as F

from vellum.llm import decontaminate, jaccard, queries


@pytest.fixture(scope="module")
def folder(spark, docs, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{path}/documents.parquet")
    words = next(r[1] for r in rows if r[1] and len(r[1].split()) == 90).split()
    spark.createDataFrame([(1, " ".join(words[:30]))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, docs, folder, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "decontamination", "source_mix", "shards"]
    before = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, folder).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        if name != "shards":
            assert after.columns == docs.columns
            assert set(Counter(got(after))) <= set(Counter(got(before)))
        if name == "language_id":
            assert all(r.text and any(c.isalpha() for c in r.text) for r in after.collect())
            lost = Counter(r.text for r in before.collect() if r.text and any(c.isalpha() for c in r.text)) - Counter(r.text for r in after.collect())
            assert not lost
        elif name == "ngram_jaccard":
            sizes = Counter(r.component_id for r in jaccard.join_similar(after).where("doc_id is not null").collect())
            assert max(sizes.values()) == 1
        elif name == "decontamination":
            found = decontaminate.find_contamination(before, spark.read.parquet(f"{folder}/benchmark.parquet"))
            assert after.count() == found.where("not contaminated").count() < before.count()
        elif name == "source_mix":
            assert max(Counter(r.doc_id for r in after.collect()).values()) <= 2
        else:
            assert after.count() == before.count()
        before = after


def test_run(spark, folder):
    one = got(corpus_pipeline.run(spark, folder))
    assert one and got(corpus_pipeline.run(spark, folder)) == one


def test_no_row_has_a_language(spark, docs, folder):
    kept = corpus_pipeline.language_id(spark, docs.withColumn("lang", F.lit(None).cast("string")), folder)
    assert kept.columns == docs.columns
    assert sorted(r.text for r in kept.collect()) == sorted(r.text for r in docs.collect() if r.text and any(c.isalpha() for c in r.text))


def test_texts_in_no_known_language_go(spark, docs, folder):
    odd = docs.limit(2).withColumn("text", F.lit("\u65e5\u672c\u8a9e\u306e\u6587\u7ae0 " * 9))
    kept = corpus_pipeline.language_id(spark, docs.unionByName(odd.withColumn("lang", F.lit(None).cast("string"))), folder)
    assert not kept.where("text like '\u65e5%'").count() and kept.count() == corpus_pipeline.language_id(spark, docs, folder).count()


def test_a_learned_language_with_a_large_alphabet_stays(spark, folder):
    rng = random.Random(3)
    chinese = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(400)) for _ in range(58)]
    rows = [(i, " ".join(rng.choice(["the", "and", "river", "stone"]) for _ in range(40)), "en") for i in range(200)]
    rows += [(1000 + i, text, "zh" if i < 8 else None) for i, text in enumerate(chinese)] + [(2000, "один два", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, table, folder).collect()} == {r[0] for r in rows} - {2000}


def test_an_empty_corpus(spark, docs, folder, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(queries.oracle_sql()) <= set(names)
