"""The corpus pipeline's stages against plain versions."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyframe.llm import toxicity

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_stages_one_by_one(spark, documents):
    docs, benchmark = documents, [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = toxicity.fit_grammar(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = corpus_pipeline.toxicity(spark, docs, SF).cache()
    assert clean.columns == docs.columns
    assert Counter(rows(clean)) == Counter(r for r in rows(docs) if model.score(r[1]) < toxicity.THRESHOLD)
    single = corpus_pipeline.near_duplicates(spark, clean, SF).cache()
    assert single.columns == docs.columns
    keep = {i for i, _, c in brute.ngram_join(rows(clean)) if i == c}
    assert sorted(rows(single)) == sorted(r for r in rows(clean) if r[0] in keep)
    free = corpus_pipeline.decontamination(spark, single, SF).cache()
    bad = {i for i, *_, hit in brute.contamination(rows(single), benchmark) if hit}
    assert sorted(rows(free)) == sorted(r for r in rows(single) if r[0] not in bad)
    mixed = corpus_pipeline.mixing(spark, free, SF).cache()
    assert mixed.columns == docs.columns and {r[0] for r in rows(mixed)} <= {r[0] for r in rows(free)}
    assert max(Counter(r[0] for r in rows(mixed)).values()) <= 3
    last = corpus_pipeline.sharding(spark, mixed, SF)
    assert last.count() == mixed.count()
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r[0] for r in rows(mixed))


def test_awkward_rows(spark):
    docs = brute.frame(spark, brute.corpus())
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        found = out.collect()
        assert any(r.text is None for r in found), name
        assert stage(spark, docs.limit(0), SF).count() == 0
        if name != "near_duplicates":
            assert len(found) <= 3 * n
    assert corpus_pipeline.sharding(spark, docs, SF).count() == n


def test_copies_follow_the_mix(spark):
    docs = spark.createDataFrame([(i, "w " * 10, f"s{i % 2}") for i in range(40)], "doc_id long, text string, source string")
    counted = corpus_pipeline.mixing(spark, docs, SF).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    got = {r.source: r.n for r in counted.collect()}
    assert abs(got["s0"] - 40 / 3) <= 1 and abs(got["s1"] - 80 / 3) <= 1


def test_one_id_with_two_texts(spark):
    words = [f"w{i}" for i in range(60)]
    base, near, other = " ".join(words), " ".join(words[:-1]), " ".join(reversed(words))
    rows = [(1, base, "a"), (1, other, "a"), (2, near, "a"), (2, near, "a"), (None, base, "a"), (None, "lone words of a row without an id", "b"), (3, None, "b"), (3, None, "b"), (4, "", "b"), (None, " ", "b")]
    docs = brute.frame(spark, rows)
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    want = [(1, base), (1, other), (None, rows[5][1]), (3, None), (3, None), (4, ""), (None, " ")]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)
    # The representative may be a row that stands twice, or one without an id.
    twice = corpus_pipeline.near_duplicates(spark, docs.where("doc_id = 2 or doc_id is null and source = 'a'"), SF)
    assert [(r.doc_id, r.text) for r in twice.collect()] == [(2, near)]
    nameless = corpus_pipeline.near_duplicates(spark, docs.where("doc_id is null"), SF)
    assert sorted((r.text for r in nameless.collect())) == [" ", rows[5][1], base]
