import brute
import pytest

import corpus_pipeline
from profloom.llm import op05_mixture, registry
from profloom.llm.common import components

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(same_as_duckdb, name):
    assert same_as_duckdb(registry.QUERIES[name], registry.ORACLES[name])


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 7)] + [(200 + i, 200) for i in range(1, 5)]
    found = {r.id: r.component_id for r in components(spark.createDataFrame(chain, "a long, b long").repartition(5)).collect()}
    assert found == {i: 0 for i in (*range(41), 100)} | {200 + i: 200 for i in range(5)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("name", ["op4_ngram_join", "op6_suffix_dedup"])
def test_whole_table_is_brute_force(spark, name):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    found = {r.doc_id: tuple(r)[1:] for r in registry.QUERIES[name](spark, SMALL).collect()}
    assert found == (brute.ngram_join(docs) if name == "op4_ngram_join" else brute.suffix_dedup(docs))


def test_pipeline_is_brute_force_after_the_classifier(spark):
    source = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, source, SMALL)
    assert kept.columns == source.columns
    rows = {r.doc_id: r for r in kept.collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("toxic = 0").collect()}
    assert len(toxic & set(rows)) >= 0.97 * len(toxic)  # clean documents stay
    texts = brute.line_dedup([(i, r.text) for i, r in rows.items()])
    texts = {i: t for i, t in texts.items() if t == rows[i].text or brute.words(t)}
    groups = brute.ngram_join(list(texts.items()))
    texts = {i: t for i, t in texts.items() if groups[i][1] == i}
    leaks = {r.doc_id for r in corpus_pipeline.STAGES[3][1](spark, spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string"), SMALL).collect()}
    texts = {i: t for i, t in texts.items() if i in leaks}
    mixed = brute.mixture([(i, t, rows[i].lang, rows[i].source) for i, t in texts.items()], op05_mixture)
    found = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id: (r.copies, r.tail_tokens) for r in found} == mixed
    assert {r.doc_id: r.text for r in found} == {i: texts[i] for i in mixed}
