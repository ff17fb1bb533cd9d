"""Registered queries of the subpackage against their statements, and the pipeline stage by stage."""
import duckdb
import pytest

import corpus_pipeline
from check import TABLES, rows_of
from lamella.llm import op1_toxicity, op7_quality_votes, op8_odd_sketch
from lamella.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", [n for n, (_, oracle) in QUERIES.items() if oracle])
def test_query_equals_its_statement(spark, name):
    run, oracle = QUERIES[name]
    df = run(spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    res = con.execute(oracle)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in res.description], res.fetchall())


def test_pipeline_applies_each_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    scores = {r.doc_id: r.predicted for r in op1_toxicity.scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    one = dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, SF)
    assert one.columns == columns and {r.doc_id for r in one.select("doc_id").collect()} == {i for i, p in scores.items() if not p}
    two = corpus_pipeline.quality(spark, one, SF).persist()
    assert two.columns == columns and {r.doc_id for r in two.select("doc_id").collect()} == {r.doc_id for r in op7_quality_votes.verdicts(one).collect() if r.kept}
    three = corpus_pipeline.near_dedup(spark, two, SF).persist()
    assert three.columns == columns and {r.doc_id for r in three.select("doc_id").collect()} == {r.doc for r in op8_odd_sketch.linked(two).collect() if r.doc == r.component}
    four = corpus_pipeline.substring_dedup(spark, three, SF).persist()
    assert four.columns == columns and four.count() == three.count() and four.where("n_chars <> length(text)").isEmpty()
    five = corpus_pipeline.packing(spark, four, SF)
    assert {r.doc_id for r in five.select("doc_id").collect()} == {r.doc_id for r in four.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "substring_dedup", "packing"]


def test_pipeline_runs_over_documents(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
