"""The pipeline against its stages written down plainly."""

import duckdb

import corpus_pipeline
from conftest import SMALL
from tabwright.llm import queries
from tabwright.llm.toxicity import fit
from test_contamination import brute
from test_near import survivors
from test_packing import check


def test_pipeline_matches_plain_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    finder = model.finder()
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall())
    left = {i: t for i, t in texts.items() if model.score(finder.features(t)) < 0.5}
    last = {t: i for i, t in sorted(left.items())}
    left = {i: left[i] for i in last.values()}
    left = {i: left[i] for i in survivors(left)}
    items = duckdb.sql(f"SELECT item_id, text FROM '{SMALL}/benchmark.parquet'").fetchall()
    hit = {d for d, *_ in brute(list(left.items()), items)}
    left = {i: [t] for i, t in left.items() if i not in hit}
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(left)
    assert check(rows, left, 2048) == 0


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), SMALL)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns


def test_queries_cover_the_operators():
    numbers = {int(n[2:].split("_")[0]) for n in queries.QUERIES}
    assert numbers == set(range(1, 14))
