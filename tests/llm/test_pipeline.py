"""The pipeline's stages one by one against brute force, and the registered queries against their SQL."""

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from fablens.llm import toxicity
from fablens.llm.queries import CHECKS, QUERIES
from tests.llm.test_operators import hits_brute, lower, near_brute
from tools.check import TABLES, rows_of


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_sql(spark, db, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), db.sql(CHECKS[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_every_number_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, benchmark = docs.columns, spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(str(r.item_id), r.text) for r in benchmark.collect()]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        after = stage(spark, docs, sf_dir).cache()
        ids = {r.doc_id for r in after.collect()}
        if number == 0:
            chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity.label_categories())
            found = [toxicity.features(t) for _, t in before]
            scores = toxicity.chain_scores(chain, [f for f, _ in found], np.array([s for _, s in found]))
            want = {i for (i, _), s in zip(before, scores.round(6)) if s[-1] < chain.cuts[-1]}
        elif number == 1:
            want = set({lower(t): i for i, t in sorted(before)}.values())
        elif number == 2:
            want = {w[0] for w in near_brute(before, 5, 80) if w[3]}
        elif number == 3:
            want = {i for i, t in before if not hits_brute(t, items)[1]}
        else:
            want = {i for i, _ in before}
        assert ids == want, name
        if number < 4:
            assert after.columns == columns
        docs = after


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert len(rows) > 50 and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert sum(r.taken for r in rows) == int(1.5 * sum(r.size for r in rows))
