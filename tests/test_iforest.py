"""Isolation forest: planted outliers, repeatability, schedule."""

import random

from pyspark.sql import functions as F

from fablens.operators import iforest


def points(spark, rows=2000, outliers=5):
    rng = random.Random(1)
    data = [(i, [rng.gauss(0, 1) for _ in range(4)] + [1.0]) for i in range(rows)]
    data += [(rows + i, [8.0 + i, -9.0, 7.0, 8.0, 1.0]) for i in range(outliers)]
    return spark.createDataFrame(data, "event_id long, features array<double>").repartition(8)


def test_planted_outliers_rank_first(spark):
    df = points(spark)
    forest = iforest.fit_forest(df)
    scores = df.select("event_id", iforest.novelty(forest, F.col("features")).alias("s")).orderBy(F.desc("s")).limit(5).collect()
    assert {r["event_id"] for r in scores} == {2000, 2001, 2002, 2003, 2004}
    assert all(0.6 < r["s"] <= 1.0 for r in scores)


def test_fit_depends_on_rows_and_seed_only(spark):
    df = points(spark)
    first = sorted(map(tuple, iforest.fit_forest(df).collect()))
    again = sorted(map(tuple, iforest.fit_forest(df.repartition(3)).collect()))
    other = sorted(map(tuple, iforest.fit_forest(df, seed=7).collect()))
    assert first == again and first != other


def test_forest_shape(spark):
    nodes = iforest.fit_forest(points(spark)).toPandas()
    assert nodes["tree"].nunique() == 100
    assert (nodes.groupby("tree").size() <= 511).all()
    assert (nodes[nodes["node"] == 0]["size"] == 256).all() and nodes["depth"].max() <= 8
    inner = nodes[nodes["feature"] >= 0]
    assert (inner["left"] > 0).all() and (inner["right"] > 0).all() and (inner["feature"] != 4).all()


def test_too_few_rows(spark):
    assert iforest.fit_forest(points(spark, 40, 0)) is None
    df = points(spark, 40, 0)
    assert df.select(iforest.novelty(None, F.col("features")).alias("s")).distinct().collect()[0]["s"] is None


def test_identical_rows_score_the_same(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(100)], "event_id long, features array<double>")
    scores = df.select(iforest.novelty(iforest.fit_forest(df), F.col("features")).alias("s")).distinct().collect()
    assert len(scores) == 1


def test_refit_schedule():
    assert [iforest.refits_due(n) for n in (49, 50, 59, 60, 79, 80, 100)] == [0, 1, 1, 2, 2, 3, 4]


def test_forest_scores_send_events_to_review(spark, sf_dir):
    """What the forest calls an anomaly goes to review with its reason, and nothing else changes."""
    from fablens.plans import scoring_queries

    got = scoring_queries.forest_escalation(spark, sf_dir).collect()
    base = {r["event_id"]: r["topic"] for r in scoring_queries.route(spark, sf_dir).collect()}
    assert len(got) == len(base)
    for row in got:
        anomaly = row["novelty_score"] >= 0.72
        assert ("anomaly" in (row["review_reason"] or "")) == anomaly
        assert row["topic"] == (None if anomaly else base[row["event_id"]])


def test_rollup_reads_push_their_bounds_down(spark, sf_dir):
    from fablens.plans import table_queries

    for build in (table_queries.hourly_analytics, table_queries.machine_health):
        plan = build(spark, sf_dir)._jdf.queryExecution().toString()
        assert "PushedFilters: [" in plan and "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
