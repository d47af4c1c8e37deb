"""Queries that pass over a view more than once read it as a written table."""

import pytest
from pyspark.sql import functions as F

from hydrosift.operators import stats as S
from hydrosift.plans import flows, registry
from hydrosift.sources import views

from .conftest import SF001


@pytest.fixture
def scans(monkeypatch):
    found = []
    plain = views.readings
    monkeypatch.setattr(views, "readings", lambda *a: found.append(a) or plain(*a))
    return found


def reads_readings(df):
    return any("lineitem" in f for f in df.inputFiles())


def test_written_views_do_not_read_line_items(spark):
    ml = flows.written_ml_frame(spark, SF001)
    assert ml.count() > 0 and not reads_readings(ml)
    assert not reads_readings(flows.predictions(spark, SF001, written=True))


@pytest.mark.parametrize("name", ["stratified_split", "stratified_kfold_assign", "eval_line_fit", "eval_prediction_frame", "best_model",
                                  "metrics_long", "yearly_trend"])
def test_results_come_from_written_rows(spark, scans, name):
    assert not reads_readings(registry.QUERIES[name](spark, SF001)) and len(scans) == 1


def test_model_queries_build_one_frame(spark, scans):
    registry.QUERIES["feature_importance"](spark, SF001)
    assert len(scans) == 1


def test_ranks_of_a_narrowed_bracket_in_groups(spark):
    """Several brackets per group, ties on their edges, a group without asked ranks, values read twice or written."""
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") == 1, "c").otherwise("b").alias("g"),
                                    F.floor(F.col("id") * 7 % 30_000 / 4).cast("double").alias("v"))
    ranks = [F.floor(F.col("__n") * p) for p in (0.9, 0.1, 0.5)] + [F.col("__n") + 5]
    rows = {}
    for r in df.collect():
        rows.setdefault(r.g, []).append(r.v)
    want = {g: [sorted(v)[int(len(v) * p)] for p in (0.9, 0.1, 0.5)] + [None] for g, v in rows.items()}
    for write in (True, False):
        got = S.order_stats(df, ["g"], "v", ranks, list("xyzo"), accuracy=100, max_band=20, write=write).collect()
        assert {r.g: [r.x, r.y, r.z, r.o] for r in got} == want
    none = S.order_stats(df, ["g"], "v", [F.lit(-1)], ["x"], accuracy=100, max_band=20).collect()
    assert sorted((r.g, r.x) for r in none) == [("a", None), ("b", None), ("c", None)]


def test_written_rows_have_as_many_parts_as_they_ask_for(spark):
    """Few rows out of many shuffle partitions: one part, the same rows and metadata."""
    from hydrosift.session import FIT_ROWS, cut_lineage, for_fits
    df = spark.range(40).repartition(40).select("id", F.col("id").cast("double").alias("x", metadata={"kind": "index"}))
    cut = cut_lineage(df)
    assert cut.schema["x"].metadata == {"kind": "index"} and not cut.inputFiles()[0].startswith("rdd")
    fit = for_fits(df)
    assert fit.rdd.getNumPartitions() == 1 and sorted(r.id for r in fit.collect()) == list(range(40))
    assert for_fits(spark.range(3 * FIT_ROWS)).rdd.getNumPartitions() <= 3


def test_model_frames_fit_on_few_parts(spark):
    train, test, _, _ = flows.model_frames(flows.written_ml_frame(spark, SF001).repartition(30), "ground")
    assert train.rdd.getNumPartitions() == test.rdd.getNumPartitions() == 1


def test_scores_of_folds_keep_their_order(spark):
    """Folds run side by side; each score is its own fold's, in order."""
    from pyspark.ml.regression import LinearRegression
    from hydrosift.operators import models as MD
    df = spark.range(60).select(F.col("id").cast("double").alias("x"), (F.col("id") % 3).cast("int").alias("fold"),
                                F.when(F.col("id") % 3 == 1, 100.0).otherwise(0.0).alias("target"))

    class Mean:
        def evaluate(self, d):
            return d.agg(F.max("fold")).first()[0] + d.agg(F.max("target")).first()[0]
    assert MD.cv_score(LinearRegression(featuresCol="features", labelCol="target"), df, ["x"], Mean(), "fold", 3)[2] == [0.0, 101.0, 2.0]


def test_gap_patterns_are_broadcast(spark):
    """The join of rows with the few gap patterns does not deal rows by pattern."""
    from hydrosift.operators import common, knn
    found = []
    plain = common.per_group
    knn.per_group = lambda df, *a: found.append(df.columns) or plain(df, *a)
    try:
        df = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, 3.0), ("c", 4.0, 5.0)], "key string, x double, y double")
        got = {r.key: r.y for r in knn.knn_impute(df, df, ["x", "y"], "key", 1).collect()}
    finally:
        knn.per_group = plain
    assert got == {"a": 3.0, "b": 3.0, "c": 5.0} and any("__pd" in c for c in found)
