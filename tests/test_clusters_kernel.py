import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrosift.operators import clusters, common, kernel
from hydrosift.operators import models as MD


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(2)
    middle = [(0, 0), (4, 0), (0, 4), (5, 5)]
    rows = [(f"k{i}", *map(float, rng.normal(middle[i % 4], 0.3))) for i in range(200)]
    return spark.createDataFrame(rows, "key string, x double, y double").repartition(3).cache(), rows


def plain(rows, start):
    x, c = np.array([r[1:] for r in rows]), start.copy()
    for _ in range(300):
        near = ((x[:, None] - c) ** 2).sum(axis=2)
        at = near.argmin(axis=1)
        new = np.array([x[at == k].mean(axis=0) if (at == k).any() else c[k] for k in range(len(c))])
        if np.abs(new - c).max() <= 1e-8:
            break
        c = new
    return c, near.min(axis=1).sum()


def test_every_start_ends_where_plain_kmeans_does(points):
    df, rows = points
    found = clusters.kmeans_starts(df, ["x", "y"], "key", 4, starts=5)
    begun = clusters.first_centroids(df, ["x", "y"], "key", 4, 5, 42)
    ends = [plain(rows, b) for b in begun]
    np.testing.assert_allclose(found.inertias, [e[1] for e in ends], rtol=1e-9)
    assert found.start == int(np.argmin(found.inertias)) and found.inertia == min(found.inertias)
    np.testing.assert_allclose(found.centroids, ends[found.start][0], rtol=1e-9)
    got = clusters.assign(df, ["x", "y"], found)
    assert got.agg(F.sum("distance")).first()[0] == pytest.approx(found.inertia)
    assert sorted(r["count"] for r in got.groupBy("cluster").count().collect()) == [50] * 4


def test_few_rows(points):
    df, _ = points
    one = clusters.kmeans_starts(df.limit(1), ["x", "y"], "key", 3, starts=2)
    assert one.inertia == 0
    none = clusters.kmeans_starts(df.limit(0), ["x", "y"], "key", 2, starts=2)
    assert none.inertia == 0 and none.centroids.tolist() == [[0, 0], [0, 0]]


def test_draws_are_those_of_the_hash(spark):
    got = spark.range(1).select(common.unit_hash(F.lit(3), F.lit("ph"), F.lit("r"), seed="rbf")).first()[0]
    assert got == kernel.draw("rbf", 3, "ph", "r")


def test_products_approach_the_kernel(points):
    df, rows = points
    some = df.limit(12).select("x", "y", kernel.cosine_features(["x", "y"], 4000, 0.5).alias("z")).collect()
    for a in some:
        for b in some:
            rbf = np.exp(-0.5 * ((a.x - b.x) ** 2 + (a.y - b.y) ** 2))
            assert np.dot(a.z, b.z) == pytest.approx(rbf, abs=0.08)


def test_a_line_on_cosines_follows_a_curve(spark):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(np.sin(3 * a))) for a in rng.uniform(-2, 2, 400)]
    df, names = kernel.with_cosines(spark.createDataFrame(rows, "a double, target double"), ["a"], 40, 2.0)
    fitted = MD.predict(MD.fit(MD.regressors()["SVR-like"], df, names), df)
    gap = fitted.select(F.avg(F.abs(F.col("prediction") - F.col("target")))).first()[0]
    assert gap < 0.05


def test_starts_that_stand_still_are_not_summed_again(points, monkeypatch):
    """Every start's inertia stays that of its own centroids when others move on."""
    df, rows = points
    asked, plain_sums = [], clusters._sums
    monkeypatch.setattr(clusters, "_sums", lambda c, numbers: asked.append(len(numbers)) or plain_sums(c, numbers))
    found = clusters.kmeans_starts(df, ["x", "y"], "key", 4, starts=5)
    begun = clusters.first_centroids(df, ["x", "y"], "key", 4, 5, 42)
    assert len(asked) == found.iterations and asked[0] == 5 and asked == sorted(asked, reverse=True) and asked[-1] < 5
    np.testing.assert_allclose(found.inertias, [plain(rows, b)[1] for b in begun], rtol=1e-9)
