import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrosift.operators import knn as K
from hydrosift.operators import prep as PR


def _frame(spark, n=257, classes=(("a", 140), ("b", 80), ("c", 37))):
    rows, i = [], 0
    for lab, cnt in classes:
        for _ in range(cnt):
            rows.append((f"k{i}", lab, float(i % 13) if i % 11 else None, float(i)))
            i += 1
    return spark.createDataFrame(rows, "key string, label string, x double, y double")


def test_split_exact_size_and_deterministic(spark):
    df = _frame(spark)
    a = PR.split(df, "key", 0.2, 7).where("is_test").select("key").collect()
    b = PR.split(df.repartition(5), "key", 0.2, 7).where("is_test").select("key").collect()
    assert len(a) == math.ceil(0.2 * 257) and sorted(a) == sorted(b)


def test_stratified_split_quotas(spark):
    df = _frame(spark)
    out = PR.stratified_split(df, "key", "label", 0.2, 7).where("is_test").groupBy("label").count().collect()
    got = {r.label: r["count"] for r in out}
    assert sum(got.values()) == math.ceil(0.2 * 257)
    for lab, n in (("a", 140), ("b", 80), ("c", 37)):
        assert abs(got[lab] - 52 * n / 257) < 1


def test_kfold_balanced(spark):
    df = _frame(spark)
    sizes = sorted(r["count"] for r in PR.kfold(df, "key", 5, 3).groupBy("fold").count().collect())
    assert sizes == [51, 51, 51, 52, 52]
    per = PR.stratified_kfold(df, "key", "label", 5, 3).groupBy("label", "fold").count().collect()
    for lab in "abc":
        s = [r["count"] for r in per if r.label == lab]
        assert max(s) - min(s) <= 1 and len(s) == 5


def test_noise_keeps_originals_and_nulls(spark):
    df = _frame(spark)
    a = PR.augment_noise(df, "key", ["x", "y"], 3, 0.01, 1).collect()
    assert len(a) == 4 * 257
    orig = {r.key: r for r in df.collect()}
    for r in a:
        o = orig[r.key]
        if r.copy == 0:
            assert (r.x, r.y) == (o.x, o.y)
        assert (r.x is None) == (o.x is None)


def test_median_impute_and_standardize(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (3.0, 5.0), (10.0, 5.0)], "a double, b double")
    imp = PR.median_impute(df, df, ["a"]).collect()
    assert imp[1].a == 3.0
    st = PR.standardize(df.na.drop(), df.na.drop(), ["a", "b"]).collect()
    vals = np.array([1.0, 3.0, 10.0])
    assert [r.a for r in st] == pytest.approx(list((vals - vals.mean()) / vals.std()))
    assert all(r.b == 0.0 for r in st)


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(300, 6)).round(3)
    rows = [(i, [float(v) for v in x], int(i % 3)) for i, x in enumerate(X)]
    df = spark.createDataFrame(rows, "key long, features array<double>, label int")
    q = df.where("key % 5 = 0")
    r = df.where("key % 5 != 0")
    for metric in ("euclidean", "manhattan"):
        got = K.knn(q, r, 4, metric=metric, pivots=8).collect()
        by = {}
        for g in got:
            by.setdefault(g.q_key, []).append((g.nn_rank, g.r_key))
        ref_keys = [i for i in range(300) if i % 5]
        for qi in range(0, 300, 5):
            d = np.abs(X[ref_keys] - X[qi]).sum(1) if metric == "manhattan" else \
                np.sqrt(((X[ref_keys] - X[qi]) ** 2).sum(1))
            exp = [k for _, k in sorted(zip(d, ref_keys))[:4]]
            assert [k for _, k in sorted(by[qi])] == exp


def test_smote_balances_within_segments(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=3)], lab) for i, lab in
            enumerate(["a"] * 30 + ["b"] * 12 + ["c"] * 5)]
    df = spark.createDataFrame(rows, "key long, features array<double>, label string")
    syn = K.smote(df).collect()
    counts = {"a": 30, "b": 12, "c": 5}
    for s in syn:
        counts[s.label] += 1
    assert set(counts.values()) == {30}
    feats = {k: np.array(f) for k, f, _ in rows}
    lab = {k: label for k, _, label in rows}
    for s in syn:
        a, b, x = feats[s.base_key], feats[s.nbr_key], np.array(s.features)
        t = np.dot(x - a, b - a) / np.dot(b - a, b - a)
        assert lab[s.base_key] == lab[s.nbr_key] == s.label and -1e-9 <= t <= 1 + 1e-9
        assert np.allclose(a + t * (b - a), x)
    assert F is not None


def _brute_knn_impute(fit, rows, k):
    """NaN-aware euclidean kNN imputation, written out by brute force."""
    n = fit.shape[1]
    out = rows.copy()
    for r in range(rows.shape[0]):
        for j in np.flatnonzero(np.isnan(rows[r])):
            cand = []
            for d in range(fit.shape[0]):
                if np.isnan(fit[d, j]):
                    continue
                both = ~np.isnan(rows[r]) & ~np.isnan(fit[d])
                if both.sum() == 0:
                    continue
                d2 = float(((rows[r, both] - fit[d, both]) ** 2).sum()) * n / both.sum()
                cand.append((d2, d, fit[d, j]))
            cand.sort()
            out[r, j] = np.mean([c[2] for c in cand[:k]]) if cand else np.nanmean(fit[:, j])
    return out


def test_knn_impute_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)).round(2)
    x[rng.random((300, 4)) < 0.15] = np.nan
    x[7] = [np.nan, np.nan, np.nan, 1.0]          # shares nothing with donors lacking column 3
    fit_idx = np.arange(0, 300, 3)
    rows = [(f"r{i:03d}", *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, a double, b double, c double, d double")
    fit = df.where(F.col("key").isin([f"r{i:03d}" for i in fit_idx]))
    got = K.knn_impute(fit, df, ["a", "b", "c", "d"], "key", 5, pivots=4).orderBy("key").toPandas()
    want = _brute_knn_impute(x[fit_idx], x, 5)
    assert not got[["a", "b", "c", "d"]].isna().any().any()
    np.testing.assert_allclose(got[["a", "b", "c", "d"]].to_numpy(), want, rtol=1e-9, atol=1e-12)


def test_smote_of_large_classes_loses_no_row(spark):
    df = spark.range(17_000).select(F.col("id").alias("key"), F.array(F.col("id").cast("double")).alias("features"),
                                    F.when(F.col("id") < 12_000, "a").otherwise("b").alias("label"))
    assert K.smote(df).count() == 7_000


def test_smote_of_a_one_row_class_is_empty(spark):
    df = spark.createDataFrame([(1, [1.0], "a"), (2, [2.0], "a"), (3, [3.0], "b")], "key long, features array<double>, label string")
    got = K.smote(df)
    assert got.columns == ["label", "features", "base_key", "nbr_key", "syn_id"] and got.count() == 0


def test_pca_equals_singular_vectors(spark):
    """Loadings, shares and coordinates against the singular values of the centred rows."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4)) + [5, -2, 0, 1000]
    cols = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(200, None, 0.0, 0.0, 0.0)],
                               "key long, a double, b double, c double, d double").repartition(5)
    found = PR.pca(df, cols, 3)
    _, sizes, vectors = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    for n in range(3):
        lead = np.abs(vectors[n]).argmax()
        assert np.allclose(found.loadings[n], vectors[n] * np.sign(vectors[n][lead]))
    assert np.allclose(found.explained, (sizes ** 2 / (sizes ** 2).sum())[:3])
    rows = {r.key: r for r in PR.project_components(df, found).collect()}
    assert rows[200].pc1 is None
    assert np.allclose([rows[i].pc2 for i in range(200)], (x - x.mean(axis=0)) @ found.loadings[1])
    with pytest.raises(ValueError):
        PR.pca(df.limit(0), cols)
