import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrosift.operators import stats as S


def _frame(spark, n=3000, groups=3, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(g), float(v) if i % 17 else None) for i, (g, v) in
            enumerate(zip(rng.integers(0, groups, n), rng.normal(50, 20, n).round(2)))]
    return spark.createDataFrame(rows, "g int, v double"), rows


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_exact_percentiles_match_numpy(spark, accuracy):
    # accuracy 50 forces the narrow-band path; 10 000 the whole-group path
    df, rows = _frame(spark)
    got = {r.g: r for r in S.exact_percentiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.9, 1.0],
                                               ["a", "b", "c", "d", "e"], accuracy).collect()}
    for g in range(3):
        vals = np.array([v for gg, v in rows if gg == g and v is not None])
        exp = np.percentile(vals, [0, 25, 50, 90, 100])
        assert [got[g].a, got[g].b, got[g].c, got[g].d, got[g].e] == pytest.approx(exp, rel=1e-12)


def test_exact_percentiles_global_and_ties(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 2, 2, 3, 9]], "v double")
    r = S.exact_percentiles(df, [], "v", [0.5, 0.75], ["m", "q"], accuracy=2).first()
    assert r.m == pytest.approx(np.percentile([1, 2, 2, 2, 3, 9], 50))
    assert r.q == pytest.approx(np.percentile([1, 2, 2, 2, 3, 9], 75))


def test_histogram_matches_numpy(spark):
    df, rows = _frame(spark, groups=1)
    vals = np.array([v for _, v in rows if v is not None])
    counts, edges = np.histogram(vals, bins=10)
    h = S.histogram(df, "v", 10, ["g"]).orderBy("bin").collect()
    assert [r["count"] for r in h] == list(counts)
    assert h[0].bin_lo == pytest.approx(edges[0]) and h[-1].bin_hi == pytest.approx(edges[-1])


def test_kde_matches_formula(spark):
    vals = [1.0, 2.0, 2.5, 4.0, 7.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    out = S.kde(df, "v", grid=5).orderBy("point").collect()
    x = np.array(vals)
    h = len(x) ** (-0.2) * x.std(ddof=1)
    grid = np.linspace(x.min(), x.max(), 5)
    exp = [np.exp(-0.5 * ((g - x) / h) ** 2).sum() / (len(x) * h * np.sqrt(2 * np.pi)) for g in grid]
    assert [r.density for r in out] == pytest.approx(exp, rel=1e-9)


def test_corr_matrix_pairwise_complete(spark):
    rows = [(1.0, 2.0, None), (2.0, 4.1, 1.0), (3.0, 6.2, 0.5), (4.0, 7.9, 0.2), (None, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    out = {(r.var_a, r.var_b): r.corr for r in S.corr_matrix(df, ["a", "b", "c"], digits=None).collect()}
    ab = [(a, b) for a, b, _ in rows if a is not None and b is not None]
    assert out[("b", "a")] == pytest.approx(np.corrcoef(np.array(ab).T)[0, 1])
    assert set(out) == {("b", "a"), ("c", "a"), ("c", "b")}


def test_exceedance_counts_null_as_not_exceeding(spark):
    df = spark.createDataFrame([(6.0, 10.0), (7.0, None), (9.0, 1.0), (None, 6.0)], "ph double, turbidity double")
    out = {r.param: r.rate for r in S.exceedance_rate(df, {"ph": (6.5, 8.5), "turbidity": 5.0, "x": 1.0}).collect()}
    assert out == {"ph": 0.5, "turbidity": 0.5}


def test_site_profile_mode_ties_to_smallest(spark):
    df = spark.createDataFrame([("s", 10.0, "Poor"), ("s", 20.0, "Good"), ("s", 30.0, "Poor"), ("s", 40.0, "Good")],
                               "site string, wqi double, wqi_class string")
    r = S.site_profile(df).first()
    assert r.wqi_class == "Good" and r.wqi_mean == 25.0


def test_null_profile_and_describe(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, 5.0)], "a double, b double")
    assert {r.column: r.nulls for r in S.null_profile(df).collect()} == {"a": 1, "b": 2}
    d = {r.column: r for r in S.describe(df, ["a", "b"]).collect()}
    assert d["a"].q50 == 2.0 and d["a"]["count"] == 2 and d["b"].std is None
    assert F is not None


def test_order_stats_refinement_rounds(spark):
    # tiny accuracy and band limit force the iterative narrowing path
    df, rows = _frame(spark, n=6000, groups=2, seed=5)
    got = {r.g: r for r in S.exact_percentiles(df, ["g"], "v", [0.1, 0.5, 0.97], ["a", "b", "c"],
                                               accuracy=20).collect()}
    got2 = {r.g: r for r in S.order_stats(df, ["g"], "v", [F.floor(F.col("__n") / 2)], ["m"],
                                          accuracy=20, max_band=30).collect()}
    for g in range(2):
        vals = np.sort(np.array([v for gg, v in rows if gg == g and v is not None]))
        assert [got[g].a, got[g].b, got[g].c] == pytest.approx(np.percentile(vals, [10, 50, 97]), rel=1e-12)
        assert got2[g].m == vals[len(vals) // 2]


def test_ties_cost_one_row_each(spark):
    df = spark.range(1_000_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 5).cast("double").alias("v"))
    got = S.exact_percentiles(df, ["g"], "v", [0.25, 0.5, 0.9], accuracy=100).orderBy("g").collect()
    for r in got:
        x = sorted(v % 5 for v in range(r.g, 1_000_000, 2))
        assert (r.p25, r.p50, r.p90) == (x[124999], x[249999], x[449999])


def test_any_rank_is_served(spark):
    df = spark.range(20_000).select(F.xxhash64("id").cast("double").alias("v"))
    x = sorted(r.v for r in df.collect())
    ranks = [0, 1, 137, 8_000, 19_999]
    got = S.order_stats(df, [], "v", [F.lit(k) for k in [*ranks, 20_000, -1]], [f"r{i}" for i in range(7)], max_band=50).first()
    assert [got[f"r{i}"] for i in range(7)] == [*(x[k] for k in ranks), None, None] and got["__n"] == 20_000
