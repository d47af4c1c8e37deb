"""Aggregations and summary statistics.

Exact quantiles at scale: ``exact_percentiles`` never gathers a whole group
into one task.  A bounded-memory sketch (``percentile_approx``) brackets each
target rank; only the different values inside the bracket are counted and
ranked, and the count of values below it supplies the offset.  Small groups
(``n <= 4*accuracy``) are one bracket, which is bounded by a constant.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrosift.operators.common import per_group, single_key
from hydrosift.session import stage_table


DEFAULT_ACCURACY = 1_000
DEFAULT_MAX_BAND = 200_000


def _g(group_cols) -> list[str]:
    return list(group_cols or [])


def order_stats(df: DataFrame, group_cols: Sequence[str], value: str, ranks, names: Sequence[str],
                accuracy: int = DEFAULT_ACCURACY, extra: DataFrame | None = None,
                max_band: int = DEFAULT_MAX_BAND, write: bool = True) -> DataFrame:
    """Values at given 0-based ranks per group, exact, without gathering a group.

    ``ranks[i]`` is a Column over the per-group size ``__n`` (and columns of
    ``extra``, a per-group table joined on ``group_cols``); any rank is served.

    1. One pass: ``n`` and a bounded sketch (``percentile_approx`` at a grid of
       fractions) bracket each rank's value.  A group of at most
       ``4*accuracy`` values is one bracket.
    2. While a bracket holds more than ``max_band`` different values, the values
       below it are counted, those inside are sketched and it is narrowed.  The
       values are written before that (unless ``write`` is false, for tables that
       are cheap to read).
    3. A last pass counts each different value inside a bracket (map-side
       combined, so equal values cost one row) and, once for all brackets, the
       values by the number of brackets above them; the running count picks the
       answer.

    Returns ``group_cols + names + ['__n']``; a rank outside ``0..n-1`` gives
    NULL, and a rank that its bracket misses raises an error.
    """
    g = _g(group_cols)
    if not g:
        one = df.withColumn("__all", single_key(value))
        more = extra.withColumn("__all", F.lit(0)) if extra is not None else None
        return order_stats(one, ["__all"], value, ranks, names, accuracy, more, max_band, write).drop("__all")
    eps = 3.0 / accuracy
    v = F.col(value).cast("double")
    d = df.select(*g, (v + 0.0).alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    grid = [j / accuracy for j in range(accuracy + 1)]
    stats = d.groupBy(*g).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx("__v", grid, accuracy).alias("__q"))
    if extra is not None:
        stats = stats.join(extra, g)
    inf = F.lit(float("inf"))
    small = F.col("__n") <= 4 * accuracy
    places = range(len(ranks))

    def bracket(rank: Column) -> Column:
        k = rank.cast("long")
        lo = F.floor((k / F.col("__n") - eps) * accuracy).cast("int")
        hi = F.ceil((k / F.col("__n") + eps) * accuracy).cast("int")
        return F.when((k >= 0) & (k < F.col("__n")), F.struct(
            k.alias("k"), F.when(small | (lo < 1), -inf).otherwise(F.get("__q", lo)).alias("lo"),
            F.when(small | (hi >= accuracy), inf).otherwise(F.get("__q", hi)).alias("hi")))

    def at(i: int) -> Column:   # bracket of rank i, NULL if the rank is outside
        return F.get("__t", F.lit(i))

    def inside(t: Column) -> Column:
        return (F.col("__v") >= t["lo"]) & (F.col("__v") <= t["hi"])

    stats = per_group(stats.select(*g, "__n", F.array(*[bracket(r) for r in ranks]).alias("__t"),
                                   F.when(small, F.col("__n")).otherwise(8 * F.col("__n") / accuracy).alias("__est")))
    x = F.col("__x")
    written = not write
    while (stats.agg(F.max("__est")).first()[0] or 0) > max_band:
        if not written:
            d, written = stage_table(d, "values"), True
        e = d.join(stats.select(*g, "__t"), g)
        below = e.groupBy(*g).agg(*[F.count_if(F.col("__v") < at(i)["lo"]).alias(f"__b{i}") for i in places])
        r = e.select(*g, "__v", F.posexplode("__t").alias("__i", "__x")).where(inside(x)).groupBy(*g, "__i").agg(
            F.first("__x").alias("__x"), F.count(F.lit(1)).alias("__in"), F.approx_count_distinct("__v").alias("__different"),
            F.percentile_approx("__v", grid, accuracy).alias("__grid"))
        r = r.join(below, g)
        share = (x["k"] - F.get(F.array(*[F.col(f"__b{i}") for i in places]), F.col("__i"))) / F.col("__in")
        lo = F.floor((share - eps) * accuracy).cast("int")
        hi = F.ceil((share + eps) * accuracy).cast("int")
        wide = F.col("__different") > max_band / 2
        new = F.struct(x["k"].alias("k"),
                       F.when(wide & (lo >= 1), F.get("__grid", lo)).otherwise(x["lo"]).alias("lo"),
                       F.when(wide & (hi < accuracy), F.get("__grid", hi)).otherwise(x["hi"]).alias("hi"))
        est = F.when(wide, 8.0 * F.col("__different") / accuracy).otherwise(F.lit(0.0))
        r = r.select(*g, "__i", new.alias("__s"), est.alias("__e"))
        nxt = r.groupBy(*g).agg(*[F.max(F.when(F.col("__i") == i, F.col("__s"))).alias(f"__s{i}") for i in places],
                                F.max("__e").alias("__est"))
        stats = per_group(stats.select(*g, "__n", "__t").join(nxt, g, "left").select(
            *g, "__n", F.array(*[F.coalesce(f"__s{i}", at(i)) for i in places]).alias("__t"), F.coalesce("__est", F.lit(0.0)).alias("__est")))

    def one(i: Column, val: Column) -> Column:
        return F.struct(i.cast("int").alias("i"), val.cast("double").alias("val"))

    # A row's zone is the number of brackets that begin above it; zones stand under place -1.
    zone = sum((F.when(F.col("__v") < at(i)["lo"], 1).otherwise(0) for i in places), F.lit(0))
    hits = F.array(one(F.lit(-1), zone), *[F.when(inside(at(i)), one(F.lit(i), F.col("__v"))) for i in places])
    brackets = stats.select(*g, "__t")
    counted = d.join(brackets, g).select(*g, F.explode(hits).alias("__x")).where(x.isNotNull()).groupBy(
        *g, x["i"].alias("__p"), x["val"].alias("val")).agg(F.count(F.lit(1)).alias("__c"))

    def above(i: int) -> Column:   # brackets that begin at bracket i's beginning or above
        return sum((F.when(at(j)["lo"] >= at(i)["lo"], 1).otherwise(0) for j in places), F.lit(0))

    in_zone = F.col("__p") < 0
    to = F.when(in_zone, F.array(*[F.when(F.col("val") >= above(i), F.lit(i)) for i in places])).otherwise(F.array("__p"))
    counted = counted.join(brackets, g).select(*g, "__t", "__c", F.when(~in_zone, F.col("val")).alias("val"), F.explode(to).alias("i")).where(
        F.col("i").isNotNull()).withColumn("k", F.get("__t", F.col("i"))["k"]).groupBy(*g, "i", "k", "val").agg(F.sum("__c").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*g, "i").orderBy(F.col("val").asc_nulls_first()))
    hit = counted.withColumn("__to", upto).where((F.col("k") < F.col("__to")) & (F.col("k") >= F.col("__to") - F.col("__c")))
    val = F.when(F.col("val").isNull(), F.raise_error(F.lit("a rank lies below its bracket")).cast("double")).otherwise(F.col("val"))
    picked = hit.groupBy(*g).agg(F.count(F.lit(1)).alias("__found"),
                                 *[F.max(F.when(F.col("i") == i, val)).alias(n) for i, n in enumerate(names)])
    asked = sum((F.when(at(i).isNotNull(), 1).otherwise(0) for i in places), F.lit(0))
    out = stats.select(*g, "__n", asked.alias("__asked")).join(picked, g, "left")
    missed = F.coalesce("__found", F.lit(0)) < F.col("__asked")
    return out.select(*g, *names, F.when(missed, F.raise_error(F.lit("a rank lies above its bracket")).cast("long"))
                      .otherwise(F.col("__n")).alias("__n"))


def exact_percentiles(df: DataFrame, group_cols: Sequence[str], value: str,
                      probs: Sequence[float], names: Sequence[str] | None = None,
                      accuracy: int = DEFAULT_ACCURACY, write: bool = True) -> DataFrame:
    """Linear-interpolated percentiles per group, exact (numpy's default rule),
    built on ``order_stats``.  Groups with no non-null value are absent."""
    names = list(names or [f"p{int(round(p * 100))}" for p in probs])
    n = F.col("__n")
    ranks, tmp = [], []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (n - 1)
        ranks += [F.floor(pos), F.ceil(pos)]
        tmp += [f"__a{i}", f"__b{i}"]
    o = order_stats(df, group_cols, value, ranks, tmp, accuracy, write=write)
    g = _g(group_cols)
    outs = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (n - 1)
        t = pos - F.floor(pos)
        a, b = F.col(f"__a{i}"), F.col(f"__b{i}")
        outs.append((a + (b - a) * t).alias(names[i]))
    return o.select(*g, *outs)


def exact_median(df: DataFrame, group_cols: Sequence[str], value: str, name: str = "median",
                 accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    return exact_percentiles(df, group_cols, value, [0.5], [name], accuracy)


# ---------------------------------------------------------------- D1 - D5

def yearly_mean(df: DataFrame, value: str = "wqi", year: str = "year",
                group_cols: Sequence[str] = ()) -> DataFrame:
    """Mean index by year."""
    return df.groupBy(*_g(group_cols), year).agg(F.avg(value).alias("wqi_mean"))


def yearly_trend(df: DataFrame, value: str = "wqi", year: str = "year",
                 group_cols: Sequence[str] = (), accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """Mean, exact median and sample std by year (D2).  The values are written
    first, as the median passes over them again."""
    keys = _g(group_cols) + [year]
    df = stage_table(df.select(*keys, value), "trend")
    base = df.groupBy(*keys).agg(F.avg(value).alias("wqi_mean"),
                                 F.stddev_samp(value).alias("wqi_std"))
    med = exact_median(df, keys, value, "wqi_median", accuracy)
    return base.join(med, keys, "left")


def site_mean(df: DataFrame, value: str = "wqi", site: str = "site",
              group_cols: Sequence[str] = ()) -> DataFrame:
    """Mean index by site (D3); order with ``sort_by`` when a sorted table is needed."""
    return df.groupBy(*_g(group_cols), site).agg(F.avg(value).alias("wqi_mean"))


def site_profile(df: DataFrame, value: str = "wqi", label: str | None = "wqi_class",
                 site: str = "site", group_cols: Sequence[str] = (),
                 class_of=None) -> DataFrame:
    """Mean index and modal class per site.

    Mode ties go to the smallest label.  Without a label column the class is
    derived from the mean with ``class_of``.  One shuffle: the mode buffer is
    a per-group map bounded by the number of distinct labels.
    """
    keys = _g(group_cols) + [site]
    if label and label in df.columns:
        return df.groupBy(*keys).agg(F.avg(value).alias("wqi_mean"),
                                     F.mode(label, True).alias("wqi_class"))
    out = df.groupBy(*keys).agg(F.avg(value).alias("wqi_mean"))
    return out.withColumn("wqi_class", class_of(F.col("wqi_mean")))


def class_counts(df: DataFrame, label: str = "wqi_class", group_cols: Sequence[str] = ()) -> DataFrame:
    """Count per class and its percent share within the group.

    The share window runs over the already aggregated counts (one row per class).
    """
    g = _g(group_cols)
    c = df.groupBy(*g, label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*g)) if g else F.sum("n").over(Window.partitionBy())
    return c.withColumn("share_pct", F.col("n") * 100.0 / total)


# ---------------------------------------------------------------- D6 - D9

def minmax_norm(df: DataFrame, value: str, group_cols: Sequence[str] = (), out: str = "norm") -> DataFrame:
    """(value - smallest) / (largest - smallest + 1e-9) of its group (C13); a
    constant group gets 0.  The bounds are one row per group."""
    g = _g(group_cols)
    gg = g or ["__all"]
    d = df if g else df.withColumn("__all", single_key(value))
    lim = per_group(d.groupBy(*gg).agg(F.min(value).alias("__mn"), F.max(value).alias("__mx")))
    x = (F.col(value) - F.col("__mn")) / (F.col("__mx") - F.col("__mn") + 1e-9)
    out_df = d.join(lim, gg).withColumn(out, x)
    return out_df.drop("__mn", "__mx", *([] if g else ["__all"]))


def histogram(df: DataFrame, value: str, bins: int = 10, group_cols: Sequence[str] = (),
              density: bool = True) -> DataFrame:
    """Equal-width histogram between each group's min and max.

    Every bin is returned (empty bins count 0); the top edge falls in the last
    bin.  A constant group uses the range (v-0.5, v+0.5) as numpy does.
    """
    g = _g(group_cols)
    if not g:
        out = histogram(df.withColumn("__all", single_key(value)), value, bins, ["__all"], density)
        return out.drop("__all")
    v = F.col(value).cast("double")
    # No NULL filter: the aggregates skip NULLs and a NULL value lands in a
    # NULL bin that the bin grid never matches.  (A filter here would be
    # pushed below the projections and evaluate the value expression twice.)
    d = df.select(*g, v.alias("__v"))
    st = d.groupBy(*g).agg(F.min("__v").alias("__mn"), F.max("__v").alias("__mx"),
                           F.count("__v").alias("__n")).where(F.col("__n") > 0)
    lo = F.when(F.col("__mx") == F.col("__mn"), F.col("__mn") - 0.5).otherwise(F.col("__mn"))
    hi = F.when(F.col("__mx") == F.col("__mn"), F.col("__mx") + 0.5).otherwise(F.col("__mx"))
    st = per_group(st.select(*g, "__n", lo.alias("__lo"), hi.alias("__hi")))
    j = d.join(st, g)
    b = F.floor((F.col("__v") - F.col("__lo")) * (F.lit(float(bins)) / (F.col("__hi") - F.col("__lo"))))
    b = F.when(F.col("__v").isNotNull(), F.least(F.greatest(b, F.lit(0)), F.lit(bins - 1))).cast("int")
    counts = j.groupBy(*g, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = st.select(*g, "__n", "__lo", "__hi",
                     F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    out = (grid.join(counts, g + ["bin"], "left")
           .select(*g, "bin",
                   (F.col("__lo") + F.col("bin") * width).alias("bin_lo"),
                   (F.col("__lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
                   F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
                   (F.coalesce(F.col("count"), F.lit(0)) / (F.col("__n") * width)).alias("density")))
    return out if density else out.drop("density")


def kde(df: DataFrame, value: str, grid: int = 200, group_cols: Sequence[str] = ()) -> DataFrame:
    """Gaussian kernel density on ``grid`` points from min to max.

    Scott bandwidth ``n^(-1/5) * std(ddof=1)``.  Equal values are combined
    first.  A value reaches only the grid points within 38.6 bandwidths: beyond
    that ``exp(-z*z/2)`` is exactly 0 in doubles, so nothing is lost and the
    reach shrinks as the group grows.
    """
    g = _g(group_cols)
    if not g:
        return kde(df.withColumn("__all", single_key(value)), value, grid, ["__all"]).drop("__all")
    v = F.col(value).cast("double")
    d = df.select(*g, v.alias("__v")).groupBy(*g, "__v").agg(F.count("__v").alias("__c"))
    n, mean = F.sum("__c"), F.sum(F.col("__c") * F.col("__v")) / F.sum("__c")
    st = d.groupBy(*g).agg(n.alias("__n"), mean.alias("__mean"), F.min("__v").alias("__mn"), F.max("__v").alias("__mx"))
    st = per_group(st.where("__n > 0"))
    dev = F.col("__v") - F.col("__mean")
    sd = d.join(st, g).groupBy(*g).agg(F.sqrt(F.sum(F.col("__c") * dev * dev) / (F.first("__n") - 1)).alias("__sd"))
    st = per_group(st.join(sd, g).select(
        *g, "__n", "__mn", (F.pow(F.col("__n").cast("double"), -0.2) * F.col("__sd")).alias("__h"),
        ((F.col("__mx") - F.col("__mn")) / (grid - 1)).alias("__step")))
    at = (F.col("__v") - F.col("__mn")) / F.col("__step")
    reach = 38.6 * F.col("__h") / F.col("__step")
    bounded = (F.col("__step") > 0) & (F.col("__h") > 0)
    lo = F.when(bounded, F.greatest(F.floor(at - reach), F.lit(0))).otherwise(F.lit(0))
    hi = F.when(bounded, F.least(F.ceil(at + reach), F.lit(grid - 1))).otherwise(F.lit(grid - 1))
    e = d.where("__c > 0").join(st, g).select(*g, "__v", "__c", "__mn", "__h", "__step",
                                             F.explode(F.sequence(lo.cast("int"), hi.cast("int"))).alias("point"))
    x = F.col("__mn") + F.col("point") * F.col("__step")
    z = (x - F.col("__v")) / F.col("__h")
    sums = e.groupBy(*g, "point").agg(F.sum(F.col("__c") * F.exp(-0.5 * z * z)).alias("__s"))
    points = st.select("*", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"))
    return points.join(sums, [*g, "point"], "left").select(
        *g, "point", x.alias("x"),
        (F.coalesce("__s", F.lit(0.0)) / (F.col("__n") * F.col("__h") * math.sqrt(2 * math.pi))).alias("density"))


def _long(df: DataFrame, group_cols: Sequence[str], params: Sequence[str],
          name: str = "param", value: str = "value") -> DataFrame:
    g = _g(group_cols)
    cast = df.select(*g, *[F.col(p).cast("double").alias(p) for p in params])
    return cast.unpivot(g, list(params), name, value)


def moments(df: DataFrame, params: Sequence[str], group_cols: Sequence[str] = (),
            accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """Mean, exact median and population std per parameter and group."""
    g = _g(group_cols)
    lg = _long(df, g, params)
    base = lg.groupBy(*g, "param").agg(F.avg("value").alias("mean"),
                                       F.stddev_pop("value").alias("std_pop"))
    med = exact_median(lg, g + ["param"], "value", "median", accuracy)
    return base.join(med, g + ["param"], "left")


def box_stats(df: DataFrame, params: Sequence[str], group_cols: Sequence[str] = (),
              whisker: float = 1.5, accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """Quartiles, 1.5-IQR whiskers, outlier count, mean and std per parameter."""
    g = _g(group_cols) + ["param"]
    lg = _long(df, _g(group_cols), params).where(F.col("value").isNotNull())
    q = exact_percentiles(lg, g, "value", [0.25, 0.5, 0.75], ["q1", "median", "q3"], accuracy)
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    q = q.withColumn("lower_fence", F.col("q1") - whisker * F.col("iqr")) \
         .withColumn("upper_fence", F.col("q3") + whisker * F.col("iqr"))
    q = per_group(q)
    j = lg.join(q.select(*g, "lower_fence", "upper_fence"), g)
    inside = (F.col("value") >= F.col("lower_fence")) & (F.col("value") <= F.col("upper_fence"))
    agg = j.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std_pop"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_hi"),
        F.count_if(~inside).alias("n_outliers"))
    return q.join(agg, g)


# ---------------------------------------------------------------- D10 - D15

def corr_matrix(df: DataFrame, cols: Sequence[str], group_cols: Sequence[str] = (),
                digits: int | None = 3, diagonal: bool = False) -> DataFrame:
    """Pairwise-complete Pearson correlations, lower triangle, long form.

    All pairs are computed in a single aggregation, so the table is scanned once.
    """
    g = _g(group_cols)
    pairs = [(a, b) for i, a in enumerate(cols) for j, b in enumerate(cols)
             if (i > j) or (diagonal and i == j)]
    aggs = [F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"__c{k}")
            for k, (a, b) in enumerate(pairs)]
    wide = df.groupBy(*g).agg(*aggs)
    structs = F.array(*[F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"),
                                 F.col(f"__c{k}").alias("corr")) for k, (a, b) in enumerate(pairs)])
    out = wide.select(*g, F.inline(structs))
    if digits is not None:
        out = out.withColumn("corr", F.round("corr", digits))
    return out


def corr_with_target(df: DataFrame, cols: Sequence[str], target: str,
                     group_cols: Sequence[str] = ()) -> DataFrame:
    """Correlation of every column with the target (D11); order by ``corr`` desc to rank."""
    g = _g(group_cols)
    aggs = [F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in cols]
    wide = df.groupBy(*g).agg(*aggs)
    return wide.unpivot(g, list(cols), "feature", "corr")


def exceedance_rate(df: DataFrame, limits: Mapping, group_cols: Sequence[str] = (),
                    columns: Mapping[str, str] | None = None) -> DataFrame:
    """Share of rows over the limit, or outside a (lo, hi) range.

    A missing value counts as not exceeding; the denominator is all rows.
    Parameters without a column are skipped.
    """
    g = _g(group_cols)
    columns = dict(columns or {p: p for p in limits})
    aggs = []
    for p, lim in limits.items():
        c = columns.get(p)
        if c is None or c not in df.columns:
            continue
        x = F.col(c).cast("double")
        cond = ((x < lim[0]) | (x > lim[1])) if isinstance(lim, tuple) else (x > lim)
        aggs.append(F.avg(F.when(cond, 1.0).otherwise(0.0)).alias(p))
    wide = df.groupBy(*g).agg(*aggs)
    names = [a for a in limits if columns.get(a) in df.columns]
    return wide.unpivot(g, names, "param", "rate")


def extremes(site_means: DataFrame, value: str = "wqi_mean", group_cols: Sequence[str] = ()) -> DataFrame:
    """Min and max of the site means."""
    return site_means.groupBy(*_g(group_cols)).agg(F.min(value).alias("wqi_min"),
                                                    F.max(value).alias("wqi_max"))


def water_type_summary(profile: DataFrame, group_col: str = "water_type", value: str = "wqi_mean",
                       site: str = "site", label: str = "wqi_class",
                       worse: Mapping[str, str] | str = "high") -> DataFrame:
    """Average of site means, worst and best site per water type.

    Worst = first site with the worse end first, site name breaking ties;
    best = last site in that order.
    """
    from hydrosift.operators.rank import worse_first
    s = worse_first(value, group_col, worse)
    order = F.struct((-s).alias("k"), F.col(site).alias("s"))
    rec = F.struct(F.col(site).alias("site"), F.col(value).alias("wqi"), F.col(label).alias("cls"))
    agg = profile.groupBy(group_col).agg(
        F.avg(value).alias("avg_site_wqi"),
        F.count(F.lit(1)).alias("n_sites"),
        F.min_by(rec, order).alias("__w"),
        F.max_by(rec, order).alias("__b"))
    return agg.select(group_col, "avg_site_wqi", "n_sites",
                      F.col("__w.site").alias("worst_site"), F.col("__w.wqi").alias("worst_wqi"),
                      F.col("__w.cls").alias("worst_class"),
                      F.col("__b.site").alias("best_site"), F.col("__b.wqi").alias("best_wqi"),
                      F.col("__b.cls").alias("best_class"))


def param_pairs(df: DataFrame, params: Sequence[str], target: str = "wqi",
                keep: Sequence[str] = ()) -> DataFrame:
    """Value-versus-index point sets for several parameters."""
    ids = list(keep) + [target]
    return (df.select(*ids, *[F.col(p).cast("double").alias(p) for p in params])
            .unpivot(ids, list(params), "param", "value"))


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null count per column, long form."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "nulls")


def describe(df: DataFrame, cols: Sequence[str], group_cols: Sequence[str] = (),
             accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """count, mean, sample std, min, exact quartiles, max per column (B22); ``df``
    is read several times."""
    g = _g(group_cols)
    lg = _long(df, g, cols, "column", "value")
    base = lg.groupBy(*g, "column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    q = exact_percentiles(lg, g + ["column"], "value", [0.25, 0.5, 0.75], ["q25", "q50", "q75"], accuracy, write=False)
    return base.join(q, g + ["column"], "left")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Unique values of a column."""
    return df.select(col).distinct()
