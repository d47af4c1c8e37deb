"""ML preparation (G1-G12): exact, deterministic, hash-keyed.

Randomness comes from md5 of (seed, row key, ...), never from ``rand()``, so
results do not depend on partitioning or retries and an SQL engine can
recompute every draw.  Exact split sizes and fold boundaries come from
per-group order statistics (``stats.order_stats``): no global row numbering
and no task ever holds a whole group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrosift.operators.common import hash_long, per_group, unit_hash
from hydrosift.operators.stats import exact_percentiles, order_stats


def encode_label(df: DataFrame, col: str, out: str = "label_idx"):
    """Label -> index in alphabetical order (G1); returns (df, labels).

    ``StringIndexer`` fits the distinct labels (a bounded list) and the
    transform is a per-row lookup.
    """
    from pyspark.ml.feature import StringIndexer
    model = StringIndexer(inputCol=col, outputCol=out, stringOrderType="alphabetAsc",
                          handleInvalid="keep").fit(df)
    return model.transform(df), list(model.labels)


def _u(key: str | Sequence[str], seed) -> Column:
    keys = [key] if isinstance(key, str) else list(key)
    return unit_hash(*keys, seed=str(seed))


def split(df: DataFrame, key: str | Sequence[str], test_frac: float = 0.2, seed=42,
          out: str = "is_test") -> DataFrame:
    """Random split with exactly ``ceil(test_frac * n)`` test rows.

    Rows are ordered by a keyed uniform hash; the test set is the smallest
    ``k`` hashes, found as an exact order statistic (no global sort).
    """
    u = _u(key, seed)
    k = F.ceil(F.lit(float(test_frac)) * F.col("__n")) - 1
    bound = order_stats(df.select(u.alias("__u")), [], "__u", [k], ["__thr"]).first()
    if bound is None or bound["__thr"] is None:
        return df.withColumn(out, F.lit(False))
    return df.withColumn(out, F.coalesce(u <= F.lit(bound["__thr"]), F.lit(False)))


def stratified_quotas(df: DataFrame, label: str, test_frac: float = 0.2) -> DataFrame:
    """Per-class test quota: total ``ceil(frac*n)`` shared in proportion by
    largest remainder (ties to the smaller label).  One row per class; the
    window runs over this class table only."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w_all = Window.partitionBy()
    c = c.withColumn("__N", F.sum("n_c").over(w_all))
    c = c.withColumn("__T", F.ceil(F.lit(float(test_frac)) * F.col("__N")))
    c = c.withColumn("__e", F.col("__T") * F.col("n_c") / F.col("__N"))
    c = c.withColumn("__f", F.floor("__e"))
    c = c.withColumn("__r", F.col("__e") - F.col("__f"))
    c = c.withColumn("__left", F.col("__T") - F.sum("__f").over(w_all))
    c = c.withColumn("__pos", F.row_number().over(Window.partitionBy().orderBy(F.desc("__r"), label)))
    q = (F.col("__f") + F.when(F.col("__pos") <= F.col("__left"), 1).otherwise(0)).cast("long")
    return c.select(label, "n_c", q.alias("quota"))


def stratified_split(df: DataFrame, key: str | Sequence[str], label: str, test_frac: float = 0.2,
                     seed=42, out: str = "is_test") -> DataFrame:
    """Stratified split (G3): per-class quotas, smallest hashes within each class."""
    u = "__u"
    d = df.withColumn(u, _u(key, seed))
    quotas = stratified_quotas(df, label, test_frac).select(label, "quota")
    thr = order_stats(d, [label], u, [F.col("quota") - 1], ["__thr"], extra=quotas)
    return (d.join(per_group(thr.select(label, "__thr")), label, "left")
            .withColumn(out, F.coalesce(F.col(u) <= F.col("__thr"), F.lit(False)))
            .drop("__thr", u))


def _fold_bounds(k: int):
    """Ranks where folds 1..k-1 start: sizes n//k (+1 for the first n%k folds)."""
    n = F.col("__n")
    return [F.lit(j) * F.floor(n / k) + F.least(F.lit(j), F.pmod(n, F.lit(k))) for j in range(1, k)]


def kfold(df: DataFrame, key: str | Sequence[str] | None, k: int = 5, seed=42, out: str = "fold",
          order_col: str | None = None, group_cols: Sequence[str] = ()) -> DataFrame:
    """Fold id 0..k-1 (G4).  Shuffled: contiguous blocks in keyed-hash order
    (what a shuffled K-fold does); with ``order_col``: contiguous blocks in
    that order (unshuffled).  Fold sizes differ by at most one.  With
    ``group_cols`` folds are made per group (G5, stratified)."""
    g = list(group_cols)
    v = "__u"
    d = df.withColumn(v, F.col(order_col).cast("double") if order_col else _u(key, seed))
    names = [f"__b{j}" for j in range(1, k)]
    bounds = order_stats(d, g, v, _fold_bounds(k), names).drop("__n")
    if g:
        j, starts = d.join(per_group(bounds), g), [F.col(b) for b in names]
    else:  # one row, read back
        row = bounds.first()
        j, starts = d, [F.lit(row[b] if row else None).cast("double") for b in names]
    fold = sum((F.when(F.col(v) >= b, 1).otherwise(0) for b in starts), F.lit(0))
    return j.withColumn(out, fold.cast("int")).drop(*names, v)


def stratified_kfold(df: DataFrame, key: str | Sequence[str], label: str, k: int = 5, seed=42,
                     out: str = "fold") -> DataFrame:
    """Folds balanced per class."""
    return kfold(df, key, k, seed, out, group_cols=[label])


def median_impute(fit: DataFrame, apply: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill NULLs with exact medians learnt on ``fit`` (G6).  The medians are
    one value per column, read back as a single row."""
    lg = fit.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "param", "value")
    med = exact_percentiles(lg, ["param"], "value", [0.5], ["median"]).collect()
    fill = {r["param"]: r["median"] for r in med if r["median"] is not None}
    return apply.na.fill(fill)


def standardize(fit: DataFrame, apply: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """z-score with the population std learnt on ``fit``; zero std -> 0."""
    st = fit.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        m, s = st[f"m_{i}"], st[f"s_{i}"]
        scale = s if (s is not None and s != 0) else 1.0
        out[c + suffix] = (F.col(c) - F.lit(m)) / F.lit(scale)
    return apply.withColumns(out)


def keyed_normal(*parts: Column | str, seed: str = "0") -> Column:
    """Standard normal from md5 of the parts (Box-Muller on two 60-bit draws)."""
    u1 = hash_long(*parts, seed=seed, offset=1) / F.lit(float(16 ** 15))
    u2 = hash_long(*parts, seed=seed, offset=16) / F.lit(float(16 ** 15))
    return F.sqrt(-2.0 * F.log(1.0 - u1)) * F.cos(2.0 * math.pi * u2)


def augment_noise(df: DataFrame, key: str, cols: Sequence[str], n_copies: int = 3, frac: float = 0.01,
                  seed=42, target: str | None = None, target_frac: float = 0.005,
                  copy_col: str = "copy") -> DataFrame:
    """Original rows plus ``n_copies`` noisy copies.

    Each non-null feature gets N(0, (frac*std)^2) with std the sample std of
    the column (skipped when 0 or undefined); with ``target`` the target gets
    N(0, (target_frac*std_y)^2).  Copies come from ``explode(sequence)``, a
    per-row generator; the noise is keyed on (key, copy, column).
    """
    names = list(cols) + ([target] if target else [])
    st = df.agg(*[F.stddev_samp(c).alias(f"s_{i}") for i, c in enumerate(names)]).first()
    d = df.withColumn(copy_col, F.explode(F.sequence(F.lit(0), F.lit(n_copies))))
    out = {}
    for i, c in enumerate(names):
        s = st[f"s_{i}"]
        if s is None or s == 0 or (isinstance(s, float) and math.isnan(s)):
            continue
        f = target_frac if (target and c == target) else frac
        z = keyed_normal(F.col(key), F.col(copy_col), F.lit(c), seed=str(seed))
        noisy = F.col(c) + F.lit(f * s) * z
        out[c] = F.when((F.col(copy_col) > 0) & F.col(c).isNotNull(), noisy).otherwise(F.col(c))
    return d.withColumns(out)


@dataclass(frozen=True)
class Components:
    """Principal components: columns, their means, loadings by component (the
    loading of largest size is positive; ties: the first column's) and shares of
    the variance."""

    cols: list[str]
    means: list[float]
    loadings: list[list[float]]
    explained: list[float]


def pca(df: DataFrame, cols: Sequence[str], k: int = 2) -> Components:
    """First ``k`` principal components (G12) from one centred Gram matrix.

    Means are one aggregation and the matrix another, both map-side combined; the
    driver sees columns x columns sums.  Rows with a NULL are left out, as are
    equal rows' order and number of partitions: neither changes the result.
    No rows or no variance: an error, as there is no first component."""
    whole = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    means = list(whole.agg(*[F.avg(c) for c in cols]).first())
    if None in means:
        raise ValueError("pca: no row without NULL")
    centred = whole.select(*[(F.col(c) - m).alias(c) for c, m in zip(cols, means, strict=True)])
    at = [(i, j) for i in range(len(cols)) for j in range(i + 1)]
    sums = centred.agg(*[F.sum(F.col(cols[i]) * F.col(cols[j])) for i, j in at]).first()
    gram = np.zeros((len(cols), len(cols)))
    for (i, j), v in zip(at, sums, strict=True):
        gram[i, j] = gram[j, i] = v
    if not np.trace(gram) > 0:
        raise ValueError("pca: no variance")
    values, vectors = np.linalg.eigh(gram)
    loadings = []
    for v in vectors[:, ::-1].T[:k]:
        size = np.abs(v)
        lead = int(np.flatnonzero(size >= size.max() - 1e-12)[0])
        loadings.append([float(x) for x in (v if v[lead] > 0 else -v)])
    return Components(list(cols), means, loadings, [float(x) for x in values[::-1][:k] / np.trace(gram)])


def project_components(df: DataFrame, found: Components, prefix: str = "pc") -> DataFrame:
    """Coordinates ``pc1`` ... of rows, or of centroids, in native columns; NULL
    where a column is."""
    score = lambda w: sum(((F.col(c) - m) * x for c, m, x in zip(found.cols, found.means, w, strict=True)), F.lit(0.0))
    return df.withColumns({f"{prefix}{n}": score(w) for n, w in enumerate(found.loadings, 1)})
