"""K-means with many starts, all advanced by one scan per iteration."""

from __future__ import annotations

import json
import sys
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrosift.operators.common import hash_long

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package


@dataclass(frozen=True)
class Clusters:
    """The best start: its number, centroids, inertia and iterations, and the
    inertia of every start."""

    start: int
    centroids: np.ndarray
    inertia: float
    iterations: int
    inertias: np.ndarray


def _literal(values: np.ndarray) -> Column:
    kind = "array<" * values.ndim + "double" + ">" * values.ndim
    return F.from_json(F.lit(json.dumps(values.tolist())), kind)


def _distances(point: Column, centroids: Column) -> Column:
    """Squared distance to every centroid."""
    return F.transform(centroids, lambda c: F.aggregate(
        F.zip_with(point, c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, b: a + b))


def nearest(point: Column, centroids: np.ndarray) -> Column:
    """(cluster, distance): the nearest centroid, the first among equals."""
    far = _distances(point, _literal(centroids))
    return F.transform(F.array(far), lambda d: F.struct(
        (F.array_position(d, F.array_min(d)) - 1).cast("int").alias("cluster"), F.array_min(d).alias("distance")))[0]


def first_centroids(df: DataFrame, cols: Sequence[str], key: str, k: int, starts: int, seed: int) -> np.ndarray:
    """Per start the points of k rows chosen by a keyed hash (starts x k x columns);
    a table of fewer rows repeats them."""
    point = F.array(*[F.col(c).cast("double") for c in cols])

    def one(s: int) -> list:
        rows = df.select(hash_long(key, seed=f"{seed}.{s}").alias("h"), F.col(key).alias("key"), point.alias("f")).orderBy("h", "key").limit(k)
        found = [r["f"] for r in rows.collect()]
        return [found[i % len(found)] for i in range(k)] if found else [[0.0] * len(cols)] * k
    with ThreadPoolExecutor(max(1, starts)) as pool:
        return np.array(list(pool.map(one, range(starts))))


def _sums(centroids: np.ndarray, numbers: np.ndarray):
    """Rows a task holds -> its (start, cluster) counts, distances and coordinate sums."""
    starts, k, n = centroids.shape

    def run(batches):
        total = np.zeros((starts * k, n + 2))
        for b in batches:
            x = [b.column(i).to_numpy(zero_copy_only=False) for i in range(n)]
            far = np.zeros((starts, k, b.num_rows))
            for i in range(n):
                gap = x[i] - centroids[:, :, i, None]
                far += gap * gap
            near = far.argmin(axis=1)
            at = (near + k * np.arange(starts)[:, None]).ravel()
            for j, values in enumerate((1.0, np.take_along_axis(far, near[:, None], axis=1)[:, 0], *x)):
                total[:, j] += np.bincount(at, np.broadcast_to(values, near.shape).ravel(), starts * k)
        at = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers[at // k].astype(np.int32)), pa.array((at % k).astype(np.int32)), pa.array(total[at, 0].astype(np.int64)),
             *[pa.array(total[at, j]) for j in range(1, n + 2)]], ["start", "cluster", "n", "far", *[f"s{i}" for i in range(n)]])
    return run


def kmeans_starts(df: DataFrame, cols: Sequence[str], key: str, k: int, starts: int = 10, iterations: int = 300,
                  tolerance: float = 1e-8, seed: int = 42) -> Clusters:
    """The start of least inertia (the smallest number among equals).  Every
    iteration is one job: each row meets its nearest centroid of every start that
    still moves, and a task sums its rows by (start, cluster), so only starts x k sums
    a task reach the driver.  An empty cluster keeps its centroid; rows with a NULL
    coordinate are left out."""
    df = df.dropna(subset=list(cols))
    points = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    centroids = first_centroids(df, cols, key, k, starts, seed)
    inertias, moving, done = np.zeros(starts), np.arange(starts), 0
    names = [f"s{i}" for i in range(len(cols))]
    schema = "start int, cluster int, n long, far double" + "".join(f", {s} double" for s in names)
    for done in range(1, iterations + 1):
        totals, far = np.zeros((starts, k, 1 + len(cols))), np.zeros(starts)
        for r in points.mapInArrow(_sums(centroids[moving], moving), schema).collect():
            totals[r["start"], r["cluster"]] += [r["n"], *[r[s] for s in names]]
            far[r["start"]] += r["far"]
        n = totals[..., :1]
        moved = np.where(n > 0, totals[..., 1:] / np.maximum(n, 1), centroids)
        inertias[moving] = far[moving]
        moving = np.flatnonzero(~(np.abs(moved - centroids).max(axis=(1, 2)) <= tolerance))
        centroids[moving] = moved[moving]
        if not len(moving):
            break
    best = int(np.argmin(inertias))
    return Clusters(best, centroids[best], float(inertias[best]), done, inertias)


def assign(df: DataFrame, cols: Sequence[str], found: Clusters) -> DataFrame:
    """``df`` with its cluster and the squared distance to the centroid."""
    m = nearest(F.array(*[F.col(c).cast("double") for c in cols]), found.centroids)
    return df.withColumn("__m", m).withColumns({"cluster": F.col("__m.cluster"), "distance": F.col("__m.distance")}).drop("__m")
