"""Gradient boosting of histogram trees, for many classes and with second-order
splits (H2, H4, H8, H10), and the shares of the features in a score (H18).

Rows are binned once by quantile edges and written; each level of a round's trees
(one per class) is one job: tasks add up gradients and hessians per (class, node,
feature, bin), Spark sums the tasks' tables, and the driver, which holds only such
tables (classes x nodes x features x bins), chooses the splits.  Scores are brought
up to date in the written rows every few rounds, so no task replays all trees.

First-order trees are fitted to residuals (largest drop of their variance) and
get Newton leaf values; second-order trees choose and weigh by gradient and
hessian with an L2 penalty and a least gain.  A NULL or NaN feature goes left.
Scoring is a native expression over the model held as one array.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hydrosift.session import stage_table


@dataclass(frozen=True)
class Boosting:
    """Rounds, depth and learning rate; L2 penalty, least gain of a split and least
    hessian of a child (second order); bins of a feature, and rounds between two
    writings of the scores."""

    rounds: int = 100
    depth: int = 3
    rate: float = 0.1
    second_order: bool = False
    l2: float = 0.0
    min_gain: float = 0.0
    min_weight: float = 0.0
    bins: int = 32
    refresh: int = 10


@dataclass
class Tree:
    """Nodes 1, 2, ... (children 2 k and 2 k + 1): feature (-1: leaf), the last bin
    that goes left, value, rows and gain of each."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    rows: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 << depth
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n))


@dataclass
class Model:
    """Trees by round and class; classes 0 stands for a regression."""

    features: list[str]
    edges: list[np.ndarray]
    classes: int
    base: np.ndarray
    opt: Boosting
    trees: list[list[Tree]] = field(default_factory=list)

    def rows(self) -> list[tuple]:
        """(round, class, node, feature, threshold, value, gain, rows) of every node."""
        out = []
        for r, group in enumerate(self.trees, start=1):
            for k, t in enumerate(group):
                for node in np.flatnonzero(t.rows):
                    f = int(t.feature[node])
                    out.append((r, k, int(node), self.features[f] if f >= 0 else None, float(self.edges[f][t.cut[node]]) if f >= 0 else None,
                                float(t.value[node]), float(t.gain[node]), int(t.rows[node])))
        return out


MODEL_SCHEMA = "round int, class int, node int, feature string, threshold double, value double, gain double, rows long"


def bin_edges(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Per feature the different values at the ranks i / bins; a value up to the
    first edge is in bin 0.  Exact up to ten thousand rows, within a ten
    thousandth of the ranks beyond."""
    at = [i / bins for i in range(1, bins)]
    found = df.agg(*[F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), at, 10_000).alias(f"e{i}")
                     for i, c in enumerate(features)]).first()
    return [np.unique(np.array(found[i] or [0.0])) for i in range(len(features))]


def leaf_of(tree: Tree, bins: np.ndarray, depth: int) -> np.ndarray:
    node, rows = np.ones(len(bins), np.int64), np.arange(len(bins))
    for _ in range(depth):
        f = tree.feature[node]
        right = bins[rows, np.maximum(f, 0)] > tree.cut[node]
        node = np.where(f >= 0, 2 * node + right, node)
    return node


def binned(matrix: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(matrix.shape, np.int16)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(matrix[:, j]), 0, np.searchsorted(e, matrix[:, j]))
    return out


def gradients(score: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss, a column per class."""
    if not classes:
        return score - y[:, None], np.ones_like(score)
    p = np.exp(score - score.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return p - (y[:, None] == np.arange(classes)), p * (1 - p)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _tree_tables(data: DataFrame, model: Model, pending: list, growing: list[Tree] | None, level: int) -> DataFrame:
    """Rows (class, node, feature, bin, g, h, n) of a level, or, without trees that
    grow, the data with its scores brought up to date."""
    n_features, outputs, depth, classes = len(model.features), max(1, model.classes), model.opt.depth, model.classes
    width = 1 + max(map(len, model.edges))

    def run(batches):
        first, nodes = 1 << level, 1 << level
        table = np.zeros((3, outputs, nodes, n_features, width))
        for batch in batches:
            bins, y, score = _matrix(batch.column(0), n_features), batch.column(1).to_numpy(), _matrix(batch.column(2), outputs).copy()
            for group in pending:
                for k, tree in enumerate(group):
                    score[:, k] += tree.value[leaf_of(tree, bins, depth)]
            if growing is None:
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * outputs), pa.array(score.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["b", "y", "s"])
                continue
            g, h = gradients(score, y, classes)
            for k, tree in enumerate(growing):
                node = leaf_of(tree, bins, level) - first
                here = np.flatnonzero(node >= 0)
                cell = ((node[here, None] * n_features + np.arange(n_features)) * width + bins[here]).ravel()
                for i, w in enumerate((g[here, k], h[here, k], np.ones(len(here)))):
                    table[i, k] += np.bincount(cell, np.repeat(w, n_features), nodes * n_features * width).reshape(nodes, n_features, width)
        if growing is not None:
            at = np.nonzero(table[2])
            yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in at), *(pa.array(t[at]) for t in table)],
                                             names=["class", "node", "feature", "bin", "g", "h", "n"])

    if growing is None:
        return data.mapInArrow(run, "b array<smallint>, y double, s array<double>")
    return data.mapInArrow(run, "class int, node int, feature int, bin int, g double, h double, n double").groupBy(
        "class", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))


def split_gains(table: np.ndarray, opt: Boosting) -> tuple[np.ndarray, np.ndarray]:
    """(gains, left sums) of every (feature, cut) of a node's (3, features, bins) sums."""
    left = np.cumsum(table, axis=2)
    total = left[:, :, -1:]
    right = total - left

    def score(part):
        weight = part[1] + opt.l2 if opt.second_order else part[2]
        return np.where(weight > 1e-12, part[0] ** 2 / np.maximum(weight, 1e-12), 0.0)

    gain = score(left) + score(right) - score(total)
    allowed = (left[2] > 0) & (right[2] > 0)
    if opt.second_order:
        allowed &= (left[1] >= opt.min_weight) & (right[1] >= opt.min_weight)
    return np.where(allowed, gain, -np.inf), left


def leaf_value(g: float, h: float, n: float, classes: int, opt: Boosting) -> float:
    if opt.second_order:
        return -opt.rate * g / (h + opt.l2) if h + opt.l2 > 1e-12 else 0.0
    newton = h if classes else n
    return -opt.rate * (1 - 1 / classes if classes else 1.0) * g / newton if newton > 1e-12 else 0.0


def _grow(data: DataFrame, model: Model, pending: list) -> list[Tree]:
    """One tree per class, level by level."""
    opt, outputs, width = model.opt, max(1, model.classes), 1 + max(map(len, model.edges))
    trees = [Tree.empty(opt.depth) for _ in range(outputs)]
    for level in range(opt.depth):
        table = np.zeros((3, outputs, 1 << level, len(model.features), width))
        sums = _tree_tables(data, model, pending, trees, level).toArrow()  # at most classes x nodes x features x bins rows
        at = tuple(sums.column(c).to_numpy() for c in ("class", "node", "feature", "bin"))
        for i, c in enumerate("ghn"):
            table[i][at] = sums.column(c).to_numpy()
        split = False
        for k, tree in enumerate(trees):
            for node in range(1 << level):
                at_node, here = (1 << level) + node, table[:, k, node]
                total = here[:, 0].sum(axis=1)
                if not total[2]:
                    continue
                if not level:
                    tree.rows[1], tree.value[1] = total[2], leaf_value(*total, model.classes, opt)
                gain, left = split_gains(here, opt)
                f, cut = np.unravel_index(int(np.argmax(np.round(gain, 9))), gain.shape)
                if gain[f, cut] <= opt.min_gain + 1e-9:
                    continue
                split = True
                tree.feature[at_node], tree.cut[at_node], tree.gain[at_node] = f, cut, gain[f, cut]
                for child, part in ((2 * at_node, left[:, f, cut]), (2 * at_node + 1, total - left[:, f, cut])):
                    tree.rows[child], tree.value[child] = part[2], leaf_value(*part, model.classes, opt)
        if not split:
            break
    return trees


def prepare(df: DataFrame, features: Sequence[str], label: str, classes: int, opt: Boosting) -> tuple[Model, DataFrame, int]:
    """A model without trees, the binned rows with its base scores, and their number."""
    df = df.where(F.col(label).isNotNull())
    edges, outputs = bin_edges(df, features, opt.bins), max(1, classes)
    if classes:
        counts = dict(map(tuple, df.groupBy(F.col(label).cast("int")).count().collect()))
        n = sum(counts.values())
        prior = [math.log(max(counts.get(k, 0), 1e-9) / n) if n and not opt.second_order else 0.0 for k in range(classes)]
    else:
        mean, n = df.agg(F.avg(label), F.count(F.lit(1))).first()
        prior = [mean or 0.0]
    model = Model(list(features), edges, classes, np.array(prior), opt)

    def run(batches):
        for batch in batches:
            bins = binned(_matrix(batch.column(0), len(edges)), edges)
            ends = np.arange(len(bins) + 1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(ends * len(edges)), pa.array(bins.ravel())), batch.column(1),
                 pa.ListArray.from_arrays(pa.array(ends * outputs), pa.array(np.tile(prior, len(bins))))], names=["b", "y", "s"])

    numbers = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])
    rows = df.select(numbers.alias("f"), F.col(label).cast("double").alias("y"))
    return model, stage_table(rows.mapInArrow(run, "b array<smallint>, y double, s array<double>"), "boosting"), n


def root_gains(df: DataFrame, features: Sequence[str], label: str, classes: int = 0, opt: Boosting = Boosting()) -> list[tuple]:
    """(class, feature, threshold, gain) of every split that the first trees may begin with."""
    model, data, n = prepare(df, features, label, classes, opt)
    outputs, width = max(1, classes), 1 + max(map(len, model.edges))
    table = np.zeros((3, outputs, len(features), width))
    for r in _tree_tables(data, model, [], [Tree.empty(opt.depth) for _ in range(outputs)], 0).collect():
        table[:, r["class"], r["feature"], r["bin"]] = r["g"], r["h"], r["n"]
    out = []
    for k in range(outputs if n else 0):
        gain, _ = split_gains(table[:, k], opt)
        out += [(k, features[f], float(e), float(gain[f, c])) for f, edges in enumerate(model.edges)
                for c, e in enumerate(edges) if np.isfinite(gain[f, c])]
    return out


def fit(df: DataFrame, features: Sequence[str], label: str, classes: int = 0, opt: Boosting = Boosting()) -> Model:
    """A model of ``label``: a number, or a class 0 .. classes - 1.  Rows with a
    NULL label are left out; no rows give a model without trees."""
    model, data, n = prepare(df, features, label, classes, opt)
    pending: list[list[Tree]] = []
    for _ in range(opt.rounds if n else 0):
        if len(pending) == opt.refresh:
            data, pending = stage_table(_tree_tables(data, model, pending, None, 0), "boosting"), []
        group = _grow(data, model, pending)
        model.trees.append(group)
        pending.append(group)
    return model


def raw_scores(model: Model, features: Column) -> Column:
    """Array of the sums of the leaves that a row (array of its features) falls
    into, a number per class, on top of the base scores."""
    def literal(k: int) -> Column:
        held = [{"f": g[k].feature.tolist(), "v": g[k].value.tolist(),
                 "c": [float(model.edges[f][c]) if f >= 0 else 0.0 for f, c in zip(g[k].feature, g[k].cut, strict=True)]} for g in model.trees]
        return F.from_json(F.lit(json.dumps(held)), "array<struct<f:array<int>,c:array<double>,v:array<double>>>")

    def step(tree: Column, node: Column) -> Column:
        f = F.get(tree["f"], node)
        value = F.nanvl(F.get(features, f), F.lit(None).cast("double"))
        right = F.when(value > F.get(tree["c"], node), 1).otherwise(0)
        return F.when(f >= 0, 2 * node + right).otherwise(node)

    def leaf(tree: Column) -> Column:
        node = F.lit(1)
        return F.get(tree["v"], F.aggregate(F.sequence(F.lit(1), F.lit(model.opt.depth)), node, lambda at, _: step(tree, at)))

    return F.array(*[F.aggregate(literal(k), F.lit(float(b)), lambda total, t: total + leaf(t)) for k, b in enumerate(model.base)])


def predict(model: Model, df: DataFrame, out: str = "prediction", scores: str = "scores") -> DataFrame:
    """``df`` with the raw scores and the predicted number or class (ties: the smallest)."""
    raw = raw_scores(model, F.array(*[F.col(c).cast("double") for c in model.features]))
    scored = df.withColumn(scores, raw)
    best = F.array_position(scores, F.array_max(scores)) - 1 if model.classes else F.get(scores, F.lit(0))
    return scored.withColumn(out, best.cast("double"))


def shares(model: Model, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x classes x features, base per class): how much each feature moves a
    row's score from the mean over the training rows, by the paths of the trees.

    A leaf counts for a coalition if the row meets the splits on its features; the
    splits on other features are met by the share of training rows that did.  The
    weights of all coalitions are sums over the coefficients of a polynomial."""
    bins = binned(matrix, model.edges)
    out, base = np.zeros((len(matrix), max(1, model.classes), len(model.features))), model.base.astype(float).copy()
    for group in model.trees:
        for k, tree in enumerate(group):
            for leaf in np.flatnonzero((tree.rows > 0) & (tree.feature < 0)):
                met, open_share, node = {}, {}, int(leaf)
                while node > 1:
                    parent, f = node // 2, int(tree.feature[node // 2])
                    goes = (bins[:, f] > tree.cut[parent]) == bool(node % 2)
                    met[f] = met.get(f, True) & goes
                    open_share[f] = open_share.get(f, 1.0) * tree.rows[node] / tree.rows[parent]
                    node = parent
                base[k] += tree.value[leaf] * math.prod(open_share.values())
                m = len(met)
                for f in met:
                    poly = [np.ones(len(matrix))]
                    for other in met:
                        if other != f:
                            z, o = open_share[other], met[other]
                            poly = [(poly[s] * z if s < len(poly) else 0.0) + (poly[s - 1] * o if s else 0.0) for s in range(len(poly) + 1)]
                    weight = sum(p * (math.factorial(s) * math.factorial(m - 1 - s) / math.factorial(m)) for s, p in enumerate(poly))
                    out[:, k, f] += tree.value[leaf] * weight * (met[f] - open_share[f])
    return out, base


def feature_shares(model: Model, df: DataFrame, key: str) -> DataFrame:
    """(key, class, base, shares): every row's shares per class, in feature order."""
    outputs, n = max(1, model.classes), len(model.features)

    def run(batches):
        for batch in batches:
            value, base = shares(model, _matrix(batch.column(1), n))
            rows = len(value) * outputs
            lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * n), pa.array(value.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(len(value)), outputs))), pa.array(np.tile(np.arange(outputs, dtype=np.int32), len(value))),
                 pa.array(np.tile(base, len(value))), lists], names=["key", "class", "base", "shares"])

    numbers = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in model.features])
    return df.select(F.col(key).alias("key"), numbers.alias("f")).mapInArrow(
        run, f"key {df.schema[key].dataType.simpleString()}, class int, base double, shares array<double>")


def share_ranking(model: Model, df: DataFrame, key: str) -> DataFrame:
    """(feature, mean_share, rank): mean absolute share over rows and classes."""
    names = F.array(*[F.lit(c) for c in model.features])
    parts = feature_shares(model, df, key).select(F.posexplode("shares").alias("at", "share"))
    ranked = parts.groupBy("at").agg(F.avg(F.abs("share")).alias("mean_share")).select(F.get(names, F.col("at")).alias("feature"), "mean_share")
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_share"), "feature")))  # a row per feature
