"""Quality scores from a generalised additive model with pairwise interactions.

A text becomes about twenty numbers (shares of character classes, word and line
statistics).  Each number is cut into quantile bins; the model is a table of
additions per number and per chosen pair of numbers.  Tables are learned by
cyclic gradient boosting: in turn, each number gets a shallow tree over its
bins that fits the current residuals, and a small step of it is added to its
table.  Pairs are picked by how much a four-way split lowers the residuals, then
boosted likewise.  Scoring looks up one bin per number and adds.

The model is fitted on a bounded sample of labelled rows; every text is scored whole.

Defined results for odd input: a NULL or empty text is scored as one without
words; rows with a NULL label are not trained on; without training rows every
score is 0.5; a document labelled twice counts twice; repeated rows get a row
each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, in_batches
from .words import Words, slices

# Character classes as bytes of UTF-8; bytes from 0x80 are "wide".
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
    "space": b" ", "break": b"\n", "blank": b"\t\x0b\x0c\r", "symbol": b"#*$%&<>~^_=+\\/", "bar": b"|",
    "shout": b"!?", "stop": b".", "comma": b",;:", "quote": b"\"'()[]{}`", "dash": b"-@", "wide": bytes(range(128, 256)),
}
VOWELS = b"aeiouAEIOU"
FEATURES = (*(f"share_{c}" for c in CLASSES), "share_vowel", "byte_entropy", "log_words", "word_length", "longest_word",
            "distinct_words", "short_words", "long_words", "capital_words", "words_per_line", "repeated_lines",
            "words_per_stop", "stop_per_line")


@dataclass(frozen=True)
class GamOptions:
    """Most labelled rows fitted on; bins of a number and of each side of a
    pair; rounds, step and leaves of the boosting; pairs; least weight of a
    leaf; penalty of a leaf value; score from which a document is predicted good."""

    max_rows: int = 20_000
    bins: int = 32
    pair_bins: int = 8
    rounds: int = 150
    pair_rounds: int = 60
    step: float = 0.1
    leaves: int = 3
    pairs: int = 6
    least: float = 4.0
    penalty: float = 1.0
    threshold: float = 0.3


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text."""
    w = Words(texts)
    n = len(texts)
    offsets = w.offsets
    owner = np.repeat(np.arange(n), np.diff(offsets))
    hist = np.bincount(owner * 256 + w.data, minlength=n * 256).reshape(n, 256).astype(np.float64)
    total = np.maximum(hist.sum(axis=1), 1)
    share = {c: hist[:, list(members)].sum(axis=1) / total for c, members in CLASSES.items()}
    p = hist / total[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    words = w.counts().astype(np.float64)
    per_word = np.maximum(words, 1)
    length = (w.end - w.start).astype(np.float64)
    of = np.repeat(np.arange(n), w.counts())
    capital = (w.data[w.start] >= 65) & (w.data[w.start] <= 90) if len(w.start) else np.zeros(0, bool)
    sums = lambda x: np.bincount(of, weights=x.astype(np.float64), minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, of, length)
    distinct, repeated, lines = np.ones(n), np.zeros(n), np.ones(n)
    for t in range(n):
        mine = w.hashes[w.first[t]:w.first[t + 1]]
        if len(mine):
            distinct[t] = len(np.unique(mine)) / len(mine)
        full = [x for x in w.data[offsets[t]:offsets[t + 1]].tobytes().split(b"\n") if x.strip()]
        lines[t] = max(len(full), 1)
        repeated[t] = (len(full) - len(set(full))) / lines[t]
    stops = hist[:, ord(".")]
    columns = [*share.values(), hist[:, list(VOWELS)].sum(axis=1) / total, entropy, np.log1p(words),
               sums(length) / per_word, np.log1p(longest), distinct, sums(length <= 3) / per_word, sums(length >= 12) / per_word,
               sums(capital) / per_word, np.log1p(words / lines), repeated, np.log1p(words / (stops + 1)), stops / lines]
    return np.stack(columns, axis=1)


@dataclass(frozen=True)
class Gam:
    """edges[f]: bin borders of number f; tables[f]: additions of its bins;
    pairs: (f, g, borders of f, borders of g, additions)."""

    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for f, (edge, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table[np.searchsorted(edge, x[:, f], side="right")]
        for f, g, a, b, table in self.pairs:
            out += table[np.searchsorted(a, x[:, f], side="right"), np.searchsorted(b, x[:, g], side="right")]
        return _sigmoid(out)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def quantile_edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def tree_over_bins(grad: np.ndarray, weight: np.ndarray, opt: GamOptions) -> np.ndarray:
    """Leaf values, per bin, of a tree with up to ``leaves`` ranges of bins:
    the range whose split gains most is split, until none gains."""
    ranges = [(0, len(grad))]
    while len(ranges) < opt.leaves:
        best = (1e-9, None)
        for k, (a, b) in enumerate(ranges):
            g, h = np.cumsum(grad[a:b]), np.cumsum(weight[a:b])
            left_g, left_h, right_g, right_h = g[:-1], h[:-1], g[-1] - g[:-1], h[-1] - h[:-1]
            gain = left_g**2 / (left_h + opt.penalty) + right_g**2 / (right_h + opt.penalty) - g[-1]**2 / (h[-1] + opt.penalty)
            gain = np.where((left_h >= opt.least) & (right_h >= opt.least), gain, 0)
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), (k, a + int(gain.argmax()) + 1))
        if best[1] is None:
            break
        k, at = best[1]
        a, b = ranges[k]
        ranges[k:k + 1] = [(a, at), (at, b)]
    out = np.zeros(len(grad))
    for a, b in ranges:
        out[a:b] = grad[a:b].sum() / (weight[a:b].sum() + opt.penalty)
    return out


def tree_over_grid(grad: np.ndarray, weight: np.ndarray, opt: GamOptions) -> tuple[float, np.ndarray]:
    """Gain and leaf values, per cell, of the best cut into four quadrants."""
    g, h = (np.pad(m.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0))) for m in (grad, weight))
    best = (0.0, np.zeros_like(grad))
    rows, cols = np.arange(1, grad.shape[0])[:, None], np.arange(1, grad.shape[1])[None, :]
    if not rows.size or not cols.size:
        return best
    quads = []
    for m in (g, h):
        a = m[rows, cols]
        quads.append((a, m[rows, -1] - a, m[-1, cols] - a, m[-1, -1] - m[rows, -1] - m[-1, cols] + a))
    gain = sum(x**2 / (y + opt.penalty) for x, y in zip(*quads, strict=True)) - g[-1, -1]**2 / (h[-1, -1] + opt.penalty)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    values = [x[i, j] / (y[i, j] + opt.penalty) for x, y in zip(*quads, strict=True)]
    out = np.empty_like(grad)
    i, j = i + 1, j + 1
    out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = values
    return float(gain.max()), out


def fit(x: np.ndarray, y: np.ndarray, opt: GamOptions) -> Gam:
    """Main effects by cyclic boosting, then pairs on what is left."""
    if not len(y):
        return Gam(0.0, [np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1], [])
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(rate / (1 - rate)))
    total = np.full(len(y), bias)
    edges = [quantile_edges(x[:, f], opt.bins) for f in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    for _ in range(opt.rounds):
        for f, b in enumerate(bins):
            p = _sigmoid(total)
            size = len(tables[f])
            step = opt.step * tree_over_bins(np.bincount(b, y - p, size), np.bincount(b, p * (1 - p), size), opt)
            tables[f] += step
            total += step[b]
    coarse_edges = [quantile_edges(x[:, f], opt.pair_bins) for f in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse_edges)]

    def grids(f: int, g: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(coarse_edges[f]) + 1, len(coarse_edges[g]) + 1)
        cell, p = coarse[f] * shape[1] + coarse[g], _sigmoid(total)
        return tuple(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p)))

    ranked = sorted(((tree_over_grid(*grids(f, g), opt)[0], f, g) for f in range(len(bins)) for g in range(f)), reverse=True)
    chosen = {(f, g): np.zeros((len(coarse_edges[f]) + 1, len(coarse_edges[g]) + 1)) for _, f, g in ranked[:opt.pairs]}
    for _ in range(opt.pair_rounds):
        for (f, g), table in chosen.items():
            step = opt.step * tree_over_grid(*grids(f, g), opt)[1]
            table += step
            total += step[coarse[f], coarse[g]]
    return Gam(bias, edges, tables, [(f, g, coarse_edges[f], coarse_edges[g], t) for (f, g), t in chosen.items()])


def training_rows(docs: DataFrame, labels: DataFrame, opt: GamOptions) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``max_rows`` labelled documents outside
    the held-out fold, drawn by a hash of the key."""
    draw = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30))
    usable = labels.where(~held_out("doc_id") & F.col("quality").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), draw.alias("draw"))
    count = usable.count()
    chosen = usable.where(F.col("draw") < int(min(1.0, opt.max_rows / max(count, 1)) * (1 << 30))).limit(2 * opt.max_rows)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                x = text_features(part.column("text"))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("draw"), part.column("quality"), flat], names=["draw", "quality", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select(
        "text", "draw", "quality").transform(in_batches, run, "draw long, quality int, x array<double>").collect()
    rows = sorted(rows, key=lambda r: (r["draw"], r["quality"], r["x"]))[:opt.max_rows]
    return np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([float(r["quality"] == 1) for r in rows])


def score_quality(docs: DataFrame, labels: DataFrame, opt: GamOptions = GamOptions()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    gam = fit(*training_rows(docs, labels, opt), opt)
    shipped = docs.sparkSession.sparkContext.broadcast((gam.bias, gam.edges, gam.tables, gam.pairs))
    threshold = opt.threshold

    def run(batches):
        model = Gam(*shipped.value)
        for batch in batches:
            for part in slices(batch, "text"):
                score = model.score(text_features(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), "text").transform(in_batches,
        run, "doc_id long, held_out boolean, score double, predicted int")
