"""Language identification with a string kernel.

Texts are compared by the blended-spectrum presence kernel: the number of
distinct character n-grams (1 to 3 characters, lower case) that two texts
share, divided by the root of the product of their numbers of n-grams.  A
bounded sample of landmark texts spans the kernel's feature space (Nyström);
ridge regressions, one per language against the rest, are fitted there.  Every
language value with a training row is learned.  The rows of the sample are made
in tasks; the driver sums them up in blocks of languages.

N-grams are hashed to a fixed number of columns, so a text is a 0/1 row and the
kernel against the landmarks is a matrix product.  Scoring a batch is rows x
landmark matrix x weights; as the product is associative the last two factors
are multiplied once.

Defined results for odd input: a NULL text, or one without a letter, gets the
language ``und`` and score 0; a text of any length is read whole in parts; an
empty table, or one without training rows, gives ``und`` for all; rows with a
NULL label are never trained on; repeated rows get a row each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, in_batches, stage
from .words import slices

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class KernelOptions:
    """Longest n-gram, hashed columns, training texts per language (the bound
    of the fitted sample), landmarks per language and altogether (but one
    of each language at least), sampled rows on the driver at once, label counts that may be
    broadcast, ridge penalty, rows of a batch and characters read at once."""

    n: int = 3
    columns: int = 1 << 14
    train_per_label: int = 400
    landmarks_per_label: int = 40
    landmarks: int = 1000
    block_rows: int = 40_000
    broadcast_rows: int = 1_000_000
    ridge: float = 1e-3
    rows: int = 128
    chunk: int = 1 << 20


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    weights: np.ndarray  # columns x labels: landmark matrix x Nyström map x ridge weights
    head: np.ndarray | None  # the ridge weights, kept apart where labels outnumber features
    bias: np.ndarray
    sharpness: float


def presence(texts: list[str], opt: KernelOptions) -> np.ndarray:
    """0/1 rows: which hashed n-grams (1 to n characters) each text holds."""
    out = np.zeros((len(texts), opt.columns), np.uint8)
    for row, text in zip(out, texts, strict=True):
        for at in range(0, max(len(text), 1), opt.chunk):
            part = text[at:at + opt.chunk + opt.n - 1].lower()
            codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            gram = np.zeros(len(codes), np.uint64)
            for k in range(min(opt.n, len(codes))):
                gram = (gram[:len(codes) - k] * np.uint64(0x100000001B3)) ^ codes[k:]
                mixed = gram * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
                row[(mixed >> np.uint64(40)) % np.uint64(opt.columns)] = 1
    return out


def normalized(rows: np.ndarray) -> np.ndarray:
    """Rows of unit length, so that products are kernel values."""
    x = rows.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def unpacked(bits: np.ndarray, opt: KernelOptions) -> np.ndarray:
    """Rows of unit length from packed presence rows."""
    return normalized(np.unpackbits(bits, axis=1, count=opt.columns))


def fit(names: tuple[str, ...], blocks, opt: KernelOptions) -> Model:
    """``blocks()`` yields (label numbers, packed presence rows), each label in
    one block and in a random (hashed) order.  Landmarks are the first rows of
    each label; the ridge needs sums over the rows only."""
    each = min(opt.landmarks_per_label, max(1, opt.landmarks // len(names)))
    marks = unpacked(np.concatenate([
        bits[np.sort(np.concatenate([np.flatnonzero(index == k)[:each] for k in np.unique(index)]))]
        for index, bits in blocks()]), opt)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    nystrom = vectors[:, good] / np.sqrt(values[good])
    size = nystrom.shape[1]
    gram, sums, rows = np.zeros((size, size)), np.zeros((len(names), size)), np.zeros(len(names))
    for index, bits in blocks():
        for a in range(0, len(index), 512):
            features = (unpacked(bits[a:a + 512], opt) @ marks.T).astype(np.float64) @ nystrom
            gram += features.T @ features
            np.add.at(sums, index[a:a + 512], features)
            np.add.at(rows, index[a:a + 512], 1)
    total = rows.sum()
    mean = sums.sum(axis=0) / total
    # targets are 1 for a label's rows and -1 for the others; features are centred
    cross = 2 * (sums - rows[:, None] * mean).T
    ridge = np.linalg.solve(gram - total * np.outer(mean, mean) + opt.ridge * total * np.eye(size), cross)
    bias = (2 * rows / total - 1 - mean @ ridge).astype(np.float32)
    if len(names) > size:
        return Model(names, (marks.T.astype(np.float64) @ nystrom).astype(np.float32), ridge.astype(np.float32), bias, 4.0)
    return Model(names, (marks.T.astype(np.float64) @ (nystrom @ ridge)).astype(np.float32), None, bias, 4.0)


def score(model: Model, texts: list[str], opt: KernelOptions) -> tuple[list[str], np.ndarray]:
    raw = normalized(presence(texts, opt)) @ model.weights
    raw = (raw if model.head is None else raw @ model.head) + model.bias
    odds = np.exp(model.sharpness * (raw - raw.max(axis=1, keepdims=True)).astype(np.float64))
    best = raw.argmax(axis=1)
    return [model.labels[k] for k in best], odds.max(axis=1) / odds.sum(axis=1)


def training_sample(docs: DataFrame, opt: KernelOptions) -> tuple[dict[str, int], DataFrame]:
    """Rows of each label outside the held-out fold, and (lang, draw, bits): the
    packed presence rows of about 1.5 x ``train_per_label`` of them.

    Labels are counted first; a label's share of its rows is then drawn by
    comparing the hash with a threshold, so both passes are plain scans."""
    usable = docs.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        "text", "lang", F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1 << 30)).alias("draw"))
    counted = stage(usable.groupBy("lang").count(), "language-labels")
    counts = {r["lang"]: r["count"] for r in counted.collect()}
    if len(counts) <= opt.broadcast_rows:
        counted = F.broadcast(counted)
    drawn = usable.join(counted, "lang").where(F.col("draw") < F.lit(1.5 * opt.train_per_label * (1 << 30)) / F.col("count"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                bits = [row.tobytes() for a in range(0, len(texts), opt.rows)
                        for row in np.packbits(presence(texts[a:a + opt.rows], opt), axis=1)]
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("draw"), pa.array(bits, pa.binary())],
                                                 names=["lang", "draw", "bits"])

    rows = drawn.select("text", "lang", "draw").transform(in_batches, run, "lang string, draw long, bits binary")
    return counts, stage(rows, "language-sample")


def label_blocks(counts: dict[str, int], sample: DataFrame, opt: KernelOptions):
    """The sample in blocks of labels, at most ``train_per_label`` rows of each
    and about ``block_rows`` together; a single block is read once."""
    names = tuple(sorted(counts))
    groups, size = [[]], 0
    for k, name in enumerate(names):
        n = min(counts[name], 2 * opt.train_per_label)
        if groups[-1] and size + n > opt.block_rows:
            groups.append([])
            size = 0
        groups[-1].append(k)
        size += n

    def read(group):
        wanted = F.col("lang").between(names[group[0]], names[group[-1]]) if len(groups) > 1 else F.lit(True)
        number = {names[k]: k for k in group}
        rows = sorted((r["draw"], r["lang"], bytes(r["bits"])) for r in sample.where(wanted).collect())
        taken, index, bits = dict.fromkeys(number, 0), [], []
        for _, lang, row in rows:
            taken[lang] += 1
            if taken[lang] <= opt.train_per_label:
                index.append(number[lang])
                bits.append(np.frombuffer(row, np.uint8))
        return np.array(index, np.int64), np.array(bits, np.uint8).reshape(len(bits), -(-opt.columns // 8))

    kept = [read(groups[0])] if len(groups) == 1 else None
    return names, lambda: kept or (read(g) for g in groups)


def identify(docs: DataFrame, opt: KernelOptions = KernelOptions()) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    counts, sample = training_sample(docs, opt)
    fitted = fit(*label_blocks(counts, sample, opt), opt) if counts else None
    shipped = docs.sparkSession.sparkContext.broadcast(
        fitted and (fitted.labels, fitted.weights, fitted.head, fitted.bias, fitted.sharpness))

    def run(batches):
        model = Model(*shipped.value) if shipped.value else None
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                lang, points = [UNKNOWN] * len(texts), np.zeros(len(texts))
                known = [i for i, t in enumerate(texts) if LETTER.search(t)] if model else []
                for a in range(0, len(known), opt.rows):
                    rows = known[a:a + opt.rows]
                    found, sure = score(model, [texts[i] for i in rows], opt)
                    for i, name, p in zip(rows, found, sure, strict=True):
                        lang[i], points[i] = name, p
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()),
                                                  pa.array(points)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), "text").transform(in_batches,
        run, "doc_id long, held_out boolean, lang_pred string, score double")
