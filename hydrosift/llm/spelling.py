"""Spelling variants: words one edit apart, found through a reduced alphabet.

Every letter is hashed to one of a few symbols, so the vocabulary shrinks to far
fewer reduced words and a word's one-edit neighbourhood to a few dozen.  Steps:

1. Words are counted per batch in the tasks, then summed.
2. Each distinct reduced word generates its full one-edit neighbourhood (itself,
   every symbol replaced, dropped, inserted) and joins it to the reduced
   vocabulary.  What is found says at which places an edit can lead to a word.
3. Only at those places a word makes keys: itself without the letter there (with
   the place, for a replacement; bare, to meet the shorter word).  Words of equal
   keys agree everywhere else, so a key is shared by at most an alphabet of words
   and a crowded reduced word never forms pairs of all its members.
4. Each pair is verified on the original strings.
5. A word's form is its most frequent near word, if frequent enough; forms are
   followed to their end by doubling (counts at least double at each step, so the
   rounds grow with the logarithm of the logarithm of the largest count).

Reduced words and keys are 64-bit hashes taken from running sums, so a word of a
million letters costs rows in proportion to its length; equal hashes of different
strings only add candidates, which step 4 drops.

Defined results for odd input: a NULL or empty text has no words; a NULL doc_id
is an empty id in the damage rule; rows that repeat a doc_id count each; ties
between forms go to the first in code-point order; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, stage
from .words import _BASE, _BASE_INV, U, mix, powers

RUN = re.compile("[a-zÀ-ÿ]+")
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SAME, SWAP, DROP, ADD = range(4)
_CELLS = 1 << 16


@dataclass(frozen=True)
class Spelling:
    """Shortest word and smallest count of the vocabulary, symbols of the reduced
    alphabet, how many times more frequent a form must be, and the damage rule: 0
    for none, else one letter goes from the runs whose hash it divides."""

    min_chars: int = 5
    min_count: int = 3
    symbols: int = 4
    form_ratio: int = 2
    damage: int = 0


def add_runs(counts: dict[str, int], doc_id, text: str, opt: Spelling) -> None:
    """Add the words of one text to ``counts``."""
    lowered = text.encode().translate(FOLD).decode()
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, times in Counter(RUN.findall(lowered)).items():
        if len(run) < opt.min_chars:
            continue
        if opt.damage:
            h = zlib.crc32(run.encode(), prefix)
            if h % opt.damage == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
                if len(run) < opt.min_chars:
                    continue
        counts[run] = counts.get(run, 0) + times


def count_words(docs: DataFrame, opt: Spelling = Spelling(), held_words: int = 200_000) -> DataFrame:
    """(word, n) of the vocabulary; a task holds ``held_words`` counts, then emits them."""

    def run(batches):
        counts: dict[str, int] = {}

        def emit():
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()),
                                              "n": pa.array(list(counts.values()), pa.int64())})
            counts.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    add_runs(counts, doc_id, text, opt)
                    if len(counts) >= held_words:
                        yield emit()
        yield emit()

    parts = in_batches(docs.select("doc_id", "text"), run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= opt.min_count)


class Codes:
    """Hashes of sequences of one length (rows of ``symbols``) and of their
    neighbours by one edit at the places a to b - 1."""

    def __init__(self, symbols: np.ndarray):
        self.symbols = symbols.astype(U)
        m, self.length = symbols.shape
        self.power = powers(_BASE, self.length + 1)
        self.before = np.zeros((m, self.length + 1), U)
        np.cumsum(self.symbols * self.power[:-1], axis=1, out=self.before[:, 1:])
        self.total = self.before[:, -1:]

    def _code(self, sums: np.ndarray, length: int) -> np.ndarray:
        return mix(sums + U(length * 0x2545F4914F6CDD1D % (1 << 64)))

    def whole(self) -> np.ndarray:
        return self._code(self.total, self.length)

    def swapped(self, a: int, b: int, symbol: int) -> np.ndarray:
        return self._code(self.total + (U(symbol) - self.symbols[:, a:b]) * self.power[a:b], self.length)

    def dropped(self, a: int, b: int) -> np.ndarray:
        after = (self.total - self.before[:, a + 1:b + 1]) * U(_BASE_INV)
        return self._code(self.before[:, a:b] + after, self.length - 1)

    def added(self, a: int, b: int, symbol: int) -> np.ndarray:
        after = (self.total - self.before[:, a:b]) * U(_BASE)
        return self._code(self.before[:, a:b] + U(symbol) * self.power[a:b] + after, self.length + 1)

    def masked(self, a: int, b: int) -> np.ndarray:
        """Equal for two sequences that agree everywhere but at the same place."""
        place = mix(np.arange(a, b, dtype=U) + U(1))
        return mix(self.swapped(a, b, 0) ^ place)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in ``words``, matrix of their code points), blocks of one length."""
    lengths = np.array([len(w) for w in words], np.int64)
    for n in np.unique(lengths):
        where, step = np.flatnonzero(lengths == n), max(1, _CELLS // max(1, int(n)))
        for lo in range(0, len(where), step):
            rows = where[lo:lo + step]
            points = np.frombuffer("".join(words[k] for k in rows).encode("utf-32-le"), np.uint32)
            yield rows, points.reshape(len(rows), int(n))


def blocks(n: int, rows: int) -> Iterator[tuple[int, int]]:
    step = max(1, _CELLS // rows)
    return ((a, min(a + step, n)) for a in range(0, n, step))


def reduce_points(points: np.ndarray, symbols: int) -> np.ndarray:
    return points % symbols + 1


def neighbourhood(points: np.ndarray, symbols: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(kind, first place, end, hashes) of all one-edit neighbours of reduced words."""
    reduced = reduce_points(points, symbols)
    codes = Codes(reduced)
    m, n = reduced.shape
    for a, b in blocks(n, m):
        yield DROP, a, b, codes.dropped(a, b)
        for s in range(1, symbols + 1):
            yield SWAP, a, b, np.where(reduced[:, a:b] == s, U(0), codes.swapped(a, b, s))
    for a, b in blocks(n + 1, m):
        for s in range(1, symbols + 1):
            yield ADD, a, b, codes.added(a, b, s)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def reduced_words(words: DataFrame, opt: Spelling) -> DataFrame:
    """``words`` with ``code``, the reduced word's hash, and ``whole``, its own."""
    symbols = opt.symbols

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            code, whole = np.zeros(len(texts), U), np.zeros(len(texts), U)
            for rows, points in by_length(texts):
                code[rows] = Codes(reduce_points(points, symbols)).whole()[:, 0]
                whole[rows] = Codes(points).whole()[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, _signed(code), _signed(whole)], names=["word", "n", "code", "whole"])

    return in_batches(words.select("word", "n"), run, "word string, n long, code long, whole long")


def edit_places(vocabulary: DataFrame, opt: Spelling) -> DataFrame:
    """Per reduced word: whether it has several words (``crowded``), the places
    where a replaced (``swaps``) or dropped (``drops``) symbol leads to a reduced
    word, and whether an added one does (``adds``)."""
    symbols = opt.symbols

    def run(batches):
        for batch in batches:
            code = batch.column(0).to_numpy()
            for rows, points in by_length(batch.column(1).to_pylist()):
                for kind, a, b, near in neighbourhood(points, symbols):
                    flat = near.ravel()
                    keep = flat != 0 if kind == SWAP else np.ones(len(flat), bool)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(code[rows], b - a)[keep]), pa.array(np.full(int(keep.sum()), kind, np.int8)),
                         pa.array(np.tile(np.arange(a, b, dtype=np.int32), len(rows))[keep]), _signed(flat[keep])],
                        names=["code", "kind", "place", "near"])

    reduced = stage(vocabulary.groupBy("code").agg(F.min("word").alias("sample"), F.count(F.lit(1)).alias("size")), "spelling-reduced")
    around = in_batches(reduced.select("code", "sample"), run, "code long, kind byte, place int, near long")
    found = around.join(reduced.select(F.col("code").alias("near")), "near", "left_semi")
    places = found.groupBy("code").agg(
        F.collect_set(F.when(F.col("kind") == SWAP, F.col("place"))).alias("swaps"),
        F.collect_set(F.when(F.col("kind") == DROP, F.col("place"))).alias("drops"),
        F.max(F.col("kind") == ADD).alias("adds"))
    return reduced.select("code", (F.col("size") > 1).alias("crowded")).join(places, "code", "left")


def edit_keys(placed: DataFrame) -> DataFrame:
    """(kind, key, place, whole) of every word: SWAP keys meet each other, a DROP
    key meets the SAME key of the word that is one letter shorter.  In a run of
    equal letters only the last is dropped."""

    def run(batches):
        for batch in batches:
            column = {n: batch.column(n).to_pylist() for n in ("word", "whole", "crowded", "swaps", "drops", "adds")}
            whole = np.array(column["whole"], np.int64)
            for rows, points in by_length(column["word"]):
                codes, (m, n) = Codes(points), points.shape
                mine = rows[[bool(column["adds"][k]) for k in rows]]
                parts = [(SAME, mine, np.zeros(len(mine), np.int32), whole[mine])]
                ends_run = np.ones((m, n), bool)
                ends_run[:, :-1] = points[:, :-1] != points[:, 1:]
                for a, b in blocks(n, m):
                    for kind, name, keys in ((SWAP, "swaps", codes.masked), (DROP, "drops", codes.dropped)):
                        chosen = np.zeros((m, b - a), bool)
                        for k, row in enumerate(rows):
                            if kind == SWAP and column["crowded"][row]:
                                chosen[k] = True
                            elif column[name][row]:
                                at = np.array(column[name][row])
                                chosen[k, at[(at >= a) & (at < b)] - a] = True
                        k, at = np.nonzero(chosen & ends_run[:, a:b] if kind == DROP else chosen)
                        parts.append((kind, rows[k], (at + a).astype(np.int32), keys(a, b)[k, at].view(np.int64)))
                for kind, owners, place, key in parts:
                    if len(owners):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(owners), kind, np.int8)), pa.array(key), pa.array(place), pa.array(whole[owners])],
                            names=["kind", "key", "place", "whole"])

    names = ["word", "whole", "crowded", "swaps", "drops", "adds"]
    return in_batches(placed.select(*names), run, "kind byte, key long, place int, whole long")


def near_words(vocabulary: DataFrame, opt: Spelling = Spelling()) -> DataFrame:
    """(word, near, near_n): every pair of words one edit apart, in both directions."""
    placed = vocabulary.join(edit_places(vocabulary, opt), "code")
    keys = stage(edit_keys(placed), "spelling-keys")
    of = lambda kind, name, *more: keys.where(F.col("kind") == kind).select("key", F.col("whole").alias(name), *more)
    swaps = of(SWAP, "a", "place").join(of(SWAP, "b", "place"), ["key", "place"]).where("a <> b").select("a", "b", "place")
    drops = of(DROP, "a", "place").join(of(SAME, "b"), "key").select("a", "b", "place")
    side = lambda key, word, n: vocabulary.select(F.col("whole").alias(key), F.col("word").alias(word), F.col("n").alias(n))
    strings = lambda pairs: pairs.join(side("a", "x", "x_n"), "a").join(side("b", "y", "y_n"), "b")
    rest = "concat(substring({0}, 1, place), substring({0}, place + 2))".format
    swapped = strings(swaps).where(f"x <> y and {rest('x')} = {rest('y')}").selectExpr("x as word", "y as near", "y_n as near_n")
    dropped = stage(strings(drops).where(f"{rest('x')} = y").select("x", "x_n", "y", "y_n"), "spelling-drops")
    return swapped.union(dropped.select("x", "y", "y_n")).union(dropped.select("y", "x", "x_n")).distinct()


def variant_groups(words: DataFrame, opt: Spelling = Spelling()) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``words(word, n)``."""
    vocabulary = stage(reduced_words(words, opt), "spelling-words")
    best = near_words(vocabulary, opt).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    judged = vocabulary.select("word", "n").join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.less") >= opt.form_ratio * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("n"))).alias("f"))
    judged = stage(judged.select("word", "n", "n_near", F.col("f.form").alias("form"), F.col("f.n").alias("form_n")), "spelling-forms")
    roots = judged.where("form is not null").select("word", F.col("form").alias("root"))
    top = judged.agg(F.max("form_n")).first()[0] or 1
    for _ in range(max(1, math.ceil(math.log(top, opt.form_ratio))).bit_length()):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        roots = stage(roots.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")), "spelling-roots")
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
