"""Ranked search: the best documents for each item of a query set.

Documents stay where they are: a task reads a share of them, indexes it and ranks
it for all items; only each share's best documents are shuffled.  Steps:

1. The items' terms (64-bit hashes) are counted per item.  Items go in blocks of a
   bounded number of terms, one block for query sets of usual size.
2. One pass over the texts writes each document's length and the block's terms in
   it; numbers of documents and terms and document frequencies are sums over that.
3. A task gathers documents into shards of a bounded number of postings, sorted by
   doc_id, with postings per term and their largest gain per window of documents.
   For an item, its short lists are summed term at a time into accumulators, which
   then act as one more list, bounded by its own largest sums.  Document at a time,
   window by window: a window whose summed bounds cannot beat the k-th best score
   is skipped; otherwise the lists that together cannot beat it are only looked up
   for the documents that the others bring up.
4. The best documents of the shares are ranked in two steps, so that no task holds
   an item's rows of all shares.

All scores are integers, so no order of summing changes them.  A later document
of equal score never replaces an earlier one (smaller doc_id), so bounds equal to
the k-th best score can be skipped too.

Defined results for odd input: NULL or empty texts have no terms and no rank; each
row of the items is ranked for itself and each row of the documents is a document,
also where they share an id; a NULL doc_id comes after all others; an empty table
of items or documents gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_batches, stage
from .words import U, Words, slices

#: All of ASCII but digits and letters.
DELIMITERS = bytes(b for b in range(128) if not chr(b).isalnum())


@dataclass(frozen=True)
class Ranking:
    """Documents to return, longest list that is summed term at a time, documents
    in a window, postings in a shard, and terms in a block of items."""

    top: int = 20
    short_list: int = 200
    window: int = 1024
    shard_postings: int = 1_000_000
    block_terms: int = 500_000


def item_terms(items: DataFrame) -> DataFrame:
    """(item, term, times) of every row of the items; ``item`` numbers the rows."""

    def run(batches):
        for batch in batches:
            w = Words(batch.column(1), lower=True, delimiters=DELIMITERS)
            item = np.repeat(batch.column(0).to_numpy(), w.counts())
            order = np.lexsort((w.hashes, item))
            item, term = item[order], w.hashes[order]
            new = np.ones(len(item), bool)
            new[1:] = (item[1:] != item[:-1]) | (term[1:] != term[:-1])
            first = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item[first]), pa.array(term[first].view(np.int64)), pa.array(np.diff([*first, len(item)]).astype(np.int64))],
                names=["item", "term", "times"])

    return in_batches(items.select("item", "text"), run, "item long, term long, times long")


def term_postings(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: its number of terms
    and, for those in the sorted ``vocabulary``, their places there and counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                w = Words(batch.column(1), lower=True, delimiters=DELIMITERS)
                n, at = w.counts(), np.searchsorted(known, w.hashes)
                at[at == len(known)] = 0
                held = known[at] == w.hashes if len(known) else np.zeros(len(at), bool)
                cell, tf = np.unique(np.repeat(np.arange(len(n)), n)[held] * len(known) + at[held], return_counts=True)
                doc = cell // max(1, len(known))
                rows = np.flatnonzero(n)
                ends = pa.array(np.append(np.searchsorted(doc, rows), len(doc)).astype(np.int32))
                lists = (pa.ListArray.from_arrays(ends, pa.array(v.astype(t)))
                         for v, t in ((cell - doc * max(1, len(known)), np.int32), (tf, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(n[rows].astype(np.int64)), *lists],
                                                 names=["doc_id", "n", "terms", "tfs"])

    return in_batches(docs.select("doc_id", "text"), run, "doc_id long, n long, terms array<int>, tfs array<long>")


def gains(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What each posting adds to a score, in whole numbers."""
    if len(n) and 25 * int(n.max()) * documents >= 1 << 63:  # beyond 64 bits: exact whole numbers of Python
        m = np.array([75 + 25 * int(x) * documents // length for x in n], np.int64)
    else:
        m = 75 + 25 * n * documents // max(1, length)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class Shard:
    """Postings of some documents, by term and document (numbered by doc_id)."""

    def __init__(self, doc_ids: pa.Array, counts: np.ndarray, terms: np.ndarray, gain: np.ndarray, window: int):
        ids = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
        order = np.lexsort((ids, doc_ids.is_null().to_numpy(zero_copy_only=False)))
        self.doc_ids, self.window, self.size = doc_ids.take(pa.array(order)), window, len(order)
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        doc = np.repeat(number, counts)
        by_term = np.lexsort((doc, terms))
        self.doc, self.gain = doc[by_term], gain[by_term]
        self.terms, first = np.unique(terms[by_term], return_index=True)
        self.windows = -(-self.size // window)
        cell = np.repeat(np.arange(len(self.terms)), np.diff([*first, len(doc)])) * self.windows + self.doc // window
        #: postings of term t in window w: start[t * windows + w] to the next one's start
        self.start = np.searchsorted(cell, np.arange(len(self.terms) * self.windows + 1))
        self.peak = np.zeros(len(self.start) - 1, np.int64)
        filled = np.flatnonzero(np.diff(self.start))
        if len(filled):
            self.peak[filled] = np.maximum.reduceat(self.gain, self.start[filled])

    def _list(self, t: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(documents, gains, starts of the windows, bounds of the windows)."""
        start = self.start[t * self.windows:(t + 1) * self.windows + 1]
        a, b = start[0], start[-1]
        return (self.doc[a:b], self.gain[a:b] * times, start - a, self.peak[t * self.windows:(t + 1) * self.windows] * times)

    def _accumulators(self, lists: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Short lists summed term at a time, in the form of one list."""
        doc, at = np.unique(np.concatenate([x[0] for x in lists]), return_inverse=True)
        total = np.zeros(len(doc), np.int64)
        np.add.at(total, at, np.concatenate([x[1] for x in lists]))
        start = np.searchsorted(doc, np.arange(self.windows + 1) * self.window)
        bound = np.zeros(self.windows, np.int64)
        filled = np.flatnonzero(np.diff(start))
        if len(filled):
            bound[filled] = np.maximum.reduceat(total, start[filled])
        return doc, total, start, bound

    def best(self, terms: np.ndarray, times: np.ndarray, top: int, short_list: int, skipped: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the ``top`` best with a score above 0.
        ``skipped`` receives the number of windows passed over."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        lists = [self._list(int(t), int(k)) for t, k, ok in zip(at, times, self.terms[at] == terms, strict=True) if ok] if len(self.terms) else []
        short = [x for x in lists if len(x[0]) <= short_list]
        lists = [x for x in lists if len(x[0]) > short_list] + ([self._accumulators(short)] if short else [])
        docs, scores, floor = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        if not lists:
            return docs, scores
        bounds = np.stack([x[3] for x in lists])
        summed = bounds.sum(axis=0)
        for w in range(self.windows):
            if summed[w] <= floor:
                if skipped is not None:
                    skipped.append(w)
                continue
            order = np.argsort(bounds[:, w], kind="stable")
            reach = np.cumsum(bounds[order, w])
            optional = int(np.searchsorted(reach, floor, side="right"))  # these lists alone cannot beat the floor
            low, partial = w * self.window, np.zeros(self.window, np.int64)
            part = lambda x: slice(x[2][w], x[2][w + 1])
            for k in order[optional:]:
                here = part(lists[k])
                partial[lists[k][0][here] - low] += lists[k][1][here]
            rest = int(reach[optional - 1]) if optional else 0
            found = np.flatnonzero((partial > 0) & (partial + rest > floor))
            total = partial[found]
            for k in order[:optional][::-1]:
                here = part(lists[k])
                held, gain = lists[k][0][here], lists[k][1][here]
                if len(held):
                    place = np.minimum(np.searchsorted(held, found + low), len(held) - 1)
                    total = total + np.where(held[place] == found + low, gain[place], 0)
            better = total > floor
            docs, scores = np.append(docs, found[better] + low), np.append(scores, total[better])
            if len(docs) > top:
                chosen = np.lexsort((docs, -scores))[:top]
                docs, scores = docs[chosen], scores[chosen]
            if len(docs) == top:
                floor = max(floor, int(scores.min()))
        return docs, scores


def _flat(column: list[pa.Array]) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column])


def rank_shares(postings: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray,
                documents: int, length: int, opt: Ranking) -> DataFrame:
    """(item, doc_id, score) of the best documents of every shard."""
    shared = postings.sparkSession.sparkContext.broadcast((items, weights))
    top, short, window, bound = opt.top, opt.short_list, opt.window, opt.shard_postings

    def ranked(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weight = shared.value
        doc_ids = pa.chunked_array([b.column(0) for b in held]).combine_chunks()
        n = np.concatenate([b.column(1).to_numpy() for b in held])
        counts = np.concatenate([b.column(2).value_lengths().to_numpy(zero_copy_only=False) for b in held])
        terms, tf = _flat([b.column(2) for b in held]), _flat([b.column(3) for b in held])
        shard = Shard(doc_ids, counts, terms, gains(tf, np.repeat(n, counts), weight[terms], documents, length), window)
        for item, item_term, times in wanted:
            docs, scores = shard.best(item_term, times, top, short)
            if len(docs):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), item)), shard.doc_ids.take(pa.array(docs)), pa.array(scores)],
                                                 names=["item", "doc_id", "score"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column(2).flatten()) + batch.num_rows
            if size >= bound:
                yield from ranked(held)
                held, size = [], 0
        if held:
            yield from ranked(held)

    return in_batches(postings, run, "item long, doc_id long, score long")


def best_of(rows: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each item with their rank; each item is ranked in
    buckets first, as many as keep both steps about equally large."""
    largest = rows.groupBy("item").count().agg(F.max("count")).first()[0] or 0
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    buckets = max(1, math.isqrt(largest // top))
    if buckets > 1:
        rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(buckets)))
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = rows.select("item", "doc_id", "score", F.row_number().over(Window.partitionBy("item").orderBy(*order)).alias("rank"))
    return ranked.where(F.col("rank") <= top)


def rank_documents(docs: DataFrame, items: DataFrame, opt: Ranking = Ranking()) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents for every row of ``items``."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    numbered = stage(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "search-items")
    wanted = stage(item_terms(numbered), "search-terms")
    blocks = max(1, -(-wanted.count() // opt.block_terms))
    documents = length = None
    results = []
    for block in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toArrow()
        if not part.num_rows:
            continue
        item, term, times = (part.column(c).to_numpy() for c in ("item", "term", "times"))
        vocabulary = np.unique(term.view(U))
        postings = stage(term_postings(docs, vocabulary), "search-postings")
        if documents is None:  # the same in every block
            documents, length = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
        df = np.zeros(len(vocabulary), np.int64)
        for r in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most a block's terms
            df[r["term"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        place, order = np.searchsorted(vocabulary, term.view(U)), np.argsort(item, kind="stable")
        ids, first = np.unique(item[order], return_index=True)
        listed = [(int(i), place[order[a:b]], times[order[a:b]]) for i, a, b in zip(ids, first, [*first[1:], len(order)], strict=True)]
        shares = stage(rank_shares(postings, listed, weights, documents, length or 0, opt), "search-shares")
        results.append(best_of(shares, opt.top))
    if not results:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    found = results[0]
    for more in results[1:]:
        found = found.union(more)
    return found.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
