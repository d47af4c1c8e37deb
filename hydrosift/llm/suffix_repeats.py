"""Exact removal of long passages repeated across documents, by suffix trees
over prefix partitions.

A window is 50 words.  A word goes when some window covering it also starts in
a document with a smaller doc_id.

1. Documents with the same words are one class; only the smallest doc_id of a
   class goes on, its copies lose every word (or none, when under 50).
2. Of each window the smallest 26-word gram is its seed (equal windows have
   equal seeds, and neighbouring windows mostly share one).  Only windows whose
   seed occurs in two classes can repeat; the others are left out.
3. A remaining window is a suffix, read as symbols of 10, 15 and 25 words.
   Suffixes are dealt to groups by a prefix: one symbol, or two, or three where
   the measured size of the group of a shorter prefix is beyond ``group_rows``.
4. A group's suffixes, sorted by their symbols, and the symbols that each shares
   with the one before it are its subtree: suffixes that share all symbols lie
   below one internal node of depth 50.  Every suffix below a node but those of
   its smallest doc_id marks a window to remove.  Suffixes whose whole prefix
   is still too frequent are not gathered; their smallest doc_id is aggregated
   and joined back.
5. ``maximal_repeats`` goes on below depth 50: nodes at 50, 100, 200 ... words
   are aggregated by hash, those whose suffixes follow different words are kept,
   and their suffixes, sorted word by word up to the next of these depths, give
   the internal nodes between: the maximal repeats, with exact lengths.

Windows are compared by three 64-bit hashes (10, 15 and 25 words).

Defined results for odd input: a NULL, empty or blank text has no words; a
document with under 50 words loses none; rows with one doc_id never count against
each other and each loses its own words (a row is known by doc_id and a hash of
its text); rows with a NULL doc_id keep all words and are never the smaller
document; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, stage
from .words import Words, mix, slices


@dataclass(frozen=True)
class RepeatOptions:
    """Words of a window and of a seed gram, words of each symbol of a suffix,
    suffixes up to which a prefix is one group, and rows that may be broadcast."""

    window: int = 50
    seed: int = 26
    symbols: tuple[int, int, int] = (10, 15, 25)
    group_rows: int = 50_000
    broadcast_ids: int = 2_000_000


KEY = ["doc_id", "row"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def word_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and the SHA-256 of the words joined by one space."""

    def run(batches):
        for batch in batches:
            n, sha = [], []
            for text in batch.column("text").to_pylist():
                words = (text or "").encode().split()
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(n, pa.int64()), pa.array(sha, pa.string())],
                names=["doc_id", "row", "n_words", "sha"])

    return docs.select("doc_id", "row", "text").transform(in_batches, run, "doc_id long, row long, n_words long, sha string")


def _seeds(words: Words, t: int, grams: np.ndarray, opt: RepeatOptions) -> np.ndarray:
    """For each window of text t, the position (in the text) of its seed."""
    a, b = words.first[t], words.first[t + 1]
    if b - a < opt.window:
        return np.zeros(0, np.int64)
    own = grams[a:b - opt.seed + 1]
    width = opt.window - opt.seed + 1
    out = np.empty(len(own) - width + 1, np.int64)
    for lo in range(0, len(out), 1 << 18):
        part = own[lo:lo + (1 << 18) + width - 1]
        view = np.lib.stride_tricks.sliding_window_view(part, width)
        out[lo:lo + len(view)] = view.argmin(axis=1) + np.arange(lo, lo + len(view))
    return out


def seed_postings(docs: DataFrame, opt: RepeatOptions) -> DataFrame:
    """(gram, doc_id, row, pos) of every seed of every document."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                grams = words.windows(opt.seed)
                gram, pos, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
                for t in range(part.num_rows):
                    at = np.unique(_seeds(words, t, grams, opt))
                    gram.append(grams[words.first[t] + at])
                    pos.append(at)
                    n.append(len(at))
                ids, rows = (part.column(c).to_numpy(zero_copy_only=False) for c in KEY)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(gram).view(np.int64)), pa.array(np.repeat(ids, n).astype(np.int64)),
                     pa.array(np.repeat(rows, n).astype(np.int64)), pa.array(np.concatenate(pos).astype(np.int32))],
                    names=["gram", *KEY, "pos"])

    return docs.select(*KEY, "text").transform(in_batches, run, "gram long, doc_id long, row long, pos int")


def suffixes(docs: DataFrame, opt: RepeatOptions) -> DataFrame:
    """(p1, p2, p3, doc_id, row, pos) of the windows with a repeated seed;
    ``docs`` carries ``seeds``: the positions of the document's repeated seeds."""
    ends = np.cumsum([0, *opt.symbols])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                grams = words.windows(opt.seed)
                symbols = [words.windows(k) for k in opt.symbols]
                ids, rows = (part.column(c).to_numpy(zero_copy_only=False) for c in KEY)
                lists = part.column("seeds")
                at = np.asarray(lists.offsets)
                seed_pos = np.asarray(lists.values)
                out = [[np.zeros(0, np.uint64)] for _ in symbols] + [[np.zeros(0, np.int64)] for _ in range(3)]
                for t in range(part.num_rows):
                    of = _seeds(words, t, grams, opt)
                    repeated = np.zeros(int(words.first[t + 1] - words.first[t]) + 1, bool)
                    mine = seed_pos[at[t]:at[t + 1]]
                    repeated[mine[mine < len(repeated)]] = True
                    s = np.flatnonzero(repeated[of]) if len(of) else of
                    for k, sym in enumerate(symbols):
                        out[k].append(sym[words.first[t] + s + ends[k]])
                    out[3].append(np.full(len(s), ids[t], np.int64))
                    out[4].append(np.full(len(s), rows[t], np.int64))
                    out[5].append(s)
                a, b, c, d, r, s = (np.concatenate(x) for x in out)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x.view(np.int64)) for x in (a, b, c)), pa.array(d), pa.array(r),
                     pa.array(s.astype(np.int32))], names=["p1", "p2", "p3", *KEY, "pos"])

    return docs.select(*KEY, "text", "seeds").transform(in_batches,
        run, "p1 long, p2 long, p3 long, doc_id long, row long, pos int")


def prefix_groups(found: DataFrame, opt: RepeatOptions) -> tuple[DataFrame, DataFrame | None]:
    """The suffixes with ``level``, the symbols of their group's prefix, and those
    whose whole prefix is beyond ``group_rows`` (None if there are none)."""
    parts = []
    for level in (1, 2, 3):
        prefix = ["p1", "p2", "p3"][:level]
        large = stage(found.groupBy(*prefix).count().where(F.col("count") > opt.group_rows).select(*prefix), "repeat-large")
        n = large.limit(opt.broadcast_ids + 1).count()
        if not n:
            parts.append(found.withColumn("level", F.lit(level)))
            return reduce(DataFrame.unionByName, parts), None
        large = F.broadcast(large) if n <= opt.broadcast_ids else large
        parts.append(found.join(large, prefix, "left_anti").withColumn("level", F.lit(level)))
        found = found.join(large, prefix, "left_semi")
    return reduce(DataFrame.unionByName, parts), found


def deep_nodes(symbols: np.ndarray) -> np.ndarray:
    """For suffixes sorted by their symbols (one row each): the symbols that
    each shares with the one before it (0 for the first).  A maximal run with
    all symbols shared is an internal node of full depth."""
    shared = np.zeros(len(symbols), np.int64)
    if len(symbols) > 1:
        same = symbols[1:] == symbols[:-1]
        shared[1:] = np.cumprod(same, axis=1).sum(axis=1)
    return shared


def subtree_repeats(dealt: DataFrame) -> DataFrame:
    """(doc_id, row, pos) of suffixes below a full-depth node whose smallest doc_id
    is another document.  Partitions are sorted, so a node is a run of rows
    and only its first one is carried from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]):
        last, first_doc = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            sym = np.stack([batch.column(c).to_numpy() for c in ("p1", "p2", "p3")], axis=1)
            docs = batch.column("doc_id").to_numpy()
            inside = deep_nodes(sym) == sym.shape[1]
            if last is not None and (sym[0] == last).all():
                inside[0] = True
            heads = np.flatnonzero(~inside)
            node = np.cumsum(~inside) - 1
            lowest = np.where(node >= 0, docs[heads[np.maximum(node, 0)]] if len(heads) else 0,
                              first_doc if first_doc is not None else 0)
            hit = docs > lowest
            last, first_doc = sym[-1], lowest[-1]
            yield pa.RecordBatch.from_arrays([pa.array(docs[hit]), *(batch.column(c).filter(pa.array(hit)) for c in ("row", "pos"))],
                                             names=[*KEY, "pos"])

    return dealt.select("p1", "p2", "p3", *KEY, "pos").transform(in_batches, run, "doc_id long, row long, pos int")


def repeated_suffixes(docs: DataFrame, opt: RepeatOptions) -> DataFrame:
    """The suffixes of the windows whose seed occurs in two documents, written."""
    postings = stage(seed_postings(docs, opt), "repeat-seeds")
    # written first: a join with the aggregate itself could not split a frequent gram's rows
    grams = stage(postings.groupBy("gram").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where(
        "lo < hi").select("gram"), "repeat-grams")
    seeds = stage(postings.join(grams, "gram").groupBy(*KEY).agg(F.collect_list("pos").alias("seeds")), "repeat-seeded")
    ids = seeds.select(*KEY)
    if ids.limit(opt.broadcast_ids + 1).count() <= opt.broadcast_ids:
        docs = docs.join(F.broadcast(ids), KEY, "left_semi")
    return stage(suffixes(docs.join(seeds, KEY), opt), "repeat-suffixes")


def repeated_windows(docs: DataFrame, opt: RepeatOptions) -> DataFrame:
    """(doc_id, row, pos): starts of the windows that also start in a smaller doc_id."""
    grouped, many = prefix_groups(repeated_suffixes(docs, opt), opt)
    key = F.xxhash64("p1", F.when(F.col("level") > 1, F.col("p2")), F.when(F.col("level") > 2, F.col("p3")))
    some = subtree_repeats(grouped.repartition(key).sortWithinPartitions("p1", "p2", "p3", "doc_id"))
    if many is None:
        return some
    low = stage(many.groupBy("p1", "p2", "p3").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where(
        "low < high"), "repeat-frequent")
    rest = many.join(low, ["p1", "p2", "p3"]).where("doc_id > low")
    return some.union(rest.select(*KEY, "pos"))


def depth_nodes(docs: DataFrame, opt: RepeatOptions) -> DataFrame:
    """(node, depth, doc_id, row, pos, left) of each suffix at depths of 1, 2, 4 ...
    windows inside its text: a hash of its first ``depth`` words and of the word
    before it (at the start of a text, of the row itself)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                ids, rows = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in KEY)
                starts = part.column("starts")
                n = np.diff(np.asarray(starts.offsets))
                of = np.repeat(np.arange(part.num_rows), n)
                pos = np.asarray(starts.flatten()).astype(np.int64)
                left = mix(ids.view(np.uint64) ^ rows.view(np.uint64))[of]
                if len(words.hashes):
                    left = np.where(pos > 0, words.hashes[np.maximum(words.first[of] + pos - 1, 0)], left)
                depth = opt.window
                while len(of):
                    fits = pos + depth <= words.counts()[of]
                    of, pos, left = of[fits], pos[fits], left[fits]
                    if len(of):
                        node = words.windows(depth)[words.first[of] + pos]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(node.view(np.int64)), pa.array(np.full(len(of), depth, np.int64)), pa.array(ids[of]),
                             pa.array(rows[of]), pa.array(pos.astype(np.int32)), pa.array(left.view(np.int64))],
                            names=["node", "depth", *KEY, "pos", "left"])
                    depth *= 2

    return docs.select(*KEY, "text", "starts").transform(in_batches,
        run, "node long, depth long, doc_id long, row long, pos int, left long")


def word_tails(docs: DataFrame) -> DataFrame:
    """(node, depth, doc_id, pos, left, tail): of each of a text's ``leaves`` the
    hashes of its words from ``depth`` to twice ``depth``."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                for t, leaves in enumerate(part.column("leaves").to_pylist()):
                    own = words.hashes[words.first[t]:words.first[t + 1]].view(np.int64)
                    for lo in range(0, len(leaves), 1_000):
                        some = leaves[lo:lo + 1_000]
                        yield pa.RecordBatch.from_pylist([
                            {"node": f["node"], "depth": f["depth"], "doc_id": int(ids[t]), "pos": f["pos"], "left": f["left"],
                             "tail": own[f["pos"] + f["depth"]:f["pos"] + 2 * f["depth"]].tolist()} for f in some], schema=TAILS)

    return docs.select(*KEY, "text", "leaves").transform(in_batches,
        run, "node long, depth long, doc_id long, pos int, left long, tail array<long>")


TAILS = pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()),
                   ("left", pa.int64()), ("tail", pa.list_(pa.int64()))])


def _shared_words(a: list[int], b: list[int]) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.asarray(a[:n]) != np.asarray(b[:n]))
    return int(differ[0]) if len(differ) else n


def internal_nodes(leaves) -> Iterator[tuple]:
    """Internal nodes of the tree of one node's sorted leaves (doc_id, pos, left,
    tail): (words below the node, leaves, smallest (doc_id, pos), largest doc_id,
    whether the words before the leaves differ).  Only the open path is held."""
    path, last = [], None  # [words shared, leaves, first, last doc, left, differ]

    def join(into, other):
        into[1] += other[1]
        into[5] = into[5] or other[5] or into[4] != other[4]
        into[2], into[3] = min(into[2], other[2]), max(into[3], other[3])

    for doc, pos, left, tail in leaves:
        leaf = [len(tail), 1, (doc, pos), doc, left, False]
        if last is not None:
            shared = _shared_words(last, tail)
            closed = held
            while path and path[-1][0] > shared:
                join(path[-1], closed)
                closed = path.pop()
                yield tuple(closed)
            if path and path[-1][0] == shared:
                join(path[-1], closed)
            else:
                path.append([shared, *closed[1:]])
        held, last = leaf, tail
    while path:
        join(path[-1], held)
        held = path.pop()
        yield tuple(held)


def maximal_repeats(docs: DataFrame, opt: RepeatOptions = RepeatOptions()) -> DataFrame:
    """length, occurrences, doc_id, pos, last_doc_id of every word sequence of at
    least ``window`` words that occurs in two documents and that no one word
    before or after extends at all its occurrences; doc_id and pos are its first
    occurrence.  Rows of equal words count once, as the smallest doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text").where("doc_id is not null")
    sha = stage(word_texts(docs), "repeat-words").where(F.col("n_words") >= opt.window)
    first = sha.groupBy("sha", "n_words").agg(F.min(F.struct(*KEY)).alias("k")).select("k.*")
    docs = docs.dropDuplicates(KEY).join(stage(first, "repeat-first"), KEY, "left_semi")
    starts = repeated_suffixes(docs, opt).groupBy(*KEY).agg(F.collect_list("pos").alias("starts"))
    at = stage(depth_nodes(docs.join(stage(starts, "repeat-starts"), KEY), opt), "repeat-depths")
    kept = stage(at.groupBy("node", "depth").agg(
        F.min("left").alias("l0"), F.max("left").alias("l1"), F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")).where(
        "l0 <> l1 and d0 < d1").select("node", "depth"), "repeat-nodes")
    leaves = at.join(kept, ["node", "depth"]).groupBy(*KEY).agg(F.collect_list(F.struct("node", "depth", "pos", "left")).alias("leaves"))
    tails = word_tails(docs.join(stage(leaves, "repeat-leaves"), KEY))

    def run(batches):
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in TAILS.names), strict=True))
        for (_, depth), group in groupby(rows, key=lambda r: r[:2]):
            out = []
            for shared, n, (doc, pos), last, _, differ in internal_nodes(r[2:] for r in group):
                # at twice the depth the node is found again, as one of the next depth
                if differ and doc < last and shared < depth:
                    out.append((depth + shared, n, doc, pos, last))
                if len(out) == 10_000:
                    yield _repeat_rows(out)
                    out = []
            yield _repeat_rows(out)

    order = ["node", "depth", "tail", "doc_id", "pos"]
    return tails.repartition("node", "depth").sortWithinPartitions(*order).transform(in_batches,
        run, "length long, occurrences long, doc_id long, pos long, last_doc_id long")


def _repeat_rows(out: list[tuple]) -> pa.RecordBatch:
    cols = zip(*out, strict=True) if out else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                      names=["length", "occurrences", "doc_id", "pos", "last_doc_id"])


def remove_repeats(docs: DataFrame, opt: RepeatOptions = RepeatOptions()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text of every row;
    kept_text is NULL where the text keeps all its words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    all_words = stage(word_texts(docs), "repeat-words")
    classes = all_words.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= opt.window)).groupBy("sha", "n_words").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("size"))
    copies = stage(all_words.join(classes.where("size > 1"), ["sha", "n_words"]).where("doc_id > class_id").select(
        *KEY).distinct(), "repeat-copies")
    n_copies = copies.limit(opt.broadcast_ids + 1).count()
    few = F.broadcast(copies) if n_copies <= opt.broadcast_ids else copies
    distinct = docs.where("doc_id is not null").join(few, KEY, "left_anti")
    hits = stage(repeated_windows(distinct, opt).groupBy(*KEY).agg(F.collect_list("pos").alias("starts")), "repeat-hits")
    ids = hits.select(*KEY)
    texts = distinct.join(F.broadcast(ids), KEY, "left_semi") if ids.limit(
        opt.broadcast_ids + 1).count() <= opt.broadcast_ids else distinct

    def cut(batches):
        for batch in batches:
            out = []
            for doc_id, row, text, starts in zip(*(batch.column(c).to_pylist() for c in (*KEY, "text", "starts")), strict=True):
                words = (text or "").encode().split()
                step = np.zeros(len(words) + opt.window + 1, np.int64)
                at = np.asarray(starts)
                at = at[at < len(words)]
                np.add.at(step, at, 1)
                np.add.at(step, at + opt.window, -1)
                keep = np.flatnonzero(np.cumsum(step)[:len(words)] == 0)
                kept = b" ".join([words[i] for i in keep])
                out.append((doc_id, row, len(words) - len(keep), hashlib.sha256(kept).hexdigest(), kept.decode()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True) if out else [[]] * 5,
                                                      (*[pa.int64()] * 3, *[pa.string()] * 2), strict=True)],
                names=[*KEY, "n_removed", "kept_sha256", "kept_text"])

    # a repeated row is cut once
    partly = texts.dropDuplicates(KEY).join(hits, KEY).select(*KEY, "text", "starts").transform(in_batches,
        cut, "doc_id long, row long, n_removed long, kept_sha256 string, kept_text string")
    wholly = copies.select(*KEY, F.lit(None).cast("long").alias("n_removed"), F.lit(EMPTY_SHA).alias("kept_sha256"),
                           F.lit("").alias("kept_text"))
    changed = partly.union(wholly).withColumn("changed", F.lit(True))
    out = all_words.join(changed, KEY, "left")
    removed = F.when(F.col("changed"), F.coalesce("n_removed", "n_words")).otherwise(0)
    return out.select("doc_id", "n_words", removed.cast("long").alias("n_removed"),
                      F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept_text")
