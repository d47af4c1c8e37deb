"""Self-join of documents on the Jaccard similarity of their 5-word shingles,
with signature trees, and the connected components of its links.

1. Equal shingle sets are one class; only its smallest doc_id goes on.
2. Every class lists the prefix of its shingles under one global order (rare
   ones first), longer than needed by an eighth of its set: two sets as similar
   as asked then share that many prefix shingles (of the smaller set), not
   just one.  A shingle listed by one class alone is dropped.
3. Each class joins the bundle of the smallest doc_id it shares most prefix
   shingles with.  A unit of work is a bundle, or two bundles with a common
   prefix shingle (then only their classes that list enough of them).  Large
   units are split into blocks, and pairs of blocks are units of their own.
4. In a unit the classes, each with its whole set, form signature trees: a node
   holds the OR of its members' token bitmaps, their range of set sizes and the
   most tokens that a member's bitmap hides.  Two trees are walked together; a
   pair of nodes is left when sizes cannot match or the largest possible
   overlap is too small.  What is left is compared exactly.
5. A unit returns a spanning set of its links, and components are joined over
   all units.

The order of shingles uses counts from a fixed share of the documents (bounded
number of entries); it changes the cost, never the result.

Defined results for odd input: a NULL, empty or blank text has an empty set and
is linked with nothing; repeated rows get a row each; an empty table gives an
empty result; further columns are ignored.  A row with a NULL doc_id has no key to link by
and gets a NULL component_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, stage, without
from .components import components
from .words import Words, mix, slices


@dataclass(frozen=True)
class JaccardJoin:
    """words per shingle; threshold num / den; share (1 in n) of documents that
    the shingle order is counted on, with the least count and the most entries
    kept; the part (1 in n) of a set by which its prefix is longer; ids that may be broadcast; classes and shingles in a block; bitmap bits; leaf and
    fan-out of a tree."""

    k: int = 5
    num: int = 75
    den: int = 100
    order_share: int = 16
    order_least: int = 4
    order_entries: int = 1_000_000
    extra: int = 8
    broadcast_ids: int = 2_000_000
    block: int = 2048
    block_tokens: int = 8_000_000
    bits: int = 1024
    leaf: int = 16
    fan: int = 8

    def similar(self, both, union):
        return self.den * both >= self.num * union


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes (int64)."""
    words = Words(texts, lower=True)
    grams = words.windows(k).view(np.int64)
    for t in range(len(texts)):
        a, b = words.first[t], words.first[t + 1]
        if b - a >= k:
            yield np.unique(grams[a:b - k + 1])
        elif b > a:
            yield np.array([words.text_hash(t)], dtype=np.uint64).view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def _each(batches: Iterator[pa.RecordBatch], k: int):
    for batch in batches:
        for part in slices(batch, "text"):
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            yield part, ids, list(shingle_sets(part.column("text"), k))


def set_signatures(docs: DataFrame, opt: JaccardJoin) -> DataFrame:
    """doc_id, n_shingles and a 128-bit signature of the set (NULL when empty)."""
    k = opt.k

    def run(batches):
        for part, _, sets in _each(batches, k):
            sums = np.zeros((2, len(sets)), np.uint64)
            for i, s in enumerate(sets):
                u = s.view(np.uint64)
                sums[0, i], sums[1, i] = mix(u).sum(dtype=np.uint64), mix(u ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
            n = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n), *(pa.array(x.view(np.int64), mask=n == 0) for x in sums)],
                names=["doc_id", "n_shingles", "s1", "s2"])

    return docs.select("doc_id", "text").transform(in_batches, run, "doc_id long, n_shingles long, s1 long, s2 long")


def with_ids(docs: DataFrame, ids: DataFrame, opt: JaccardJoin, keep: bool = True) -> DataFrame:
    """Rows whose doc_id is (or is not) in ``ids``; broadcast only after a count."""
    if ids.limit(opt.broadcast_ids + 1).count() <= opt.broadcast_ids:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", "left_semi" if keep else "left_anti")


def common_shingles(docs: DataFrame, opt: JaccardJoin) -> np.ndarray:
    """The most frequent shingles of a share of the documents, rarest first."""
    k = opt.k

    def run(batches):
        for _, _, sets in _each(batches, k):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]))], names=["token"])

    share = docs.where(F.xxhash64(F.lit(1), "doc_id") % opt.order_share == 0)
    counted = share.select("doc_id", "text").transform(in_batches, run, "token long").groupBy("token").count()
    counted = stage(counted.where(F.col("count") >= opt.order_least), "jaccard-order")
    # entries by count, so that the rows to send are known before any is sent
    least, entries = None, 0
    for count, n in sorted(counted.groupBy("count").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pandas().itertuples(index=False), reverse=True):
        entries += n
        if entries > opt.order_entries:
            break
        least = count
    if least is None:
        return np.zeros(0, np.int64)
    top = counted.where(F.col("count") >= int(least)).toArrow()
    token, count = top.column("token").to_numpy(), top.column("count").to_numpy()
    return token[np.lexsort((-token, count))]


def prefix_postings(docs: DataFrame, common: np.ndarray, opt: JaccardJoin) -> DataFrame:
    """(token, doc_id) for the prefix of each set under the global order:
    uncommon shingles by hash, then the common ones from rare to frequent."""
    k, num, den, extra = opt.k, opt.num, opt.den, opt.extra
    by_hash = np.argsort(common)
    shared = docs.sparkSession.sparkContext.broadcast((common[by_hash], by_hash))

    def run(batches):
        values, rank = shared.value
        for _, ids, sets in _each(batches, k):
            out, n = [], []
            for s in sets:
                size = len(s) - -(-num * len(s) // den) + max(1, len(s) // extra) if len(s) else 0
                if len(values) and len(s):
                    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    hit = values[at] == s
                    s = np.concatenate([s[~hit], s[hit][np.argsort(rank[at[hit]])]])
                out.append(s[:size])
                n.append(size)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*out, np.zeros(0, np.int64)])),
                                              pa.array(np.repeat(ids, n).astype(np.int64))], names=["token", "doc_id"])

    return docs.select("doc_id", "text").transform(in_batches, run, "token long, doc_id long")


def work_units(postings: DataFrame, sizes: DataFrame, opt: JaccardJoin) -> DataFrame:
    """(doc_id, unit, side, split): which classes meet where.

    A unit is a bundle (side 0 only) or a pair of bundles; ``split`` is the
    number of blocks into which each side falls."""
    centers = postings.groupBy("doc_id", "low").count().groupBy("doc_id").agg(
        F.max_by("low", F.struct("count", -F.col("low"))).alias("center"))
    chosen = centers.where("center <> doc_id").select(F.col("center").alias("doc_id")).distinct()
    bundles = stage(centers.join(chosen.withColumn("own", F.lit(True)), "doc_id", "left").select(
        "doc_id", F.when(F.col("own"), F.col("doc_id")).otherwise(F.col("center")).alias("bundle")), "jaccard-bundles")
    alone = bundles.select("doc_id", F.col("bundle").alias("b1"), F.col("bundle").alias("b2"), F.lit(0).alias("side"))
    listed = postings.select("token", "doc_id").join(bundles, "doc_id")
    many = stage(listed.groupBy("token").agg(F.min("bundle").alias("lo"), F.max("bundle").alias("hi")).where(
        "lo < hi").select("token"), "jaccard-many")
    across = stage(listed.join(many, "token"), "jaccard-across")
    by_token = across.select("token", "bundle").distinct()
    pairs = by_token.join(by_token.select("token", F.col("bundle").alias("other")), "token").where("bundle <> other")
    met = across.join(pairs, ["token", "bundle"]).groupBy("doc_id", "bundle", "other").agg(
        F.count(F.lit(1)).alias("shared")).join(sizes, "doc_id")
    # a partner has at least num / den of this set's size, and a prefix longer by 1 / extra of its own
    needed = F.greatest(F.lit(1), F.floor(F.floor(opt.num * F.col("n_shingles") / opt.den) / opt.extra))
    across = met.where(F.col("shared") >= needed).select(
        "doc_id", F.least("bundle", "other").alias("b1"), F.greatest("bundle", "other").alias("b2"),
        (F.col("bundle") > F.col("other")).cast("int").alias("side"))
    rows = stage(alone.union(across), "jaccard-rows")
    found = rows.join(sizes, "doc_id").groupBy("b1", "b2").agg(
        F.count(F.lit(1)).alias("n"), F.min("side").alias("low"), F.max("side").alias("high"),
        F.sum("n_shingles").alias("tokens")).where("n > 1 and (b1 = b2 or low < high)")
    split = F.ceil(F.greatest(F.col("n") / opt.block, F.col("tokens") / opt.block_tokens)).cast("int")
    # written first: a join with the aggregate itself could not split a large bundle's rows
    found = stage(found.select("b1", "b2", F.xxhash64("b1", "b2").alias("unit"), split.alias("split")), "jaccard-found")
    return rows.join(found, ["b1", "b2"])


def blocks(units: DataFrame) -> DataFrame:
    """(doc_id, unit, side): units of several blocks become pairs of blocks."""
    own = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.col("split")).cast("int")
    met = units.withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col("split") - 1)).alias("met"))
    selfjoin = F.col("b1") == F.col("b2")
    i = F.when(selfjoin, F.least("own", "met")).when(F.col("side") == 0, F.col("own")).otherwise(F.col("met"))
    j = F.when(selfjoin, F.greatest("own", "met")).when(F.col("side") == 0, F.col("met")).otherwise(F.col("own"))
    side = F.when(selfjoin & (i < j) & (F.col("own") == j), 1).otherwise(F.col("side"))
    return met.select("doc_id", F.xxhash64("unit", i, j).alias("unit"), side.cast("int").alias("side"))


class Tree:
    """A signature tree over the sets ``rows`` of a unit (as positions)."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray, bits: np.ndarray, hidden: np.ndarray, leaf: int, fan: int):
        order = np.lexsort((*bits[rows].T[:2], sizes[rows]))
        self.rows = rows[order]
        self.leaf = leaf
        cuts = np.arange(0, len(rows), leaf)
        level = (np.bitwise_or.reduceat(bits[self.rows], cuts), np.minimum.reduceat(sizes[self.rows], cuts),
                 np.maximum.reduceat(sizes[self.rows], cuts), np.maximum.reduceat(hidden[self.rows], cuts))
        self.levels = [level]
        while len(level[0]) > 1:
            cuts = np.arange(0, len(level[0]), fan)
            level = (np.bitwise_or.reduceat(level[0], cuts), np.minimum.reduceat(level[1], cuts),
                     np.maximum.reduceat(level[2], cuts), np.maximum.reduceat(level[3], cuts))
            self.levels.append(level)
        self.fan = fan

    def members(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of leaf nodes, and the index of the node each came from."""
        return _expand(nodes, self.leaf, len(self.rows))


def _expand(nodes: np.ndarray, width: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    child = (nodes[:, None] * width + np.arange(width)).ravel()
    source = np.repeat(np.arange(len(nodes)), width)
    real = child < count
    return child[real], source[real]


def possible(a: tuple, b: tuple, num: int, den: int) -> np.ndarray:
    """Can some member of node a be as similar as asked to some member of b?

    Common tokens share bits: there are at most the common bits plus the tokens
    hidden behind another bit of the same set.  ``both / union`` at least
    num / den needs both >= num * (size + size) / (num + den)."""
    (bits_a, low_a, high_a, hid_a), (bits_b, low_b, high_b, hid_b) = a, b
    fits = (den * high_b >= num * low_a) & (den * high_a >= num * low_b)
    most = np.bitwise_count(bits_a & bits_b).sum(axis=1, dtype=np.int64) + np.minimum(hid_a, hid_b)
    most = np.minimum(most, np.minimum(high_a, high_b))
    return fits & ((num + den) * most >= num * (low_a + low_b))


def walk(x: Tree, y: Tree, num: int, den: int, chunk: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Dual traversal: pairs of leaves (as node numbers) that may hold a link."""
    same = x is y
    todo = [(len(x.levels) - 1, len(y.levels) - 1, np.array([0]), np.array([0]))]
    while todo:
        lx, ly, i, j = todo.pop()
        ok = possible(tuple(v[i] for v in x.levels[lx]), tuple(v[j] for v in y.levels[ly]), num, den)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if lx == 0 and ly == 0:
            yield i, j
            continue
        if lx >= ly and lx:
            i, at = _expand(i, x.fan, len(x.levels[lx - 1][0]))
            j, lx = j[at], lx - 1
        if ly > lx or (same and ly):
            j, at = _expand(j, y.fan, len(y.levels[ly - 1][0]))
            i, ly = i[at], ly - 1
        if same:
            i, j = i[i <= j], j[i <= j]
        for lo in range(0, len(i), chunk):
            todo.append((lx, ly, i[lo:lo + chunk], j[lo:lo + chunk]))


def member_pairs(x: Tree, y: Tree, opt: JaccardJoin, chunk: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of sets in the leaves that ``walk`` leaves, at most about ``chunk``
    at once: where all sets are alike, no pair of leaves falls out."""
    step = max(1, chunk // opt.leaf ** 2)
    for i, j in walk(x, y, opt.num, opt.den):
        for lo in range(0, len(i), step):
            a, at = x.members(i[lo:lo + step])
            b, at2 = _expand(j[lo:lo + step][at], y.leaf, len(y.rows))
            a = a[at2]
            if x is y:
                a, b = a[a < b], b[a < b]
            yield x.rows[a], y.rows[b]


def unit_links(sets: list[np.ndarray], sides: np.ndarray, opt: JaccardJoin) -> Iterator[tuple[int, int]]:
    """A spanning set of the links inside one unit (positions in ``sets``)."""
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    tokens = np.concatenate(sets)
    tokens.sort()
    values = tokens[np.append(True, tokens[1:] != tokens[:-1])]
    del tokens
    # a few sets at a time: what is made for each token must not add up over the unit
    dense = np.empty(starts[-1], np.int32)
    bits = np.zeros((len(sets), opt.bits // 64), np.uint64)
    for lo in range(0, len(sets), 64):
        some = np.concatenate(sets[lo:lo + 64])
        dense[starts[lo]:starts[lo] + len(some)] = np.searchsorted(values, some)
        bit = (some.view(np.uint64) >> np.uint64(20)) % np.uint64(opt.bits)
        own = np.repeat(np.arange(lo, min(lo + 64, len(sets))), sizes[lo:lo + 64])
        np.bitwise_or.at(bits, (own, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    hidden = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    node = (bits, sizes, sizes, hidden)
    marked = np.zeros(len(values) + 1, bool)
    root = np.arange(len(sets))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = a = root[root[a]]
        return a

    left = np.flatnonzero(sides == 0)
    x = Tree(left, sizes, bits, hidden, opt.leaf, opt.fan)
    y = x if len(left) == len(sets) else Tree(np.flatnonzero(sides == 1), sizes, bits, hidden, opt.leaf, opt.fan)
    for a, b in member_pairs(x, y, opt):
        # what is linked already is left before its bitmaps are read
        while not np.array_equal(root[root], root):
            root[:] = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        ok = possible(tuple(v[a] for v in node), tuple(v[b] for v in node), opt.num, opt.den)
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        cuts = np.flatnonzero(np.diff(a, prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], len(a)], strict=True):
            one = int(a[lo])
            mine = find(one)
            others = [int(c) for c in b[lo:hi] if find(int(c)) != mine]
            if not others:
                continue
            own = dense[starts[one]:starts[one + 1]]
            marked[own] = True
            for other in others:
                if find(other) == find(one):
                    continue
                both = int(np.count_nonzero(marked[dense[starts[other]:starts[other + 1]]]))
                if opt.similar(both, int(sizes[one] + sizes[other]) - both):
                    root[find(other)] = find(one)
                    yield one, other
            marked[own] = False


def links(docs: DataFrame, members: DataFrame, opt: JaccardJoin) -> DataFrame:
    """(a, b): a spanning set of the links of every unit, from whole sets."""
    k = opt.k
    # a row holds any number of units, so the units are counted
    held = members.agg(F.sum(F.size("units"))).first()[0] or 0
    texts = docs.select("doc_id", "text").join(F.broadcast(members) if held <= opt.broadcast_ids else members, "doc_id")

    def to_sets(batches):
        for part, _, sets in _each(batches, k):
            n = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(n), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([part.column("units"), part.column("doc_id"), flat],
                                             names=["units", "doc_id", "tokens"])

    def solve(rows):
        ids, sides, sets = zip(*rows, strict=True)
        if len(ids) > 1 and 0 in sides:
            for a, b in unit_links([np.asarray(s, np.int64) for s in sets], np.array(sides), opt):
                yield ids[a], ids[b]

    def join(batches):
        unit, rows = None, []
        for batch in batches:
            units, ids, sides = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "doc_id", "side"))
            lists = batch.column("tokens")
            flat, at = lists.values.to_numpy(zero_copy_only=False), np.asarray(lists.offsets)
            found = []
            for r in range(len(ids)):
                if units[r] != unit and rows:
                    found += solve(rows)
                    rows = []
                unit = units[r]
                rows.append((int(ids[r]), int(sides[r]), flat[at[r]:at[r + 1]].copy()))
            yield pa.RecordBatch.from_pydict({"a": [x[0] for x in found], "b": [x[1] for x in found]}, schema=schema)
        if rows:
            found = list(solve(rows))
            yield pa.RecordBatch.from_pydict({"a": [x[0] for x in found], "b": [x[1] for x in found]}, schema=schema)

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    kind = "array<struct<unit:bigint,side:int>>"
    sets = texts.transform(in_batches, to_sets, f"units {kind}, doc_id long, tokens array<long>")
    dealt = sets.select(F.inline("units"), "doc_id", "tokens").repartition("unit").sortWithinPartitions("unit", "side", "doc_id")
    return dealt.transform(in_batches, join, "a long, b long")


def jaccard_components(docs: DataFrame, opt: JaccardJoin = JaccardJoin()) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with the same set) and
    component_id of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stage(set_signatures(docs, opt), "jaccard-sets")
    classes = stage(signed.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "s1", "s2").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("size")), "jaccard-classes")
    copies = signed.where("n_shingles > 0").join(classes.where("size > 1"), ["n_shingles", "s1", "s2"]).where("doc_id <> class_id")
    distinct = with_ids(docs.where("doc_id is not null"), stage(copies.select("doc_id").distinct(), "jaccard-copies"), opt, keep=False)
    common = common_shingles(distinct, opt)
    listed = prefix_postings(distinct, common, opt).selectExpr(
        "token", "doc_id", "min(doc_id) over (partition by token) low", "max(doc_id) over (partition by token) high")
    postings = stage(listed.where("low < high").select("token", "doc_id", "low"), "jaccard-postings")
    sizes = classes.select(F.col("class_id").alias("doc_id"), "n_shingles")
    members = stage(blocks(work_units(postings, sizes, opt)).groupBy("doc_id").agg(
        F.collect_set(F.struct("unit", "side")).alias("units")), "jaccard-units")
    linked = components(links(docs, members, opt), "jaccard-links").select(
        F.col("id").alias("class_id"), F.col("component").alias("component_id"))
    classes = classes.drop("size").join(linked, "class_id", "left").withColumn(
        "component_id", F.coalesce("component_id", "class_id"))
    out = signed.join(classes, ["n_shingles", "s1", "s2"], "left")
    own = F.col("doc_id")
    return out.select("doc_id", "n_shingles", F.when(own.isNotNull(), F.coalesce("class_id", own)).alias("class_id"),
                      F.when(own.isNotNull(), F.coalesce("component_id", own)).alias("component_id"))


def keep_one(docs: DataFrame, opt: JaccardJoin = JaccardJoin()) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with
    its own columns; repeated rows of that doc_id all stay."""
    return without(docs, stage(jaccard_components(docs, opt).where("doc_id <> component_id").select("doc_id"), "jaccard-removed"))
