import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hydrosift.llm import ranked_search
from hydrosift.llm.ranked_search import Ranking, Shard

from . import brute


def brute_rank(docs, items, top=20):
    """[(item_id, rank, doc_id, score)] by scoring every document."""
    bags = [(d, Counter(brute.test_words(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, length = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for d, bag in bags:
            m = 75 + 25 * bag.total() * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m))
                    for t in brute.test_words(text) if bag[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores)[:top], start=1)]
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


ITEMS = [(1, "same words here again"), (2, "EDIT edit, edit. line a b"), (3, None), (4, ""), (5, "zzzz-nothing"),
         (1, "line other two"), (None, "words x 中文 ßäö é̀"), (2, "EDIT edit, edit. line a b")]


@pytest.mark.parametrize("opt", [Ranking(), Ranking(top=3, short_list=2, window=4, shard_postings=40),
                                 Ranking(short_list=0, window=2, shard_postings=1), Ranking(block_terms=3)])
def test_equals_brute_force(spark, small, opt):
    texts = [t for _, t in small.rows if t]
    items = ITEMS + [(100 + k, " ".join(t.split()[:12])) for k, t in enumerate(texts[:20])]
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1L as doc_id", "2 as rank", "'x' as item")
    got = ranked_search.rank_documents(small.docs, table, opt).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_rank(small.rows, items, opt.top), key=key)


def test_empty_tables_and_null_ids(spark, small):
    items = spark.createDataFrame([(1, "same words edit")], "item_id long, text string")
    assert ranked_search.rank_documents(small.empty, items).count() == 0
    assert ranked_search.rank_documents(small.docs, items.limit(0)).count() == 0
    assert ranked_search.rank_documents(small.docs, spark.createDataFrame([("a", None)], "item_id string, text string")).count() == 0
    rows = [(None, "red green"), (7, "red green"), (3, "red green"), (None, "red red"), (9, "blue")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ranked_search.rank_documents(docs, spark.createDataFrame([("q", "red")], "item_id string, text string")).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_rank(rows, [("q", "red")]), key=key)
    assert [r.doc_id for r in sorted(got, key=lambda r: r.rank)] == [None, 3, 7, None]


@pytest.mark.parametrize("seed", range(30))
def test_a_shard_skips_without_loss(seed):
    rnd = random.Random(seed)
    size, n_terms, top = rnd.choice([1, 50, 3000]), 12, rnd.choice([1, 5, 20])
    rows = [sorted(rnd.sample(range(n_terms), rnd.choice([1, 1, 2, 5]))) for _ in range(size)]
    terms = np.array([t for r in rows for t in r])
    gain = np.array([rnd.choice([0, 1, 5, 5, 100 * (t + 1)]) * (1 if k > 400 else 50) for k, r in enumerate(rows) for t in r])
    ids = [rnd.randrange(10 * size) for _ in range(size)]
    shard = Shard(pa.array(ids, pa.int64()), np.array([len(r) for r in rows]), terms, gain, 64)
    wanted, times = np.array(sorted(rnd.sample(range(n_terms + 3), 6))), np.array([rnd.randint(1, 3) for _ in range(6)])
    skipped = []
    docs, scores = shard.best(wanted, times, top, rnd.choice([0, 30, 300, 10**6]), skipped)
    at, total = 0, []
    for d, r in zip(ids, rows, strict=True):
        total.append((-sum(int(gain[at + k]) * int(times[list(wanted).index(t)]) for k, t in enumerate(r) if t in wanted), d))
        at += len(r)
    expect = sorted(x for x in total if x[0] < 0)[:top]
    assert sorted((-int(s), shard.doc_ids[int(d)].as_py()) for d, s in zip(docs, scores, strict=True)) == expect
    assert size < 3000 or top > 1 or skipped or seed > 20


def test_lengths_beyond_64_bits():
    n = np.array([10**13, 5])
    one = ranked_search.gains(np.array([3, 3]), n, np.array([7, 7]), 10**6, 10**15)
    m = [75 + 25 * int(x) * 10**6 // 10**15 for x in n]
    assert one.tolist() == [7 * (3 * 10**9 // (3000 + 12 * x)) for x in m]
