import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hydrosift.llm import queries, spelling
from tests.conftest import SF001

CHARS = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | {chr(k) for k in range(0xC0, 0x100)}
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows, damage):
    counts = Counter()
    for doc_id, text in rows:
        for run in "".join(c if c in CHARS else " " for c in text or "").split():
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if damage and h % damage == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def edits(word, letters):
    for k in range(len(word) + 1):
        yield from (word[:k] + c + word[k:] for c in letters)
        if k < len(word):
            yield word[:k] + word[k + 1:]
            yield from (word[:k] + c + word[k + 1:] for c in letters)


def brute_groups(counts, ratio=2):
    letters = sorted(set("".join(counts)))
    near = {w: {v for v in edits(w, letters) if v in counts and v != w} for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return out


def rows_of(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    got = rows_of(queries.QUERIES["op11_reduced_alphabet"](spark, SF001))
    expect = brute_groups(brute_counts([tuple(r) for r in docs], 97))
    assert len(got) == len(expect) > 1000 and set(got) == expect
    assert any(r[2] != r[1] and r[1] for r in got)  # a chain of forms


@pytest.mark.parametrize("symbols", [1, 2, 4, 9])
def test_any_alphabet_finds_every_pair(spark, symbols):
    rnd = random.Random(symbols)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randint(5, 8))): rnd.randint(3, 60) for _ in range(400)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = rows_of(spelling.variant_groups(df, spelling.Spelling(symbols=symbols)))
    assert len(got) == len(words) and set(got) == brute_groups(words)


def test_odd_tables(spark, small):
    opt = spelling.Spelling(damage=97)
    got = rows_of(spelling.variant_groups(spelling.count_words(small.docs, opt), opt))
    assert set(got) == brute_groups(brute_counts(small.rows, 97)) and len(got) == len(set(got))
    assert rows_of(spelling.variant_groups(spelling.count_words(small.empty, opt), opt)) == []
    none = small.docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert {tuple(r) for r in spelling.count_words(none, opt).collect()} == set(
        brute_counts([(None, t) for _, t in small.rows], 97).items())


def test_chain_ties_and_very_long_words(spark):
    long = "ab" * 60_000
    words = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 48, "abbbc": 48,
             long: 3, long + "c": 9, long[:-1] + "z": 3, long[1:] + "qq": 5}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r[0]: r[1:] for r in rows_of(spelling.variant_groups(df))}
    assert got["aaaaa"] == ("aaaab", "abbbb", 3, 1, 6)
    assert got["aabbb"] == ("abbbb", "abbbb", 24, 2, 48)  # the other near word has 12
    assert got["abbbb"] == (None, "abbbb", 48, 3, None)
    assert got[long] == (long + "c", long + "c", 3, 2, 9)
    assert got[long[1:] + "qq"] == (None, long[1:] + "qq", 5, 0, None)


def test_counts_leave_the_task_in_parts(spark, small):
    opt = spelling.Spelling(min_count=1)
    parts = spelling.count_words(small.docs, opt, held_words=7)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, spelling.count_words(small.docs, opt).collect()))
