import hashlib
import json
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hydrosift.llm import bpe_automaton, queries
from tests.conftest import SF001

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def automaton():
    return bpe_automaton.Automaton(bpe_automaton.compile_tables(PATH))


def explicit(merges, alphabet):
    """The gadgets on a plain table of arcs: {state: {token: next state}}, where
    every state is named by the token before it and "" is the start."""
    arcs = {s: set(alphabet) for s in ["", *alphabet]}
    for u, v in merges:
        if u not in arcs or v not in arcs.get(u, ()):
            continue
        copy = set(arcs[v])
        if u == v:
            copy.add(u)
        had = {s for s in arcs if u in arcs[s]}
        if v in arcs[u]:
            arcs[u].discard(v)
        if u == v:
            had.discard(u)
        for s in had:
            arcs[s].add(u + v)
        if u in copy:
            copy.add(u + v)
        arcs[u + v] = copy
    return arcs


def merged(word, merges):
    parts = list(word)
    for u, v in merges:
        k = 0
        while k < len(parts) - 1:
            if parts[k] == u and parts[k + 1] == v:
                parts[k:k + 2] = [u + v]
            k += 1
    return parts


@pytest.mark.parametrize("seed", range(40))
def test_arcs_are_those_of_the_gadgets(tmp_path, seed):
    rnd = random.Random(seed)
    tokens, merges = list("abc"), []
    for _ in range(12):
        u, v = rnd.choice(tokens), rnd.choice(tokens)
        if u + v not in tokens:
            tokens.append(u + v)
            merges.append([u, v])
    file = tmp_path / "small.json"
    file.write_text(json.dumps({"added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False},
                                "model": {"type": "BPE", "vocab": {t: k for k, t in enumerate(tokens)}, "merges": merges}}))
    built = bpe_automaton.Automaton(bpe_automaton.compile_tables(str(file)))
    table = explicit(merges, "abc")
    reachable, todo = {""}, [""]
    while todo:
        for t in table[todo.pop()]:
            if t not in reachable:
                reachable.add(t)
                todo.append(t)
    for s in reachable - {""}:
        assert {t for k, t in enumerate(tokens) if t in reachable and built.arc(tokens.index(s), k)} == table[s] & reachable
    for _ in range(200):
        word = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 14)))
        assert [tokens[t] for t in built.encode_bytes(word.encode())] == merged(word, merges), word


def test_every_character_like_the_library(automaton, library):
    points = [chr(c) for c in [*range(0x600), *range(0x1F00, 0x2100), *range(0x600, 0x110000, 61)] if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 4096):
        text = "".join(f"a{c}1{c} {c}{c}" for c in points[lo:lo + 4096])
        assert automaton.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, hex(lo)


ODD = ["", " ", "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> <|endof", "it's they'll 'S  x\n\n  y\t", "é̀ 中文 ßäö",
       "\x00\x1c\x85 ​﻿", "🙂" * 40, "=" * 700, " " * 5000 + "x", "\n" * 3001, "ab" * 3000, "0123456789" * 30, "-" * 999 + "\\" * 600]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(automaton, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert automaton.encode(text).tolist() == ids
    assert automaton.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_random_texts_and_ids(automaton, library):
    rnd = random.Random(3)
    for _ in range(2000):
        text = "".join(rnd.choice(" abcdeéstrin'\n01.,ñ日\t") for _ in range(rnd.randint(1, 60)))
        assert automaton.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
        ids = [rnd.randrange(50257) for _ in range(12)]
        assert automaton.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert automaton.decode([50257, -1]) == ""


def test_runs_of_millions(automaton):
    for c in (" ", "\n", "x"):
        ids = automaton.encode(c * 1_000_000)
        assert automaton.decode(ids.tolist()) == c * 1_000_000


def test_query_like_the_library(spark, library):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").toPandas()
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op12_tokenization_automaton"](spark, SF001).collect()}
    assert len(got) == len(docs)
    for d, text in zip(docs.doc_id, docs.text, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), back)]
        assert got[d] == (d, len(ids), *sha)


def test_odd_tables(spark, small, library):
    got = bpe_automaton.decode(bpe_automaton.encode(small.docs)).collect()
    expect = [(d, library.encode(t or "", add_special_tokens=False).ids, t or "") for d, t in small.rows]
    assert sorted((r.doc_id, r.ids, r.text) for r in got) == sorted(expect)
    assert bpe_automaton.decode(bpe_automaton.encode(small.empty)).count() == 0
    none = small.docs.limit(3).withColumn("doc_id", F.lit(None).cast("string"))
    assert [r.doc_id for r in bpe_automaton.encode(none, text_bytes=1).collect()] == [None] * 3
    nulls = spark.createDataFrame([(1, None), (None, [262]), (2, []), (3, [-5, 262, 99999])], "doc_id long, ids array<int>")
    assert sorted((r.text for r in bpe_automaton.decode(nulls).collect())) == ["", "", automaton_text(262), automaton_text(262)]


def automaton_text(t):
    return Tokenizer.from_file(PATH).decode([t])


def test_a_memo_that_overflows(library):
    built = bpe_automaton.Automaton(bpe_automaton.compile_tables(PATH), memo_words=2, memo_chars=3)
    text = "the cat sat on the mat " * 20
    assert built.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError):
        bpe_automaton.compile_tables(public_tokenizers.path("word_bpe_49k.json"))
