"""Rows that share or lack an id, ids of any size, texts that once stopped a task."""

import hashlib
import time

import pytest

from hydrosift.llm import packing, phrase_index, pii, site_style_tree, suffix_repeats, warc


def passage(name, n=60):
    return " ".join(f"{name}{k}" for k in range(n))


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    rows = [(1, passage("a")), (2, passage("a")), (2, passage("b")), (None, passage("a")), (None, passage("c")), (0, passage("a")),
            (3, passage("b")), (3, passage("b"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, passage("a", 12)), (8, passage("b", 12))], "item_id long, text string")
    got = phrase_index.decontaminate(docs, items).collect()
    assert sorted((str(r.doc_id), r.n_hit, r.item_ids) for r in got) == sorted(
        [("1", 12, ["7"]), ("2", 12, ["7"]), ("2", 12, ["8"]), ("None", 12, ["7"]), ("None", 0, []), ("0", 12, ["7"])] + [("3", 12, ["8"])] * 2)
    kept = phrase_index.keep_clean(docs, items)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(None, passage("c"))]

    got = suffix_repeats.remove_repeats(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed) for r in got) == sorted(
        [("0", 60, 0), ("1", 60, 60), ("2", 60, 60), ("2", 60, 0), ("None", 60, 0), ("None", 60, 0)] + [("3", 60, 60)] * 2)


def test_a_repeated_row_loses_its_words_once(spark):
    own, shared = passage("x", 20), passage("s", 55)
    rows = [(1, shared + " " + passage("y", 9)), (5, own + " " + shared), (5, own + " " + shared), (5, own)]
    got = suffix_repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sha = hashlib.sha256(own.encode()).hexdigest()
    assert sorted((r.doc_id, r.n_removed, r.kept_sha256 == sha) for r in got) == [(1, 0, False), (5, 0, True), (5, 55, True), (5, 55, True)]


@pytest.mark.parametrize("blank", [" ", "\n", "\t", "\r\n"])
def test_white_space_that_runs_on(spark, blank):
    text = "word" + blank * 1_200_000 + "word"
    library = packing.load_library(packing.default_vocabulary())
    got = packing.pack(spark.createDataFrame([(1, text), (2, "word"), (3, "a" + blank * 30_000)], "doc_id long, text string")).collect()
    assert sum(r.length for r in got if r.doc_id == 1) == len(library.encode(text, add_special_tokens=False).ids) + 1
    assert max(r.length for r in got) <= 1024 and {r.doc_id for r in got} == {1, 2, 3}


def test_the_fast_encoder_up_to_its_bound():
    encoder, library = packing.load_encoder(packing.default_vocabulary()), packing.load_library(packing.default_vocabulary())
    for blank in " \n\t":
        text = "a" + blank * (packing.LONG_RUN - 1) + "b"
        assert not packing.has_long_run(text) and packing.has_long_run(text + blank * packing.LONG_RUN)
        assert packing.encode_text(encoder, text) == library.encode(text, add_special_tokens=False).ids


def test_page_ids_of_any_size(spark):
    rows = [(k, f"http://h.example/{k}", "x" * 200) for k in (0, -5, 10**13, 9 * 10**18, 86_400, 3 * 10**11)] + [(None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive_pages(pages).collect()}
    assert got == {None: ("response", None), -5: ("response", None)} | {k: ("revisit", -5) for k, _, _ in rows if k is not None and k != -5}


@pytest.mark.parametrize("source, text", [
    ("<p title='it's fine'>Hello one</p><p>Second</p>", "Hello one\nSecond"),
    ("<p title='it's fine'>Hello one</p><p>Second</p><p>don't</p>", "Hello one\nSecond\ndon't"),
    ('<p title="a > b">t</p><p>a < b, 1<2</p>', "t\na < b, 1<2"),
    ("<p>it's <a href=x'y>here</a> now</p>", "it's here now"),
    ('<p a="x>y</p><p>z</p>', "y\nz"),
    ("<p>x</p><!-- <p>no</p>", "x")])
def test_quotes_in_tags(source, text):
    assert "\n".join(b[1] for b in site_style_tree.Page(source).blocks) == text


@pytest.mark.parametrize("part", ["<a ", "<a x='", '<a =">"', "<", "<!--", "</script ", "<p class='", "<a" + "x" * 50, "&amp;", "</p x=\""])
@pytest.mark.parametrize("end", ["", ">"])
def test_pages_are_read_in_linear_time(part, end):
    start = time.perf_counter()
    site_style_tree.Page(part * (1_000_000 // len(part)) + end)
    assert time.perf_counter() - start < 8


@pytest.mark.parametrize("part", ["account" + " " * 999, "token=", "account ", "a@", "1.", "+1 ", "http://", "token \t", "password=x1", "9", "account:"])
def test_texts_are_scanned_in_linear_time(part):
    scanner, start = pii.Scanner(), time.perf_counter()
    scanner.spans(part * (1_000_000 // len(part)))
    scanner.spans("account" + " " * 1_000_000)
    assert time.perf_counter() - start < 12


def test_a_refused_secret_hides_no_other():
    text = "token=password=abcdefgh token=secret_xy9z8 account no 1234567, token=aa=token=bbbbbbbb passwd: q1w2e3r4t5"
    found = [text[s.start:s.end] for s in pii.Scanner().spans(text) if s.kind == "account"]
    assert found == ["secret_xy9z8", "1234567", "q1w2e3r4t5"]
