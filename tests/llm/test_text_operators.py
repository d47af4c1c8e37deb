import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hydrosift.llm import additive_quality, host_rules, pii, string_kernel
from hydrosift.llm.words import Words

from . import brute


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té中")), max_size=6), st.booleans())
@settings(max_examples=60, deadline=None)
def test_words_are_whitespace_runs(texts, lower):
    w = Words(pa.array(texts, pa.string()), lower=lower)
    got = [[bytes(w.data[s:e]).decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)]
           for a, b in zip(w.first, w.first[1:], strict=False)]
    assert got == [brute.words(t) for t in texts]
    by_hash = {}
    for s, e, h in zip(w.start, w.end, w.hashes, strict=True):
        assert by_hash.setdefault(int(h), bytes(w.data[s:e])) == bytes(w.data[s:e])


def test_host_rules_count_like_brute_force(small):
    got = {r["doc_id"]: r for r in host_rules.host_rules(small.docs).collect()}
    for d, t in small.rows:
        r = got[d]
        if len(brute.words(t)) < 2000:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.rule_counts(t), d
        assert r.kept == (not r.base_failed and not r.host_failed)
    assert host_rules.host_rules(small.docs).count() == len(small.rows)
    assert host_rules.host_rules(small.empty).count() == 0


def test_bad_hosts_are_rejected_and_small_ones_shrunk(spark):
    good = "these are ten plain words that make a fine text"
    rows = [(k, good, "good") for k in range(200)] + [(1000 + k, "bad", "bad") for k in range(199)] + [(2000, good, "bad")]
    rows += [(3000, "bad", "tiny")] + [(4000 + k, good, f"h{k % 20}") for k in range(200)] + [(5000, good, None)]
    got = {r["doc_id"]: r for r in host_rules.host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[2000].kept and not got[2000].base_failed and got[2000].host_failed
    assert got[0].kept and got[5000].kept and got[4000].kept
    assert got[3000].host_rate < 1


def test_kept_rows_have_their_own_columns(small):
    kept = host_rules.keep_passing(small.docs)
    assert kept.columns == small.docs.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {
        r["doc_id"] for r in host_rules.host_rules(small.docs).where("kept").collect()}


def test_scanner_equals_patterns():
    rnd = random.Random(1)
    parts = ["a", "b.", "@", ".com", "-", "1", "12", "255", "300", ".", "+", "+1", " ", "(", ")", "4111111111111111",
             "4539 1488 0343 6467", "é", "@x.y", "\n", "0000", "192.168.0.1", "٣", "%"]
    scanner = pii.Scanner()
    for _ in range(20_000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert [str(s) for s in scanner.spans(t) if s.kind in pii.BASE_KINDS] == brute.base_spans(t), t


def test_added_kinds_and_masking():
    scanner = pii.Scanner()
    t = 'IBAN: DE89 3704 0044 0532 0130 00, account no. 12345678, token = "0a1b2c3d4e5f" at https://joe:pw@ex.com/a'
    spans = scanner.spans(t)
    assert [(s.kind, t[s.start:s.end]) for s in spans if s.kind in ("url", "account")] == [
        ("url", "https://joe:pw@ex.com"), ("account", "DE89 3704 0044 0532 0130 00"), ("account", "12345678"),
        ("account", "0a1b2c3d4e5f")]
    assert "joe" not in pii.mask(t, spans) and "DE89" not in pii.mask(t, spans)
    assert scanner.spans("a plain account of the token economy at noon") == []


def test_personal_data_of_all_rows(small):
    got = pii.find_personal_data(small.docs).collect()
    assert len(got) == len(small.rows)
    texts = dict(small.rows)
    for r in got:
        base = brute.base_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in base) for k in ("email", "ip", "card", "phone")]
        assert set(base) <= set(r.spans.split(",")) | {""}
    masked = pii.mask_personal_data(small.docs)
    assert masked.schema == small.docs.schema
    for r in masked.collect():
        assert r.text is None or (brute.base_spans(r.text) == [] and r.n_chars == len(r.text))
        assert (r.text is None) == (texts[r.doc_id] is None)


def test_language_is_learned(spark, small):
    alphabets = {"xx": "abcde ", "yy": "fghij ", "zz": "éàçl "}
    rnd = random.Random(2)
    rows = [(k, "".join(rnd.choice(alphabets[x]) for _ in range(rnd.randint(20, 200))), x)
            for k, x in enumerate(rnd.choices(list(alphabets), k=300))]
    rows += [(1000, None, "xx"), (1001, "12 34", "yy"), (1002, "", None), (1003, "abc dea", None)]
    got = {r.doc_id: r for r in string_kernel.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert np.mean([got[k].lang_pred == x for k, _, x in rows[:300] if got[k].held_out]) > 0.95
    assert got[1000].lang_pred == got[1001].lang_pred == got[1002].lang_pred == "und" and got[1003].lang_pred == "xx"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert string_kernel.identify(small.empty).count() == 0
    assert {r.lang_pred for r in string_kernel.identify(small.docs).collect()} <= {"en", "und"}


def test_every_language_value_is_learned(spark):
    rnd = random.Random(4)
    rows = [(6 * k + i, "".join(rnd.choice([chr(0x4e00 + 6 * k + j) for j in range(6)]) for _ in range(40)), f"l{k:03}")
            for k in range(240) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for opt in (string_kernel.KernelOptions(), string_kernel.KernelOptions(landmarks=100, block_rows=300)):
        got = {r.doc_id: r.lang_pred for r in string_kernel.identify(docs, opt).collect()}
        assert len(set(got.values())) == 240
        assert np.mean([got[d] == lang for d, _, lang in rows]) > 0.95


def test_presence_does_not_depend_on_chunks():
    texts = ["abcabdé中" * 50, "", "a"]
    a = string_kernel.presence(texts, string_kernel.KernelOptions())
    b = string_kernel.presence(texts, string_kernel.KernelOptions(chunk=7))
    assert (a == b).all()


def test_quality_is_learned(spark, small):
    rnd = random.Random(3)
    good = lambda: " ".join("".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 7))) for _ in range(40))
    bad = lambda: " ".join("".join(rnd.choice("ABC#$%!") for _ in range(rnd.randint(2, 7))) for _ in range(40))
    rows = [(k, good() if k % 3 else bad()) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), None) for k in range(400)] + [(7, None, 0), (99999, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows + [(1000, None), (1001, "")], "doc_id long, text string")
    got = additive_quality.score_quality(docs, labels).collect()
    assert len(got) == 402 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in got if r.doc_id < 400 and r.held_out]) > 0.95
    none = additive_quality.score_quality(small.docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert additive_quality.score_quality(small.empty, labels).count() == 0


def test_pairs_catch_what_single_tables_cannot():
    rnd = np.random.default_rng(0)
    x = rnd.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    opt = additive_quality.GamOptions(rounds=30)
    model = additive_quality.fit(x[:3000], y[:3000], opt)
    assert np.mean((model.score(x[3000:]) > 0.5) == y[3000:]) > 0.9
    alone = additive_quality.fit(x[:3000], y[:3000], additive_quality.GamOptions(rounds=30, pairs=0))
    assert np.mean((alone.score(x[3000:]) > 0.5) == y[3000:]) < 0.7


@pytest.mark.parametrize("size", [1, 5])
def test_features_do_not_depend_on_the_batch(small, size):
    texts = [t for _, t in small.rows]
    whole = additive_quality.text_features(pa.array(texts))
    parts = np.concatenate([additive_quality.text_features(pa.array(texts[a:a + size], pa.string())) for a in range(0, len(texts), size)])
    assert np.allclose(whole, parts) and Counter(np.isnan(whole).ravel())[True] == 0
