import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrosift.llm import packing, phrase_index, sigtree, site_style_tree, suffix_repeats, warc
from hydrosift.llm.components import components

from . import brute


def test_jaccard_components(small):
    expect = brute.components(small.rows)
    for opt in (sigtree.JaccardJoin(), sigtree.JaccardJoin(block=3, block_tokens=300, leaf=2, fan=2, broadcast_ids=1, order_share=1, order_least=2)):
        got = sigtree.jaccard_components(small.docs, opt).collect()
        assert len(got) == len(small.rows)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expect
    assert sigtree.jaccard_components(small.empty).count() == 0
    kept = sigtree.keep_one(small.docs)
    assert kept.columns == small.docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, (_, c) in expect.items() if c == d}


def test_jaccard_without_a_key(spark):
    rows = [(None, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g")]
    got = sigtree.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == [(1, 1), (2, 1), (None, None)]


def test_tree_join_misses_no_link():
    rnd = random.Random(4)
    base = [rnd.sample(range(10**6), 60) for _ in range(6)]
    sets = []
    for b in base:
        for _ in range(30):
            own = [x if rnd.random() > 0.1 else rnd.randrange(10**6) for x in b]
            sets.append(np.unique(np.array(own[:rnd.randint(45, 60)], np.int64) * 2654435761))
    links = {(i, j) for i in range(len(sets)) for j in range(i)
             if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    assert len(links) > 100

    def groups(edges):
        root = list(range(len(sets)))

        def find(a):
            while root[a] != a:
                a = root[a]
            return a
        for a, b in edges:
            root[find(a)] = find(b)
        return {frozenset(k for k in range(len(sets)) if find(k) == r) for r in map(find, range(len(sets)))}
    for opt in (sigtree.JaccardJoin(), sigtree.JaccardJoin(bits=64, leaf=2, fan=3)):
        assert groups(sigtree.unit_links(sets, np.zeros(len(sets), int), opt)) == groups(links)
        sides = np.array([k % 2 for k in range(len(sets))])
        across = {(i, j) for i, j in links if sides[i] != sides[j]}
        assert groups(sigtree.unit_links(sets, sides, opt)) == groups(across)


def test_a_unit_of_near_copies_is_bounded_in_memory():
    import tracemalloc
    rng = np.random.default_rng(3)
    base = rng.integers(-2**62, 2**62, 60)
    sets = [np.unique(np.append(base, rng.integers(-2**62, 2**62, 3 + k % 3))) for k in range(1200)]
    for sides in (np.zeros(len(sets), int), np.arange(len(sets)) % 2):
        tracemalloc.start()
        found = list(sigtree.unit_links(sets, sides, sigtree.JaccardJoin()))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        # no pair of leaves falls out: 720,000 pairs of sets, 128 bytes of bitmap each side
        assert len(found) == len(sets) - 1
        assert peak < 60e6


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(20)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 120), 100)}


def items_of(small):
    p = small.passage.split()
    return [(1, " ".join(p[5:30])), (10, " ".join(p[40:52]).upper()), (2, "one two three"), (3, None), (4, "..."),
            (5, "words that no document holds in this order at all"), (6, "one two three")]


def test_contamination(spark, small):
    items = items_of(small)
    table = spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, pos int")
    expect = brute.contamination([r for r in small.rows if len(r[1] or "") < 50_000], items)
    assert any(n for _, n, _ in expect.values())
    for opt in (phrase_index.PhraseIndex(), phrase_index.PhraseIndex(lists=1, broadcast_rows=1)):
        got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in phrase_index.decontaminate(small.docs, table, opt).collect()}
        assert {d: got[d] for d in expect} == expect
    assert phrase_index.decontaminate(small.empty, table).count() == 0
    assert phrase_index.decontaminate(small.docs, table.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    clean = phrase_index.keep_clean(small.docs, table)
    assert clean.columns == small.docs.columns
    assert {r.doc_id for r in clean.collect()} >= {d for d, (_, n, _) in expect.items() if not n}


def test_proximity(spark, small):
    docs = spark.createDataFrame([(1, "alpha x x beta"), (2, "beta " + "y " * 80 + "alpha"), (3, "beta alpha")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    opt = phrase_index.PhraseIndex()
    windows = phrase_index.item_windows(bench, opt)
    terms = phrase_index.rarest_terms(docs, windows, opt)
    index = phrase_index.postings(docs, terms, opt)
    assert {r.id for r in phrase_index.proximity_matches(index, terms, 10).collect()} == {1, 3}


def test_repeated_passages(small):
    expect = brute.repeats(small.rows)
    assert any(0 < r < n for n, r, _ in expect.values())
    for opt in (suffix_repeats.RepeatOptions(), suffix_repeats.RepeatOptions(group_rows=2, broadcast_ids=1)):
        got = suffix_repeats.remove_repeats(small.docs, opt).collect()
        assert len(got) == len(small.rows)
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == expect
    assert suffix_repeats.remove_repeats(small.empty).count() == 0


def test_maximal_repeats(spark):
    opt = suffix_repeats.RepeatOptions(window=6, seed=3, symbols=(1, 2, 3))
    rnd = random.Random(6)
    base = [str(rnd.randrange(40)) for _ in range(90)]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (9, None), (10, ""), (None, " ".join(base))]
    for d in range(3, 9):
        at = rnd.randrange(30)
        own = base[at:at + rnd.randrange(20, 60)]
        own[rnd.randrange(len(own))] = "x"
        rows.append((d, " ".join(own + [str(d)] * (d % 2) + base[:rnd.randrange(12)])))
    texts = {d: t.split() for d, t in rows if d not in (None, 2) and t}
    found = {}
    for d, w in texts.items():
        for i in range(len(w)):
            for j in range(i + opt.window, len(w) + 1):
                found.setdefault(tuple(w[i:j]), []).append((d, i))
    expect = []
    for seq, places in found.items():
        before = {texts[d][i - 1] if i else (d, i) for d, i in places}
        after = {texts[d][i + len(seq)] if i + len(seq) < len(texts[d]) else (d, i) for d, i in places}
        if len(before) > 1 and len(after) > 1 and len({d for d, _ in places}) > 1:
            expect.append((len(seq), len(places), *min(places), max(places)[0]))
    assert len(expect) > 5 and max(expect)[0] > 2 * opt.window
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, suffix_repeats.maximal_repeats(docs, opt).collect())) == sorted(expect)
    assert suffix_repeats.maximal_repeats(docs.limit(0), opt).count() == 0


def pages_of():
    page = "<html><head><title>t &amp</title><style>p{}</style></head><body>{nav}{body}<footer>&copy; f</footer></body></html>"
    nav = "<nav><ul><li><a href='/a'>Home</a></li></ul></nav><div class=\"ad\">Buy!</div>"
    out = [(k, f"http://www.host.example/{k}", page.replace("{nav}", nav).replace(
        "{body}", f"<article><h1>Title {k}</h1><p><b>First&nbsp;&lt;{k}&gt;<br><p>Second\n  part {k}</article>")) for k in range(8)]
    out += [(20 + k, f"https://plain.example/{k}", f"<body><div class=main><p>Own text {k} goes here.</p></div>"
             "<div class=box><p>The same line on all pages.</p></div><div class='comments'><p>me too</p></div>") for k in range(6)]
    return out + [(50, None, "<p>no host</p><script>var a='<p>x</p>';"), (51, "::", None), (52, "http://e.example/", ""),
                  (53, "http://l.example/", "<article>" + "<p>long text</p>" * 20000 + "</article>")]


def test_main_text(spark):
    rows = pages_of()
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows + rows[:1]], "page_id long, url string, html string, host int, path string")
    got = site_style_tree.main_text(pages).collect()
    assert len(got) == len(rows) + 1
    text = {r.page_id: r.text for r in got}
    for k in range(8):
        assert text[k] == f"Title {k}\nFirst <{k}>\nSecond part {k}"
    for k in range(6):
        assert text[20 + k] == f"Own text {k} goes here."
    assert (text[50], text[51], text[52]) == ("no host", "", "")
    assert text[53].count("\n") == 19999
    assert site_style_tree.main_text(pages.limit(0)).count() == 0


def test_archives_round_trip(spark):
    big, small_one = "é" * 80, "tiny"
    rows = [(5, "http://b.example/x", big), (2, "http://www.b.example/x#f", big), (9, None, big), (1, "http://a.example/?q=a b", small_one),
            (3, "http://a.example/", small_one), (4, "http://c.example", None), (6, "u", "WARC/1.1\r\n\r\n\r\n" * 20), (2, "http://www.b.example/x#f", big)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.archive_pages(pages, warc.WarcOptions(file_bytes=200, range_rows=3)).collect()
    assert sorted(r.page_id for r in got) == sorted(r[0] for r in rows)
    for r in got:
        payload = (dict((k, h) for k, _, h in rows)[r.page_id] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 2) if r.page_id in (5, 9) else ("response", None))
    keys = [(r.url_key, r.captured, r.page_id) for r in got]
    assert keys == sorted(keys)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_loser_tree_merges():
    rnd = random.Random(6)
    for k in (1, 2, 3, 7, 16):
        runs = [sorted(((rnd.randrange(30),), i) for i in range(rnd.randint(0, 20))) for _ in range(k)]
        assert [x[0] for x in warc.LoserTree(runs)] == sorted(x[0] for r in runs for x in r)


def test_url_keys_group_one_address():
    assert warc.url_key("HTTP://u:p@WWW.Ex.org:80/A?b#c") == warc.url_key("https://ex.org/a?b") == "org,ex)/a?b"
    assert warc.url_key(None) == "" and warc.url_key("http://ex.org:8080") == "org,ex:8080)/"


def check_packing(rows, expected_tokens):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r.length for r in rows) == expected_tokens
    return len(by_sequence)


def test_packing_of_documents(spark, small):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    encoder = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    total, pieces = 0, {}
    for d, t in dict(small.rows).items():
        ids = [*encoder.encode(t or "", add_special_tokens=False).ids, 2]
        for k, (a, n) in enumerate(packing.cut(len(ids), 1024)):
            pieces[d, k] = (a, n, zlib.crc32(np.array(ids[a:a + n], "<u4").tobytes()))
        total += len(ids) * sum(x[0] == d for x in small.rows)
    rows = packing.pack(small.docs, packing.Packing(bucket_rows=4)).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == pieces
    check_packing(rows, total)
    assert packing.pack(small.empty).count() == 0


def test_plans_fill_exactly_where_they_can():
    assert packing.pack_lengths({600: 3, 424: 3}, 1024) == [((600, 424), 3)]
    assert packing.pack_lengths({500: 2, 300: 2, 224: 2}, 1024) == [((500, 300, 224), 2)]
    assert packing.cut(2050, 1024) == [(0, 2), (2, 1024), (1026, 1024)] and packing.cut(1024, 1024) == [(0, 1024)]
    rnd = random.Random(7)
    counts = {}
    for _ in range(20_000):
        n = min(1024, int(rnd.lognormvariate(5.5, 1)) + 1)
        counts[n] = counts.get(n, 0) + 1
    plan = packing.pack_lengths(dict(counts), 1024)
    used = {}
    for pattern, times in plan:
        assert sum(pattern) <= 1024
        for n in pattern:
            used[n] = used.get(n, 0) + times
    assert used == counts
    bound = -(-sum(n * c for n, c in counts.items()) // 1024)
    assert sum(times for _, times in plan) <= 1.002 * bound + 1
    assert len(plan) <= 4 * len(counts)


def texts_of(spark, pages):
    rows = [(k, url, html) for k, (url, html) in enumerate(pages)]
    got = site_style_tree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return {r.page_id: r.text for r in got}


def sentence(*seed):
    rnd = random.Random(str(seed))
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(20))


def test_marked_pages_are_judged_by_the_tree(spark):
    teaser = "<article><p>The same teaser card on all pages.</p></article>"
    cards = [("http://cards.example/", f"<body><div class=story><p>{sentence('c', k)}</p></div>{teaser}</body>") for k in range(8)]
    inner = [("http://inner.example/", f"<main><p>{sentence('m', k)}</p><p>Read more on our front page.</p></main>"
              f"<p>{sentence('beside', k)}</p>") for k in range(8)]
    copies = [("http://copies.example/", f"<article><p>{sentence('one')}</p></article><p>Stamp {k} {sentence('s', k)}</p>") for k in range(20)]
    got = texts_of(spark, cards + inner + copies)
    for k in range(8):
        assert got[k].startswith(sentence("c", k))
        assert got[8 + k] == sentence("m", k) + "\n" + sentence("beside", k)
    for k in range(20):
        assert got[16 + k].startswith(sentence("one"))


def test_verdict_depends_neither_on_host_size_nor_on_copies(spark):
    pages, expect = [], []
    for size in (24, 90, 400):
        for k in range(size):
            pages.append((f"http://h{size}.example/", f"<div class=main><p>{sentence(size, k)}</p></div>"
                          f"<div class=box><p>{sentence('box', k % 3)}</p></div><div class=tip><p>{sentence('tip', k % 6)}</p></div>"))
            expect.append(sentence(size, k))
    for copies in (4, 100):  # a host of copies, and one with others beside them
        for others in (0, 8):
            for k in range(copies + others):
                text = [sentence("copy", i) for i in range(3)] if k < copies else [sentence("other", k)]
                pages.append((f"http://c{copies}-{others}.example/", "<div class=main>" + "".join(f"<p>{t}</p>" for t in text) + "</div>"))
                expect.append("\n".join(text))
    got = texts_of(spark, pages)
    assert [got[k] for k in range(len(pages))] == expect


def test_a_boilerplate_word_alone_takes_no_article(spark):
    kept = lambda source: [b[1] for b in site_style_tree.Page(source).blocks if not b[4]]
    body, lead = sentence("body"), "A lead."
    for wrapper in ("div class='layout has-sidebar'", "div id=widget class=banner", "div class='sidebar'"):
        assert kept(f"<{wrapper}><article><p>{body}</p></article></div><div class=ad>Buy!</div>") == [body]
    for wrapper in ("div class='entry-content comments-open'", "section class='ad-hoc-study'", "div class=widget"):
        assert kept(f"<{wrapper}><p>{body}</p></div></section><div class='ad-slot'>Buy!</div>") == [body]
    assert kept(f"<section><p>{body}</p></section><section class='ad-hoc-study'><p>{lead}</p></section>") == [body, lead]
    inside = f"<div class=header><h1>Title</h1></div><p class=teaser>{lead}</p><p>{body}</p><div class=comments><p>me too</p></div>"
    assert kept(f"<article>{inside}</article>") == ["Title", lead, body]
    assert kept(f"<article><p>{body}</p></article><div class='post-comments'><p>{body} {body}</p></div>") == [body]
    notice = " ".join(sentence("notice", i) for i in range(12))  # most of the host's text
    got = texts_of(spark, [("http://n.example/", f"<div class='layout has-sidebar'><article><p>{sentence('n', k)}</p></article>"
                            f"<div class=box><p>{notice}</p></div></div>") for k in range(8)])
    assert [got[k] for k in range(8)] == [sentence("n", k) for k in range(8)]


def test_texts_that_spell_an_added_token(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    encoder = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    mark = "<|endoftext|>"
    texts = [f"a {mark} b", mark, f"{mark}{mark}x", f"one \n {mark}  two  {mark}\n", f"<|endoftext|{mark}|>", "<|endoftext|", f"é中 {mark}" * 700]
    got = {}
    for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True).collect():
        got.setdefault(r.doc_id, {})[r.start] = r.ids
    for k, text in enumerate(texts):
        ids = [x for _, part in sorted(got[k].items()) for x in part]
        assert ids == [*encoder.encode(text, add_special_tokens=False).ids, 2]


def test_importance_is_an_entropy(spark):
    """Both kinds of importance against sums over single pages."""
    from math import log2

    opt = site_style_tree.StyleTree()
    shares = [1 / 1000, 1 / 50, 1 / 12, 1 / 9, 0.4, 0.9, 1.0]
    rows = spark.createDataFrame([(x,) for x in shares], "share double")
    got = [r[0] for r in rows.select(site_style_tree.content_importance(rows.share, opt)).collect()]
    bits = lambda p: -p * log2(p) - (1 - p) * log2(1 - p)
    assert got == pytest.approx([1 - bits(min(x, opt.full_share)) / bits(opt.full_share) for x in shares])
    styles = {"one": ["a"] * 7, "two": ["a", "a", "b"], "all": list("abcde"), "page": ["a"]}
    counted = [(k, s, v.count(s)) for k, v in styles.items() for s in set(v)]
    frame = spark.createDataFrame(counted, "node string, styles string, n long").groupBy("node").agg(
        site_style_tree.presentation_importance("n").alias("own"))
    own = {r.node: r.own for r in frame.collect()}
    entropy = {k: sum(-log2(v.count(x) / len(v)) / len(v) for x in v) for k, v in styles.items()}
    for node, v in styles.items():
        want = (1 - 2 ** -entropy[node]) * len(v) / (len(v) - 1) if len(v) > 1 else 1.0
        assert own[node] == pytest.approx(want, abs=1e-9)
    assert own["all"] == pytest.approx(1.0) and own["one"] == pytest.approx(0.0)


def test_shingle_order_keeps_whole_counts(spark):
    """Entries of one count go together, the rarest first, within the bound."""
    docs = spark.createDataFrame([(i, "a b c d e") for i in range(5)] + [(i, "f g h i j") for i in range(5, 9)]
                                 + [(i, "k l m n o") for i in range(9, 13)], "doc_id long, text string")
    order = lambda n: sigtree.common_shingles(docs, sigtree.JaccardJoin(order_share=1, order_entries=n))
    assert [len(order(n)) for n in (0, 1, 2, 3)] == [0, 1, 1, 3]
    assert order(3)[-1] == order(1)[0]
