"""Benchmark decontamination with a distributed positional inverted index.

A test item is cut into windows of 10 words (a shorter item is one window).
The corpus is read twice: once to count the items' words, once to store the
postings (term, doc_id, pos) of each window's rarest terms.  A window's
candidates are the postings of its rarest term, shifted by the term's offset;
they are intersected with the shifted postings of its next rarest terms, and
what is left is compared word by word with the document.

Only DataFrame functions are used.  Windows are known by a 64-bit hash of their
words.

Defined results for odd input: a NULL or wordless text has no words, in
documents and items alike; an item without words occurs nowhere; repeated
items count by their item_id; every row of the documents is judged by its own
text, also where rows share a doc_id or have none (rows are known by a hash of
doc_id and text beside the doc_id); an empty benchmark contaminates nothing and
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DELIMITER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DELIMITERS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
KEY = ["id", "row"]
END = "\x00"  # no word; its posting holds a document's number of words


@dataclass(frozen=True)
class PhraseIndex:
    """Words of a window, lists intersected before the comparison, and rows of
    a table made from the benchmark that may be broadcast."""

    window: int = 10
    lists: int = 3
    broadcast_rows: int = 1_000_000


def words_of(text: Column, *after: Column) -> Column:
    """Lower-cased (A-Z) words, then the given elements."""
    bare = F.btrim(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(DELIMITERS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, DELIMITER))
    return F.concat(words, F.array(*after)) if after else words


def key_columns() -> tuple[Column, Column]:
    """The columns of KEY, which know a row also without a doc_id."""
    return (F.coalesce(F.col("doc_id").cast("long"), F.lit(0)),
            F.xxhash64("text", "doc_id", F.col("doc_id").isNull()))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*(c.alias(k) for k, c in zip(KEY, key_columns(), strict=True)), "doc_id", "text")


def _small(df: DataFrame, opt: PhraseIndex) -> DataFrame:
    """Broadcast after counting at most one row over the bound, else as it is."""
    return F.broadcast(df) if df.limit(opt.broadcast_rows + 1).count() <= opt.broadcast_rows else df


def item_windows(benchmark: DataFrame, opt: PhraseIndex = PhraseIndex()) -> DataFrame:
    """(item_id, win, words) of every window of every item."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - opt.window, F.lit(0))
    cut = items.select("item_id", F.explode(F.transform(
        F.sequence(F.lit(1), last + 1), lambda i: F.slice("w", i, opt.window))).alias("words"))
    return cut.select("item_id", F.xxhash64("words").alias("win"), "words").distinct()


def rarest_terms(docs: DataFrame, windows: DataFrame, opt: PhraseIndex) -> DataFrame:
    """(win, nth, term, offset): each window's rarest terms in the corpus,
    rarest first; windows with a term that the corpus lacks are left out."""
    places = windows.select("win", F.posexplode("words").alias("offset", "term"))
    vocabulary = stage(places.select("term").distinct(), "phrase-vocabulary")
    counted = docs.select(F.explode(words_of(F.col("text"))).alias("term")).join(
        _small(vocabulary, opt), "term", "left_semi").groupBy("term").count()
    known = places.join(counted, "term", "left").groupBy("win").agg(
        F.count_if(F.col("count").isNull()).alias("lacking"),
        F.sort_array(F.collect_list(F.struct("count", "term", "offset"))).alias("terms")).where("lacking = 0")
    return known.select("win", F.posexplode(F.slice("terms", 1, opt.lists)).alias("nth", "t")).select(
        "win", "nth", "t.term", "t.offset")


def postings(docs: DataFrame, terms: DataFrame, opt: PhraseIndex) -> DataFrame:
    """(term, id, row, pos) of the given terms; END marks each document's length
    and alone carries its doc_id."""
    every = keyed(docs).select(*KEY, "doc_id", F.posexplode(words_of(F.col("text"), F.lit(END))).alias("pos", "term"))
    wanted = terms.select("term").distinct().union(docs.sparkSession.range(1).select(F.lit(END).alias("term")))
    return every.join(_small(wanted, opt), "term", "left_semi").select(
        "term", *KEY, "pos", F.when(F.col("term") == END, F.col("doc_id")).alias("doc_id"))


def intersect(index: DataFrame, terms: DataFrame, opt: PhraseIndex) -> DataFrame:
    """(win, id, row, start) where all chosen terms of a window lie at their offsets."""
    index = index.select("term", *KEY, "pos")
    first = _small(terms.where("nth = 0").drop("nth"), opt)
    found = index.join(first, "term").select("win", *KEY, (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0")
    for nth in range(1, opt.lists):
        more = terms.where(F.col("nth") == nth).drop("nth")
        wanted = found.join(_small(more, opt), "win", "left").withColumn("pos", F.col("start") + F.col("offset"))
        listed = index.join(_small(more.select("term").distinct(), opt), "term", "left_semi").withColumn("listed", F.lit(True))
        met = wanted.join(listed, [*KEY, "term", "pos"], "left")
        found = met.where("term is null or listed").select("win", *KEY, "start")
    return found.distinct()


def phrase_matches(docs: DataFrame, windows: DataFrame, index: DataFrame, terms: DataFrame,
                   opt: PhraseIndex) -> DataFrame:
    """(id, row, hits): the windows that occur, as an array of (win, start, length)."""
    phrases = windows.select("win", "words").dropDuplicates(["win"])
    candidates = stage(intersect(index, terms, opt).join(_small(phrases, opt), "win").groupBy(*KEY).agg(
        F.collect_list(F.struct("start", "win", "words")).alias("cand")), "phrase-candidates")
    texts = keyed(docs).select(*KEY, "text").join(_small(candidates.select(*KEY), opt), KEY, "left_semi")
    same = lambda w, c: F.forall(
        F.sequence(F.lit(0), F.size(c["words"]) - 1), lambda k: F.coalesce(F.get(w, c["start"] + k) == F.get(c["words"], k), F.lit(False)))
    hits = let(words_of(F.col("text")), lambda w: F.transform(
        F.filter("cand", lambda c: same(w, c)),
        lambda c: F.struct(c["win"].alias("win"), c["start"].alias("start"), F.size(c["words"]).alias("length"))))
    return texts.join(candidates, KEY).select(*KEY, hits.alias("hits")).where(F.size("hits") > 0).dropDuplicates(KEY)


def covered(hits: Column) -> Column:
    """Words inside at least one hit."""
    spans = F.sort_array(F.transform(hits, lambda h: F.struct(
        h["start"].alias("a"), (h["start"] + h["length"]).alias("b"))))
    merged = F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["b"] - F.greatest(s["a"], acc["end"]), F.lit(0))).alias("n"),
        F.greatest(s["b"], acc["end"]).alias("end")))
    return merged["n"].cast("long")


def proximity_matches(index: DataFrame, terms: DataFrame, within: int = 50) -> DataFrame:
    """(win, id, row, pos): places of a window's rarest term that have each of
    its other chosen terms at most ``within`` words away, in any order."""
    first = index.join(terms.where("nth = 0").select("win", "term"), "term").select("win", *KEY, "pos")
    asked = terms.groupBy("win").agg(F.countDistinct("term").alias("asked"))
    near = first.join(terms.select("win", "term").distinct(), "win").join(
        index.select(*KEY, "term", F.col("pos").alias("at"), F.explode(F.array(*[
            F.floor(F.col("pos") / (within + 1)) + d for d in (-1, 0, 1)])).alias("cell")), [*KEY, "term"]).where(
        (F.floor(F.col("pos") / (within + 1)) == F.col("cell")) & (F.abs(F.col("at") - F.col("pos")) <= within))
    met = near.groupBy("win", *KEY, "pos").agg(F.countDistinct("term").alias("met"))
    return met.join(asked, "win").where("met = asked").select("win", *KEY, "pos")


def judged(docs: DataFrame, benchmark: DataFrame, opt: PhraseIndex = PhraseIndex()) -> DataFrame:
    """id, row, doc_id, n_words, n_hit, item_ids (sorted strings) of every document."""
    docs = docs.select("doc_id", "text")
    windows = stage(item_windows(benchmark, opt), "phrase-windows")
    terms = stage(rarest_terms(docs, windows, opt), "phrase-terms")
    index = stage(postings(docs, terms, opt), "phrase-index")
    hits = stage(phrase_matches(docs, windows, index, terms, opt), "phrase-hits")
    items = hits.select(*KEY, F.explode(F.array_distinct(F.transform("hits", lambda h: h["win"]))).alias("win")).join(
        _small(windows.select("win", "item_id"), opt), "win").groupBy(*KEY).agg(
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    spans = hits.select(*KEY, covered(F.col("hits")).alias("n_hit"))
    lengths = index.where(F.col("term") == END).select(*KEY, "doc_id", F.col("pos").cast("long").alias("n_words"))
    out = lengths.join(spans, KEY, "left").join(items, KEY, "left")
    return out.select(*KEY, "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                      F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, opt: PhraseIndex = PhraseIndex()) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted strings) of every document."""
    return judged(docs, benchmark, opt).drop(*KEY)


def keep_clean(docs: DataFrame, benchmark: DataFrame, opt: PhraseIndex = PhraseIndex()) -> DataFrame:
    """Documents without any window of the benchmark, with their own columns."""
    found = stage(judged(docs, benchmark, opt).where("n_hit > 0").select(*(F.col(k).alias(f"__{k}") for k in KEY)).distinct(),
                  "phrase-contaminated")
    known = docs.withColumns({f"__{k}": c for k, c in zip(KEY, key_columns(), strict=True)})
    return known.join(_small(found, opt), [f"__{k}" for k in KEY], "left_anti").drop(*(f"__{k}" for k in KEY))
