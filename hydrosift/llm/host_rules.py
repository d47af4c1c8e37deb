"""Quality rules judged per document and per host.

Each document is counted natively (words, symbols, repeated lines, words in
repeated 5-word windows) and fails the base rules on its own.  The failures are
then summed per host, every host's failure rate is shrunk towards an empirical
beta prior fitted to all hosts' rates, and hosts whose shrunk rate exceeds a
threshold are rejected as a whole; the verdict is joined back to the documents.

Defined results for odd input: a NULL or blank text has no words and fails the
base rules; a NULL host is no host, so such documents are judged on their own;
repeated rows are judged each; an empty table gives an empty result; further
columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, let, stage, without

SYMBOL = r"[#*$%&|<>]"
WINDOW = 5


@dataclass(frozen=True)
class HostRules:
    """Thresholds: fewest words, highest percentage of words in repeated
    windows, highest shrunk failure rate of a host, and the bounds of the
    prior's strength in documents (the upper one stands for hosts that all
    fail alike, where the method of moments has no finite answer)."""

    min_words: int = 10
    max_repeat_pct: int = 20
    max_host_rate: float = 0.5
    min_prior_docs: float = 1.0
    max_prior_docs: float = 1000.0


def words_of(text: Column) -> Column:
    """Runs of non-whitespace (ASCII blank, tab to carriage return); NULL: none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITESPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _repeat_positions(grams: Column) -> Column:
    """Ascending starts of the windows that occur twice or more.

    Windows are sorted by (64-bit hash, start), so equal ones are neighbours;
    hashes are only ever compared within one text."""
    runs = lambda s: F.zip_with(
        s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    by_hash = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.sort_array(F.array_distinct(F.flatten(F.array_compact(let(by_hash, runs)))))


def repeat_words(words: Column) -> Column:
    """Words lying in some ``WINDOW``-word window found at least twice."""
    grams = F.transform(
        F.when(F.size(words) > WINDOW, F.sequence(F.lit(0), F.size(words) - WINDOW)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    covered = lambda p: F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))),
        F.lit(0), lambda acc, x: acc + x)
    return let(grams, lambda h: F.when(
        F.size(F.array_distinct(h)) < F.size(h), let(_repeat_positions(h), covered)).otherwise(0))


def document_counts(docs: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words and base_failed of every document, in one scan."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(words_of(F.col("text")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeat_words(w).cast("long").alias("n_repeat_words")))
    counted = docs.select(
        "doc_id", F.col("source").alias("host"), by_words.alias("w"),
        (F.size(F.split(text, SYMBOL)) - 1).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    n, rep = F.col("n_words"), F.col("n_repeat_words")
    return counted.select("doc_id", "host", "w.*", "n_symbols", "n_dup_lines").withColumn(
        "base_failed", (n < rules.min_words) | (100 * rep > rules.max_repeat_pct * n))


def host_verdicts(counts: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """host, host_rate (posterior mean of its failure rate) and host_failed.

    The beta prior has the mean and variance of the hosts' observed rates
    (method of moments).  Two map-side-combined aggregations; the second one
    reads one row per host."""
    hosts = counts.where(F.col("host").isNotNull()).groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("f"))
    rate = F.col("f") / F.col("n")
    moments = hosts.agg(F.avg(rate).alias("m"), F.avg(rate * rate).alias("m2")).select(
        "m", (F.col("m2") - F.col("m") * F.col("m")).alias("v"))
    row = moments.first()
    m, v = row["m"] or 0.0, row["v"] or 0.0
    strength = m * (1 - m) / v - 1 if v > 1e-12 else rules.max_prior_docs
    strength = min(max(strength, rules.min_prior_docs), rules.max_prior_docs)
    posterior = (F.col("f") + F.lit(m * strength)) / (F.col("n") + F.lit(strength))
    return hosts.select("host", F.round(posterior, 6).alias("host_rate")).withColumn(
        "host_failed", F.col("host_rate") > rules.max_host_rate)


def host_rules(docs: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """``document_counts`` with host_rate, host_failed and kept for every row.

    The counts are written once (narrow rows, no text) and read by both the
    host sums and the join.  A host's rows can be a third of the table, so the
    join is left to the planner: a sort-merge join whose skewed side is split."""
    counts = stage(document_counts(docs, rules), "host-rules")
    joined = counts.join(host_verdicts(counts, rules), "host", "left")
    failed = F.coalesce(F.col("host_failed"), F.lit(False))
    return joined.select(*counts.columns, "host_rate", failed.alias("host_failed"),
                         (~F.col("base_failed") & ~failed).alias("kept"))


def keep_passing(docs: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns.  Rows with one
    doc_id share a verdict: a rejected one takes the others along."""
    return without(docs, stage(host_rules(docs, rules).where("not kept").select("doc_id"), "host-rejected"))
