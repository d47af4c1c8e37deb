"""Packing tokenized documents into sequences by exact complements.

Documents become token pieces of at most a sequence's length.  Packing works on
how many pieces there are of each length, not on the pieces: the longest length
left opens a sequence, and its gap is looked up among the sums of one, two and
three available lengths; a combination that fills it exactly is used as often as
the counts allow.  Where no sum fits exactly the longest fitting piece goes in
(best fit) and the rest of the gap is looked up again.  The plan is a list of
patterns with counts, whose size depends on the sequence length only.

Pieces then get their places: each is numbered within its length (counted per
length and hash bucket, so that no task holds a whole length), and the number
selects the pattern, the sequence and the offset.

Defined results for odd input: a NULL or empty text is one piece holding the end
token; rows that repeat a doc_id are packed each; a NULL doc_id is kept as it is;
an empty table gives an empty result; further columns are ignored; texts of any
length are cut into pieces, and one with white space running on for 20,000
characters is encoded by the tokenizers library (the same ids, more slowly).
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, stage


@dataclass(frozen=True)
class Packing:
    """Tokens of a sequence, the token after each document, the vocabulary file
    (byte-level ranks, with the added tokens in the .json file beside it; the
    path must be readable by the executors) and the pieces numbered in one bucket."""

    length: int = 1024
    end_id: int = 2
    vocabulary: str = ""
    bucket_rows: int = 50_000


LONG_RUN = 20_000
LONG_BLANK = re.compile(r"\s{%d}" % LONG_RUN)


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens(path: str) -> dict[str, int]:
    """The tokens that the vocabulary's .json file adds to its ranks."""
    import json
    import os
    described = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(described):
        return {}
    with open(described, encoding="utf-8") as file:
        added = json.load(file).get("added_tokens", [])
    if any(t.get(rule) for t in added for rule in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{described} adds tokens that match with more than their text")
    return {t["content"]: t["id"] for t in added}


def load_encoder(path: str):
    """A byte-level encoder from a rank file and the added tokens beside it."""
    import base64

    import public_tokenizers
    import tiktoken
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(path))


def has_long_run(text: str) -> bool:
    """Whether white space runs on for longer than the fast encoder's pattern can
    follow (its stack ends at about a million characters)."""
    return len(text) >= LONG_RUN and LONG_BLANK.search(text) is not None


def load_library(path: str):
    """The tokenizers library on the .json file beside a rank file."""
    import os

    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(os.path.splitext(path)[0] + ".json")
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encode_text(encoder, text: str) -> list[int]:
    """The ids of a text; where it spells an added token, that token's id."""
    if any(token in text for token in encoder.special_tokens_set):
        return encoder.encode(text, allowed_special="all", disallowed_special=())
    return encoder.encode_ordinary(text)


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first takes the remainder."""
    first = n % length or min(n, length)
    edges = [0, *range(first, n + 1, length)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def token_pieces(docs: DataFrame, opt: Packing, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked) of every piece."""
    path = opt.vocabulary or default_vocabulary()
    length, end_id = opt.length, opt.end_id
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
              ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if with_ids else [])
    schema = pa.schema(fields)

    def run(batches):
        encoder, library = load_encoder(path), None
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if has_long_run(text or ""):
                    library = library or load_library(path)
                    found = library.encode(text, add_special_tokens=False).ids
                else:
                    found = encode_text(encoder, text or "")
                ids = np.array([*found, end_id], dtype="<u4")
                for k, (a, n) in enumerate(cut(len(ids), length)):
                    part = ids[a:a + n]
                    row = (doc_id, k, a, n, zlib.crc32(part.tobytes()))
                    rows.append((*row, part.astype(np.int32)) if with_ids else row)
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    ids = ", ids array<int>" if with_ids else ""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(in_batches,
        run, f"doc_id long, piece int, start long, length long, ids_crc32 long{ids}")


class Complements:
    """Available lengths with counts, and look-ups of sums that fill a gap."""

    def __init__(self, counts: dict[int, int], length: int):
        self.count = np.zeros(length + 1, np.int64)
        for n, c in counts.items():
            self.count[n] = c

    def one(self, gap: int) -> tuple[int, ...]:
        return (gap,) if self.count[gap] else ()

    def two(self, gap: int) -> tuple[int, ...]:
        """The pair summing to the gap with the longest member."""
        a = np.arange((gap + 1) // 2, gap)
        ok = (self.count[a] > 0) & (self.count[gap - a] > (a == gap - a))
        hits = np.flatnonzero(ok)
        return (int(a[hits[-1]]), int(gap - a[hits[-1]])) if len(hits) else ()

    def three(self, gap: int) -> tuple[int, ...]:
        """The triple summing to the gap with the longest member."""
        for a in np.flatnonzero(self.count[:gap - 1])[::-1]:
            self.count[a] -= 1
            rest = self.two(gap - int(a))
            self.count[a] += 1
            if rest:
                return (int(a), *rest)
        return ()

    def fill(self, gap: int) -> tuple[int, ...]:
        """Lengths that fill the gap, exactly if some sum of up to three does
        (after the longest fitting pieces, where none does at once)."""
        chosen: list[int] = []
        while gap > 0:
            exact = self.one(gap) or self.two(gap) or self.three(gap)
            fits = np.flatnonzero(self.count[:gap + 1])
            take = exact or ((int(fits[-1]),) if len(fits) else ())
            if not take:
                break
            for n in take:
                self.count[n] -= 1
            chosen += take
            gap -= sum(take)
        for n in chosen:
            self.count[n] += 1
        return tuple(chosen)


def pack_lengths(counts: dict[int, int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences), using every piece.

    Each pattern is repeated until one of its lengths runs short, so there are
    few more patterns than lengths."""
    left = Complements(counts, length)
    plan = []
    while True:
        have = np.flatnonzero(left.count)
        if not len(have):
            return plan
        longest = int(have[-1])
        left.count[longest] -= 1
        pattern = (longest, *left.fill(length - longest))
        left.count[longest] += 1
        used = np.bincount(pattern, minlength=length + 1)
        times = int((left.count[used > 0] // used[used > 0]).min())
        left.count -= times * used
        plan.append((pattern, times))


def place_table(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first number, first sequence, offset): the pieces of a
    length numbered from ``first number`` on go to consecutive sequences."""
    rows, taken, sequence = [], {}, 0
    for pattern, times in plan:
        offset = 0
        for n in pattern:
            rows.append((n, taken.get(n, 0), sequence, offset))
            taken[n] = taken.get(n, 0) + times
            offset += n
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def numbered(pieces: DataFrame, total: int, opt: Packing) -> DataFrame:
    """``pieces`` with ``number``: 0, 1, ... within each length."""
    buckets = max(1, -(-total // opt.bucket_rows))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = dealt.groupBy("length", "bucket").count().selectExpr(
        "length", "bucket", "sum(count) over (partition by length order by bucket) - count as before")
    ranked = dealt.selectExpr("*", "row_number() over (partition by length, bucket order by doc_id, piece, ids_crc32) - 1 as nth")
    return ranked.join(before, ["length", "bucket"]).withColumn("number", F.col("before") + F.col("nth")).drop("bucket", "before", "nth")


def pack(docs: DataFrame, opt: Packing = Packing(), with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with their sequence_id and offset."""
    pieces = stage(token_pieces(docs, opt, with_ids), "pack-pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most opt.length rows
    places = docs.sparkSession.sparkContext.broadcast(place_table(pack_lengths(counts, opt.length)))
    columns = [f for f in pieces.schema.names]

    def run(batches):
        table = places.value
        span = int(table[:, 1].max(initial=0)) + 1
        for batch in batches:
            n, number = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "number"))
            span_here = max(span, int(number.max(initial=0)) + 1)
            at = np.searchsorted(table[:, 0] * span_here + table[:, 1], n * span_here + number, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(table[at, 2] + number - table[at, 1]), pa.array(table[at, 3])],
                names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered(pieces, sum(counts.values()), opt).select(*columns, F.col("number").cast("long").alias("number")).transform(in_batches,
        run, f"{schema}, sequence_id long, offset long")
