"""WARC archives of pages, read back and indexed by merging sorted runs.

Writing: a record per page.  Of records with equal payloads of at least a
hundred bytes the one with the smallest page_id is the response and the others
are revisits that refer to it.  Spark's text writer writes the files, with the
blank lines that end a WARC record as its line separator, so archives are
committed like any other Spark output, on any file system.  Files hold a bounded
amount of payload.

Reading: files are parsed record by record by their Content-Length, payload
digests are recomputed, and every file yields an index run: its captures sorted
by URL key and timestamp.

Index: runs are dealt to ranges of (URL key, timestamp, page_id); each range
merges its pieces of runs k ways with a loser tree, which gives captures in
global order.

Defined results for odd input: a NULL payload is empty; a NULL URL is left out
of the record and has an empty key (white space and control characters of a
URL are written as %20); repeated rows with one page_id give a record
each; an empty table writes nothing and gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, stage, stage_path

CRLF = "\r\n"
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"


@dataclass(frozen=True)
class WarcOptions:
    """Least payload of a revisit, payload bytes of a file (the largest page
    may come on top), captures of an index range, and revisits that may be
    broadcast."""

    revisit_bytes: int = 100
    file_bytes: int = 8 << 20
    range_rows: int = 200_000
    broadcast_rows: int = 1_000_000


def digests(pages: DataFrame) -> DataFrame:
    """page_id, digest (SHA-256 of the UTF-8 payload) and length in bytes."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("length"))


def revisits(known: DataFrame, opt: WarcOptions) -> DataFrame:
    """(page_id, digest, refers_to) of captures whose payload an earlier page has.

    One payload can be a third of all rows: the smallest page_id is a map-side
    combined minimum, and only repeated digests are joined back."""
    large = known.where(F.col("length") >= opt.revisit_bytes)
    first = large.groupBy("digest", "length").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where(
        "refers_to < last").drop("last")
    return large.join(first, ["digest", "length"]).where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a NULL value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def records(pages: DataFrame, referred: DataFrame) -> DataFrame:
    """One string per page: its record without the blank lines that end it.

    Pages carry no capture time, so a second of one fixed day, taken from the
    page_id, stands for it; captures of one second are told apart by page_id."""
    keyed = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html")).withColumn(
        "digest", F.sha2(F.col("html").cast("binary"), 256)).join(referred, ["page_id", "digest"], "left")
    again = F.col("refers_to").isNotNull()
    body = F.when(again, F.lit("")).otherwise(F.col("html"))
    size = lambda c: F.octet_length(c.cast("binary")).cast("string")
    urn = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    captured = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(86_400)))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), _line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", urn(F.col("page_id"))), _line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")),
        _line("WARC-Date", F.date_format(captured, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Profile", F.when(again, F.lit(REVISIT_PROFILE))), _line("WARC-Refers-To", F.when(again, urn(F.col("refers_to")))),
        _line("Content-Type", F.when(~again, F.lit("text/html; charset=utf-8"))), _line("X-Payload-Length", size(F.col("html"))),
        _line("Content-Length", size(body)), F.lit(CRLF))
    return keyed.select("page_id", F.concat(head, body).alias("value"))


def write_archives(pages: DataFrame, path: str, opt: WarcOptions = WarcOptions()) -> None:
    """Write one record per page into WARC files below ``path``."""
    known = stage(digests(pages), "warc-digests")
    referred = stage(revisits(known, opt), "warc-revisits")
    total = known.agg(F.sum("length")).first()[0] or 0
    if referred.limit(opt.broadcast_rows + 1).count() <= opt.broadcast_rows:
        referred = F.broadcast(referred)
    files = max(1, -(-total // opt.file_bytes))
    spread = records(pages, referred).repartition(files, F.xxhash64("page_id", F.length("value")))
    spread.select("value").write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, by Content-Length."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:end].decode().split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        start = end + 4
        size = int(headers["Content-Length"])
        if content[start + size:start + size + 4] != RECORD_END.encode():
            raise ValueError(f"record at byte {at} does not end where it says")
        yield headers, content[start:start + size]
        at = start + size + 4


def url_key(url: str | None) -> str:
    """Sort key of a URL: host from the top level down, then path and query;
    without scheme, user, ``www.``, default port and fragment, in lower case."""
    if not url:
        return ""
    rest = url.split("#", 1)[0].split("://", 1)[-1].lower()
    cut = min((k for k in map(rest.find, "/?") if k >= 0), default=len(rest))
    host, path = rest[:cut].rsplit("@", 1)[-1], rest[cut:] or "/"
    name, _, port = host.partition(":")
    labels = name.removeprefix("www.").split(".")[::-1]
    return ",".join(labels) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + path


def _id(urn: str | None) -> int | None:
    text = (urn or "").removeprefix(f"<{URN}").removesuffix(">")
    return int(text) if text else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: run (its file), seq (its place in the file's captures
    sorted by URL key, timestamp and page_id) and what the record says; the
    digest of a response is taken from its block and must agree."""
    names = ["run", "seq", "url_key", "captured", "page_id", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def capture(headers, block):
        said = headers["WARC-Payload-Digest"].removeprefix("sha256:")
        revisit = headers["WARC-Type"] == "revisit"
        digest = said if revisit else hashlib.sha256(block).hexdigest()
        size = int(headers["X-Payload-Length"]) if revisit else len(block)
        if digest != said:
            raise ValueError(f"payload of {headers['WARC-Record-ID']} does not have its digest")
        return (url_key(headers.get("WARC-Target-URI")), headers["WARC-Date"], _id(headers["WARC-Record-ID"]),
                headers["WARC-Type"], size, digest, _id(headers.get("WARC-Refers-To")))

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                found = sorted((capture(*r) for r in parse(gzip.decompress(content.as_py()))), key=order_key)
                rows = [(name, k, *c) for k, c in enumerate(found)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                    zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.transform(in_batches, run, "run string, seq long, url_key string, captured string, page_id long, "
                           "record_type string, payload_bytes long, payload_digest string, refers_to long")


def order_key(capture: tuple) -> tuple:
    """URL key, timestamp, page_id (NULL first)."""
    return capture[0], capture[1], capture[2] is not None, capture[2] or 0


class LoserTree:
    """Merges sorted lists: every inner node keeps the loser of its match, and
    the winner's next item plays only the matches on its way to the root."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = runs
        self.at = [0] * len(runs)
        self.loser = [-1] * max(len(runs), 1)
        self.winner = -1
        for k in range(len(runs)):
            self._play(k)

    def _key(self, k: int) -> tuple:
        at = self.at[k]
        return (0, *self.runs[k][at][:1], k) if at < len(self.runs[k]) else (1,)

    def _play(self, k: int) -> None:
        node = (k + len(self.runs)) // 2
        while node:
            other = self.loser[node]
            if other == -1:
                self.loser[node] = k
                return
            if self._key(other) < self._key(k):
                self.loser[node], k = k, other
            node //= 2
        self.winner = k

    def __iter__(self) -> Iterator[tuple]:
        for _ in range(sum(map(len, self.runs))):
            k = self.winner
            yield self.runs[k][self.at[k]]
            self.at[k] += 1
            self._play(k)


def merged_index(captures: DataFrame, opt: WarcOptions = WarcOptions()) -> DataFrame:
    """The captures in global order of URL key, timestamp and page_id."""
    fields = [f.name for f in captures.schema]
    rows = captures.count()
    ranges = max(1, -(-rows // opt.range_rows))

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        keys = list(zip(*(table.column(c).to_pylist() for c in ("url_key", "captured", "page_id")), strict=True))
        names, of = np.unique(table.column("run").to_numpy(), return_inverse=True)
        by_run = np.lexsort((table.column("seq").to_numpy(), of))
        cuts = np.searchsorted(of[by_run], np.arange(len(names) + 1))
        pieces = [[(order_key(keys[r]), int(r)) for r in by_run[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]
        order = pa.array([r for _, r in LoserTree(pieces)], pa.int64())
        yield from table.take(order).combine_chunks().to_batches(max_chunksize=20_000)

    dealt = captures.repartitionByRange(ranges, F.col("url_key").asc_nulls_first(), F.col("captured"), F.col("page_id").asc_nulls_first())
    return dealt.transform(in_batches, run, captures.schema).select(*fields)


def archive_pages(pages: DataFrame, opt: WarcOptions = WarcOptions()) -> DataFrame:
    """Write archives of ``pages`` to the shared folder, read them back and
    return their captures from the merged index."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    path = stage_path(spark, "warc")
    write_archives(pages, path, opt)
    return merged_index(stage(read_archives(spark, path), "warc-captures"), opt).drop("run", "seq")
