"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a text: at-signs, plus signs,
digits, URL schemes and cue words of identifiers.  From each anchor a small
deterministic parser for its kind expands to the exact boundaries and validates
them.  Parsers run left to right and never re-read what a kind has consumed, so
the work is linear in the text.

Kinds: email, ip, card and phone have fixed patterns (leftmost and
non-overlapping per kind; a match that fails its check is dropped and not
retried).  Two more are added: url (an address with user information before its
host) and account (an identifier or secret after a cue word).

Defined results for odd input: a NULL text is an empty one and has no spans;
repeated rows get a row each; an empty table gives an empty result; NULLs in
other columns and further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches
from .words import slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")

# What a kind may consist of.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = "0123456789"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
USER_URL = re.compile(r"://[A-Za-z0-9._~%!$&'()*+,;=:-]+@(?:[A-Za-z0-9.-]+|\[[0-9A-Fa-f:.]+\])(?::[0-9]+)?")
IDENTIFIER = re.compile(r"(?:[ \t]++(?:no|nr|number|id))?\.?[ \t]*+[:=#]?+[ \t]*+[\"']?+([A-Za-z0-9](?:[ -]?[A-Za-z0-9]){5,33})(?![A-Za-z0-9])")
SECRET = re.compile(r"[\"']?+[ \t]*+[:=][ \t]*+[\"']?+([A-Za-z0-9_+/.=-]{8,})")
IDENTIFIER_CUES = ("account", "acct", "iban", "ssn", "passport")
SECRET_CUES = ("token", "password", "passwd", "secret", "api_key", "apikey", "access_key")
SCHEMES = ("http", "https", "ftp", "sftp", "ssh", "smtp", "imap", "ldap", "mysql", "postgres", "mongodb", "redis")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int

    def __str__(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


def build_anchors():
    """The automaton; values are (family, length of the anchor)."""
    import ahocorasick
    found = ahocorasick.Automaton()
    for char in DIGITS:
        found.add_word(char, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for scheme in SCHEMES:
        for form in (scheme, scheme.upper()):
            found.add_word(f"{form}://", ("scheme", len(form) + 3))
    for family, cues in (("identifier", IDENTIFIER_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                found.add_word(form, (family, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def iban(value: str) -> bool:
    """The check digits of an international account number (remainder 1 of 97)."""
    if not (15 <= len(value) <= 34 and value[:2].isalpha() and value[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


class Scanner:
    """Spans of one text after another."""

    def __init__(self):
        self.anchors = build_anchors()

    def spans(self, text: str) -> list[Span]:
        out: dict[str, list[Span]] = {kind: [] for kind in KINDS}
        done = dict.fromkeys((*KINDS, "refused"), 0)
        for last, (family, size) in self.anchors.iter(text):
            at = last - size + 1
            if family == "digit":
                if at >= done["card"]:
                    self._card(text, at, out, done)
                if at >= done["ip"] and (at == done["ip"] or text[at - 1] not in DIGITS or at == 0):
                    self._ip(text, at, out, done)
            elif family == "at":
                self._email(text, at, out, done)
            elif family == "plus":
                if at >= done["phone"]:
                    self._phone(text, at, out, done)
            elif family == "scheme":
                self._url(text, at, last - 2, out, done)
            elif at >= done["account"] and not (at and text[at - 1].isalnum()):
                self._account(family, text, last + 1, out, done)
        return [s for kind in KINDS for s in out[kind]]

    def _email(self, text, at, out, done):
        start = at
        while start > done["email"] and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done["email"] = domain.end()
            out["email"].append(Span("email", start, domain.end()))

    def _ip(self, text, at, out, done):
        m = IP.match(text, at)
        if m:
            done["ip"] = m.end()
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
                out["ip"].append(Span("ip", m.start(), m.end()))

    def _card(self, text, at, out, done):
        m = CARD.match(text, at)
        done["card"] = m.end() if m else at + 1
        if m and m.end() - at <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(Span("card", at, m.end()))

    def _phone(self, text, at, out, done):
        m = PHONE.match(text, at)
        if m:
            done["phone"] = m.end()
            if 9 <= sum(c in DIGITS for c in m.group()) <= 15:
                out["phone"].append(Span("phone", at, m.end()))

    def _url(self, text, at, colon, out, done):
        m = USER_URL.match(text, colon)
        if m and at >= done["url"] and not (at and text[at - 1].isalnum()):
            done["url"] = m.end()
            out["url"].append(Span("url", at, m.end()))

    def _account(self, family, text, after, out, done):
        if family == "secret" and after < done["refused"]:
            return  # inside a refused value, of which only a part could follow
        m = (SECRET if family == "secret" else IDENTIFIER).match(text, after)
        if not m:
            return
        value = m.group(1).replace(" ", "").replace("-", "")
        digits = sum(c in DIGITS for c in value)
        if iban(value) or (digits >= 2 if family == "secret" else digits >= 6 and 2 * digits >= len(value)):
            done["account"] = m.end(1)
            out["account"].append(Span("account", m.start(1), m.end(1)))
        elif family == "secret":
            done["refused"] = m.end(1)


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, as ``<KIND>`` of
    the one that starts first (the longest among equals)."""
    out, at, end = [], 0, -1
    for s in sorted(spans, key=lambda s: (s.start, -s.end, KINDS.index(s.kind))):
        if s.start >= end:
            out += [text[at:s.start], f"<{s.kind.upper()}>"]
        end = max(end, s.end)
        at = end
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row."""
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE_KINDS),
                        ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    spans = scanner.spans(text or "")
                    base = [s for s in spans if s.kind in BASE_KINDS]
                    rows.append((doc_id, *(sum(s.kind == k for s in base) for k in BASE_KINDS),
                                 hashlib.sha256(",".join(map(str, base)).encode()).hexdigest(), ",".join(map(str, spans))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    counts = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(in_batches,
        run, f"doc_id long, {counts}, base_sha256 string, spans string")


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` masked and ``n_chars`` brought up to
    date; NULL texts stay NULL, other columns stay as they are."""
    names = docs.columns

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t if t is None else mask(t, scanner.spans(t)) for t in part.column("text").to_pylist()]
                yield part.set_column(names.index("text"), "text", pa.array(texts, pa.string()))

    masked = docs.transform(in_batches, run, docs.schema)
    if "n_chars" in names:
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(
            F.length("text")).cast(docs.schema["n_chars"].dataType)).select(*names)
    return masked
