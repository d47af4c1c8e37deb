"""Byte-level BPE as a tokenization automaton.

The automaton reads tokens: one state with an arc for each byte at first.  Each
merge (u, v) in turn applies a merge gadget: the state behind u loses its arc v,
every state with an arc u gets an arc uv beside it, and uv leads to a copy of the
state that v led to.  The finished automaton is deterministic and accepts exactly
the right tokenizations, one for each string of bytes; as it has a path for each
prefix too, one token ends the path of every prefix.

Copies and parallel arcs are kept as what the gadgets did, not as 50,000 x 50,000
arcs: per token the step that made it and its two parts, per lost arc the step
that took it.  ``Automaton.arc`` follows these tables back: the state behind a
token is the copy of the state behind its right part, an arc stands where its
left part stood when it was laid.  Answers are kept as transitions.

Texts are split at the added tokens, then into words by the vocabulary's pattern;
each word is run through the table from left to right, in time linear in its
bytes.  Words met before come from a bounded memo.  Decoding emits the labels.

Defined results for odd input: a NULL or empty text has no ids and decodes to the
empty text; rows that repeat a doc_id are encoded each, a NULL doc_id is kept; a
run of blanks or letters of any length is one word and takes linear time; ids
without a label decode to nothing, bytes that are no UTF-8 to U+FFFD; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_batches
from .words import slices

# Fixed value: the pattern of words that byte-level vocabularies of this kind use.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with other characters are split by the library itself, whose tables of
#: letters may be of another Unicode version.
SETTLED = r"[^\x00-ԯ -⁯]"
NEVER = 1 << 40


@dataclass(frozen=True)
class Vocabulary:
    """The tokenizer's file (read on the driver) and how many words of at most
    ``memo_chars`` characters a task remembers."""

    path: str = ""
    memo_words: int = 400_000
    memo_chars: int = 64


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file:
    itself where it is printable Latin-1, else the next one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def stands(made: list[int], left: list[int], right: list[int], lost: dict[int, int], s: int, t: int, before: int) -> bool:
    """Whether the state behind s had an arc t before a half step: step k copies
    the state of its right part at 2 k and lays its arcs at 2 k + 1."""
    while True:
        if 2 * lost.get(s << 20 | t, NEVER) < before:
            return False
        if made[s] >= made[t]:
            if not made[s]:
                return True
            before = min(before, 2 * made[s])
            s = right[s]
        else:
            before = min(before, 2 * made[t] + 1)
            t = left[t]


def compile_tables(path: str) -> dict:
    """The automaton of a tokenizer file, as plain tables.

    labels[t], made[t], left[t], right[t] of token t (bytes are made at step 0),
    lost[(u, v)] = step, as u << 20 | v; added tokens by their text.  A merge of
    parts that never stand side by side changes nothing and makes no token."""
    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    model, split = described["model"], described.get("pre_tokenizer") or {}
    plain = all(not model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or described.get("normalizer") or not plain:
        raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
    if any(t.get(rule) for t in described["added_tokens"] for rule in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path} adds tokens that match with more than their text")
    names, vocab = byte_names(), model["vocab"]
    size = max([*vocab.values(), *(t["id"] for t in described["added_tokens"])]) + 1
    labels: list[bytes] = [b""] * size
    for name, t in vocab.items():
        labels[t] = bytes(names[c] for c in name)
    made, left, right, lost = [0] * size, [-1] * size, [-1] * size, {}
    for step, (a, b) in enumerate((m if isinstance(m, list) else m.split(" ") for m in model["merges"]), start=1):
        u, v, t = vocab[a], vocab[b], vocab[a + b]
        if made[t]:
            raise ValueError(f"{path} makes the token {a + b!r} twice")
        if any(len(x) > 1 and not made[vocab[x]] for x in (a, b)) or not stands(made, left, right, lost, u, v, 2 * step):
            continue
        made[t], left[t], right[t], lost[u << 20 | v] = step, u, v, step
    for t in described["added_tokens"]:
        labels[t["id"]] = t["content"].encode()
    tokens = [t for name, t in vocab.items() if made[t] or len(name) == 1]
    return {"labels": labels, "made": made, "left": left, "right": right, "lost": lost, "tokens": tokens,
            "added": {t["content"]: t["id"] for t in described["added_tokens"]}}


class Automaton:
    """Transitions by state (the last token; -1 at the start) and token."""

    def __init__(self, tables: dict, memo_words: int = 400_000, memo_chars: int = 64):
        import regex
        self.labels, self.made = tables["labels"], tables["made"]
        self.left, self.right, self.lost = tables["left"], tables["right"], tables["lost"]
        self.added = tables["added"]
        self.token = {self.labels[t]: t for t in tables["tokens"]}
        self.reach: dict[bytes, int] = {}  # longest label that starts with these two bytes
        for label in self.token:
            self.reach[label[:2]] = max(self.reach.get(label[:2], 1), len(label))
        self.arcs: dict[int, bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.memo_words, self.memo_chars = memo_words, memo_chars
        self.word, self.unsettled = regex.compile(WORD), regex.compile(SETTLED)
        self.splits = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.library = self.emitted = None

    def arc(self, state: int, token: int) -> bool:
        """Whether the state behind token ``state`` has an arc ``token``."""
        key = state << 20 | token
        known = self.arcs.get(key)
        if known is not None:
            return known
        found = stands(self.made, self.left, self.right, self.lost, state, token, NEVER)
        if len(self.arcs) > 2_000_000:
            self.arcs.clear()
        self.arcs[key] = found
        return found

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        """The accepted path of a word.  From each place the longest token with an
        arc comes first; a place from which no token leads on is left for good, as
        only one path leads there."""
        n, token_of, reach, arcs = len(data), self.token.get, self.reach.get, self.arcs
        whole = token_of(data)
        if whole is not None:
            return (whole,)
        at, end, state, path, starts, closed = 0, 0, -1, [], [], set()
        while at < n:
            if not end:
                end = min(n, at + reach(data[at:at + 2], 1))
            while end > at:
                token = token_of(data[at:end])
                if token is not None and end not in closed:
                    known = not at or arcs.get(state << 20 | token)
                    if self.arc(state, token) if known is None else known:
                        path.append(token)
                        starts.append(at)
                        at, end, state = end, 0, token
                        break
                end -= 1
            else:
                closed.add(at)
                end, at = at - 1, starts.pop()
                path.pop()
                state = path[-1] if path else -1
        return tuple(path)

    def paths(self, words: list[str]) -> list[tuple[int, ...]]:
        """The paths of different words; new ones are run in order, as words that
        begin alike use the same entries of the tables."""
        known = list(map(self.memo.get, words))
        # a word of a text split at the added tokens holds none but itself
        new = {w: (self.added[w],) if w in self.added else self.encode_bytes(w.encode())
               for w in sorted(w for w, p in zip(words, known, strict=True) if p is None)}
        if len(self.memo) + len(new) > self.memo_words:
            self.memo.clear()
        self.memo.update((w, p) for w, p in islice(new.items(), self.memo_words) if len(w) <= self.memo_chars)
        return [new[w] if p is None else p for w, p in zip(words, known, strict=True)]

    def split(self, text: str) -> list[str]:
        if not self.unsettled.search(text):
            return self.word.findall(text)
        if self.library is None:
            from tokenizers import pre_tokenizers
            self.library = pre_tokenizers.ByteLevel(add_prefix_space=False)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def words(self, text: str) -> list[str]:
        """Words and added tokens of a text."""
        if self.splits is None:
            return self.split(text)
        parts = self.splits.split(text)
        return self.split(text) if len(parts) == 1 else [
            w for p in parts for w in ((p,) if p in self.added else self.split(p))]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and where each text's begin (and the last end).
        Equal words of the texts are looked up once."""
        lists = [self.words(text) for text in texts]
        coded = pa.array(chain.from_iterable(lists), pa.string()).dictionary_encode()
        paths = self.paths(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, paths), np.int64, len(paths))
        flat, first = np.fromiter(chain.from_iterable(paths), np.int32, int(size.sum())), np.cumsum(size) - size
        word = coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(size[word])])
        ids = flat[np.repeat(first[word] - ends[:-1], size[word]) + np.arange(ends[-1])]
        return ids, ends[np.cumsum([0, *map(len, lists)])]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The labels of the ids from each end to the next, as texts."""
        n = len(self.labels)
        if self.emitted is None:
            self.emitted = pa.array([*self.labels, b""], pa.large_binary())
        out = self.emitted.take(pa.array(np.where((ids >= 0) & (ids < n), ids, n)))
        data, at = out.buffers()[2], np.frombuffer(out.buffers()[1], np.int64, len(ids) + 1)[ends].tolist()
        return [bytes(data[a:b]).decode("utf-8", "replace") if b > a else "" for a, b in zip(at, at[1:], strict=False)]

    def decode(self, ids) -> str:
        return self.decode_all(np.asarray(ids, np.int64), np.array([0, len(ids)]))[0]


def _tables(df: DataFrame, opt: Vocabulary):
    path = opt.path
    if not path:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.json")
    return df.sparkSession.sparkContext.broadcast(compile_tables(path))


def encode(docs: DataFrame, opt: Vocabulary = Vocabulary(), text_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, ids) of every text; texts are encoded together up to ``text_bytes``."""
    tables, memo = _tables(docs, opt), (opt.memo_words, opt.memo_chars)

    def run(batches):
        automaton = Automaton(tables.value, *memo)
        for batch in batches:
            for part in slices(batch, "text", text_bytes):
                ids, ends = automaton.encode_all([text or "" for text in part.column(1).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, opt: Vocabulary = Vocabulary()) -> DataFrame:
    """(doc_id, ids, text) of every list of ids."""
    tables = _tables(encoded, opt)

    def run(batches):
        automaton = Automaton(tables.value)
        for batch in batches:
            lists = batch.column(1)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            texts = pa.array(automaton.decode_all(ids, np.cumsum([0, *sizes])), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return in_batches(encoded.select("doc_id", "ids"), run, f"doc_id {kind}, ids array<int>, text string")
