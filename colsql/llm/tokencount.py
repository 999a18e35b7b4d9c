"""Token counts by a linear longest-match automaton: the lengths of greedy word pieces, without the pieces."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Words whose counts a task remembers.
MEMORY = 300_000
#: Added to a word's last byte: where a vocabulary marks the ends of words, that byte is a symbol of its own.
LAST = 256


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + k)] = b
    return out


def vocabulary(path: str | None = None) -> tuple[list[tuple[int, ...]], bool]:
    """The pieces of a byte-level tokenizers file as symbols, and whether it marks the ends of words: then the last byte of a
    marked piece, and of every word, has LAST added. All single bytes are pieces, so every word can be cut."""
    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters, mark, out = byte_letters(), model.get("end_of_word_suffix") or "", []
    for p in model["vocab"]:
        body = p.removesuffix(mark) if mark else p
        if body and all(x in letters for x in body):
            symbols = [letters[x] for x in body]
            symbols[-1] += LAST * (body != p)
            out.append(tuple(symbols))
    return list(dict.fromkeys(out)), bool(mark)


def symbols_of(word: bytes, marked: bool) -> Iterable[int]:
    return (*word[:-1], word[-1] + LAST) if marked and word else word


class Automaton:
    """A trie of the pieces. Each node has a failure link and the number of pieces that are popped when it is followed: what
    the longest-match rule cuts off the node's string before what is left is the link's."""

    def __init__(self, pieces: Iterable[tuple[int, ...]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        final = {0: False}
        for p in pieces:
            at = 0
            for x in p:
                if x not in self.next[at]:
                    self.next[at][x] = len(self.next)
                    final[len(self.next)] = False
                    self.next.append({})
                at = self.next[at][x]
            final[at] = True
        self.fail, self.pops = [-1] * len(self.next), [0] * len(self.next)
        level = [(0, x, v) for x, v in self.next[0].items()]
        while level:
            for parent, x, v in level:
                if final[v]:
                    self.fail[v], self.pops[v] = 0, 1
                    continue
                z, n = self.fail[parent], self.pops[parent]
                while z >= 0 and x not in self.next[z]:
                    n += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = self.next[z][x], n
            level = [(v, x, w) for _, _, v in level for x, w in self.next[v].items()]

    def count(self, symbols: Iterable[int]) -> int | None:
        """The number of greedy longest-match pieces of a string, each symbol read once; None if it can't be cut into pieces."""
        at, n, next_, fail, pops = 0, 0, self.next, self.fail, self.pops
        for x in symbols:
            while x not in next_[at]:
                n += pops[at]
                at = fail[at]
                if at < 0:
                    return None
            at = next_[at][x]
        while at:
            n += pops[at]
            at = fail[at]
            if at < 0:
                return None
        return n


def greedy(symbols: tuple[int, ...], pieces: set[tuple[int, ...]]) -> int | None:
    """The same by trying each length: for tests."""
    at = n = 0
    while at < len(symbols):
        end = next((e for e in range(len(symbols), at, -1) if symbols[at:e] in pieces), None)
        if end is None:
            return None
        at, n = end, n + 1
    return n


@lru_cache(maxsize=1)
def automaton_of(path: str | None) -> tuple[Automaton, bool, dict[bytes, int]]:
    """An automaton, whether it marks ends, and the counts of words seen, kept by a worker for its next task."""
    pieces, marked = vocabulary(path)
    return Automaton(pieces), marked, {}


def _counted(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    automaton, marked, known = automaton_of(path)
    for b in batches:
        words, total, unknown, most = [], [], [], []
        for text in b.column(1).to_pylist():
            ws = text.lower().split() if text else []
            n = bad = high = 0
            for w in ws:
                k = known.get(w)
                if k is None:
                    if len(known) >= MEMORY:
                        known.clear()
                    k = automaton.count(symbols_of(w, marked)) or -1
                    if len(w) <= 256:
                        known[w] = k
                if k < 0:
                    bad, k = bad + 1, 1
                n += k
                high = max(high, k)
            words.append(len(ws)), total.append(n), unknown.append(bad), most.append(high)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (words, total, unknown, most))], ["doc_id", "n_words", "n_tokens", "n_unknown", "longest"])


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown, longest) of every row: words (A-Z lower-cased, between ASCII white space), their
    greedy pieces, words that can't be cut into pieces (they count as one token), and the most pieces of a word.

    Null, empty and blank texts have 0. Repeated rows have a result each; extra columns are not looked at; an empty table gives no rows.
    """
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), partial(_counted, path=path), "doc_id long, n_words long, n_tokens long, n_unknown long, longest long")
