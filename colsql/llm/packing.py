"""Packing of documents into fixed windows of tokens by an order-preserving dynamic program."""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator, Sequence
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import map_arrow
from .tokencount import byte_letters

WINDOW, END = 1024, 0
#: What a cut costs, in tokens of padding: inside a sentence, and between sentences of a document; and what each window costs, so that
#: short windows, though they need no padding at a power of two, aren't free. On sf0.01 these leave 1.0 % padding; of 992 windows 34
#: are short, and 176 cuts of 894 are inside a sentence.
INSIDE, BETWEEN, EACH = 64, 32, 64
#: Tokens that one dynamic program sees. What its last windows hold is carried to the next.
BLOCK = 1 << 17


class Encoder:
    """Token ids of texts, as little-endian 32-bit numbers: those that tokenizers gives for its file without special tokens.

    A byte-level file whose ids are ranks of merges is run by tiktoken, from the file's own vocabulary: the same ids, at a
    fraction of the time. Texts that hold an added token's string, and files of any other kind, are left to tokenizers.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.added = [x["content"] for x in file["added_tokens"]]
        self.fast = self._fast(file)

    def _fast(self, file: dict) -> tiktoken.Encoding | None:
        model, split = file["model"], file["pre_tokenizer"] or {}
        if model.get("type") != "BPE" or file["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
            return None
        if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        letters, vocab = byte_letters(), {t: i for t, i in model["vocab"].items() if t not in self.added}
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(set(merged)) or len(merged) + 256 != len(vocab) or not all(x in letters for t in vocab for x in t):
            return None
        ranks = {bytes(letters[x] for x in t): i for t, i in vocab.items()}
        return tiktoken.Encoding("of_file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: Sequence[str]) -> list[bytes]:
        out = [None if self.fast is None or any(x in t for x in self.added) else self.fast.encode_to_numpy(t, disallowed_special=()).astype("<u4").tobytes() for t in texts]
        left = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(left, self.tokenizer.encode_batch([texts[i] for i in left], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def sentence_ends(self) -> np.ndarray:
        """For each id, whether a sentence can end with it."""
        n = self.tokenizer.get_vocab_size()
        out = np.zeros(n, bool)
        for i in range(n):
            token = self.tokenizer.id_to_token(i) or ""
            out[i] = token.endswith((".", "!", "?", "Ċ"))  # the last stands for a line feed
        return out


@lru_cache(maxsize=1)
def encoder_of(path: str) -> tuple[Encoder, np.ndarray]:
    """An encoder and its sentence ends, kept by a worker for its next task."""
    encoder = Encoder(path)
    return encoder, encoder.sentence_ends()


def padding(length: int, window: int = WINDOW) -> int:
    return 0 if length & (length - 1) == 0 else window - length


def plan(cuts: Sequence[int], penalties: Sequence[float], window: int = WINDOW) -> list[int]:
    """The cheapest choice among the places to cut (ascending; the first and the last are always taken), windows no longer
    than window: least sum of padding, penalties of the places taken, and EACH for each window. Besides cuts, the place a
    full window after one of them can be cut, at the price INSIDE.

    best[j] = penalty + EACH + window - place[j] + min(best[i] + place[i]), over places i that the window reaches: the
    least is kept by a monotone queue. Windows of a power of two need no padding; those that start at a place are tried as
    well. Neighbouring cuts may not be further apart than window.
    """
    place, best, back = [cuts[0]], [0.0], [0]
    queue, full = deque([(float(cuts[0]), 0)]), deque([(cuts[0] + window, 0)])
    at, last = {cuts[0]: 0}, cuts[-1]
    powers = [1 << k for k in range(window.bit_length()) if min(32, window) <= 1 << k < window]

    def put(c: int, cost: float, i: int) -> None:
        j = len(place)
        place.append(c), best.append(cost), back.append(i)
        at[c] = j
        value = cost + c
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))

    for c, penalty in zip(cuts[1:], penalties[1:], strict=True):
        while full and full[0][0] <= c:
            f, i = full.popleft()
            if f < c and f < last:
                put(f, best[i] + INSIDE + EACH, i)
        while place[queue[0][1]] < c - window:
            queue.popleft()
        cost, i = queue[0][0] + window - c, queue[0][1]
        for p in powers:
            k = at.get(c - p)
            if k is not None and best[k] < cost:
                cost, i = best[k], k
        k = at.get(c - window)
        if k is not None and best[k] < cost:
            cost, i = best[k], k
        put(c, cost + penalty + EACH, i)
        full.append((c + window, at[c]))
    out, j = [], len(place) - 1
    while j:
        out.append(place[j])
        j = back[j]
    return out[::-1]


def binary(length: int) -> list[int]:
    """Powers of two, the largest first, that add up to length."""
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


class Packer:
    """Takes documents in order and gives windows in order: lists of (document's place, start, length)."""

    def __init__(self, window: int = WINDOW, block: int = BLOCK) -> None:
        self.window, self.block = window, max(block, 8 * window)
        self.docs: deque[tuple[int, int, np.ndarray]] = deque()  # place, length, ends of its sentences; not yet all given out
        self.given = 0  # ids of the first document that are
        self.held = 0

    def add(self, place: int, length: int, ends: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
        self.docs.append((place, length, ends))
        self.held += length
        if self.held >= self.block:
            yield from self._give(last=False)

    def end(self) -> Iterator[list[tuple[int, int, int]]]:
        if self.held:
            yield from self._give(last=True)

    def _give(self, last: bool) -> Iterator[list[tuple[int, int, int]]]:
        places, costs, base = [np.array([0])], [np.array([0.0])], -self.given
        for _, length, ends in self.docs:
            inner = ends[(ends + base > 0) & (ends < length)] + base
            places += [inner, np.array([base + length])]
            costs += [np.full(len(inner), float(BETWEEN)), np.array([0.0])]
            base += length
        cut, cost = np.concatenate(places), np.concatenate(costs)
        gaps = np.flatnonzero(np.diff(cut) > self.window)
        if len(gaps):  # no place to cut in reach: further ones, a window apart
            more = np.concatenate([np.arange(cut[k] + self.window, cut[k + 1], self.window) for k in gaps])
            order = np.argsort(np.concatenate([cut, more]), kind="stable")
            cut, cost = np.concatenate([cut, more])[order], np.concatenate([cost, np.full(len(more), float(INSIDE))])[order]
        ends = plan(cut.tolist(), cost.tolist(), self.window)
        if last:
            final = ends[-1] - (ends[-2] if len(ends) > 1 else 0)
            if padding(final, self.window):  # nothing follows that could fill it
                ends = ends[:-1] + (ends[-1] - final + np.cumsum(binary(final))).tolist()
        else:
            ends = ends[: max(1, len(ends) - 4)]  # the rest may still be cut better
        at = 0
        for e in ends:
            yield self._take(e - at)
            at = e
        self.held -= at

    def _take(self, n: int) -> list[tuple[int, int, int]]:
        out = []
        while n:
            place, length, _ = self.docs[0]
            k = min(n, length - self.given)
            out.append((place, self.given, k))
            n -= k
            self.given += k
            if self.given == length:
                self.docs.popleft()
                self.given = 0
        return out


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _packed(batches: Iterator[pa.RecordBatch], path: str | None, window: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder, is_end = encoder_of(path or public_tokenizers.path("byte_bpe_50k.json"))
    packer = Packer(window)
    known: dict[int, tuple] = {}  # documents not yet all given out
    sequence, place, rows = TaskContext.get().partitionId() << 33, 0, []

    def batch() -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:7]] if rows else [pa.array([], pa.int64())] * 7
        names = list(NAMES)
        if with_ids:
            columns.append(pa.array([np.frombuffer(r[7], np.uint32).astype(np.int32) for r in rows], pa.list_(pa.int32())))
            names.append("ids")
        rows.clear()
        return pa.RecordBatch.from_arrays(columns, names)

    def put(windows: Iterator[list[tuple[int, int, int]]]) -> None:
        nonlocal sequence
        for w in windows:
            offset = 0
            for p, start, length in w:
                doc_id, ids = known[p]
                part = ids[4 * start : 4 * (start + length)]
                rows.append((doc_id, start, length, zlib.crc32(part), len(ids) // 4, sequence, offset, part))
                offset += length
                if 4 * (start + length) == len(ids):
                    del known[p]
            sequence += 1

    for b in batches:
        ids = encoder([x or "" for x in b.column(1).to_pylist()])
        for doc_id, raw in zip(b.column(0).to_pylist(), ids, strict=True):
            raw += END.to_bytes(4, "little")
            known[place] = (doc_id, raw)
            put(packer.add(place, len(raw) // 4, np.flatnonzero(is_end[np.frombuffer(raw, np.uint32)]) + 1))
            place += 1
            if len(rows) >= 2000:
                yield batch()
    put(packer.end())
    yield batch()


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of packed documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Each task packs its input partition in order, without a shuffle; only the last few windows of a task can be shorter for
    want of what follows, and they are powers of two. Null and empty texts are a document of the end id alone. Repeated
    rows and null doc_ids are packed like any other; extra columns are not looked at; an empty table gives no rows.
    tokenizer: path of a byte-level tokenizers file on every machine; None: the public one.
    """
    schema = ", ".join(f"{x} long" for x in NAMES) + ", ids array<int>" * with_ids
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), partial(_packed, path=tokenizer, window=window, with_ids=with_ids), schema)
