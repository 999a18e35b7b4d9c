"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a one-pass Viterbi search."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

SPACE = "▁"
#: Chunks of text whose pieces a task remembers.
MEMORY = 300_000
#: What a byte piece costs more than any other: bytes are for what no piece covers.
BYTE_COST = 100.0


class Model:
    """The pieces of a SentencePiece model file with unigram scores.

    scores "file": those of the file. "zipf": log of 1 / (rank + 1), normalised, for files of merge ranks (byte-pair
    encoding), whose scores are no log probabilities: by Zipf's law the piece of rank r has a share in proportion to 1 / r.
    """

    def __init__(self, path: str | None = None, scores: str = "zipf") -> None:
        file = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        n = file.get_piece_size()
        self.text: list[str] = [file.id_to_piece(i) for i in range(n)]
        self.byte = np.full(256, file.unk_id(), np.int64)
        self.byte_of: dict[int, int] = {}
        self.unknown = file.unk_id()
        self.automaton = ahocorasick.Automaton()
        plain = []
        for i, t in enumerate(self.text):
            if file.is_byte(i):
                self.byte[int(t[3:5], 16)] = i
                self.byte_of[i] = int(t[3:5], 16)
            elif not (file.is_control(i) or file.is_unknown(i)):
                plain.append((-file.get_score(i), i, t))
        total = np.log(np.sum(1 / np.arange(1, len(plain) + 1)))
        # pieces after which a new chunk can't begin: they hold a space behind another character
        self.whole = any(SPACE in t.lstrip(SPACE) for t in self.text)
        for rank, (cost, i, t) in enumerate(sorted(plain), 1):
            self.automaton.add_word(t, (i, len(t), -cost if scores == "file" else float(-np.log(rank) - total)))
        self.automaton.make_automaton()
        self.known: dict[str, bytes] = {}

    def viterbi(self, text: str) -> list[int]:
        """The ids of the best segmentation of a text: sum of scores; of equals, the one whose last piece is longest.

        The automaton reads each character once; at each, its output links lead through all pieces that end there, the
        longest first. A character without a piece becomes its UTF-8 bytes.
        """
        n = len(text)
        best, back = [0.0] + [-np.inf] * n, [(0, 0)] * (n + 1)
        found = iter(self.automaton.iter(text))
        hit = next(found, None)
        for end in range(1, n + 1):
            while hit is not None and hit[0] == end - 1:
                i, length, score = hit[1]
                s = best[end - length] + score
                if s > best[end]:
                    best[end], back[end] = s, (end - length, i)
                hit = next(found, None)
            s = best[end - 1] - BYTE_COST * len(text[end - 1].encode("utf-8", "replace"))
            if s > best[end]:
                best[end], back[end] = s, (end - 1, -1)
        out, at = [], n
        while at:
            start, i = back[at]
            out += [i] if i >= 0 else [int(self.byte[b]) for b in reversed(text[start:at].encode("utf-8", "replace"))]
            at = start
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers. A space is put before the text, then spaces are written as U+2581; nothing else is changed.

        No piece holds a space behind another character, so the best segmentation is made of those of the chunks that
        begin with spaces, which are remembered.
        """
        if not text:
            return b""
        text = (SPACE + text.replace(" ", SPACE))
        if self.whole:
            return np.array(self.viterbi(text), np.uint32).tobytes()
        parts, chunks, spaces = text.split(SPACE), [], 0
        for k, p in enumerate(parts):  # the first is empty
            if k == 0:
                if p:
                    chunks.append(p)
                continue
            spaces += 1
            if p:
                chunks.append(SPACE * spaces + p)
                spaces = 0
        if spaces:
            chunks.append(SPACE * spaces)
        out = []
        for c in chunks:
            ids = self.known.get(c)
            if ids is None:
                if len(self.known) >= MEMORY:
                    self.known.clear()
                ids = np.array(self.viterbi(c), np.uint32).tobytes()
                if len(c) <= 256:
                    self.known[c] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of encoded ids."""
        out, run = [], bytearray()
        for i in np.frombuffer(ids, np.uint32).tolist():
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(self.text[i])
        out.append(run.decode("utf-8", "replace"))
        return "".join(out)


@lru_cache(maxsize=1)
def model_of(path: str | None, scores: str = "zipf") -> Model:
    """A model, kept by a worker for its next task."""
    return Model(path, scores)


def restored(decoded: str) -> str:
    return decoded.replace(SPACE, " ")[1:]


def _encoded(batches: Iterator[pa.RecordBatch], path: str | None, scores: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    model = model_of(path, scores)
    for b in batches:
        texts = b.column(1).to_pylist()
        ids = [None if t is None else model.encode(t) for t in texts]
        numbers = [None if x is None else np.frombuffer(x, np.uint32).astype(np.int32) for x in ids]
        back = [None if x is None else restored(model.decode(x)) == t.replace(SPACE, " ") for x, t in zip(ids, texts, strict=True)]
        columns = [b.column(0), pa.array([None if x is None else len(x) // 4 for x in ids], pa.int64()), pa.array([None if x is None else zlib.crc32(x) for x in ids], pa.int64()), pa.array(back, pa.bool_())]
        names = ["doc_id", "n_pieces", "ids_crc32", "round_trip"]
        if with_ids:
            columns.append(pa.array(numbers, pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names)


def encode(docs: DataFrame, path: str | None = None, scores: str = "zipf", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, round_trip, and ids) of every row: round_trip says whether decoding gives the text again,
    U+2581 in it read as a space.

    A null text has nulls, an empty one no pieces. Repeated rows have a result each; extra columns are not looked at; an empty
    table gives no rows.
    """
    schema = "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), partial(_encoded, path=path, scores=scores, with_ids=with_ids), schema)


def _decoded(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    model = model_of(path)
    for b in batches:
        out = [None if x is None else restored(model.decode(np.array(x, np.uint32).tobytes())) if x else "" for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows with ids: null ids have a null text, no ids an empty one. Repeated rows and null doc_ids have a result
    each; extra columns are not looked at; an empty table gives no rows."""
    return map_arrow(encoded.select(F.col("doc_id").cast("long"), "ids"), partial(_decoded, path=path), "doc_id long, text string")
