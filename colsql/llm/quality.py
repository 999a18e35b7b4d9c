"""Quality rules as a short-circuit cascade, ordered by rejection per cost as measured on a sample.

A rule's cost is what it adds: the measures that no rule before it has asked for. Its rejection counts only texts that the
rules before it let through. So the order is found rule by rule, each time the one that rejects most for its cost.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

SYMBOLS, BLANK, WINDOW = b"#*$%&|<>", b" \t\n\r\x0b\x0c", 8
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: Deleted, these leave a byte for each code point that isn't white space.
_NOT_CHARS = bytes(range(0x80, 0xC0)) + BLANK
_MIX = np.random.default_rng(1).integers(1, 1 << 62, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _deleted(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


class Text:
    """Measures of one text (UTF-8; null counts as empty), each computed once, when a rule asks for it."""

    def __init__(self, text: bytes | None) -> None:
        self.text = text or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text.translate(None, _NOT_CHARS))

    @cached_property
    def n_symbols(self) -> int:
        return _deleted(self.text, SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x.strip(BLANK)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def keys(self) -> np.ndarray:
        return np.fromiter(map(hash, self.words), np.int64, self.n_words).view(np.uint64)

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside windows of 8 words that occur twice or more, by 64-bit keys of the windows."""
        n = self.n_words - WINDOW + 1
        if n < 2:
            return 0
        key = self.keys[:n] * _MIX[0]
        for i in range(1, WINDOW):
            key += self.keys[i : n + i] * _MIX[i]
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        if not same.any():
            return 0
        edge = np.zeros(self.n_words + 1, np.int64)
        twice = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
        edge[twice] += 1
        edge[twice + WINDOW] -= 1
        return int((np.cumsum(edge) > 0).sum())

    @cached_property
    def n_stutters(self) -> int:
        """Words equal to the one before."""
        return int((self.keys[1:] == self.keys[:-1]).sum())

    @cached_property
    def n_upper(self) -> int:
        return _deleted(self.text, UPPER)

    @cached_property
    def n_lower(self) -> int:
        return _deleted(self.text, LOWER)

    @cached_property
    def n_shouts(self) -> int:
        return self.text.count(b"!")


#: Scripts written without spaces between words: Thai, Lao, Burmese, Khmer, kana, Han.
_SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


class Spaced(Text):
    """A text whose characters of scripts without spaces are words of their own, each as long as two letters, so that rules
    about words hold for them, too."""

    def __init__(self, text: bytes | None) -> None:
        self.n_spaceless = 0
        if text and max(text) >= 0xE0:
            spaced, self.n_spaceless = _SPACELESS.subn(r" \g<0> ", text.decode(errors="replace"))
            text = spaced.encode()
        super().__init__(text)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text.translate(None, _NOT_CHARS)) + self.n_spaceless


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Text], bool]
    #: The measures that it asks for, those that others rest on first.
    needs: tuple[str, ...]


#: The first two are the base: no verdict overrules them.
RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda t: t.n_words < 20, ("words", "n_words")),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 30 * t.n_words, ("words", "n_words", "keys", "n_repeat_words")),
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words, ("words", "n_words", "n_symbols")),
    Rule("duplicate_lines", lambda t: 2 * t.n_dup_lines > len(t.lines), ("lines", "n_dup_lines")),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words, ("words", "n_words", "word_chars")),
    Rule("stutter", lambda t: 5 * t.n_stutters > t.n_words, ("words", "n_words", "keys", "n_stutters")),
    Rule("capitals", lambda t: 2 * t.n_upper > t.n_upper + t.n_lower > 0, ("n_upper", "n_lower")),
    Rule("exclamations", lambda t: 5 * t.n_shouts > t.n_words, ("words", "n_words", "n_shouts")),
)
#: Texts, about, on which cost and rejection are measured.
SAMPLE_ROWS = 400


class Sampled(NamedTuple):
    """Of a text of the sample: seconds that each measure took, those it rests on apart, and which rules reject."""

    seconds: dict[str, float]
    rejected: tuple[bool, ...]


def sampled(text: bytes | None, rules: Sequence[Rule] = RULES, kind: type[Text] = Text) -> Sampled:
    t, seconds = kind(text), {}
    for name in dict.fromkeys(n for r in rules for n in r.needs):
        began = time.perf_counter()
        getattr(t, name)
        seconds[name] = time.perf_counter() - began
    return Sampled(seconds, tuple(bool(r.rejects(t)) for r in rules))


def ordered(sample: Sequence[Sampled], rules: Sequence[Rule] = RULES) -> list[Rule]:
    """The rules, each the one that rejects most of what is left for what it costs more; add-one smoothed, so that no sample divides by 0."""
    left, known, out, alive = list(range(len(rules))), set(), [], list(sample)
    while left:

        def worth(i: int) -> float:
            new = [n for n in rules[i].needs if n not in known]
            cost = sum(s.seconds[n] for s in alive for n in new) + 1e-7 * (len(alive) + 1)
            return (sum(s.rejected[i] for s in alive) + 1) / (len(alive) + 2) / cost

        best = max(left, key=lambda i: (worth(i), -i))
        left.remove(best)
        out.append(rules[best])
        known |= set(rules[best].needs)
        alive = [s for s in alive if not s.rejected[best]]
    return out


def _sampled(batches: Iterator[pa.RecordBatch], rules: Sequence[Rule], kind: type[Text]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [sampled(x, rules, kind) for x in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([list(s.seconds.values()) for s in found], pa.list_(pa.float64())), pa.array([list(s.rejected) for s in found], pa.list_(pa.bool_()))], ["seconds", "rejected"])


def fit(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, kind: type[Text] = Text) -> list[Rule]:
    """The rules in the order in which to run them. The sample is drawn from all rows and measured where they are; only times and
    verdicts of about sample_rows texts reach the driver. It decides on the order only, never on a verdict."""
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    drawn = texts.sample(min(1.0, sample_rows / max(1, docs.count())), seed=1)
    rows = map_arrow(drawn, partial(_sampled, rules=rules, kind=kind), "seconds array<double>, rejected array<boolean>").collect()
    names = list(dict.fromkeys(n for r in rules for n in r.needs))
    return ordered([Sampled(dict(zip(names, r.seconds, strict=True)), tuple(r.rejected)) for r in rows], rules)


def passes(text: Text, cascade: Sequence[Rule]) -> bool:
    return not any(rule.rejects(text) for rule in cascade)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measured(batches: Iterator[pa.RecordBatch], cascade: Sequence[Rule]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [Text(x) for x in b.column(1).to_pylist()]
        kept = [passes(t, cascade) for t in texts]
        sums = [[getattr(t, k) for t in texts] for k in MEASURES]
        failed = [RULES[0].rejects(t) or RULES[1].rejects(t) for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in sums), pa.array(failed, pa.bool_()), pa.array([k and not f for k, f in zip(kept, failed, strict=True)], pa.bool_())], ["doc_id", *MEASURES, "base_failed", "kept"])


def measures(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, the measures, base_failed, kept) of every row.

    Null, empty and blank texts have no words and fail the base. Repeated rows have a result each; extra columns are not
    looked at; an empty table gives no rows.
    """
    schema = "doc_id long, " + ", ".join(f"{k} long" for k in MEASURES) + ", base_failed boolean, kept boolean"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), partial(_measured, cascade=fit(docs, rules, sample_rows)), schema)


def _kept(batches: Iterator[pa.RecordBatch], cascade: Sequence[Rule], at: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        verdicts = [passes(Spaced(x.encode() if isinstance(x, str) else x), cascade) for x in b.column(at).to_pylist()]
        yield b.filter(pa.array(verdicts, pa.bool_()))


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs, all columns, whose text passes every rule; a text is measured no further than its first failure.
    Characters of scripts without spaces count as words.

    Null, empty and blank texts have no words and go. Rows that repeat stay or go alike; columns may have any names; an empty
    table gives no rows.
    """
    return map_arrow(docs, partial(_kept, cascade=fit(docs, rules, sample_rows, Spaced), at=docs.columns.index("text")), docs.schema)
