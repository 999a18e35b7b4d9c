"""Language identification in two steps: the family, then the language within it, by one-versus-one linear SVMs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Hashed features of a text: its letter 1- to 3-grams.
BITS = 13
#: Labelled texts a language, and of all languages, that the classifiers are fitted on. A language needs two, so the
#: SAMPLE_ROWS / 2 with the most texts can be learned.
PER_LANGUAGE, SAMPLE_ROWS = 300, 2400
UNKNOWN = "und"
FAMILIES = {
    "germanic": "en de nl af da sv no nb nn is fy lb yi", "romance": "fr es it pt ro ca gl oc", "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "uralic": "fi et hu", "turkic": "tr az kk uz ky tk", "baltic": "lt lv", "celtic": "ga cy gd br", "semitic": "ar he am mt", "indic": "hi bn mr ur pa gu ne",
    "dravidian": "ta te kn ml", "sinitic": "zh yue", "japonic": "ja", "koreanic": "ko", "hellenic": "el", "iranian": "fa ku ps tg", "austronesian": "id ms tl jv mg", "vietic": "vi", "tai": "th lo",
}
_FAMILY = {x: f for f, langs in FAMILIES.items() for x in langs.split()}
_LETTER = np.array([chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(1 << 16)])
_MUL = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917)]


def family(lang: str) -> str:
    """A language's family by its ISO 639 code; a code that isn't listed is a family of its own."""
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


def features(text: str) -> np.ndarray | None:
    """Square roots of the shares of hashed n-grams, a vector of length 1; None if the text has no letter.

    All that isn't a letter counts as a space, and each run of spaces as one; case is folded.
    """
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    low = code < 1 << 16
    letter = _LETTER[np.where(low, code, 0)] & low
    if not low.all():
        high = np.unique(code[~low])
        letter |= np.isin(code, high[[chr(c).isalpha() for c in high.tolist()]])
    if not letter.any():
        return None
    code = np.where(letter, code, np.uint32(32))
    code = np.concatenate([[np.uint32(32)], code[letter | np.concatenate([[True], letter[:-1]])], [np.uint32(32)]])
    one = code * _MUL[0]
    two = (one[:-1] ^ (code[1:] * _MUL[1] + np.uint32(1))) * _MUL[0]
    three = (two[:-1] ^ (code[2:] * _MUL[2] + np.uint32(2))) * _MUL[0]
    n = np.bincount(np.concatenate([one, two, three]) >> np.uint32(32 - BITS), minlength=1 << BITS)
    return np.sqrt(n / n.sum())


def svm(x: np.ndarray, sign: np.ndarray, c: float = 10.0, rounds: int = 30, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine, by dual coordinate descent on the Gram matrix."""
    gram = x @ x.T + 1.0  # the bias is the weight of a feature that is always 1
    alpha, out, order = np.zeros(len(x)), np.zeros(len(x)), np.random.default_rng(seed)
    diagonal = np.diag(gram)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(x)):
            new = min(max(alpha[i] + (1 - sign[i] * out[i]) / diagonal[i], 0.0), c)
            if step := new - alpha[i]:
                alpha[i] = new
                out += step * sign[i] * gram[i]
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    weight = alpha * sign
    return weight @ x, float(weight.sum())


class Duel:
    """One-versus-one machines over classes: most wins, then the larger sum of margins, then the first name."""

    def __init__(self, x: np.ndarray, names: Sequence[str]) -> None:
        self.classes = sorted(set(names))
        self.pairs = list(combinations(range(len(self.classes)), 2))
        names = np.array(names)
        fits = []
        for a, b in self.pairs:
            at = (names == self.classes[a]) | (names == self.classes[b])
            fits.append(svm(x[at], np.where(names[at] == self.classes[a], 1.0, -1.0)))
        self.weights = np.array([w for w, _ in fits], np.float32).reshape(-1, x.shape[1]).T
        self.bias = np.array([b for _, b in fits])

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and score of each row of x. The score is the least, over the others, of a logistic function of the margin."""
        wins, sums, least = (np.full((len(x), len(self.classes)), v) for v in (0.0, 0.0, np.inf))
        margins = x @ self.weights + self.bias
        for k, (a, b) in enumerate(self.pairs):
            m = margins[:, k]
            for c, own in ((a, m), (b, -m)):
                wins[:, c] += own > 0
                sums[:, c] += own
                least[:, c] = np.minimum(least[:, c], own)
        rank = wins + (np.tanh(sums / (1 + len(self.pairs))) + 1) / 4
        best = rank.argmax(axis=1)
        return best, 1 / (1 + np.exp(-3 * np.minimum(least[np.arange(len(x)), best], 50)))


class Model:
    """The family's duel, and a duel in each family of more than one language."""

    def __init__(self, x: np.ndarray, langs: Sequence[str]) -> None:
        families = [family(v) for v in langs]
        self.top = Duel(x, families) if langs else None
        self.below = {}
        for f in set(families):
            at = [i for i, v in enumerate(families) if v == f]
            self.below[f] = Duel(x[at], [langs[i] for i in at])

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if self.top is None:
            return lang, score
        found = [(i, v) for i, t in enumerate(texts) if t and (v := features(t)) is not None]
        if not found:
            return lang, score
        x = np.array([v for _, v in found], np.float32)
        best, sure = self.top(x)
        for k, name in enumerate(self.top.classes):
            at = np.flatnonzero(best == k)
            if len(at):
                duel = self.below[name]
                inner, inner_sure = duel(x[at])
                for j, c, s in zip(at, inner, inner_sure, strict=True):
                    lang[found[j][0]], score[found[j][0]] = duel.classes[c], float(s * sure[j])
        return lang, score


def bucket(doc_id: Column | str, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null doc_id counts as an empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for key, lang, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if (v := features(text)) is not None:
                at = np.flatnonzero(v)
                rows.append((key, lang, at.astype(np.int32).tobytes(), v[at].astype(np.float32).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.binary(), pa.binary()))], ["key", "lang", "at", "value"])


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fitted on at most per_language texts a language and sample_rows in all, chosen by a hash of doc_id.

    labelled: doc_id, text, lang. Rows with a null text or lang, or without a letter, teach nothing. No row: a model that says `und`.
    """
    rows = labelled.where("lang is not null and text is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample_rows // 2).collect()}
    if not counts:
        return Model(np.zeros((0, 1 << BITS), np.float32), [])
    most = max(2, min(per_language, sample_rows // len(counts)))
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, 1.3 * most / n + 20 / n))) for k, n in counts.items()))
    key = F.xxhash64(F.col("doc_id").cast("long"), F.lit(7))
    chosen = rows.select(key.alias("key"), "lang", "text").where(F.col("key").bitwiseAND(F.lit((1 << 31) - 1)) < share * (1 << 31))
    table = map_arrow(chosen, _features, "key long, lang string, at binary, value binary").toArrow().to_pylist()
    seen: dict[str, int] = {}
    x, langs = [], []
    for r in sorted(table, key=lambda r: (r["key"], r["at"], r["value"])):
        seen[r["lang"]] = seen.get(r["lang"], 0) + 1
        if seen[r["lang"]] <= most:
            v = np.zeros(1 << BITS, np.float32)
            v[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["value"], np.float32)
            x.append(v)
            langs.append(r["lang"])
    return Model(np.array(x, np.float32).reshape(len(x), 1 << BITS), langs)


def _predicted(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lang, score = model.value.predict(b.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, "lang_pred", "score"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score (these names replace columns of docs so named).

    `und` with score 0 for a null text, one without a letter, and for all if nothing was learned. Only the text is looked
    at, the whole of it. Repeated rows have a result each; an empty table gives no rows.
    """
    base = docs.drop("lang_pred", "score")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields), "lang_pred string", "score double"])
    return map_arrow(base, partial(_predicted, model=docs.sparkSession.sparkContext.broadcast(model)), schema)


def _known(batches: Iterator[pa.RecordBatch], model, min_score: float, at: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lang, score = model.value.predict(b.column(at).to_pylist())
        yield b.filter(pa.array([x != UNKNOWN and s >= min_score for x, s in zip(lang, score, strict=True)], pa.bool_()))


def keep_known(docs: DataFrame, min_score: float = 0.0) -> DataFrame:
    """The rows of docs, all columns whatever their names, whose language can be told: not `und`, and with a score of min_score
    at least. The labels of docs teach; a table without labels teaches nothing and loses all rows."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))
    return map_arrow(docs, partial(_known, model=shared, min_score=min_score, at=docs.columns.index("text")), docs.schema)
