"""The tokens of full-text search."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex

LONGEST, MOST, TERMS = 32, 4096, 32
_RUN = regex.compile(r"[\p{L}\p{N}]+")
_CJK = regex.compile(r"[\p{scx=Han}\p{scx=Hiragana}\p{scx=Katakana}]+")


def tokens(text: str) -> list[str]:
    """NFKC, lower case, runs of letters and digits; of ideographs and kana, pairs of neighbours. At most MOST, cut at LONGEST."""
    out: list[str] = []
    for run in _RUN.finditer(unicodedata.normalize("NFKC", text).lower()):
        at = 0
        for part in _CJK.finditer(run[0]):
            if part.start() > at:
                out.append(run[0][at : part.start()])
            cjk = part[0]
            out += [cjk] if len(cjk) == 1 else [cjk[i : i + 2] for i in range(len(cjk) - 1)]
            at = part.end()
        if at < len(run[0]):
            out.append(run[0][at:])
        if len(out) >= MOST:
            break
    return [t if len(t) <= LONGEST else t.encode("utf-16-le")[: 2 * LONGEST].decode("utf-16-le", "ignore") for t in out[:MOST]]


def query_terms(query: str) -> list[tuple[str, bool]]:
    """Terms of a query, and whether each stands for all tokens that it begins."""
    out = []
    for chunk in query.split():
        found = tokens(chunk.removesuffix("*"))
        out += [(t, chunk.endswith("*") and i == len(found) - 1) for i, t in enumerate(found)]
    if len(out) > TERMS:
        raise ValueError(f"Full-text queries support at most {TERMS} terms")
    return out


def tokens_udf(texts: pd.Series) -> pd.Series:
    """Each text's tokens, a space after each but the last: a list of them takes ten times the text, so only one text has one at a time."""
    return texts.map(lambda t: None if t is None else " ".join(tokens(t)))
