"""SQL/JSON on strict JSON text: one parse a value, the last of repeated keys counts."""

from __future__ import annotations

import json
import re

import pandas as pd

_STEP = re.compile(r"\.([A-Za-z_$][\w$]*)|\[(\d+)\]|\[\s*(?:'([^']*)'|\"([^\"]*)\")\s*\]")
_NONE = object()


def path_steps(path: str) -> list[str | int]:
    """`$`, `.member`, `[n]`, `['member']`; anything else is an error."""
    if not path.startswith("$"):
        raise ValueError(f"A JSON path starts with $: {path!r}")
    out: list[str | int] = []
    at = 1
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"Unsupported JSON path {path!r}")
        out.append(int(m[2]) if m[2] is not None else next(x for x in (m[1], m[3], m[4]) if x is not None))
        at = m.end()
    return out


def _refuse(word: str) -> None:
    raise ValueError(word)


def parsed(text: str | None):
    if text is None:
        return _NONE
    try:
        return json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return _NONE


def _at(value, steps: list):
    for s in steps:
        if isinstance(s, int) and isinstance(value, list) and s < len(value) or isinstance(s, str) and isinstance(value, dict) and s in value:
            value = value[s]
        else:
            return _NONE
    return value


def compact(value) -> str:
    def number(x):
        if isinstance(x, float) and x.is_integer() and abs(x) < 1e21:
            return int(x)
        return {k: number(v) for k, v in x.items()} if isinstance(x, dict) else [number(v) for v in x] if isinstance(x, list) else x

    return json.dumps(number(value), separators=(",", ":"), ensure_ascii=False)


def select(text: str | None, path: str | None, how: str) -> str | None:
    """How value: a scalar as text; query: JSON text; exists: 'true' or 'false'. None for null or malformed text."""
    if text is None or path is None:
        return None
    value = parsed(text)
    if value is not _NONE:
        value = _at(value, path_steps(path))
    if how == "exists":
        return "false" if value is _NONE else "true"
    if value is _NONE or how == "value" and (value is None or isinstance(value, dict | list)):
        return None
    return value if how == "value" and isinstance(value, str) else compact(value)


def kind(text: str | None) -> str | None:
    if text is None:
        return None
    value = parsed(text)
    return "" if value is _NONE else "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "scalar"


def select_udf(text: pd.Series, path: pd.Series, how: pd.Series) -> pd.Series:
    return pd.Series([select(t, p, h) for t, p, h in zip(text, path, how, strict=True)], dtype=object)


def kind_udf(text: pd.Series) -> pd.Series:
    return pd.Series([kind(t) for t in text], dtype=object)
