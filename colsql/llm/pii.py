"""Personal data: fixed formats, and what is found from them by bootstrapping. DataFrame functions only.

Seeds (what the formats match, and secrets of well-known form) induce lexical patterns: the word before, the two words before, and the
shape. A graph of patterns and instances (identifier-like tokens) is scored in turns: a pattern by the share of good instances,
an instance by its patterns. Instances that confident patterns accept support further patterns in the next turn, until a turn
accepts nothing new; those that aren't seeds become spans of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, written

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Kind and pattern. Where a match can't begin inside a run of the same characters, a look-behind says so, and what is
#: followed by other characters is possessive: the same matches, in linear time on texts of any kind.
BASE = (
    ("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
KINDS = tuple(k for k, _ in BASE)
#: What must be in a text for a kind to be looked for.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Kind of what is discovered.
FOUND = "id"
_TOKEN = r"(?<![A-Za-z0-9_])[A-Za-z0-9](?:[A-Za-z0-9_-]){7,}+"
#: What is assigned, with the sign before it: any run of other characters than these, of six or more.
_SIGN = r"[=:]\s{0,3}[\"']?"
_ASSIGNED = _SIGN + r"[^\s\"'<>,;()\[\]{}=:][^\s\"'<>,;()\[\]{}]{4,}[A-Za-z0-9/+=_-]"
_SECRET = r"^(?:AKIA[0-9A-Z]{16}|[0-9a-f]{40})$"
#: Good instances that a pattern needs; confidences from which a pattern counts and an instance is good.
SUPPORT, SURE, ACCEPT = 5, 0.8, 0.8


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, b: a + b)


_EMPTY = "cast(array() as array<struct<kind:string,start:int,end:int,value:string>>)"


def spans(text: Column, kind: str, pattern: str) -> Column:
    """All matches, leftmost, without overlap: kind, start, end (code points, end exclusive), value.

    A match starts after the lengths of what the pattern leaves between matches and of the matches before; they are summed
    up in blocks of 64, so that a text with very many matches takes no square of their number.
    """

    def place(m: Column, between: Column) -> Column:
        both = F.transform(m, lambda x, k: F.length(between[k]) + F.length(x))

        def with_blocks(ls: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(ls) / 64).cast("int")), lambda b: _sum(F.slice(ls, b * 64 + 1, 64)))
            return let(blocks, lambda bs: let(F.transform(bs, lambda _, b: _sum(F.slice(bs, 1, b))), lambda cs: F.transform(m, lambda x, k: at(ls, cs, x, k))))

        def at(ls: Column, cs: Column, x: Column, k: Column) -> Column:
            block = F.floor(k / 64).cast("int")
            start = cs[block] + _sum(F.slice(ls, block * 64 + 1, k % 64)) + F.length(between[k])
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(x)).alias("end"), x.alias("value"))

        return let(both, with_blocks)

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = let(matches, lambda m: F.when(F.size(m) == 0, F.expr(_EMPTY)).otherwise(let(F.split(text, pattern, -1), lambda b: place(m, b))))
    return F.when(F.contains(text, F.lit(_NEEDS[kind])), found).otherwise(F.expr(_EMPTY)) if kind in _NEEDS else found


def _digits(x: Column) -> Column:
    return F.length(F.regexp_replace(x, "[^0-9]", ""))


def luhn(value: Column) -> Column:
    """Whether the digits of value pass the Luhn check."""
    digits = F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), "")
    doubled = F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: let(d.cast("int") * (i % 2 + 1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return _sum(doubled) % 10 == 0


_VALID = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: x.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": lambda x: F.when(_digits(x).between(13, 19), luhn(x)).otherwise(F.lit(False)),
    "phone": lambda x: _digits(x).between(9, 15),
}


def base_spans(text: Column) -> Column:
    """The spans of fixed formats, by kind as listed, then start. Matches that fail their kind's check are dropped."""
    def valid(kind: str) -> Callable[[Column], Column]:
        return lambda s: _VALID[kind](s["value"])

    return F.concat(*(F.filter(spans(text, k, p), valid(k)) for k, p in BASE))


def candidates(text: Column, taken: Column) -> Column:
    """Identifier-like tokens that overlap nothing in taken: what is assigned, and elsewhere tokens of eight characters or more, at
    least four of them digits, or secrets of well-known form."""

    def free(of: Column) -> Callable[[Column], Column]:
        return lambda s: ~F.exists(of, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"]))

    def value(s: Column) -> Column:
        rest = F.regexp_replace(s["value"], "^" + _SIGN, "")
        return F.struct(s["kind"].alias("kind"), (s["end"] - F.length(rest)).alias("start"), s["end"].alias("end"), rest.alias("value"))

    assigned = F.when(text.rlike("[=:]"), F.filter(F.transform(spans(text, FOUND, _ASSIGNED), value), free(taken))).otherwise(F.expr(_EMPTY))
    listed = F.filter(spans(text, FOUND, _TOKEN), lambda s: ((_digits(s["value"]) >= 4) | s["value"].rlike(_SECRET)) & free(taken)(s))
    others = F.when(text.rlike("[0-9]|AKIA"), listed).otherwise(F.expr(_EMPTY))
    return let(assigned, lambda own: F.concat(own, F.filter(others, free(own))))


def patterns(text: Column, span: Column) -> Column:
    """Lexical patterns of a span: the word and the two words before it, with whether something is assigned, and its shape."""
    before = F.substring(text, F.greatest(span["start"] - 79, F.lit(1)), F.least(span["start"], F.lit(80)))
    assigned = F.when(F.regexp_extract(before, r"([\s=:\"']*)$", 1).rlike("[=:]"), "=").otherwise(" ")
    words = F.lower(F.regexp_extract(before, r"((?:[^\s=:\"']+[\s=:\"']+)?[^\s=:\"']+)[\s=:\"']*$", 1))
    value = span["value"]
    shape = (
        F.when(value.rlike("^[0-9]+$"), F.concat(F.lit("num"), F.length(value).cast("string")))
        .when(value.rlike("^[0-9a-f]+$"), F.concat(F.lit("hex"), F.length(value).cast("string")))
        .when(value.rlike("^[0-9A-Z]+$"), F.concat(F.lit("caps"), F.length(value).cast("string"), F.regexp_extract(value, "^[A-Z]{0,4}", 0)))
        .otherwise(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]+", "9"), "[a-z]+", "a"), "[A-Z]+", "A"))
    )
    one, two = F.regexp_extract(words, r"([^\s=:\"']+)$", 1), F.regexp_replace(words, r"[\s=:\"']+", " ")
    left = F.array(F.concat(F.lit("L:"), one, assigned), F.concat(F.lit("S:"), shape))
    return F.when(F.contains(two, F.lit(" ")), F.concat(left, F.array(F.concat(F.lit("LL:"), two, assigned)))).otherwise(left)


def extract(docs: DataFrame, *more: str) -> DataFrame:
    """row, doc_id, base (spans), tokens (candidates with their patterns), and entities' patterns, of every row; and more columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *more)
    rows = rows.withColumn("base", base_spans(F.col("text")))
    rows = rows.withColumn("tokens", candidates(F.col("text"), F.col("base")))
    seen = lambda spans_, seed: F.transform(spans_, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.xxhash64(s["value"]).alias("instance"), patterns(F.col("text"), s).alias("patterns"), seed(s).alias("seed")))
    return rows.withColumn("seen", F.concat(seen(F.col("base"), lambda s: F.lit(1.0)), seen(F.col("tokens"), lambda s: F.when(s["value"].rlike(_SECRET), 1.0).otherwise(0.0))))


def discovered(seen: DataFrame, support: int = SUPPORT, sure: float = SURE, accept: float = ACCEPT) -> DataFrame:
    """Instances with a score of accept or more, from seen(instance, seed, patterns): written tables each turn, no row is dropped.

    A pattern's confidence is the mean score of its instances, shrunk by one bad one; it counts from sure on, with at least
    support good instances: seeds, and what turns before have accepted. An instance's score is the chance that not all of its
    patterns err, where they err independently; it never falls. Turns end when no instance is newly good and no pattern newly
    counts, so there are at most as many as patterns and instances; a chain of hops takes a turn a hop.
    """
    edges = written(seen.select("instance", "seed", F.explode("patterns").alias("pattern")).groupBy("instance", "pattern").agg(F.max("seed").alias("seed")))
    scores = written(edges.groupBy("instance").agg(F.max("seed").cast("double").alias("score")))
    state = None
    while True:
        scored = edges.select("instance", "pattern").join(scores, "instance")
        good = F.sum((F.col("score") >= accept).cast("int"))
        counting = written(scored.groupBy("pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("conf"), good.alias("good")).where((F.col("good") >= support) & (F.col("conf") >= sure)).select("pattern", "conf"))
        one = edges.join(counting, "pattern", "left").groupBy("instance").agg(F.sum(F.log1p(-F.coalesce("conf", F.lit(0.0)))).alias("err"))
        after = written(scores.join(one, "instance").select("instance", F.greatest("score", 1 - F.exp("err")).alias("score")))
        now = counting.count(), after.where(F.col("score") >= accept).count()
        drop(scores, counting)
        scores = after
        if now == state:
            break
        state = now
    drop(edges)
    return scores.where(F.col("score") >= accept).select("instance")


def text_of(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _all_spans(rows: DataFrame) -> DataFrame:
    """rows (written extract) with `spans`: base spans, then discovered ones, each by start."""
    seen = rows.select("row", F.explode("seen").alias("s")).select("row", "s.*")
    good = written(discovered(seen.select("instance", "seed", "patterns")))
    new = seen.where(F.col("kind") == FOUND).join(good, "instance").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("found"))
    new = written(new)
    as_spans = F.transform(F.coalesce("found", F.expr("cast(array() as array<struct<start:int,end:int>>)")), lambda s: F.struct(F.lit(FOUND).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    slim = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.join(new, "row", "left").withColumn("spans", F.concat(slim, as_spans))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base (spans), spans) of every row.

    A null text counts as empty and has none. Repeated rows have a result each; null doc_ids are kept; extra columns are not
    looked at; an empty table gives no rows.
    """
    rows = written(extract(docs).drop("text", "tokens"))
    def of(kind: str) -> Callable[[Column], Column]:
        return lambda s: s["kind"] == kind

    counts = (F.size(F.filter("base", of(k))).cast("long").alias(f"n_{k}") for k in KINDS)
    return _all_spans(rows).select("doc_id", *counts, "base", "spans")


def mask(docs: DataFrame) -> DataFrame:
    """docs with each span of its text replaced by its kind in angle brackets; what overlaps becomes one.

    A null text stays null, an empty one empty. Rows that repeat are masked alike; columns may have any names; an empty table
    gives no rows.
    """
    names = [c for c in docs.columns if c not in ("doc_id", "text")]
    inner = [f"_{i}" for i in range(len(names))]
    kept = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(x) for c, x in zip(names, inner, strict=True)), F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    rows = written(extract(kept, *inner, "_id", "_text").drop("text", "tokens"))
    order = F.array_sort("spans", lambda a, b: a["start"] - b["start"])

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("_text"), acc["at"] + 1, s["start"] - acc["at"])
        new = F.struct(F.concat(acc["out"], gap, F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out"), s["end"].alias("at"))
        return F.when(s["start"] >= acc["at"], new).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    masked = F.aggregate(order, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("_text"), acc["at"] + 1, F.length("_text"))))
    out = _all_spans(rows).withColumn("_new", F.when(F.size("spans") > 0, masked).otherwise(F.col("_text")))
    back = dict(zip(names, inner, strict=True)) | {"doc_id": "_id", "text": "_new"}
    return out.select(*(F.col(back[c]).alias(c) for c in docs.columns))
