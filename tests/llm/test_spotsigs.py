"""Signatures and likeness against plain Python, and all alike pairs."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from colsql.llm import queries, spotsigs

from .conftest import frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def chains(words, is_anchor):
    out = set()
    for i, w in enumerate(words):
        content = [x for x in words[i + 1 : i + 1 + spotsigs.REACH] if not is_anchor(x)]
        if is_anchor(w) and content:
            out.add(" ".join([w, *content[: spotsigs.CHAIN]]))
    return out


def plain(text):
    """Chains as texts; without one, those of words by their hash; without one again, the words as a whole."""
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    spot = lambda w: hashlib.md5(w.encode()).hexdigest()[0] in spotsigs.SPOTS
    return chains(words, lambda w: w in spotsigs.ANCHORS) or chains(words, spot) or {" ".join(["", *words])}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_the_query_against_plain_python(spark, docs):
    text = {r.doc_id: r.text for r in docs.orderBy("doc_id").collect()}
    ids = list(text)
    got = {r.doc_id: r for r in queries.op6_spotsigs(spark, "/root/testdata/sf0.001").collect()}
    assert sorted(got) == ids
    for i, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        t, n = text[i], len(text[i]) // 2
        edited = t[: len(t) - n] + text[after][:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - jaccard(plain(t), plain(edited))) < 1e-9 and abs(r.near_next - jaccard(plain(t), plain(text[after]))) < 1e-9
        assert r.fingerprint == got[i].fingerprint and len(r.fingerprint) == 8 * len(plain(t)) and len(r.edited_fingerprint) == 8 * len(plain(edited))


def test_equal_texts_and_other_words(spark):
    rows = frame(spark, "the cat sat", "THE\tcat  sat", "no anchors hered", None, "", "the").withColumn("f", spotsigs.fingerprint(spotsigs.signatures(F.col("text"))))
    f = {r.doc_id: r.f for r in rows.collect()}
    assert f[0] == f[1] and f[3] == f[4] and len({f[0], f[2], f[3], f[5]}) == 4


def followed(rows, size):
    """The chain of (doc_id, text) from the first row on, by each row's next text; texts are all different."""
    got = {r.text: r for r in spotsigs.with_next(rows, "doc_id", ["text"], size).collect()}
    first = min(got.values(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text))
    out, at = [], first.text
    for _ in got:
        out.append((got[at].doc_id, at))
        at = got[at].next.text
    return out, at == first.text


def test_the_next_document(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in [5, 9, -3, 7, None, 100]] + [(9, "t9b")], "doc_id long, text string")
    for size in (4000, 1, 2, 3):
        chain, closed = followed(rows, size)
        assert closed and [i for i, _ in chain] == [None, -3, 5, 7, 9, 9, 100]


@pytest.mark.parametrize("kind", ["outlier", "repeated", "nulls", "spread"])
def test_buckets_of_any_ids(spark, kind):
    """One id of 2^62; a third of all rows with one id; a third without one: no bucket has many times its rows."""
    ids = {"outlier": [*range(3000), 1 << 62], "repeated": [7] * 1000 + [*range(2000)], "nulls": [None] * 1000 + [*range(2000)], "spread": [i * i * i - 10**9 for i in range(3000)]}[kind]
    rows = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(3)
    keyed = rows.withColumn("_k", F.coalesce("doc_id", F.lit(-(1 << 63))))
    b = spotsigs.Buckets(keyed, "_k", F.xxhash64("text"), 100)
    counts = {r.b: r["count"] for r in keyed.groupBy(b.of().alias("b")).count().collect()}
    assert sorted(counts) == list(range(b.n)) and b.n >= 20 and max(counts.values()) <= 300
    chain, closed = followed(rows, 100)
    expected = sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [i for i, _ in chain] in (expected, expected[1:] + expected[:1]) or kind in ("nulls", "repeated") and sorted(chain, key=str) == sorted(((i, f"text {k}") for k, i in enumerate(ids)), key=str)
    assert closed and len({t for _, t in chain}) == len(ids)


def test_texts_of_other_languages(spark):
    """Without a listed anchor likeness is still measured, and a small edit leaves most of it."""
    words = [f"slovo{i}" for i in range(120)]
    edited = " ".join([*words[:60], "x", *words[60:]])
    rows = frame(spark, " ".join(words), edited, " ".join(words[::-1])).withColumn("s", spotsigs.signatures(F.col("text")))
    sets = {r.doc_id: set(r.s) for r in rows.collect()}
    assert 0.7 <= jaccard(sets[0], sets[1]) <= 1 and jaccard(sets[0], sets[2]) < 0.2


def test_one_row_follows_itself(spark):
    assert [r.next.text for r in spotsigs.with_next(frame(spark, "a"), "doc_id", ["text"]).collect()] == ["a"]


def test_matches_against_all_pairs(spark, docs):
    sets = {r.doc_id: plain(r.text) for r in docs.collect()}
    members = {r.doc_id: r["class"] for r in spotsigs.class_of(docs).collect()}
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    assert members == {i: first[frozenset(s)] for i, s in sets.items()}
    ids = sorted(first.values())
    expected = {(a, b) for a in ids for b in ids if a < b and jaccard(sets[a], sets[b]) >= 0.8}
    assert {(r.a, r.b) for r in spotsigs.matches(docs).collect()} == expected
    assert {(r.a, r.b) for r in spotsigs.matches(docs, 0.3).collect()} == {(a, b) for a in ids for b in ids if a < b and jaccard(sets[a], sets[b]) >= 0.3}
