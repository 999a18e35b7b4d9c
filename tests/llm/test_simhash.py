"""Fingerprints, the index and components against plain loops."""

import random
import re

import numpy as np
import pytest
import xxhash

from colsql.llm import simhash
from colsql.llm.common import components

from .conftest import frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(keys, near):
    """keys: id to value; near: whether two values link. The smallest id that each reaches."""
    ids, of = list(keys), {i: i for i in keys}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if of[a] < of[b] and near(keys[a], keys[b]):
                    of[b], changed = of[a], True
    return of


def test_whole_table_against_plain_loops(spark, docs):
    text = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: plain_fingerprint(t) for i, t in text.items()}
    expected = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex16("fp").alias("f"), "component_id").collect()
    assert {r.doc_id: (r.f, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", expected[i]) for i in text}


def codes(n, seed):
    """Clusters of codes a few bits apart."""
    r, out = random.Random(seed), set()
    while len(out) < n:
        c = r.getrandbits(64)
        for _ in range(r.randrange(1, 9)):
            out.add(c)
            for _ in range(r.randrange(1, 4)):
                c ^= 1 << r.randrange(64)
    return sorted(out)[:n]


@pytest.mark.parametrize("n", [1, 2, 17, 300])
def test_index_finds_all_pairs(n):
    c = codes(n, n)
    q, k = simhash.GrayIndex(np.array(c, np.uint64)).search(np.array(c, np.uint64), 2)
    assert {(a, b) for a, b in zip(q.tolist(), k.tolist(), strict=True)} == {(a, b) for a in range(n) for b in range(n) if (c[a] ^ c[b]).bit_count() <= 2}


@pytest.mark.parametrize("group", [1024, 3])
def test_links_connect_what_is_near(spark, group):
    """With small groups, patterns are dealt out again under finer masks."""
    c = codes(400, 5)
    rows = spark.createDataFrame([(0, simhash.signed(x)) for x in c], "slot long, fp long")
    at = {simhash.signed(x): i for i, x in enumerate(c)}
    found = [(at[r.a], at[r.b]) for r in simhash.links(rows, group=group, node=lambda slot, fp: fp).collect()]
    assert all((c[a] ^ c[b]).bit_count() <= 2 for a, b in found)
    of = {r.node: r.root for r in components(spark.createDataFrame(found, "u long, v long")).collect()}
    assert {i: of.get(i, i) for i in range(400)} == plain_components(dict(enumerate(c)), lambda a, b: (a ^ b).bit_count() <= 2)


def test_any_doc_id(spark):
    """Ids near 2 ** 62 and below 0, a repeated id with two texts, texts that only rows without an id have."""
    rows = [((1 << 62) + 5, "a b c d"), ((1 << 62) + 9, "a b c d"), (-7, "e f g h i"), (3, "e f g h i"), (3, "j k l m"), (None, "n o p q"), (None, "n o p q"), (None, "j k l m")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    print_of = {t: plain_fingerprint(t) for _, t in rows}
    expected = {t: min((i for i, u in rows if i is not None and print_of[u] == f), default=None) for t, f in print_of.items()}
    assert sorted((str(r.doc_id), r.fp, str(r.component_id)) for r in got) == sorted((str(i), simhash.signed(print_of[t]), str(expected[t])) for i, t in rows)


def test_components_of_a_star_and_a_path(spark):
    edges = [(0, i) for i in range(1, 200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(200)} | {1000 + i: 1000 for i in range(61)}
