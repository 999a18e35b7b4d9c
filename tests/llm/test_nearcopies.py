"""Near copies against all pairs."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colsql.llm import nearcopies

from .conftest import frame
from .test_simhash import WORD, plain_components


def sets_of(text, n=5):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(words[i : i + n]) for i in range(len(words) - n + 1)) or (frozenset([" ".join(words)]) if words else None)


def alike(a, b):
    return a is not None and b is not None and len(a & b) >= 0.8 * len(a | b)


def test_near_copies_against_all_pairs(spark, docs):
    sets = {r.doc_id: sets_of(r.text) for r in docs.collect()}
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()}
    assert got == plain_components(sets, alike)


def test_near_copies_of_planted_groups(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = " ".join(r.choices(vocabulary, k=60))
    texts = []
    for g in range(30):
        words = r.choices(vocabulary, k=150)
        for k in range(1 + g % 6):
            w = list(words)
            if k:
                w[r.randrange(150)] = "other"
            texts.append(" ".join(w))
    texts += [passage + " " + " ".join(r.choices(vocabulary, k=120)) for _ in range(20)]  # share a passage only
    got = {x.doc_id: x.component_id for x in nearcopies.near_copies(frame(spark, *texts)).collect()}
    assert got == plain_components({i: sets_of(t) for i, t in enumerate(texts)}, alike)


def test_near_copies_inside_a_family(spark):
    """All texts share 70 to 87 % of their words, so that most samples fall into the shared part; few pairs of them are near copies."""
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(5000)]
    common, texts = r.choices(vocabulary, k=300), []
    for _ in range(300):
        own = r.choices(vocabulary, k=r.randrange(45, 130))
        for _ in range(r.choice([1, 1, 1, 2, 3])):
            w = common + own
            for k in r.sample(range(len(w)), r.randrange(0, 9)):
                w[k] = "other" + str(r.randrange(10**6))
            texts.append(" ".join(w))
    got = {x.doc_id: x.component_id for x in nearcopies.near_copies(frame(spark, *texts)).collect()}
    assert got == plain_components({i: sets_of(t) for i, t in enumerate(texts)}, alike)


def planted(seed=4):
    r, texts = random.Random(seed), []
    for _ in range(40):
        words = [f"w{r.randrange(400)}" for _ in range(r.randrange(1, 60))]
        texts += [" ".join(words), " ".join(words + ["more"] * r.randrange(0, 9)), " ".join(words[r.randrange(0, 4) :])]
    return [t for t in texts if t]


def across(rows, best):
    """What _across gives for rows, as pairs."""
    names = ["token", "deal", "few", "n", "at", "key", "whole", "root"]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
    return sorted((a, b) for x in nearcopies._across(iter([batch]), 0.8, best) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True))


@pytest.mark.parametrize("seed", range(20))
def test_loops_and_arrays_give_the_same(monkeypatch, seed):
    r = random.Random(seed)
    rows = [(1, 0, -1, r.randrange(20, 24), r.randrange(0, 4), k, r.getrandbits(63), r.choice([5, 5, 6, 7])) for k in range(r.randrange(2, 9))]
    roots = [x[7] for x in rows]
    if len({roots.count(q) for q in set(roots)}) < len(set(roots)):
        rows = [(*x[:2], int(x[7] != 5), *x[3:]) for x in rows]  # no largest root by itself: say which
    got = {}
    for small in (8, 0):
        monkeypatch.setattr(nearcopies, "SMALL", small)
        got[small] = [across(rows, best) for best in (False, True)]
    assert got[0][0] == got[8][0] and len(got[0][1]) == len(got[8][1]) and set(got[8][1]) <= set(got[8][0])


@pytest.mark.parametrize("meet, hot", [(1 << 16, 1 << 16), (3, 1)])
def test_the_exact_join_finds_all_pairs_by_itself(spark, monkeypatch, meet, hot):
    """Each text its own root. With meet and hot so small, shingles are dealt to several tasks and aren't gathered."""
    monkeypatch.setattr(nearcopies, "HOT", hot)
    texts = list(dict.fromkeys(planted()))
    sets = {i: sets_of(t) for i, t in enumerate(texts)}
    rows = frame(spark, *texts).select("doc_id", nearcopies.key_of().alias("key"), F.col("text").cast("binary").alias("text"))
    at = {r.key: r.doc_id for r in rows.collect()}
    labels = rows.select("key", F.lit(0).cast("long").alias("whole"), F.col("key").alias("root"))
    mixed = nearcopies.apart(nearcopies.shared_postings(rows.select("key", "text"), 5, 0.8, hold=50), labels)
    found = {tuple(sorted((at[x.a], at[x.b]))) for x in nearcopies.pairs_apart(mixed, 0.8, False, meet).collect()}
    assert {(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])} <= found


def test_a_large_family_of_near_copies(spark):
    """600 copies of one text, each with up to a tenth of its words changed: alike to it, often not to each other."""
    r = random.Random(8)
    words, texts = [f"w{r.randrange(5000)}" for _ in range(250)], []
    for _ in range(600):
        w = list(words)
        for k in r.sample(range(250), r.randrange(1, 8)):
            w[k] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"w{r.randrange(5000)}" for _ in range(200)) for _ in range(100)]
    got = {x.doc_id: x.component_id for x in nearcopies.near_copies(frame(spark, *texts)).collect()}
    assert got == plain_components({i: sets_of(t) for i, t in enumerate(texts)}, alike)


def test_keys_agree_with_python(spark):
    import xxhash

    texts = ["", "a", "Straße 🙂", "x" * 5000]
    got = {r.doc_id: r.key for r in frame(spark, *texts).select("doc_id", nearcopies.key_of().alias("key")).collect()}
    assert {i: k & (1 << 64) - 1 for i, k in got.items()} == {i: xxhash.xxh64_intdigest(t.encode(), seed=42) for i, t in enumerate(texts)}


def test_rows_of_other_texts_are_never_lost(spark):
    """A doc_id that repeats with another text; equal rows; rows without an id; blank texts; columns of clashing names."""
    a = " ".join(f"a{i}" for i in range(60))
    near, b, c = a + " more", " ".join(f"b{i}" for i in range(60)), " ".join(f"c{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, near), (2, near), (3, b), (None, c), (None, c), (4, c), (None, a), (5, ""), (5, ""), (6, None), (None, " "), (8, "only"), (8, "only")]
    docs = spark.createDataFrame([(i, t, k, "x", None) for k, (i, t) in enumerate(rows)], "doc_id long, text string, key long, rows string, root string")
    out = nearcopies.keep_first(docs)
    assert out.dtypes == docs.dtypes
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == sorted((str(i), str(t)) for i, t in [(1, a), (1, b), (4, c), (5, ""), (5, ""), (6, None), (None, " "), (8, "only")])
