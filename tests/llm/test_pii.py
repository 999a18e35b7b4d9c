"""Fixed formats against Python's re, discovery against a plain loop over a graph, and masking."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from colsql.llm import pii

from .conftest import frame

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def fine(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if fine(k, m[0])]


def base_of(spark, texts):
    got = frame(spark, *texts).select("doc_id", pii.text_of(pii.base_spans(F.coalesce("text", F.lit("")))).alias("s"))
    return {r.doc_id: r.s for r in got.collect()}


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_formats_of_odd_texts(spark):
    r = random.Random(0)
    bits = ["a@b.c", "@", ".", "x", "1", "255", "256", "+", " ", "-", "4111111111111111", "4111 1111 1111 1111", "10.0.0.1", "é", "🙂", "(", ")", "a.b@c-d.e.f", "+49 30 1234567", "\n", "_", "%", "0"]
    texts = ["".join(r.choices(bits, k=r.randrange(0, 16))) for _ in range(1500)]
    texts += [None, "", "a@b", "a@b.c_x@y.z", "1.2.3.4.5.6.7.8", "+1 2 3 4 5 6 7 8 9 +1", "1" * 3000, "a@" * 2000, "+1" * 2000, "x@y.z " * 700]
    assert base_of(spark, texts) == {i: joined(plain(t)) for i, t in enumerate(texts)}


def test_formats_of_the_table(spark, docs):
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.find(docs).select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2(pii.text_of(F.col("base")), 256).alias("h"), pii.text_of(F.col("spans")).alias("s")).collect():
        expected = plain(text[r.doc_id])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in expected) for k in pii.KINDS]
        assert r.h == hashlib.sha256(joined(expected).encode()).hexdigest() and r.s.startswith(joined(expected))


def plain_discovery(edges, seeds):
    of, by = defaultdict(set), defaultdict(set)
    for i, p in edges:
        of[i].add(p), by[p].add(i)
    score, state = dict(seeds), None
    while True:
        conf = {p: c for p, x in by.items() if sum(score[i] >= pii.ACCEPT for i in x) >= pii.SUPPORT and (c := sum(score[i] for i in x) / (len(x) + 1)) >= pii.SURE}
        for i, ps in of.items():
            err = 1.0
            for p in ps:
                err *= 1 - conf.get(p, 0.0)
            score[i] = max(score[i], 1 - err)
        now = len(conf), sum(s >= pii.ACCEPT for s in score.values())
        if now == state:
            return {i for i, s in score.items() if s >= pii.ACCEPT}
        state = now


def test_scores_against_a_plain_loop(spark):
    r = random.Random(4)
    seen = []
    for i in range(400):
        seed = float(r.random() < 0.5)
        group = r.randrange(8) if not seed else r.randrange(4)
        seen.append((i, seed, [f"L:{group}", f"S:{r.randrange(3) if seed else r.randrange(6)}"]))
    got = {x.instance for x in pii.discovered(spark.createDataFrame(seen, "instance long, seed double, patterns array<string>")).collect()}
    assert got == plain_discovery([(i, p) for i, _, ps in seen for p in ps], {i: s for i, s, _ in seen}) and 0 < len(got) < 400


def test_unseen_identifiers_are_found(spark):
    """Tokens in the places of seeds, and of their shape, are found; the same in other places aren't."""
    r = random.Random(5)
    key = lambda: "AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOP0123456789", k=16))
    texts = [f"text here key = {key()} and more words" for _ in range(40)]
    unseen = "AKIB" + "1234567890ABCDEF"
    texts += [f"text here key = {unseen} and more words", "order number 20231122445566 is in the mail"]
    got = {x.doc_id: x.s for x in pii.find(frame(spark, *texts)).select("doc_id", pii.text_of(F.col("spans")).alias("s")).collect()}
    start = texts[40].index(unseen)
    assert got[40] == f"id:{start}:{start + len(unseen)}" and all(got[i].startswith("id:") for i in range(40)) and "id" not in got[41]


def test_a_pattern_two_hops_away(spark):
    """Seeds (known secrets) follow `secret =`; tokens of another shape follow it, too, so they are accepted; by their shape, which no
    seed has, others are found after `ref`, where no seed is. Order numbers, in places of their own, stay."""
    r = random.Random(6)
    secret = lambda: "AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOP0123456789", k=16))
    second = lambda: f"zz-{r.randrange(10**4, 10**5)}-q"
    texts = [f"the secret = {secret()} here" for _ in range(400)] + [f"the secret = {second()} here" for _ in range(60)] + [f"see the ref {second()} there" for _ in range(9)]
    texts += [f"order no {r.randrange(10**9, 10**10)} came" for _ in range(30)]
    got = [x.s for x in pii.find(frame(spark, *texts)).select("doc_id", pii.text_of(F.col("spans")).alias("s")).orderBy("doc_id").collect()]
    assert [s.startswith("id:") for s in got] == [True] * 469 + [False] * 30


def test_candidates(spark):
    """Assigned values of any characters, however long; other tokens only with digits or of a known form."""
    long = "A1" * 400
    texts = [f"key={long}", "pass: hunter-two.", 'token = "ab/cd+ef=="', "a plain text with longwordswithoutdigits", f"x {long} y", "it is 12:30:45 now", "url https://a.bc/d e", "mail: a.b@c.de"]
    rows = frame(spark, *texts).select("doc_id", F.transform(pii.candidates(F.col("text"), pii.base_spans(F.col("text"))), lambda s: F.concat_ws("|", s["start"], s["end"], s["value"])).alias("c"))
    got = {r.doc_id: r.c for r in rows.collect()}
    assert {k: [v.split("|")[2] for v in x] for k, x in got.items()} == {0: [long], 1: ["hunter-two"], 2: ["ab/cd+ef=="], 3: [], 4: [long], 5: [], 6: ["//a.bc/d"], 7: []}
    for i, found in got.items():
        for a, b, v in (x.split("|") for x in found):
            assert texts[i][int(a) : int(b)] == v


def test_masking(spark):
    texts = ["mail me: a.b@c.de, or call +49 (30) 1234567!", None, "", "🙂 10.0.0.1 🙂", "nothing"]
    got = {r.doc_id: r.text for r in pii.mask(frame(spark, *texts)).collect()}
    assert got == {0: "mail me: <EMAIL>, or call <PHONE>!", 1: None, 2: "", 3: "🙂 <IP> 🙂", 4: "nothing"}


def test_masking_of_what_overlaps(spark):
    text = "x +4111111111111111 y"
    spans = plain(text)
    assert len(spans) == 1 or {k for k, _, _ in spans} >= {"card"}
    got = pii.mask(frame(spark, text)).first().text
    assert "4111" not in got and got.startswith("x ") and got.endswith(" y")


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 130, 1000])
def test_places_of_many_spans(spark, n):
    text = "é a@b.cd 🙂, " * n
    assert base_of(spark, [text])[0] == joined(plain(text))
