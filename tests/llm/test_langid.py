"""Accuracy on texts that weren't learned from, the machines against what they must do, and what is no language."""

import numpy as np
import pytest

from colsql.llm import langid

from .conftest import frame


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.bucket("doc_id", 3) == 1
    model = langid.fit(docs.where(~out))
    return langid.predict(docs.select("doc_id", "lang", out.alias("held_out"), "text"), model).collect()


def test_held_out_accuracy(rows):
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert len(held) > 300 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_a_machine_separates(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(60, 5)).astype(np.float32)
    sign = np.where(x[:, 0] + 0.5 * x[:, 1] > 0.1, 1.0, -1.0)
    x[:, 0] += 0.3 * sign
    w, b = langid.svm(x, sign, c=100.0, rounds=300)
    assert ((x @ w + b) * sign > 0).all()


def test_families():
    assert langid.family("de") == langid.family("en-GB") == "germanic" and langid.family("fr") == "romance" and langid.family("xx") == "xx"


def test_two_steps(spark):
    train = spark.createDataFrame([(i, {"de": "der ung heit sch", "en": "the ing tion wh", "fr": "le eau oux elle", "es": "el cion ado ñar"}[v], v) for i, v in enumerate(["de", "en", "fr", "es"] * 10)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    assert model.top.classes == ["germanic", "romance"] and model.below["romance"].classes == ["es", "fr"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(frame(spark, "der ung", "le eau", None, "", "12 !?", "the ing"), model).collect()}
    assert [got[i][0] for i in range(6)] == ["de", "fr", "und", "und", "und", "en"] and got[2][1] == 0.0


def test_nothing_learned(spark):
    none = spark.createDataFrame([(1, "text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.predict(none, langid.fit(none)).collect()] == ["und", "und"]


def test_one_language(spark):
    one = spark.createDataFrame([(i, "some text", "en") for i in range(5)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.predict(one, langid.fit(one)).collect()} == {"en"}


def test_columns_keep_their_values(spark):
    d = spark.createDataFrame([(1, "some text here", "en", "mine", 7)], "doc_id long, text string, lang string, lang_pred string, score int")
    assert [tuple(r) for r in langid.keep_known(d).collect()] == [(1, "some text here", "en", "mine", 7)]


def test_letters_above_the_first_plane(spark):
    """Emoji are no letters; mathematical and Gothic letters are."""
    assert langid.features("\U0001f642\U0001f680 12") is None and langid.features("\U0001d400\U0001d401") is not None and langid.features("\U00010330 \U0001f642") is not None
    train = spark.createDataFrame([(i, "some english text here", "en") for i in range(5)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(frame(spark, "\U0001f642\U0001f642", "\U0001f642 word"), langid.fit(train)).collect()}
    assert got[0] == ("und", 0.0) and got[1][0] == "en"


def test_very_many_labels(spark):
    """Labels with the most texts are learned; no number of them is an error."""
    rows = [(i, f"text number {i}", f"x{i % 1500}") for i in range(3000)] + [(5000 + i, "the english words", "en") for i in range(30)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=40)
    assert "en" in model.top.classes or any("en" in d.classes for d in model.below.values())


def plain_features(text):
    """Shares of hashed letter n-grams, by plain loops."""
    code = [ord(c) if c.isalpha() else 32 for c in text.lower()]
    run = [32] + [c for i, c in enumerate(code) if c != 32 or i == 0 or code[i - 1] != 32] + [32]
    mul, low, n = [int(m) for m in langid._MUL], (1 << 32) - 1, np.zeros(1 << langid.BITS)
    one = [c * mul[0] & low for c in run]
    two = [(one[i] ^ (run[i + 1] * mul[1] + 1 & low)) * mul[0] & low for i in range(len(run) - 1)]
    three = [(two[i] ^ (run[i + 2] * mul[2] + 2 & low)) * mul[0] & low for i in range(len(run) - 2)]
    for h in one + two + three:
        n[h >> 32 - langid.BITS] += 1
    return np.sqrt(n / n.sum())


def plain_duel(duel, x):
    """The class with most wins over the others, one by one; its score by its least margin."""
    wins, sums, least = ({c: v for c in duel.classes} for v in (0, 0.0, np.inf))
    for k, (a, b) in enumerate(duel.pairs):
        m = float(x @ duel.weights[:, k].astype(float) + duel.bias[k])
        for c, own in ((duel.classes[a], m), (duel.classes[b], -m)):
            wins[c] += own > 0
            sums[c] += own
            least[c] = min(least[c], own)
    best = max(duel.classes, key=lambda c: (wins[c], sums[c]))
    return best, 1 / (1 + np.exp(-3 * min(least[best], 50)))


def test_the_query_against_plain_loops(spark, docs):
    """Family first, then the language within it, of every document of the whole table."""
    from colsql.llm import queries

    out = langid.bucket("doc_id", 3) == 1
    model = langid.fit(docs.where(~out))
    got = {r.doc_id: r for r in queries.op7_langid(spark, "/root/testdata/sf0.001").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        if not t or not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        x = plain_features(t)
        assert np.allclose(x, langid.features(t))
        fam, sure = plain_duel(model.top, x)
        lang, inner = plain_duel(model.below[fam], x)
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(sure * inner, abs=1e-4)


def test_machines_are_nearly_the_best():
    """The objective against a plain subgradient descent with many small steps."""
    r = np.random.default_rng(2)
    x = r.normal(size=(80, 6)).astype(np.float32)
    sign, c = np.where(x[:, 0] - x[:, 1] + r.normal(size=80) > 0, 1.0, -1.0), 2.0
    cost = lambda w, b: (w @ w + b * b) / 2 + c * np.maximum(0, 1 - sign * (x @ w + b)).sum()
    w, b, best = np.zeros(6), 0.0, np.inf
    for k in range(40_000):
        inside = sign * (x @ w + b) < 1
        step = 0.5 / (1 + k) ** 0.75
        w, b = w - step * (w - c * (sign[inside] @ x[inside])) / 10, b - step * (b - c * sign[inside].sum()) / 10
        best = min(best, cost(w, b))
    got = cost(*langid.svm(x, sign, c=c, rounds=1000))
    assert got <= 1.01 * best
