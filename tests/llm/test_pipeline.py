"""Each stage against a plain version, and the whole."""

import random

import corpus_pipeline
from colsql.llm import langid, packing, pii, quality

from .test_pii import plain as plain_spans
from .test_nearcopies import alike, sets_of
from .test_simhash import plain_components

SF = "/root/testdata/sf0.001"


def test_stages_one_after_another(spark, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "language", "near_duplicates", "pii", "packing"]
    now, seen = docs, []
    for _, f in corpus_pipeline.STAGES:
        now = f(spark, now, SF).cache()
        seen.append({r.doc_id: r for r in now.collect()} if "text" in now.columns else now.collect())
    first = {r.doc_id: r for r in docs.collect()}
    assert set(seen[0]) == {i for i, r in first.items() if quality.passes(quality.Text(r.text.encode()), quality.RULES)}
    assert set(seen[1]) <= set(seen[0]) and all(langid.features(r.text) is not None for r in seen[1].values())
    assert len(seen[1]) >= 0.97 * len(seen[0])
    groups = plain_components({i: sets_of(r.text) for i, r in seen[1].items()}, alike)
    assert set(seen[2]) == {i for i, g in groups.items() if i == g} and all(seen[2][i] == first[i] for i in seen[2])
    assert set(seen[3]) == set(seen[2])
    for i, r in seen[3].items():
        before = first[i].text
        assert not [s for s in plain_spans(r.text) if s[0] in ("email", "phone")] and len(r.text) == r.n_chars
        assert r.text == before or plain_spans(before) or any(f"<{k.upper()}>" in r.text for k in [*pii.KINDS, pii.FOUND])
    assert sum(r.length for r in seen[4]) == sum({r.doc_id: r.doc_tokens for r in seen[4]}.values()) and {r.doc_id for r in seen[4]} == set(seen[3])
    assert {len(r.ids) == r.length for r in seen[4]} == {True} and packing.WINDOW == 1024


def test_run_writes_each_stage(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 100 and "ids" in rows.columns


def test_the_language_stage_decides(spark, docs):
    """Random letters and a language that wasn't learned go; what the labels have stays."""
    r = random.Random(2)
    noise = [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(2, 10))) for _ in range(80)) for _ in range(20)]
    polish = "wszyscy ludzie rodz\u0105 si\u0119 wolni i r\u00f3wni pod wzgl\u0119dem swej godno\u015bci i swych praw s\u0105 oni obdarzeni rozumem i sumieniem"
    more = spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate([*noise, polish])], "doc_id long, text string, lang string")
    wide = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    kept = {x.doc_id for x in corpus_pipeline.language_stage(spark, wide.unionByName(more), SF).select("doc_id").collect()}
    clean = {x.doc_id for x in quality.keep_good(wide).collect()}
    assert not any(i >= 10**6 for i in kept) and len(clean - kept) <= 0.002 * len(clean)


def test_stages_need_no_column_but_text_and_id(spark):
    plain = spark.createDataFrame([(1, "mail a.b@c.de now"), (2, None)], "doc_id long, text string")
    assert {x.doc_id: x.text for x in corpus_pipeline.pii_stage(spark, plain, "").collect()} == {1: "mail <EMAIL> now", 2: None}
