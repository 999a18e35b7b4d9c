"""The automaton against trying each length."""

import random

from colsql.llm import tokencount

from .conftest import frame


def test_counts_of_random_vocabularies():
    r = random.Random(0)
    for _ in range(200):
        pieces = {tuple(r.choices(b"abc", k=r.randrange(1, 5))) for _ in range(r.randrange(1, 12))}
        automaton = tokencount.Automaton(sorted(pieces))
        for _ in range(40):
            word = tuple(r.choices(b"abc", k=r.randrange(0, 14)))
            assert automaton.count(word) == tokencount.greedy(word, pieces)


def plain(text, pieces):
    words = (text or "").encode().lower().split()
    counts = [tokencount.greedy((*w[:-1], w[-1] + tokencount.LAST), pieces) for w in words]
    return len(words), sum(c or 1 for c in counts), sum(c is None for c in counts), max((c or 1 for c in counts), default=0)


def test_documents_against_greedy(spark, docs):
    pieces = set(tokencount.vocabulary()[0])
    text = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown, r.longest) for r in tokencount.token_counts(docs).collect()}
    assert got == {i: plain(t, pieces) for i, t in text.items()}


def test_marks_of_word_ends():
    """A marked piece ends a word, an unmarked one never does."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocab = set(json.load(f)["model"]["vocab"])
    pieces, marked = tokencount.vocabulary()
    pieces, letters = set(pieces), {b: x for x, b in tokencount.byte_letters().items()}
    assert marked and all((b,) in pieces and (b + tokencount.LAST,) in pieces for b in range(256))
    for p in random.Random(1).sample(sorted(pieces), 3000):
        body = "".join(letters[b % tokencount.LAST] for b in p)
        assert body + "</w>" * (p[-1] >= tokencount.LAST) in vocab and all(b < tokencount.LAST for b in p[:-1])


def test_nulls_and_blanks(spark):
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in tokencount.token_counts(frame(spark, None, "", " \n", "the")).collect()}
    assert got == {0: (0, 0), 1: (0, 0), 2: (0, 0), 3: (1, 1)}
