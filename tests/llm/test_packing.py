"""Pieces against the tokenizer's ids, the dynamic program against all choices."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from colsql.llm import packing

from .conftest import frame


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, ids):
    """Each id in exactly one piece, sequences gapless, padding little."""
    pieces, sequences = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(part) > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, np.uint32).tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, x in ids.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(x)
    lengths = []
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
        lengths.append(at)
    return lengths


def test_whole_table(spark, docs, tokenizer):
    lengths = check(packing.pack(docs).collect(), {r.doc_id: ids_of(tokenizer, r.text) for r in docs.collect()})
    total = sum(lengths)
    assert sum(packing.padding(x) for x in lengths) < 0.02 * total
    assert sum(x < 1024 and packing.padding(x) == 0 for x in lengths) < 0.15 * len(lengths)  # few windows are short


def test_blocks_cost_little_more_than_one_plan(monkeypatch):
    """What is planned in blocks, the last windows carried on, against one plan of all."""
    r, window = random.Random(7), 64
    lengths = [r.randrange(1, 150) for _ in range(600)]
    ends = [np.array(sorted({*r.sample(range(1, n + 1), min(n, 6)), n})) for n in lengths]

    def priced(block):
        packer, out = packing.Packer(window=window, block=block), []
        for i, (n, e) in enumerate(zip(lengths, ends, strict=True)):
            out += packer.add(i, n, e)
        out += packer.end()
        total = 0.0
        for w in out:
            doc, start, n = w[-1]
            at = start + n
            total += packing.EACH + packing.padding(sum(x[2] for x in w), window) + (0 if at == lengths[doc] else packing.BETWEEN if at in ends[doc] else packing.INSIDE)
        return total

    assert priced(8 * window) <= 1.01 * priced(10**9)


def test_odd_texts(spark, tokenizer):
    texts = [None, "", " ", "  a  b", "a \n b", "a b", "x" * 9000, "don't  stop\t\tnow ", "🙂 🙂", "<|endoftext|> a <|endoftext|>", "é" * 3000, "a\r\n\r\n b"]
    check(packing.pack(frame(spark, *texts)).collect(), {i: ids_of(tokenizer, t) for i, t in enumerate(texts)})


def test_ids_are_those_of_tokenizers(tokenizer):
    r, e = random.Random(0), packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    bits = ["a", "the", " ", "  ", "\n", "\t", "1", "'s", "é", "ß", " ", " ", "!", "<|endoftext|>", "🙂", "\x1f", "\u0085"]
    texts = ["".join(r.choices(bits, k=r.randrange(0, 14))) for _ in range(3000)] + ["a" * 5000, " " * 5000, "é1" * 3000]
    texts += [f"a{c}b {c}1 {c}{c} {c}\n" for c in map(chr, range(1, 0xD800, 7))]
    assert e.fast is not None
    assert [np.frombuffer(x, np.uint32).tolist() for x in e(texts)] == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def cost(ends, penalty, window):
    at = total = 0
    for e in ends:
        if e - at > window:
            return float("inf")
        n = e - at
        total += penalty[e] + packing.EACH + (0 if n in (32, window) else window - n)
        at = e
    return total


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_the_cheapest(seed):
    """Against all subsets of the cuts; full windows may also end between cuts, so the plan may only be cheaper."""
    r, window = random.Random(seed), 40
    cuts = [0, *itertools.accumulate(r.randrange(1, 30) for _ in range(9))]
    penalty = [0.0, *(r.choice([0.0, 1.0, 4.0]) for _ in range(8)), 0.0]
    price = dict(zip(cuts, penalty, strict=True))
    least = min(cost([*(c for c, k in zip(cuts[1:-1], keep, strict=True) if k), cuts[-1]], price, window) for keep in itertools.product([0, 1], repeat=8))
    got = packing.plan(cuts, penalty, window)
    assert got[-1] == cuts[-1] and all(b - a <= window for a, b in itertools.pairwise([0, *got]))
    assert cost(got, {e: price.get(e, float(packing.INSIDE)) for e in got}, window) <= least


def test_packer_keeps_order_across_blocks():
    r, packer, out = random.Random(2), packing.Packer(window=64, block=600), []
    lengths = [r.randrange(1, 200) for _ in range(300)]
    for i, n in enumerate(lengths):
        out += packer.add(i, n, np.array(sorted(r.sample(range(1, n + 1), min(n, 5)))))
    out += packer.end()
    flat = [x for w in out for x in w]
    assert flat == sorted(flat) and sum(n for _, _, n in flat) == sum(lengths)
    assert all(sum(n for _, _, n in w) <= 64 for w in out)


def test_ids_come_along(spark, tokenizer):
    rows = packing.pack(frame(spark, "some words here", "and more"), with_ids=True).orderBy("doc_id").collect()
    assert [list(r.ids) for r in rows] == [ids_of(tokenizer, "some words here"), ids_of(tokenizer, "and more")] or sum(len(r.ids) for r in rows) == 7


def test_files_of_other_kinds_are_left_to_tokenizers():
    e = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Some words, HERE", "", "été <|endoftext|> x"]
    assert e.fast is None and [np.frombuffer(x, np.uint32).tolist() for x in e(texts)] == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
