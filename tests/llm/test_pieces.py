"""Encoding against all segmentations of short texts, and decoding of everything."""

import functools
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from colsql.llm import pieces

from .conftest import frame


@pytest.fixture(scope="module")
def model():
    return pieces.Model()


def score(model):
    of = {t: s for t, (_, _, s) in ((k, model.automaton.get(k)) for k in model.automaton.keys())}
    return of


def best_score(text, of):
    @functools.cache
    def best(i):
        if i == len(text):
            return 0.0
        out = best(i + 1) - pieces.BYTE_COST * len(text[i].encode())
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in of:
                out = max(out, of[text[i:j]] + best(j))
        return out

    return best(0)


def test_scores_are_the_best(model):
    of, r = score(model), random.Random(0)
    for _ in range(200):
        text = "".join(r.choice(["the", "ing", "▁", "a", "é", "你", "x9", "qu", "🙂", "tion"]) for _ in range(r.randrange(1, 12)))
        ids = model.viterbi(text)
        got = sum(of[model.text[i]] if i not in model.byte_of else -pieces.BYTE_COST for i in ids)
        assert got == pytest.approx(best_score(text, of))


def test_chunks_give_what_the_whole_gives(model):
    of, r = score(model), random.Random(1)
    for _ in range(100):
        text = "".join(r.choice(["the", " ", "  ", "Straße", "\n", "a", "!?", "12"]) for _ in range(r.randrange(1, 15)))
        whole = "▁" + text.replace(" ", "▁")
        ids = np.frombuffer(model.encode(text), np.uint32).tolist()
        total = lambda ids: sum(of[model.text[i]] if i not in model.byte_of else -pieces.BYTE_COST for i in ids)
        assert total(ids) == pytest.approx(total(model.viterbi(whole)))


def test_round_trip(spark, docs):
    encoded = pieces.encode(docs, with_ids=True).cache()
    assert encoded.where("not round_trip").count() == 0
    back = {r.doc_id: r.text for r in pieces.decode(encoded).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}


def test_nulls_and_odd_texts(spark):
    texts = [None, "", " ", "  a  b ", "\t\n", "🙂🙂", "a" * 5000, "▁"]
    encoded = pieces.encode(frame(spark, *texts), with_ids=True)
    rows = {r.doc_id: r for r in encoded.collect()}
    assert rows[0].n_pieces is None and rows[0].ids is None and rows[1].n_pieces == 0
    assert all(r.round_trip for i, r in rows.items() if i)
    back = {r.doc_id: r.text for r in pieces.decode(encoded).collect()}
    assert [back[i] for i in range(len(texts))] == [*texts[:-1], " "]  # U+2581 stands for a space


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The public file's pieces as a unigram model of the library: a score for each, no text changed."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    proto.normalizer_spec.CopyFrom(pb.NormalizerSpec(name="identity", add_dummy_prefix=True, remove_extra_whitespaces=False, escape_whitespaces=True))
    r = random.Random(6)
    for p in proto.pieces:
        if p.type == pb.ModelProto.SentencePiece.NORMAL:
            p.score = -r.uniform(3, 6) - 2.0 / len(p.piece)  # long pieces often win, not always
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    return str(path)


def test_ids_are_those_of_the_library(unigram, docs):
    """scores="file", whole texts: the same ids, or where several segmentations are as good, the same sum of scores."""
    model, library = pieces.Model(unigram, "file"), sentencepiece.SentencePieceProcessor(model_file=unigram)
    texts = [r.text for r in docs.collect() if r.text] + ["a  b", " x ", "tab\tand\nline", "Straße 🙂 你好", "x" * 3000]
    of, same = score(model), 0
    total = lambda ids: sum(of[model.text[i]] if i not in model.byte_of else -pieces.BYTE_COST for i in ids)
    for t in texts:
        got, expected = np.frombuffer(model.encode(t), np.uint32).tolist(), library.encode(t)
        same += got == expected
        assert got == expected or total(got) == pytest.approx(total(expected), abs=1e-3 * len(got))
    assert same >= 0.9 * len(texts)


def test_scores_of_the_file_in_the_operator(spark, unigram):
    library = sentencepiece.SentencePieceProcessor(model_file=unigram)
    texts = ["the cat sat on the mat", "and more"]
    rows = {r.doc_id: list(r.ids) for r in pieces.encode(frame(spark, *texts), path=unigram, scores="file", with_ids=True).collect()}
    assert rows == {i: library.encode(t) for i, t in enumerate(texts)}
