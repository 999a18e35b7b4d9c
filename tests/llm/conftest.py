import pytest
from pyspark.sql import Row

LONG = "the quick word " * 30_000

#: Nulls in every column, empty, blank, very long, repeated and equal texts, other scripts, white space of all kinds.
TEXTS = [
    (1, "The cat sat on the mat and the dog ran to the old house by the river in the dark night of the year"),
    (2, "The cat sat on the mat and the dog ran to the old house by the river in the dark night of the year"),
    (2, "The cat sat on the mat and the dog ran to the old house by the river in the dark night of the year"),
    (3, None),
    (4, ""),
    (5, " \t\r\n\x0b\x0c "),
    (6, "word"),
    (7, LONG),
    (None, "a row without an id, to be counted all the same"),
    (None, None),
    (8, "Ünïcode straße  non breaking 你好 🙂🙂 end"),
    (9, "mail a.b@c.de and a.b@c.de, card 4111 1111 1111 1111, ip 10.0.0.1, call +49 (30) 1234567"),
    (10, "\n\na b\n\na b\n\na b c # $ %"),
    (11, "1234 5678 !!! ???"),
]
#: Names that operators use themselves.
CLASHES = ["word", "row", "fp", "key", "score", "lang_pred", "sigs", "next", "_keep", "_k", "_b", "_text", "_0", "_id", "c", "node", "shard", "spans", "kept", "sequence_id", "size", "box"]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows of `documents` that no operator may trip over, with extra columns of clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    langs = ["en", "en", None, "de"]
    rows = [(i, t, langs[k % 4], None if k % 5 == 0 else f"s{k % 3}", None if t is None else len(t), *(None if k % 2 else f"x{k}" for _ in CLASHES)) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, schema).repartition(2).cache()


@pytest.fixture(scope="session")
def empty(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def frame(spark, *texts):
    return spark.createDataFrame([Row(doc_id=i, text=t) for i, t in enumerate(texts)], "doc_id long, text string")
