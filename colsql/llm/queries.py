"""The registered queries of this subpackage: each applies its operator to the whole table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, lm, packing, pieces, pii, quality, sharding, simhash, spotsigs, tokencount
from .common import documents


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their components. Null, empty and blank texts have fingerprint zero; repeated rows and
    null ids have a result each; an empty table gives no rows."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id", "links")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents. Null, empty and blank texts have no words and fail the base; repeated rows and null ids
    have a result each; an empty table gives no rows."""
    return quality.measures(documents(spark, sf_dir))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents. A null text has nulls, an empty one none; repeated rows and null ids have a result each; an empty table
    gives no rows."""
    return pieces.encode(documents(spark, sf_dir))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents. Null and empty texts are the end alone; repeated rows and null ids have a result each (crc32 of an
    empty text is 0, so null ids are learned from); an empty table gives no rows."""
    return lm.held_out_scores(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024. Null and empty texts are the end id alone; repeated rows and null ids are packed each;
    an empty table gives no rows."""
    return packing.pack(documents(spark, sf_dir))


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and likenesses. Null texts are empty; rows with equal ids follow one
    another in an order that their texts determine, null ids come first; a table of one row follows itself; an empty one gives none."""
    rows = spotsigs.edited_and_next(documents(spark, sf_dir))
    own = spotsigs.members(F.col("fingerprint"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        spotsigs.likeness(own, spotsigs.members(F.col("edited_fingerprint"))).alias("near_edited"), spotsigs.likeness(own, spotsigs.members(F.col("next_fingerprint"))).alias("near_next"),
    )


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents. `und` for null and empty texts and such without a letter, and for all if nothing is learned; repeated
    rows and null ids have a result each; an empty table gives no rows."""
    docs = documents(spark, sf_dir)
    out = langid.bucket("doc_id", 3) == 1
    model = langid.fit(docs.where(~out))
    return langid.predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), "text"), model).drop("text")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents. Null, empty and blank texts have 0; repeated rows and null ids have a result each; an empty table
    gives no rows."""
    return tokencount.token_counts(documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents. Null texts have size 1; repeated rows and null ids have a place each; an empty table gives no rows."""
    rows = sharding.shard(documents(spark, sf_dir), 16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents. Null and empty texts have none; repeated rows and null ids have a result each; an empty table
    gives no rows."""
    found = pii.find(documents(spark, sf_dir))
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2(pii.text_of(F.col("base")), 256).alias("base_sha256"), pii.text_of(F.col("spans")).alias("spans"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py over `documents`; its docstrings say what odd rows give."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    all_ = (op1_simhash, op2_quality, op3_pieces, op4_lm, op5_packing, op6_spotsigs, op7_langid, op8_token_counts, op9_sharding, op10_pii, pipeline)
    return {f.__name__: f for f in all_}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return ORACLES
