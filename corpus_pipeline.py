"""A corpus pipeline in five stages over `documents`: each reads what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsql.llm import langid, nearcopies, packing, pii, quality
from colsql.llm.common import documents, written

#: The least score of a language that counts as known. Of 2,828 held-out documents of sf0.1 that pass the quality rules the least
#: has 0.62; random letters had 0.40 at most, and six languages that weren't learned 0.31 to 0.48.
MIN_LANGUAGE_SCORE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule. Null, empty and blank texts fail; rows that repeat stay or go alike; an empty table
    gives no rows."""
    return quality.keep_good(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told from the text; the labels of docs teach the classifier. Null and empty texts, and such
    without a letter, go; so do all where no row has a label. Rows that repeat stay or go alike; an empty table gives no rows."""
    return langid.keep_known(docs, MIN_LANGUAGE_SCORE)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the text of the smallest doc_id. Rows without a word and rows of other texts all stay,
    whatever their doc_ids."""
    return nearcopies.keep_first(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, n_chars, if there is such a column, counted anew (null for a null text). Every
    row stays, repeated ones and null ids, too; an empty table gives no rows."""
    out = pii.mask(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their token ids, in windows of 1024 tokens. A null or empty text is the end id alone; rows
    that repeat are packed each time; an empty table gives no rows."""
    return packing.pack(docs, with_ids=True)


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_duplicates", near_duplicate_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: Language, near copies, discovery and packing aren't expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
