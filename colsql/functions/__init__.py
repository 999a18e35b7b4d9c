"""Functions that Spark lacks, registered under names that begin with colsql_; each works on Arrow batches of about BATCH_BYTES at most."""

from __future__ import annotations

import decimal

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..workers import bounded, importable
from . import json, text

BATCH_BYTES = 4 << 20


def exact_round(x: pd.Series, digits: pd.Series) -> pd.Series:
    """Rounding of a double's exact binary value, half away from zero."""

    def one(v: float, d: int) -> float | None:
        if pd.isna(v):
            return None
        return float(decimal.Decimal(v).quantize(decimal.Decimal(1).scaleb(-int(d)), rounding=decimal.ROUND_HALF_UP, context=decimal.Context(prec=400)))

    return pd.Series([one(v, d) for v, d in zip(x, digits, strict=True)], dtype="float64")


def register(spark: SparkSession) -> None:
    importable(spark)
    bounded(spark, "maxBytesPerBatch", BATCH_BYTES)
    spark.udf.register("colsql_tokens", F.pandas_udf(text.tokens_udf, "string"))
    spark.udf.register("colsql_json", F.pandas_udf(json.select_udf, "string"))
    spark.udf.register("colsql_json_kind", F.pandas_udf(json.kind_udf, "string"))
    spark.udf.register("colsql_round", F.pandas_udf(exact_round, "double"))
