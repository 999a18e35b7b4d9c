"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_LIVE: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one in /tmp for a local master and one in the warehouse else."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return "file:/tmp/checkpoints/colsql"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"


def written(df: DataFrame) -> DataFrame:
    """df, written and read again: its lineage is cut."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/colsql-{uuid.uuid4().hex}"
    _LIVE.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _LIVE:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session has ended
            return
