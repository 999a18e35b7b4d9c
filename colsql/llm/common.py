"""What the operators of this subpackage share: reading, bounded Arrow batches, written intermediate tables, components."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import bounded, importable

#: Rows and bytes of an Arrow batch: texts may be very long.
BATCH_ROWS, BATCH_BYTES = 512, 32 << 20
#: What no word holds: the words of a text are its maximal runs of other characters. bytes.split() splits by exactly these.
SPACE = r"\x20\x09-\x0D"
_LIVE: set[tuple[SparkSession, str]] = set()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _released(batches: Iterator[pa.RecordBatch], f: Callable) -> Iterator[pa.RecordBatch]:
    """f's batches; then what the task has freed goes back to the system, as its worker lives on beside later stages."""
    yield from f(batches)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """mapInArrow over batches of at most BATCH_ROWS rows and about BATCH_BYTES (a row alone may have more). The session's settings say so,
    as they are read when a plan runs; smaller ones of the caller stay."""
    importable(df.sparkSession)
    bounded(df.sparkSession, "maxRecordsPerBatch", BATCH_ROWS)
    bounded(df.sparkSession, "maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(partial(_released, f=f), schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one in /tmp for a local master and one in the warehouse else."""
    for get in (lambda: spark.conf.get("spark.checkpoint.dir"), lambda: spark.sparkContext.getConf().get("spark.checkpoint.dir")):
        try:
            if found := get():
                return found.rstrip("/")
        except Exception:  # noqa: BLE001  an unset key
            continue
    if spark.sparkContext.master.startswith("local"):
        return "file:/tmp/checkpoints/colsql"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"


def delete(spark: SparkSession, path: str) -> None:
    _LIVE.discard((spark, path))
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Written(DataFrame):
    """Only a name for type hints: a DataFrame over a written table, with its path in .path."""

    path: str


def written(df: DataFrame) -> Written:
    """df, written to the shared folder and read again: lineage is cut, a lost executor loses nothing, and the plan
    above has no partitioning that would keep Spark from splitting a hot key."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/colsql-{uuid.uuid4().hex}"
    _LIVE.add((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.path = path
    return out


def drop(*tables: Written) -> None:
    for t in tables:
        delete(t.sparkSession, t.path)


@atexit.register
def _drop_all() -> None:
    for spark, path in list(_LIVE):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended
            return


def components(edges: DataFrame) -> Written:
    """Connected components of edges(u, v): (node, root), root the smallest node reachable; only for nodes in edges.

    Alternating large-star and small-star steps, each a map-side-combined minimum and a join of two written tables, so a
    node with very many neighbours is split by adaptive execution. Each round's table replaces the one before.
    Nulls and self-loops are left out; no edges give no rows.
    """
    u, v = F.col("u"), F.col("v")
    now = written(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    state = _state(now)
    while True:
        both = now.union(now.select("v", "u"))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = written(now.select(u.alias("v"), v.alias("u")).join(low, "u").select(v.alias("u"), F.col("m").alias("v")).distinct())
        low2 = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low2, "u").select(F.when(v == F.col("m"), u).otherwise(v).alias("u"), F.col("m").alias("v"))
        after = written(small.where(u != v).distinct())
        drop(now, low, large, low2)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    out = written(now.select(u.alias("node"), v.alias("root")).union(now.select(v, v).distinct()))
    drop(now)
    return out


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
