"""What the text operators share: tables, the shared folder, block sizes and components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="panelforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/panelforge-{spark.sparkContext.applicationId}"


def written(df: DataFrame, what: str, fmt: str = "parquet") -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it back.

    Lost executors cost a re-read of these files, not a rerun of the work behind them.
    """
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").format(fmt).save(path)
    return df.sparkSession.read.schema(df.schema).format(fmt).load(path)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def give_back() -> None:
    """Returns a Python worker's freed memory to the system: it lives on beside the next stage's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def few(df: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """df marked for a broadcast if it has at most so many (narrow) rows; beyond, Spark picks the join."""
    return F.broadcast(df) if df.count() <= rows else df


def blocks_for(amount: int | None, per_block: int) -> int:
    """So many blocks that one holds per_block on average: grows with the input, no upper limit."""
    return max(1, -(-int(amount or 0) // per_block))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an undirected edge list.

    Alternates large-star and small-star steps until the edges stand still; every step's minima and
    edges are written to the shared folder, so no plan names the step before it. Self loops and
    repeated edges are fine, null ends are dropped, an empty list gives no rows.
    """
    digest = lambda x: tuple(x.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = written(e, "edges")
    before, now = None, digest(e)
    while before != now:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = written(small.where("u <> v").distinct(), "edges")
        before, now = now, digest(e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
