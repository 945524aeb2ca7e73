"""File sources and sinks of panels: delimited bars, memberships, universes, snapshots, bundles."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Header names that mean the same column.
ALIASES = {"instrument": ["code", "symbol", "ticker"], "session": ["date", "trade_date", "day"], "open": ["open_price"], "high": ["high_price"], "low": ["low_price"], "close": ["close_price", "last"], "volume": ["vol"], "amount": ["turnover"]}


#: Times in delimited files, to the microsecond.
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _named(df: DataFrame) -> DataFrame:
    """Columns under their canonical names; unknown ones stay as they are."""
    known = {alias: name for name, aliases in ALIASES.items() for alias in [name, *aliases]}
    return df.toDF(*[known.get(c.strip().lower(), c.strip().lower()) for c in df.columns])


def read_bars_long(spark: SparkSession, path: str) -> DataFrame:
    """Bars from delimited files with alias headers; a number that can't be read is null and marks its
    row in the column bad, so one row never fails a job."""
    raw = _named(spark.read.option("header", True).csv(path))
    numbers = ["open", "high", "low", "close", "volume", "amount"]
    cast = {c: F.expr(f"try_cast({c} AS DOUBLE)") for c in numbers}
    bad = F.greatest(*[(F.col(c).isNotNull() & cast[c].isNull()).cast("int") for c in numbers]) == 1
    return raw.select("instrument", F.expr("try_cast(session AS DATE)").alias("session"), *[cast[c].alias(c) for c in numbers], bad.alias("bad"))


def read_memberships(spark: SparkSession, path: str) -> DataFrame:
    """Point-in-time memberships with a flag for rows whose times are out of order."""
    schema = "kind string, effective_at timestamp, available_at timestamp, ingested_at timestamp, instrument string, group_id string, group_name string"
    d = spark.read.schema(schema).option("header", True).option("timestampFormat", STAMP).csv(path)
    return d.withColumn("in_order", (F.col("effective_at") <= F.col("available_at")) & (F.col("available_at") <= F.col("ingested_at")))


def write_universe(universe: DataFrame, path: str) -> None:
    """One JSON line for each session with its members in order of place."""
    members = F.transform(F.array_sort(F.collect_list(F.struct("place", "instrument"))), lambda x: x["instrument"])
    universe.groupBy("session").agg(members.alias("members")).write.json(path)


def read_universe(spark: SparkSession, path: str, top_n: int) -> DataFrame:
    """(session, instrument, place) of the first top_n stored members."""
    d = spark.read.schema("session date, members array<bigint>").json(path)
    return d.select("session", F.posexplode("members").alias("pos", "instrument")).where(F.col("pos") < top_n).select("session", "instrument", (F.col("pos") + 1).cast("bigint").alias("place"))


def write_tiers(universe: DataFrame, path: str, tops: tuple[int, ...] = (10, 50), finish: bool = True) -> int:
    """A new version of a universe (session, instrument, place), partitioned by session; returns its number.

    Tiers are nested: a member stands in every tier whose size is at least its place. Rows are written
    first, below a version of their own; the manifest that names the version and its rows comes last, and
    readers go by manifests alone: a write that was interrupted (finish = False stops before the
    manifest) leaves the old version as it was.
    """
    spark = universe.sparkSession
    version = 1 + max(_versions(spark, path), default=0)
    rows = universe.select("session", "instrument", F.col("place").cast("bigint").alias("place"), *[(F.col("place") <= n).alias(f"top{n}") for n in tops])
    rows.repartition("session").sortWithinPartitions("session", "place").write.mode("overwrite").partitionBy("session").parquet(f"{path}/data/version={version}")
    if finish:
        stored = spark.read.parquet(f"{path}/data/version={version}")
        digest = F.sum(F.xxhash64("session", "instrument", "place").cast("decimal(38,0)")).cast("string")
        manifest = stored.agg(F.lit(version).alias("number"), F.count("*").alias("rows"), F.countDistinct("session").alias("sessions"), digest.alias("digest"))
        manifest.coalesce(1).write.json(f"{path}/manifest/version={version}")
    return version


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The finished versions of a path; none if there is no manifest yet."""
    try:
        return [r.number for r in spark.read.schema("number int, rows long, sessions long, digest string").json(f"{path}/manifest/*").collect()]
    except AnalysisException:
        return []


def read_tiers(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of the last finished version, or of a given finished one."""
    found = _versions(spark, path)
    if not found or (version is not None and version not in found):
        raise ValueError(f"no finished version of {path}")
    return spark.read.parquet(f"{path}/data/version={version or max(found)}")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index levels; blank opens and repeated dates are counted by session rather than refused."""
    d = spark.read.schema("session date, open double").option("header", True).csv(path)
    return d.groupBy("session").agg(F.max("open").alias("open"), F.count("*").alias("rows_seen"), F.sum(F.col("open").isNull().cast("long")).alias("blank"))


def snapshot(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Name, length and SHA-256 of every file, and the hash of all of them in order of name.

    A file is hashed as one value, as its format demands; the list of names and hashes is one row.
    """
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))
    whole = files.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("name", "sha256")))), 256).alias("dataset_sha256"))
    return files.join(F.broadcast(whole), how="cross")


def write_bundle(rows: DataFrame, path: str) -> None:
    """Canonical JSON lines in order."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value")).orderBy("value").write.text(path)
