"""Content of files of any size as a tree of hashes, so that no file is a cell and no list of names a row.

Spark's text reader deals a file to tasks by blocks and hands on the bytes between line feeds as they
are, whatever they mean. A leaf is the hash of one such run of bytes; FAN leaves in order make a node of
the first level, FAN of those one of the second, and so on. The result depends on bytes, names and
FAN alone: not on how files were split, on cores, or on the order in which they were read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.operators.base import written

#: Children of a node: at most so many hashes of 32 bytes meet in one row.
FAN = 4096
#: Leading hex digits of a name's hash that deal files to the nodes of the dataset's tree.
DEAL = 3


def _sha(x: Column) -> Column:
    return F.unhex(F.sha2(x, 256))


def _in_order(key: str, digest: str) -> Column:
    """Hash of a group's digests, joined in order of key."""
    pairs = F.array_sort(F.collect_list(F.struct(key, digest)))
    return _sha(F.unhex(F.array_join(F.transform(pairs, lambda x: F.hex(x[digest])), "")))


def _leaves(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, at, leaf): every run's hash and its place in the file.

    Places within a block are counted block by block; blocks are placed by the counts of those before.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    hashed = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), _sha(F.col("value").cast("binary")).alias("leaf"))
    # Written once: another scan might cut the files elsewhere.
    hashed = written(hashed)
    counts = hashed.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("file", "block", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("id")) - 1
    return hashed.withColumn("inside", inside).join(offsets, ["file", "block"]).select("file", (F.col("before") + F.col("inside")).alias("at"), "leaf")


def file_roots(spark: SparkSession, path: str | list[str], fan: int = FAN) -> DataFrame:
    """(file, length, runs, root): one row for every file that holds a byte (Spark's readers skip the rest).

    runs counts the byte runs between line feeds as Spark's reader gives them (a last line feed opens no
    run). root is the lowercase hex hash of `length:runs:` and the top node. file is a URI, so a blank in a
    name is %20. A single run must fit a row (2 GB); a whole file need not.
    """
    if fan < 2:
        raise ValueError("a node has two children at least")
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "length")
    nodes = _leaves(spark, path).select("file", "at", F.col("leaf").alias("digest"))
    nodes = written(nodes.withColumn("up", F.floor(F.col("at") / fan)).groupBy("file", "up").agg(_in_order("at", "digest").alias("digest"), F.count("*").alias("n")).select("file", F.col("up").alias("at"), "digest", "n"))
    # One round a level: the widest file decides how many there are, and the others wait with one node.
    while (nodes.agg(F.max("at")).first()[0] or 0) > 0:
        many = F.max("at").over(Window.partitionBy("file")) > 0
        level = nodes.withColumn("many", many).withColumn("up", F.floor(F.col("at") / fan))
        joined = level.where("many").groupBy("file", "up").agg(_in_order("at", "digest").alias("digest"), F.sum("n").alias("n"))
        nodes = written(joined.select("file", F.col("up").alias("at"), "digest", "n").unionByName(level.where("not many").select("file", "at", "digest", "n")))
    head = F.encode(F.concat_ws(":", "length", "n", F.lit("")), "UTF-8")
    return files.join(nodes, "file").select("file", "length", F.col("n").alias("runs"), F.sha2(F.concat(head, "digest"), 256).alias("root"))


def snapshot_tree(spark: SparkSession, path: str | list[str], base: str = "", fan: int = FAN) -> DataFrame:
    """(name, length, runs, root, dataset_root): every file, and one root over all names and roots.

    name is what follows base in a file's address (all of its last part if base is empty), so a dataset
    keeps its root where it is moved. Files are dealt to nodes by the first digits of their name's hash;
    within a node they stand in order of name, and the nodes in order of their digits.
    """
    name = F.substring_index("file", f"/{base.strip('/')}/", -1) if base else F.element_at(F.split("file", "/"), -1)
    files = written(file_roots(spark, path, fan).select(name.alias("name"), "length", "runs", "root"))
    named = files.select(F.substring(F.sha2(F.encode("name", "UTF-8"), 256), 1, DEAL).alias("node"), "name", F.unhex(F.sha2(F.encode(F.concat_ws("\n", "name", "root"), "UTF-8"), 256)).alias("digest"))
    nodes = named.groupBy("node").agg(_in_order("name", "digest").alias("digest"))
    whole = nodes.agg(F.lower(F.hex(_in_order("node", "digest"))).alias("dataset_root"))
    return files.join(F.broadcast(whole), how="cross")
