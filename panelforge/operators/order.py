"""Exact order statistics of groups that no single task should hold.

Ranks: distinct values are counted, dealt by ranges of (group, value), summed up within each range,
and moved by the counts of the ranges before. Quantiles: a counted histogram is refined around the
wanted places until a bin fits one row. Neither rounds a value nor depends on its unit.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.operators.base import written

#: Distinct values of a range, on average: what one task sorts.
PER_RANGE = 1_000_000
#: Bins that an interval is cut into, and values that are sorted within one row at last.
BINS, FITS = 1024, 10_000
#: Rows of a small table that are sent to every task at most; beyond it Spark picks the join.
FEW = 500_000
#: Rows of a range of a column, on average, where rows are ranked as they are, and cuts between ranges of a group at most.
ROWS, CUTS = 400_000, 1023


def joined(a: DataFrame, b: DataFrame, on: list[str], also: Column | None = None) -> DataFrame:
    """a with the other columns of b where the columns on are the same, nulls included."""
    right = b.select(*[F.col(c).alias(f"__{c}") for c in on], *[c for c in b.columns if c not in on])
    same = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on])
    small = F.broadcast(right) if b.count() <= FEW else right
    return a.join(small, same if also is None else same & also).drop(*[f"__{c}" for c in on])


def places(df: DataFrame, by: list[str], values: list[str], name: str) -> DataFrame:
    """df with name_before (rows of the group that sort before this one) and name_ties (equal rows).

    The average rank is before + (ties + 1) / 2. Rows are ordered by values in turn; a null is a value
    of its own, before all others, and NaN comes last. Ties are one counted row, however many they are,
    so a range holds distinct values only and equal ones never lie in two ranges.
    """
    counted = written(df.groupBy(*by, *values).agg(F.count("*").alias("ties")))
    ranges = max(1, -(-counted.count() // PER_RANGE))
    ranged = written(counted.repartitionByRange(ranges, *by, *values).withColumn("range_no", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "range_no").agg(F.sum("ties").alias("rows_here"))
    earlier = Window.partitionBy(*by).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, "range_no", F.coalesce(F.sum("rows_here").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("range_no", *by).orderBy(*values).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("local", F.coalesce(F.sum("ties").over(within), F.lit(0)))
    moved = joined(local, offsets, [*by, "range_no"])
    found = moved.select(*by, *values, (F.col("local") + F.col("offset")).alias(f"{name}_before"), F.col("ties").alias(f"{name}_ties"))
    return joined(df, written(found), [*by, *values])


def ranked(df: DataFrame, by: list[str], names: dict[str, list[str]], stored: DataFrame | None = None) -> DataFrame:
    """df with name_before and name_ties, as in places, for every name and the columns that it is ordered by.

    All begin with the same column, of doubles. Rows go once to ranges of it that lie between approximate
    quantiles of their group; each range is ranked by itself and moved by the counts of the ranges before.
    Groups are few: their cuts are sent to the tasks. Equal values stay in one range, however many they are.
    stored are the same rows where they can be read cheaply for cuts and counts, if df is not.
    """
    stored = df if stored is None else stored
    column = next(iter(names.values()))[0]
    known = F.when(~F.isnan(column), F.col(column))
    probs = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    groups = stored.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx(known, probs, 10 * CUTS).alias("cuts")).collect()
    if not groups:
        groups = [(*[None] * len(by), 0, None)]
    ranges = [min(CUTS + 1, max(1, -(-g[-2] // ROWS))) for g in groups]
    cuts = [np.unique(np.array(g[-1] or [], float)[[i * (CUTS + 1) // r - 1 for i in range(1, r)]] if g[-1] else np.zeros(0)) for g, r in zip(groups, ranges, strict=True)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, x = batch.column("group_no").to_numpy(), batch.column(column).fill_null(-np.inf).to_numpy()
            range_no = np.zeros(len(x), np.int64)
            for g in np.unique(group).tolist():
                mine = np.flatnonzero(group == g)
                range_no[mine] = np.searchsorted(cuts[g], x[mine], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(range_no)], names=[*batch.schema.names, "range_no"])

    fields = [df.schema[c] for c in by]
    numbers = df.sparkSession.createDataFrame([(*g[:-2], i) for i, g in enumerate(groups)], T.StructType([*[T.StructField(f.name, f.dataType) for f in fields], T.StructField("group_no", T.LongType())]))

    def dealing(rows: DataFrame) -> DataFrame:
        numbered = joined(rows, numbers, by)
        return numbered.mapInArrow(deal, T.StructType([*numbered.schema.fields, T.StructField("range_no", T.LongType())]))

    earlier = Window.partitionBy("group_no").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealing(stored.select(*by, column)).groupBy("group_no", "range_no").agg(F.count("*").alias("rows_here"))
    offsets = written(sums.select("group_no", "range_no", F.coalesce(F.sum("rows_here").over(earlier), F.lit(0)).alias("offset")))
    at = ["group_no", "range_no"]
    out = dealing(df).repartition(max(sum(ranges), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *at)
    for name, columns in sorted(names.items(), key=lambda item: -len(item[1])):  # the longest order serves the others
        out = out.withColumn(f"{name}_before", F.rank().over(Window.partitionBy(*at).orderBy(*columns)).cast("long") - 1).withColumn(f"{name}_ties", F.count("*").over(Window.partitionBy(*at, *columns)))
    out = out.join(F.broadcast(offsets), at)
    return out.select(*df.columns, *[c for name in names for c in ((F.col(f"{name}_before") + F.col("offset")).alias(f"{name}_before"), f"{name}_ties")])


def kth_values(rows: DataFrame, by: list[str], value: str, wanted: DataFrame) -> DataFrame:
    """(by, k, value) for the wanted (by, k): the value at place k, from 0, among a group's finite values.

    Every pass reads rows once and counts at most BINS bins around each place that is still open;
    places out of range give no row. rows should be cheap to read again: a stored table, or one joined
    to a small one.
    """
    x = rows.where(F.abs(value) < float("inf")).select(*by, F.col(value).cast("double").alias("x"))
    ends = written(x.groupBy(*by).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")))
    both = joined(wanted, ends, by)
    now = written(both.where("k >= 0 AND k < n").select(*by, "k", F.lit(0).cast("long").alias("before"), "n", "lo", "hi").distinct())
    found = now.where("lo = hi").select(*by, "k", F.col("lo").alias("value"))
    while True:
        small, large = now.where(f"lo < hi AND n <= {FITS}"), now.where(f"lo < hi AND n > {FITS}")
        held = _inside(x, small, by).groupBy(*by, "k", "before").agg(F.array_sort(F.collect_list("x")).alias("xs"))
        found = found.unionByName(held.select(*by, "k", F.element_at("xs", (F.col("k") - F.col("before") + 1).cast("int")).alias("value")))
        if large.isEmpty():
            return found
        bin_no = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
        bins = _inside(x, large, by).groupBy(*by, "k", "before", bin_no.alias("bin_no")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        earlier = Window.partitionBy(*by, "k").orderBy("bin_no").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        now = written(bins.where("k >= before AND k < before + n").select(*by, "k", "before", "n", "lo", "hi"))
        found = found.unionByName(now.where("lo = hi").select(*by, "k", F.col("lo").alias("value")))


def _inside(x: DataFrame, open_places: DataFrame, by: list[str]) -> DataFrame:
    return joined(x, open_places, by, (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))


def quantiles(rows: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """(by, one column for each name in at): quantiles with linear interpolation between two places."""
    sizes = written(rows.where(F.abs(value) < float("inf")).groupBy(*by).agg(F.count("*").alias("n")))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("n") - 1)).alias("place")) for name, p in at.items()]))
    asked = sizes.select(*by, each.alias("q")).select(*by, "q.name", "q.place")
    ends = asked.select(*by, "name", (F.col("place") - F.floor("place")).alias("weight"), F.floor("place").alias("low"), F.ceil("place").alias("high"))
    wanted = ends.select(*by, F.explode(F.array("low", "high")).alias("k")).distinct()
    got = written(kth_values(rows, by, value, wanted))
    lows, highs = (got.select(*by, F.col("k").alias(k), F.col("value").alias(f"{k}_value")) for k in ("low", "high"))
    both = joined(joined(ends, lows, [*by, "low"]), highs, [*by, "high"])
    exact = F.col("low_value") + F.col("weight") * (F.col("high_value") - F.col("low_value"))
    return both.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, exact)).alias(name) for name in at])
