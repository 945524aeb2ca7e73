"""Mixing sources to target weights by exact subset-sum budget fitting.

Documents are counted by (source, exact size). From those counts alone a bounded-knapsack programme
settles how many documents of each size a source gives; which ones is decided by a seeded hash.
Only counts are gathered per source, never documents, so a hot source costs one row per distinct
size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import n_words

#: Weights by the rank of the source (code point order, null last), repeating.
WEIGHTS = (5, 2, 1)
#: Size of the mix as a share of all sizes, and the most a source may be repeated.
SHARE, MAX_REPEATS = 1.5, 2
#: So many documents or fewer are left to the knapsack as a whole, if its table is no larger than this.
FEW, LARGEST_TABLE = 256, 4_000_000
#: A group of equally long documents is ranked within this many hash ranges, not as one group.
SALTS = 1024


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = MAX_REPEATS) -> DataFrame:
    """(__s, source_size, target): weights share the budget; what exceeds a cap is reshared by weight.

    Filling to a common level: sources sorted by cap / weight reach their caps first, so the level
    is settled by the first source whose cap lies above the level of the rest. The single ordered
    window runs over one row per source.
    """
    s = sizes.groupBy("__s").agg(F.sum("__n").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("__s").asc_nulls_last())) - 1
    s = s.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    s = s.withColumn("__cap", repeats * F.col("source_size").cast("double")).withColumn("__r", F.col("__cap") / F.col("__w"))
    whole, before = Window.partitionBy(), Window.orderBy("__r", F.col("__s").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    budget = F.least(share * F.sum("source_size").over(whole), F.sum("__cap").over(whole))
    s = s.withColumn("__level", (budget - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / (F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))))
    level = F.min(F.when(F.col("__level") <= F.col("__r"), F.struct("__r", "__level"))).over(whole)["__level"]
    return s.select("__s", "source_size", F.least("__cap", F.col("__w") * F.coalesce(level, F.lit(float("inf")))).alias("target"))


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int, seed: int = 0) -> np.ndarray:
    """How many documents of each size to take so that the sum comes as near to budget as it can.

    First every size gives its proportional share, rounded down; then sizes in seeded order give
    one more until twice the longest document is left (or until few documents are, so that these are
    settled together); that is closed by a bounded knapsack over the documents not yet taken (each sum
    remembers the item that first reached it).
    """
    take = np.zeros(len(sizes), np.int64)
    total = int((sizes * counts).sum())
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return counts.astype(np.int64)
    take = (counts * (budget / total)).astype(np.int64)
    left = budget - int((take * sizes).sum())
    order = np.random.default_rng(seed).permutation(len(sizes))
    for i in order:
        if left <= 2 * sizes.max() or (left <= LARGEST_TABLE and (counts - take).sum() <= FEW):
            break
        if sizes[i] and take[i] < counts[i] and sizes[i] <= left:
            take[i] += 1
            left -= int(sizes[i])
    if left <= 0:
        return take
    # A little too much is as good as too little.
    top = left + int(sizes.max())
    via = np.full(top + 1, -1, np.int32)
    via[0] = -2
    items: list[tuple[int, int]] = []
    for i in order:
        spare, power = int(counts[i] - take[i]), 1
        while spare > 0 and 0 < sizes[i] * power <= top and via[left] == -1:
            n = min(power, spare)
            step = int(sizes[i]) * n
            if step <= top:
                new = (via[:-step] != -1) & (via[step:] == -1)
                via[step:][new] = len(items)
                items.append((int(i), n))
            spare -= n
            power *= 2
        if via[left] != -1:
            break
    reached = np.flatnonzero(via != -1)
    at = int(reached[np.argmin(np.abs(reached - left))])
    while at > 0:
        i, n = items[via[at]]
        take[i] += n
        at -= int(sizes[i]) * n
    return take


def _plan(seed: int):
    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__n", ignore_index=True)
        size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        full = int(target // size) if size else 0
        budget = int(round(target)) - full * size
        pdf["__full"] = full
        pdf["__extra"] = fit_counts(pdf["__n"].to_numpy(), pdf["__c"].to_numpy(), budget, seed)
        return pdf[["__s", "__n", "source_size", "target", "__full", "__extra"]]

    return plan


def mix_sources(docs: DataFrame, seed: int = 42, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = MAX_REPEATS) -> DataFrame:
    """docs with size, source_size, target and copies (how often the mix takes the document, 0 up).

    A null source is a source of its own and comes last; a null text has size 0 and is never more
    than repeated whole with its source; an empty table gives no rows. Documents of one size are
    ranked by xxhash64(seed, doc_id, text), so reruns agree and ties are exact copies. Columns of
    docs pass through; size, source_size, target and copies replace columns of those names.
    """
    reserved = {"size", "source_size", "target", "copies"}
    d = docs.drop(*[c for c in docs.columns if c.lower() in reserved])
    d = d.withColumns({"__s": F.col("source"), "__n": n_words(F.col("text")), "__h": F.xxhash64(F.lit(seed), "doc_id", "text")})
    d = d.withColumn("__salt", F.pmod("__h", F.lit(SALTS)).cast("int"))
    by_salt = d.groupBy("__s", "__n", "__salt").agg(F.count("*").alias("__k"))
    by_size = by_salt.groupBy("__s", "__n").agg(F.sum("__k").alias("__c"))
    targets = source_targets(by_size.select("__s", (F.col("__n") * F.col("__c")).alias("__n")), weights, share, repeats)
    # Null sources meet null sources: the keys are compared null-safely through a struct.
    sized = by_size.withColumn("__key", F.struct("__s")).join(targets.withColumn("__key", F.struct("__s")).drop("__s"), "__key").drop("__key")
    plan = sized.groupBy("__s").applyInPandas(_plan(seed), "__s string, __n long, source_size long, target double, __full long, __extra long")
    key = lambda x: x.withColumn("__key", F.struct("__s", "__n"))
    before = Window.partitionBy("__s", "__n").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = key(by_salt.withColumn("__before", F.coalesce(F.sum("__k").over(before), F.lit(0)))).join(key(plan).drop("__s", "__n"), "__key")
    offsets = offsets.select(F.struct("__s", "__n", "__salt").alias("__key"), "__before", "source_size", "target", "__full", "__extra")
    # The window and the join share one shuffle of the documents.
    rank = F.row_number().over(Window.partitionBy("__key").orderBy("__h", "doc_id"))
    d = d.withColumn("__key", F.struct("__s", "__n", "__salt")).withColumn("__rank", rank).join(offsets, "__key")
    copies = F.col("__full") + F.when(F.col("__before") + F.col("__rank") <= F.col("__extra"), 1).otherwise(0)
    keep = [c for c in docs.columns if c.lower() not in reserved]
    return d.select(*keep, F.col("__n").alias("size"), "source_size", "target", F.least(copies, F.lit(repeats)).cast("long").alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' columns, each document as often as the mix takes it."""
    d = mix_sources(docs, **options).where("copies > 0")
    d = d.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return d.select(*docs.columns) if not {"size", "source_size", "target", "copies"} & {c.lower() for c in docs.columns} else _restored(docs, **options)


def _restored(docs: DataFrame, **options) -> DataFrame:
    """As mixed, for docs that have columns of the names that mix_sources adds."""
    renamed = docs.toDF(*[f"__in_{i}" if c.lower() in ("size", "source_size", "target", "copies") else c for i, c in enumerate(docs.columns)])
    return mixed(renamed, **options).toDF(*docs.columns)
