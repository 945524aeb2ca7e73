"""All halves of a set of paths as blocks of a matrix product."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Splits that are multiplied at once, and splits of a task.
BLOCK, TASK = 4096, 65_536
#: Scores (paths by candidates) that are sent to every task at most.
MOST_SCORES = 20_000_000
#: Scores become whole numbers, the largest with so many bits, so that sums are exact in any order; two
#: sums are the same if they agree but for this many low bits (about 1e-9 of the largest score).
BITS, LOW_BITS = 46, 16


def unranked(ranks: np.ndarray, n: int, k: int) -> np.ndarray:
    """The subsets of k of n things with these ranks, as rows of 0 and 1 (combinatorial number system)."""
    out = np.zeros((len(ranks), n))
    left, need = ranks.astype(object) if math.comb(n, k) >= 2**63 else ranks.astype(np.int64), np.full(len(ranks), k)
    for at in range(n - 1, -1, -1):
        below = np.array([math.comb(at, j) for j in range(k + 1)], left.dtype)[need]
        take = (need > 0) & (left >= below)
        out[take, at] = 1
        left = np.where(take, left - below, left)
        need = np.where(take, need - 1, need)
    return out


def logits(masks: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Logit of the relative out-of-sample rank of each split's in-sample winner.

    scores has a row for each path and a column for each candidate in the order of their ids: of equal
    ones the last wins, ranks share ties.
    """
    inside = masks @ scores
    outside = np.floor((scores.sum(0) - inside) / 2**LOW_BITS)
    inside = np.floor(inside / 2**LOW_BITS)
    n = scores.shape[1]
    winner = n - 1 - inside[:, ::-1].argmax(1)
    own = outside[np.arange(len(masks)), winner][:, None]
    rank = (outside < own).sum(1) + ((outside == own).sum(1) + 1) / 2
    share = rank / (n + 1)
    return np.log(share / (1 - share))


def half_splits(path_scores: DataFrame, paths: int, **_: object) -> DataFrame:
    """(splits, configs, dropped, lost, logits) by block of the half-splits of (path, config, score).

    Splits are numbered, and a task makes those of its range of numbers. Configurations that lack a
    path or have a score that is not finite are dropped and counted in every row. The scores, paths by
    configurations, are sent to every task: over MOST_SCORES of them are refused.
    """
    if paths % 2 or paths < 4:
        raise ValueError(f"half-splits need an even number of paths, four at least, not {paths}")
    finite = path_scores.where(F.abs("score") < float("inf"))
    whole = finite.groupBy("config").agg(F.count("*").alias("n"), F.countDistinct("path").alias("p")).where(f"n = {paths} AND p = {paths}").select("config")
    kept = finite.join(whole, "config")
    total, n = (x.count() for x in (path_scores.select("config").distinct(), whole))
    if n * paths > MOST_SCORES:
        raise ValueError(f"{n} configurations on {paths} paths are too many for one matrix")
    splits = math.comb(paths, paths // 2)
    ids = path_scores.sparkSession.range(0, splits, BLOCK, max(1, -(-splits // TASK)))
    if n < 2:
        return ids.limit(0).selectExpr("id AS splits", "id AS configs", "id AS dropped", "id AS lost", "1e0 AS logits")
    pdf = kept.toPandas().pivot(index="path", columns="config", values="score").sort_index(axis=0).sort_index(axis=1)
    x = pdf.to_numpy(np.float64)
    exact = np.rint(x * 2.0 ** (BITS - np.floor(np.log2(np.abs(x).max())))) if x.any() else x
    sent = path_scores.sparkSession.sparkContext.broadcast(exact)
    run = functools.partial(_blocks, sent=sent, paths=paths, splits=splits, block=BLOCK, dropped=total - n)
    return ids.mapInArrow(run, "splits long, configs long, dropped long, lost long, logits double")


def _blocks(batches: Iterator[pa.RecordBatch], sent, paths: int, splits: int, block: int, dropped: int) -> Iterator[pa.RecordBatch]:
    scores = sent.value
    for batch in batches:
        for first in batch.column("id").to_pylist():
            masks = unranked(np.arange(first, min(first + block, splits)), paths, paths // 2)
            found = logits(masks, scores)
            row = {"splits": len(found), "configs": scores.shape[1], "dropped": dropped, "lost": int((found <= 0).sum()), "logits": float(found.sum())}
            yield pa.RecordBatch.from_pylist([row])
