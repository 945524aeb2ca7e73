"""Queries and their DuckDB twins for all registered operators."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelforge.operators.base import REGISTRY, duck_text, written
from panelforge.plans import by_hand, twins
from panelforge.sources import panels

Query = Callable[[SparkSession, str], DataFrame]

#: Modules whose import registers operators.
MODULES = ["panelforge.functions.factors", "panelforge.functions.fields", "panelforge.operators.xs", "panelforge.operators.scores", "panelforge.operators.panel", "panelforge.operators.validation", "panelforge.operators.risk", "panelforge.operators.portfolio"]
for module in MODULES:
    importlib.import_module(module)

BY_HAND: dict[str, tuple[Query, str | None]] = by_hand.QUERIES


def _frame(spark: SparkSession, sf_dir: str, panel: str) -> DataFrame:
    return panels.SPARK[panel](spark, sf_dir) if panel in panels.SPARK else spark.read.parquet(f"{sf_dir}/{panel}.parquet")


def _query(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        entry = REGISTRY[name]
        frames = {k: _frame(spark, sf_dir, p) for k, p in entry.frames.items() if p != "cands"}
        if len(entry.stages) > 2 and "obs" in frames:  # read by most stages: derived and written once
            frames["obs"] = written(frames["obs"])
        n = panels.partitions(_frame(spark, sf_dir, "lineitem")) if entry.frames.get("obs") == "obs" else None
        if entry.by_section and n:
            frames["obs"] = panels.sections(frames["obs"], n)
        if "cands" in entry.frames:
            frames["cands"] = panels.candidates(frames["obs"])
        return entry.run(frames, n or 0, **entry.params)

    return query


def queries() -> dict[str, Query]:
    return {name: _query(name) for name in REGISTRY} | {name: q for name, (q, _) in BY_HAND.items()}


def oracle_sql() -> dict[str, str]:
    """Twins of all queries: second formulas where there are any, the operator's own text otherwise."""
    return {name: duck_text(e, panels.DUCK, panels.NEEDS) for name, e in REGISTRY.items()} | {name: sql for name, (_, sql) in BY_HAND.items() if sql} | twins.texts()
