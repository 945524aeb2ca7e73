"""How operators are written: Spark SQL over named DataFrames, one function each.

An operator is a function of a dialect and its parameters that returns a query over the frames it
names in braces. Decorated, it becomes a function from DataFrames to a DataFrame that Catalyst plans
as a whole; the registry also renders it for DuckDB, which checks the result.
"""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession


def run(text: str, **frames: DataFrame) -> DataFrame:
    """The query over the DataFrames that stand in braces in its text."""
    return next(iter(frames.values())).sparkSession.sql(text, **frames)


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share; a local one only on a local master."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="panelforge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/panel-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df by way of files in the shared folder: named many times, computed once, safe from lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Counted columns that Spark's ranking and date functions give as int; they are bigint throughout.
_COUNTED = {"y", "place", "grp_no", "fold", "path", "block", "subperiod", "offset_no"}


def widened(df: DataFrame) -> DataFrame:
    return df.selectExpr(*[f"CAST({c} AS BIGINT) AS {c}" if c in _COUNTED and t == "int" else f"`{c}`" for c, t in df.dtypes])


@dataclass
class Dialect:
    """The few functions that Spark and DuckDB call differently."""

    name: str
    #: Partitions for cross-sections that a query deals anew; 0 leaves it to the session.
    sections: int = 0

    def deal(self, columns: str) -> str:
        """A hint that deals the selected rows by these columns."""
        return f"/*+ REPARTITION({self.sections}, {columns}) */ " if self.sections else ""

    def percentile(self, value: str, p: float | str) -> str:
        return f"percentile({value}, {p})" if self.name == "spark" else f"quantile_cont({value}, {p})"

    def sha256(self, text: str) -> str:
        return f"sha2({text}, 256)" if self.name == "spark" else f"sha256({text})"

    def sequence(self, a: str, b: str) -> str:
        return f"sequence({a}, {b})" if self.name == "spark" else f"generate_series({a}, {b})"

    def explode(self, array: str, alias: str) -> str:
        """A lateral table of the array's items; stands after FROM t."""
        return f"LATERAL VIEW explode({array}) AS {alias}" if self.name == "spark" else f", unnest({array}) AS _{alias}({alias})"

    def array(self, items: list) -> str:
        inner = ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in items)
        return f"array({inner})" if self.name == "spark" else f"[{inner}]"

    def array_of(self, *items: str) -> str:
        """An array of expressions."""
        return f"array({', '.join(items)})" if self.name == "spark" else f"[{', '.join(items)}]"

    def shared(self, a: str, b: str) -> str:
        """How many items two arrays of different items share."""
        return f"size(array_intersect({a}, {b}))" if self.name == "spark" else f"len(list_intersect({a}, {b}))"

    def length(self, x: str) -> str:
        return f"size({x})" if self.name == "spark" else f"len({x})"

    def doubles(self, items: tuple) -> str:
        return self.array([f"{float(x)!r}e0" for x in items]).replace("'", "")

    def distinct(self, *columns: str) -> str:
        """How many different tuples of the columns there are."""
        inner = ", ".join(columns)
        return f"count(DISTINCT {inner})" if self.name == "spark" else f"count(DISTINCT ({inner}))"

    def pair(self, a: str, b: str) -> str:
        """A value that is ordered by a, then by b."""
        return f"struct({a}, {b})" if self.name == "spark" else f"row({a}, {b})"

    def levels(self, x: str, part: str = "horizon") -> str:
        """How many different values x has in its part, as a window."""
        return f"size(collect_set({x}) OVER (PARTITION BY {part}))" if self.name == "spark" else f"len(list_distinct(list({x}) OVER (PARTITION BY {part})))"

    def days(self, a: str, b: str) -> str:
        return f"datediff({a}, {b})" if self.name == "spark" else f"date_diff('day', {b}, {a})"

    def json(self, text: str, key: str) -> str:
        return f"get_json_object({text}, '$.{key}')" if self.name == "spark" else f"json_extract_string({text}, '$.{key}')"

    def shift_left(self, x: str) -> str:
        return f"shiftleft(1L, {x})" if self.name == "spark" else f"(1::BIGINT << ({x})::INTEGER)"

    def collect(self, x: str, order: str) -> str:
        """The items of a group as a list; order is the column that DuckDB sorts by, Spark sorts the items."""
        return f"array_sort(collect_list({x}))" if self.name == "spark" else f"list({x} ORDER BY {order})"


SPARK, DUCK = Dialect("spark"), Dialect("duckdb")


@dataclass
class Stage:
    """A stage whose rows pass through a function of the DataFrame; DuckDB gets all of it as SQL.

    more names frames and earlier stages that the function takes as well, by these names. A stage without
    duck is Spark's alone: DuckDB's text of the operator does without it. stored=False leaves a stage that
    is read once to the plan of the result.
    """

    rows: Callable[..., str]
    through: Callable[..., DataFrame]
    duck: Callable[..., str] | None
    more: tuple[str, ...] = ()
    stored: bool = True


@dataclass
class Entry:
    name: str
    text: Callable[..., str]
    frames: dict[str, str]
    params: dict = field(default_factory=dict)
    stages: dict[str, Callable[[Dialect], str] | Stage] = field(default_factory=dict)
    by_section: bool = False

    def run(self, frames: dict[str, DataFrame], sections: int = 0, **params: object) -> DataFrame:
        """The query over its frames; its stages are written first, each as one more frame."""
        frames = dict(frames)
        for name, stage in self.stages.items():
            if isinstance(stage, Stage):
                rows = stage.through(run(stage.rows(SPARK), **frames), **{m: frames[m] for m in stage.more}, **params)
                frames[name] = written(rows) if stage.stored else rows
            else:
                frames[name] = written(run(stage(SPARK), **frames))
        return widened(run(self.text(replace(SPARK, sections=sections), **params), **frames))


#: Registered operators by query name.
REGISTRY: dict[str, Entry] = {}


def operator(name: str, frames: dict[str, str] | None = None, stages: dict[str, Callable[[Dialect], str] | Stage] | None = None, by_section: bool = False, **registered: object) -> Callable:
    """Registers a query text builder; frames maps its frame names to the panels of its query, stages
    are smaller tables that its text names more than once. by_section: its query deals observations by
    cross-section first, in partitions that grow in number with the tables."""

    def wrap(text: Callable[..., str]) -> Callable[..., DataFrame]:
        text = getattr(text, "text", text)
        entry = REGISTRY[name] = Entry(name, text, frames or {}, dict(registered), stages or {}, by_section)

        @functools.wraps(text)
        def apply(**given: object) -> DataFrame:
            dfs = {k: v for k, v in given.items() if isinstance(v, DataFrame)}
            return entry.run(dfs, **{k: v for k, v in given.items() if k not in dfs})

        apply.text = text
        apply.__wrapped__ = text
        return apply

    return wrap


def duck_text(entry: Entry, panels: dict[str, str], needs: dict[str, list[str]]) -> str:
    """The query for DuckDB: panels as common table expressions before the same operator."""
    wanted: list[str] = []
    for panel in entry.frames.values():
        for p in [*needs.get(panel, []), panel]:
            if p not in wanted:
                wanted.append(p)
    stages = {s: t for s, t in entry.stages.items() if not isinstance(t, Stage) or t.duck}
    names = entry.frames | {s: s for s in stages}
    named = lambda t: re.sub(r"\{(\w+)\}", lambda m: names[m[1]], t)
    text = named(entry.text(DUCK, **entry.params))
    tables = ", ".join([f"{p} AS MATERIALIZED ({panels[p]})" for p in wanted if p in panels] + [f"{s} AS MATERIALIZED ({named(t.duck(DUCK, **entry.params) if isinstance(t, Stage) else t(DUCK))})" for s, t in stages.items()])
    return f"WITH {tables} SELECT * FROM ({text}) AS result" if tables else text
