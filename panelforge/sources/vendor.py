"""Vendor files whose headers differ from file to file: daily bars and six alternative sources.

Files are read as lines, so a large one is split like any text. A line that names both a date and an
instrument column is its file's header; headers, one row for each file, are resolved to positions and
joined to the lines. What can't be used is kept with a reason instead of failing the job.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.operators.base import written

#: Header names of daily files, lower case, without blanks.
DAILY = {
    "session": ("日期", "交易日期", "trade_date", "date"),
    "instrument": ("代码", "股票代码", "证券代码", "ts_code", "instrument"),
    "open": ("开盘价", "开盘", "open"),
    "high": ("最高价", "最高", "high"),
    "low": ("最低价", "最低", "low"),
    "close": ("收盘价", "收盘", "close"),
    "volume": ("成交量(手)", "成交量（手）", "vol"),
    "amount": ("成交额(千元)", "成交额（千元）", "amount"),
    "adjustment_factor": ("复权因子", "adj_factor", "adjustment_factor"),
}
#: Shares of a lot, and units of a thousand.
LOT, THOUSAND = 100.0, 1000.0

#: Columns of the alternative sources with what their unit is multiplied by.
FIELDS = {
    "fund_flow": {
        "small_buy_volume": ("小单买入量(手)", 100.0), "small_buy_amount": ("小单买入金额(万元)", 10000.0), "small_sell_volume": ("小单卖出量(手)", 100.0), "small_sell_amount": ("小单卖出金额(万元)", 10000.0),
        "medium_buy_volume": ("中单买入量(手)", 100.0), "medium_buy_amount": ("中单买入金额(万元)", 10000.0), "medium_sell_volume": ("中单卖出量(手)", 100.0), "medium_sell_amount": ("中单卖出金额(万元)", 10000.0),
        "large_buy_volume": ("大单买入量(手)", 100.0), "large_buy_amount": ("大单买入金额(万元)", 10000.0), "large_sell_volume": ("大单卖出量(手)", 100.0), "large_sell_amount": ("大单卖出金额(万元)", 10000.0),
        "extra_large_buy_volume": ("特大单买入量(手)", 100.0), "extra_large_buy_amount": ("特大单买入金额(万元)", 10000.0), "extra_large_sell_volume": ("特大单卖出量(手)", 100.0), "extra_large_sell_amount": ("特大单卖出金额(万元)", 10000.0),
        "net_inflow_volume": ("净流入量(手)", 100.0), "net_inflow_amount": ("净流入额(万元)", 10000.0),
    },
    "auction": {
        "auction_return": ("集合竞价涨幅%", 0.01), "auction_price": ("集合竞价成交价", 1.0), "auction_volume": ("集合竞价成交量(股)", 1.0), "auction_amount": ("集合竞价成交额(元)", 1.0), "auction_turnover_1": ("集合竞价换手率1", 0.01),
        "auction_turnover_2": ("集合竞价换手率2", 0.01), "auction_volume_ratio_1": ("集合竞价量比1", 1.0), "auction_volume_ratio_2": ("集合竞价量比2", 1.0), "auction_volume_ratio_3": ("集合竞价量比3", 1.0),
    },
    "margin": {
        "margin_total_balance": ("两融余额(元)", 1.0), "margin_financing_balance": ("融资余额(元)", 1.0), "margin_financing_buy": ("融资买入额(元)", 1.0), "margin_financing_repay": ("融资偿还额(元)", 1.0),
        "securities_lending_balance": ("融券余额(元)", 1.0), "securities_lending_quantity": ("融券余量(股)", 1.0), "securities_lending_sell": ("融券卖出量(股)", 1.0), "securities_lending_repay": ("融券偿还量(股)", 1.0),
    },
    "industry": {
        "industry_open": ("开盘点位", 1.0), "industry_high": ("最高点位", 1.0), "industry_low": ("最低点位", 1.0), "industry_close": ("收盘点位", 1.0), "industry_change": ("涨跌点位", 1.0), "industry_return": ("涨幅%", 0.01),
        "industry_volume": ("成交量(万股)", 10000.0), "industry_amount": ("成交额(万元)", 10000.0), "industry_pe": ("市盈率", 1.0), "industry_pb": ("市净率", 1.0), "industry_float_market_cap": ("流通市值(万元)", 10000.0), "industry_total_market_cap": ("总市值(万元)", 10000.0),
    },
    "chip": {
        "chip_cost_5": ("5分位成本", 1.0), "chip_cost_15": ("15分位成本", 1.0), "chip_cost_50": ("50分位成本", 1.0), "chip_cost_85": ("85分位成本", 1.0), "chip_cost_95": ("95分位成本", 1.0), "chip_weighted_cost": ("加权平均成本", 1.0), "chip_win_rate": ("胜率", 0.01),
    },
    "limit_event": {
        "kpl_main_net_amount": ("主力净额(元)", 1.0), "kpl_close_seal_amount": ("收盘封单额", 1.0), "kpl_turnover_amount": ("成交额", 1.0), "kpl_float_market_cap": ("实际流通市值", 1.0), "kpl_max_seal_amount": ("日内最大封单额", 1.0),
    },
}
#: When a source takes effect and is known, unless told otherwise.
CLOCKS = {"auction": ("09:25:00", "09:26:00")}
DEFAULT_CLOCK = ("15:00:00", "18:00:00")
#: Common columns, the column that tells limit events, what it holds for them, and their flag.
COMMON = {"session": ("日期",), "instrument": ("代码",)}
LABEL, LIMIT_UP, FLAG = "标签", "涨停", "kpl_limit_up_flag"

#: A cell of a line with the comma before it: in quotes, where two quotes mean one, or up to the next comma.
_CELL = '(?:^|,)("(?:[^"]|"")*"|[^,]*)'


def _plain(x: Column) -> Column:
    """A header name as it is looked up: no byte order mark, no blanks, lower case."""
    return F.lower(F.regexp_replace(x, r"[﻿\s]", ""))


def _lines(spark: SparkSession, path: str, known: dict[str, tuple[str, ...]]) -> DataFrame:
    """(file, file_date, is_header, cells) of every line that is not blank; folders are searched through."""
    raw = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    bare = lambda c: F.trim(F.when(F.startswith(c, F.lit('"')), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    d = raw.where(F.trim("value") != "").select("file", F.transform(F.regexp_extract_all("value", F.lit(_CELL), F.lit(1)), bare).alias("cells"))
    named = lambda c: F.arrays_overlap(F.transform("cells", _plain), F.array(*[F.lit(a.lower()) for a in known[c]]))
    day = F.expr(r"try_to_timestamp(element_at(regexp_extract_all(file, '(?<![0-9])([0-9]{8})(?![0-9])', 1), -1), 'yyyyMMdd')").cast("date")
    return d.select("file", day.alias("file_date"), F.coalesce(named("session") & named("instrument"), F.lit(False)).alias("is_header"), "cells")


def _resolved(lines: DataFrame, known: dict[str, tuple[str, ...]]) -> DataFrame:
    """Data lines with the cell of every known column, null where it is blank, and what is wrong with
    their file's header, if anything: written once, since good and bad ones are told apart later."""
    heads = lines.where("is_header").select("file", F.transform("cells", _plain).alias("header")).distinct().groupBy("file").agg(F.count("*").alias("styles"), F.min("header").alias("header"))
    spots = {c: [F.array_position("header", a.lower()) for a in aliases] for c, aliases in known.items()}
    found = {c: sum((F.when(p > 0, 1).otherwise(0) for p in ps), F.lit(0)) for c, ps in spots.items()}
    wrong = (
        F.when(F.col("styles") > 1, "two_headers")
        .when(F.greatest(*found.values(), F.lit(0)) > 1, "ambiguous_column")
        .when(F.least(*found.values(), F.lit(1)) < 1, "missing_column")
    )
    heads = heads.select(F.col("file").alias("__file"), wrong.alias("wrong_header"), *[F.greatest(*ps, F.lit(0)).cast("int").alias(f"p_{c}") for c, ps in spots.items()])
    d = lines.where("NOT is_header").join(heads, F.col("file") == F.col("__file"), "left")
    cell = {c: F.when(F.col(f"p_{c}") > 0, F.nullif(F.expr(f"try_element_at(cells, p_{c})"), F.lit(""))) for c in known}
    header = F.when(F.col("__file").isNull(), "no_header").otherwise(F.col("wrong_header"))
    return written(d.select("file", "file_date", header.alias("wrong_header"), *[x.alias(c) for c, x in cell.items()]))


def _day(x: str) -> Column:
    return F.coalesce(F.expr(f"try_to_timestamp({x}, 'yyyyMMdd')"), F.expr(f"try_to_timestamp({x}, 'yyyy-MM-dd')"), F.expr(f"try_to_timestamp({x}, 'yyyy/MM/dd')")).cast("date")


def _number(x: str) -> Column:
    return F.expr(f"try_cast(replace({x}, ',', '') AS DOUBLE)")


def _unread(columns: list[str]) -> Column:
    """Whether a cell that is not blank is no finite number."""
    wrong = [F.col(c).isNotNull() & ~F.coalesce(F.abs(_number(c)) < float("inf"), F.lit(False)) for c in columns]
    return F.greatest(*[w.cast("int") for w in wrong], F.lit(0)) == 1


def read_daily(spark: SparkSession, path: str, adjustment: str = "none", known: dict[str, tuple[str, ...]] = DAILY) -> DataFrame:
    """(instrument, session, open, high, low, close, volume, amount, adjustment_factor, file_date, reason).

    Lots become shares, thousands units, and with back_ratio prices are multiplied by the row's own
    adjustment factor. A usable row has a null reason; others have no numbers and the first of: no_header,
    two_headers, ambiguous_column, missing_column, missing_cell, bad_date, date_differs_from_file,
    bad_number, bad_adjustment, duplicate (a bar that is there already, lines in order of their text).
    """
    if adjustment not in ("none", "back_ratio"):
        raise ValueError("adjustment is none or back_ratio")
    numbers = [c for c in known if c not in ("session", "instrument")]
    d = _resolved(_lines(spark, path, known), known).withColumn("day", _day("session")).withColumn("instrument", F.upper("instrument"))
    reason = (
        F.when(F.col("wrong_header").isNotNull(), F.col("wrong_header"))
        .when(F.greatest(*[F.col(c).isNull().cast("int") for c in known]) == 1, "missing_cell")
        .when(F.col("day").isNull(), "bad_date")
        .when(~F.col("day").eqNullSafe(F.col("file_date")), "date_differs_from_file")
        .when(_unread(numbers), "bad_number")
        .when(_number("adjustment_factor") <= 0, "bad_adjustment")
    )
    d = d.withColumn("reason", reason)
    order = Window.partitionBy("instrument", "day", F.col("reason").isNull()).orderBy(*numbers, "file")
    again = F.col("reason").isNull() & (F.row_number().over(order) > 1)
    d = d.withColumn("reason", F.when(again, "duplicate").otherwise(F.col("reason")))
    scale = {c: _number("adjustment_factor") if adjustment == "back_ratio" else F.lit(1.0) for c in ("open", "high", "low", "close")} | {"volume": F.lit(LOT), "amount": F.lit(THOUSAND)}
    values = [F.when(F.col("reason").isNull(), _number(c) * scale.get(c, F.lit(1.0))).alias(c) for c in numbers]
    return d.select("instrument", F.col("day").alias("session"), *values, "file_date", "reason")


def read_alternative(spark: SparkSession, path: str, kind: str, lag_days: int = 0, offset: str = "+08:00", effective_clock: str | None = None, available_clock: str | None = None) -> DataFrame:
    """(instrument, session, field, value, effective_at, available_at, reason) of one alternative source.

    Wide files become one row for each name, session and field, in base units; a blank number is a null
    value. Limit events are the lines whose label says so, one for each name and session: the flag is 1
    and of several figures the largest counts (of net amounts the one furthest from zero). Names without an
    event have no row here (see densify). Lines that can't be used have a reason, as in read_daily, and
    neither field nor value.
    """
    if kind not in FIELDS:
        raise ValueError(f"no source of the kind {kind}")
    own = CLOCKS.get(kind, DEFAULT_CLOCK)
    effective, available = effective_clock or own[0], available_clock or own[1]
    if lag_days < 0 or (lag_days == 0 and datetime.strptime(available, "%H:%M:%S") < datetime.strptime(effective, "%H:%M:%S")):
        raise ValueError("a source can't be known before it takes effect")
    fields = FIELDS[kind]
    known = COMMON | {f: (column,) for f, (column, _) in fields.items()} | ({"label": (LABEL,)} if kind == "limit_event" else {})
    d = _resolved(_lines(spark, path, known), known).withColumn("day", _day("session")).withColumn("instrument", F.upper("instrument"))
    if kind == "limit_event":
        d = d.where(F.col("wrong_header").isNotNull() | F.coalesce(F.contains("label", F.lit(LIMIT_UP)), F.lit(False)))
    reason = (
        F.when(F.col("wrong_header").isNotNull(), F.col("wrong_header"))
        .when(F.col("instrument").isNull() | F.col("session").isNull(), "missing_cell")
        .when(F.col("day").isNull(), "bad_date")
        .when(~F.col("day").eqNullSafe(F.col("file_date")), "date_differs_from_file")
        .when(_unread(list(fields)), "bad_number")
    )
    d = d.select("instrument", F.col("day").alias("session"), reason.alias("reason"), *[(_number(f) * F.lit(scale)).alias(f) for f, (_, scale) in fields.items()])
    bad = d.where("reason IS NOT NULL")
    good = d.where("reason IS NULL")
    if kind == "limit_event":
        far = lambda f: F.max(F.when(F.col(f).isNotNull(), F.struct(F.abs(f).alias("far"), F.col(f).alias("x"))))["x"]
        good = good.groupBy("instrument", "session").agg(F.lit(1.0).alias(FLAG), *[(far(f) if f == "kpl_main_net_amount" else F.max(f)).alias(f) for f in fields]).withColumn("reason", F.lit(None).cast("string"))
    else:
        again = F.row_number().over(Window.partitionBy("instrument", "session").orderBy(*fields)) > 1
        good = good.withColumn("reason", F.when(again, "duplicate"))
        bad = bad.unionByName(good.where("reason IS NOT NULL"))
        good = good.where("reason IS NULL")
    names = ([FLAG] if kind == "limit_event" else []) + list(fields)
    stamp = lambda day, clock: F.to_timestamp(F.concat(day.cast("string"), F.lit(f"T{clock}{offset}")))
    long = good.select("instrument", "session", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in names])).alias("cell"), "reason")
    long = long.select("instrument", "session", "cell.field", "cell.value", stamp(F.col("session"), effective).alias("effective_at"), stamp(F.date_add("session", lag_days), available).alias("available_at"), "reason")
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("field", "string"), ("value", "double"), ("effective_at", "timestamp"), ("available_at", "timestamp"))]
    return long.unionByName(bad.select("instrument", "session", *empty, "reason"))
