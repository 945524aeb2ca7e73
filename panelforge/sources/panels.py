"""Research panels derived from the order tables: what every operator runs on in tests and benches.

Each panel is one group-by (or a join of small dimensions) over the given tables. Session numbers come
from the distinct sessions, a small calendar, so no window ever runs over a whole panel.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.factors import FIELDS
from panelforge.operators import base
from panelforge.operators.base import Dialect, run
from panelforge.operators.panel import GENESIS, regime_text


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of lineitem, and about as many of the observation panel, that a task sorts on average.
ROWS = 400_000


def partitions(lines: DataFrame) -> int | None:
    """How many partitions keep a task's rows near ROWS, if the session's own number does not; files count their rows."""
    n = -(-lines.count() // ROWS)
    return n if n > int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, n: int | None, *columns: str) -> DataFrame:
    """df by the columns in n partitions; None: in as many as the session says, small ones joined."""
    return df.repartition(n, *columns) if n else df.repartition(*columns)


def _bars(lines: DataFrame, key: str, unit: str) -> DataFrame:
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return lines.groupBy(F.col(key).cast("bigint").alias("instrument"), _session(unit)).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum("l_quantity").alias("volume"),
        F.round(F.sum("l_extendedprice"), 2).alias("amount"),
    )


def _session(unit: str) -> Column:
    return F.to_date(F.date_trunc(unit, "l_shipdate")).alias("session")


def _number(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    calendar = run("SELECT session, CAST(row_number() OVER (ORDER BY session) AS BIGINT) AS sx FROM (SELECT DISTINCT session FROM {sessions})", sessions=sessions)
    return bars.join(F.broadcast(calendar), "session")


def monthly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier by month, with the supplier's nation as group and a cap stand-in.

    A supplier's month has a handful of lines all over the files, so lines are dealt by supplier as they
    are: that sends less than their partial sums, and windows by instrument find their rows in place.
    """
    lines = _table(spark, sf_dir, "lineitem")
    n = partitions(lines)
    sessions = lines.select(_session("month"))
    lines = lines.select(F.col("l_suppkey").cast("bigint").alias("instrument"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    suppliers = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("instrument"), F.col("s_nationkey").cast("bigint").alias("grp"), (F.col("s_acctbal") + 1001).alias("cap"))
    return _number(_bars(dealt(lines, n, "instrument"), "instrument", "month"), sessions).join(suppliers, "instrument")


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation by week."""
    nation = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    lines = _table(spark, sf_dir, "lineitem").join(nation, "l_suppkey")
    bars = _bars(lines, "s_nationkey", "week")
    bars = _number(bars, bars)
    return bars.withColumn("grp", F.col("instrument") % 5).withColumn("cap", 100.0 + F.col("instrument"))


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User by day by event type: sum and count."""
    return _table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("instrument"), F.to_date("ts").alias("session"), "event_type").agg(F.round(F.sum("value"), 6).alias("value"), F.count("*").alias("n"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def order_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation by week: order amounts and counts of the five priorities, zero where there are none."""
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = _table(spark, sf_dir, "orders").join(customers, "o_custkey")
    rank = F.substring("o_orderpriority", 1, 1)
    cols = [F.round(F.sum(F.when(rank == str(k), F.col("o_totalprice")).otherwise(0.0)), 2).alias(f"amount_{k}") for k in range(1, 6)]
    cols += [F.sum(F.when(rank == str(k), 1.0).otherwise(0.0)).alias(f"n_{k}") for k in range(1, 6)]
    return orders.groupBy(F.col("c_nationkey").cast("bigint").alias("instrument"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("session")).agg(*cols)


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as revisions of (user_id, event_type): visible at ts, each naming its predecessor."""
    return run(
        """SELECT user_id, event_type, event_id, CAST(ts AS TIMESTAMP) AS ts, value, props,
        lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prev_id,
        lead(CAST(ts AS TIMESTAMP)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS ts_to FROM {events}""",
        events=_table(spark, sf_dir, "events"),
    )


def revisions_text(source: str) -> str:
    """The event revisions as a store keeps them, with what can be wrong with them: some rows name no
    or a wrong predecessor, some are available before they were announced, some intervals end before
    they start, run into the next one or are left open."""
    hours = lambda x: f"INTERVAL {x} HOUR"
    return f"""
SELECT user_id, event_type, event_id, value, ts AS visible_at,
  CASE WHEN event_id % 97 = 5 THEN NULL WHEN event_id % 101 = 7 THEN event_id ELSE prev_id END AS predecessor,
  ts - {hours(2)} AS announced_at, ts - {hours(1)} AS published_at, CASE WHEN event_id % 89 = 3 THEN ts - {hours(3)} ELSE ts END AS available_at, event_id % 4 = 0 AS nominal,
  ts AS effective_from, CASE WHEN event_id % 83 = 2 THEN ts - {hours(1)} WHEN event_id % 79 = 4 THEN ts_to + INTERVAL 3 DAY WHEN event_id % 103 = 6 THEN NULL ELSE ts_to END AS effective_to
FROM {source}"""


def vendor_text(source: str) -> str:
    """Bars as a vendor delivers them: lots and thousands, an adjustment factor, a name of the file they
    came in, gaps, flags, labels and adjustment ratios."""
    return f"""
SELECT instrument, session, sx, grp, cap, open, high, low, close, volume, amount,
  CASE WHEN sx % 7 = 0 THEN NULL ELSE round(close, 0) END AS close_seen, CASE WHEN sx % 50 = 0 THEN NULL ELSE close END AS close_thin, CASE WHEN cap < 2000 THEN NULL ELSE cap END AS cap_thin,
  CASE WHEN sx % 24 = 0 THEN 1.05e0 ELSE 1e0 END AS ratio, (instrument * 7 + sx) % 5 AS label, instrument % 10 = 7 AS flagged, CASE WHEN grp < 5 THEN 'growth' WHEN grp < 20 THEN 'main' ELSE 'other' END AS board,
  1 + (instrument % 3) / 2e0 AS adjustment, CASE WHEN (instrument + sx) % 211 = 0 THEN sx + 1 ELSE sx END AS file_sx
FROM {source}"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a stored hash chain: seq, previous_hash and entry_hash as a writer leaves them."""

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, previous, rows = pdf.sort_values("event_id"), GENESIS, []
        for seq, (user, event, kind) in enumerate(zip(pdf["user_id"], pdf["event_id"], pdf["event_type"], strict=True), 1):
            own = hashlib.sha256(f"{seq}|{previous}|{event}|{kind}".encode()).hexdigest()
            rows.append((user, event, kind, seq, previous, own))
            previous = own
        return pd.DataFrame(rows, columns=["user_id", "event_id", "event_type", "seq", "previous_hash", "entry_hash"])

    events = _table(spark, sf_dir, "events").select(F.col("user_id").cast("long"), F.col("event_id").cast("long"), "event_type")
    return events.groupBy("user_id").applyInPandas(chain, "user_id long, event_id long, event_type string, seq long, previous_hash string, entry_hash string")


def observations_text(d: Dialect) -> str:
    """Signals of session t - 1 with the label open(t + h) / open(t) - 1, long by factor and horizon.

    A signal is taken from the bar of session signal_at and known with that bar's close (feature_at);
    its label runs from label_start to label_end."""
    grid = f"{d.explode(d.array(['rev5', 'strength', 'width']), 'factor_id')} {d.explode(d.array([1, 5]), 'horizon')}"
    past = lambda x: f"CASE WHEN sx - (lag(sx, 1) OVER w) = 1 THEN lag({x}, 1) OVER w END"
    label = lambda h: f"CASE WHEN (lead(sx, {h}) OVER w) - sx = {h} THEN (lead(open, {h}) OVER w) / open - 1 END"
    return f"""
WITH b AS (
  SELECT *, CASE WHEN sx - (lag(sx, 5) OVER w) = 5 THEN 1 - close / (lag(close, 5) OVER w) END AS r5, close / open - 1 AS st, high / low - 1 AS wd FROM {{bars}} WINDOW w AS (PARTITION BY instrument ORDER BY sx)),
s AS (
  SELECT instrument, session, sx, grp, cap, year(session) AS subperiod, {past('r5')} AS rev5, {past('st')} AS strength, {past('wd')} AS width, {label(1)} AS fwd1, {label(5)} AS fwd5,
    lag(session, 1) OVER w AS signal_at, session AS label_start, lead(session, 1) OVER w AS end1, lead(session, 5) OVER w AS end5,
    avg(amount) OVER (PARTITION BY instrument ORDER BY sx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS adv, lag(amount, 1) OVER w AS prior_amount
  FROM b WINDOW w AS (PARTITION BY instrument ORDER BY sx)),
f AS (
  SELECT instrument, session, sx, grp, cap, subperiod, adv, prior_amount, factor_id, CASE factor_id WHEN 'rev5' THEN rev5 WHEN 'strength' THEN strength ELSE width END AS v, CAST(horizon AS BIGINT) AS horizon, CASE WHEN horizon = 1 THEN fwd1 ELSE fwd5 END AS fwd,
    signal_at, signal_at AS feature_at, label_start, CASE WHEN horizon = 1 THEN end1 ELSE end5 END AS label_end
  FROM s {grid})
SELECT * FROM f WHERE v IS NOT NULL AND fwd IS NOT NULL AND adv IS NOT NULL"""


def store_text(orders: str, customer: str) -> str:
    """Twenty-four different weekly series by nation, from orders by priority and status, as a long store:
    a third of the fields is known on Monday morning, a third on Tuesday, a third a week later."""
    named = "CASE k " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FIELDS)) + " END"
    status = "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END"
    week = "CAST(date_trunc('week', o_orderdate) AS DATE)"
    return f"""
SELECT instrument, session, {named} AS field, CAST(session AS TIMESTAMP) + CASE k % 3 WHEN 0 THEN INTERVAL 9 HOUR WHEN 1 THEN INTERVAL 30 HOUR ELSE INTERVAL 192 HOUR END AS available_at, value FROM (
  SELECT instrument, session, (p - 1) * 3 + s AS k, round(amount, 2) AS value FROM ({{0}}) AS a UNION ALL SELECT instrument, session, 15 + (p - 1) * 3 + s, CAST(n AS DOUBLE) FROM ({{0}}) AS b WHERE p <= 3) AS c""".replace(
        "{0}", f"SELECT CAST(c_nationkey AS BIGINT) AS instrument, {week} AS session, CAST(left(o_orderpriority, 1) AS INT) AS p, {status} AS s, sum(o_totalprice) AS amount, count(*) AS n FROM {orders} JOIN {customer} ON c_custkey = o_custkey GROUP BY 1, 2, 3, 4"
    )


def candidates_text(d: Dialect) -> str:
    """Every set of one to three factors under each scheme that fits it, a row for each factor."""
    fac = "SELECT DISTINCT factor_id AS f FROM {obs}"
    name = lambda *x: "concat(" + ", '+', ".join(x) + ")" if len(x) > 1 else x[0]
    sets = [
        f"SELECT {name('a.f')} AS candidate, {d.array_of('a.f')} AS fs FROM ({fac}) AS a",
        f"SELECT {name('a.f', 'b.f')} AS candidate, {d.array_of('a.f', 'b.f')} AS fs FROM ({fac}) AS a JOIN ({fac}) AS b ON a.f < b.f",
        f"SELECT {name('a.f', 'b.f', 'c.f')}, {d.array_of('a.f', 'b.f', 'c.f')} FROM ({fac}) AS a JOIN ({fac}) AS b ON a.f < b.f JOIN ({fac}) AS c ON b.f < c.f",
    ]
    single = f"SELECT candidate, fs, 'single' AS scheme FROM ({sets[0]}) AS s"
    more = f"SELECT candidate, fs, scheme FROM ({sets[1]} UNION ALL {sets[2]}) AS m {d.explode(d.array(['equal', 'positive', 'best', 'signed']), 'scheme')}"
    return f"SELECT candidate, scheme, factor_id FROM (SELECT * FROM ({single}) AS x UNION ALL SELECT * FROM ({more}) AS y) AS z {d.explode('fs', 'factor_id')}"


def observations(bars: DataFrame) -> DataFrame:
    """The evaluation panel: factor values known before a session and the returns that follow it."""
    return run(observations_text(base.SPARK), bars=bars)


def sections(obs: DataFrame, n: int) -> DataFrame:
    """obs with a cross-section in one of n partitions: windows over cross-sections find their rows in place."""
    return dealt(obs, n, "factor_id", "horizon", "session")


def candidates(obs: DataFrame) -> DataFrame:
    """(candidate, scheme, factor_id) of candidates_text; the factors are looked up once."""
    return run(candidates_text(base.SPARK), obs=base.written(obs.select("factor_id").distinct()))


# --- the same panels for DuckDB, written for its dialect -------------------------------------------

_DUCK_BARS = """
SELECT {key}::BIGINT AS instrument, date_trunc('{unit}', l_shipdate)::DATE AS session,
  arg_min(l_extendedprice / l_quantity, row(l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS open, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  arg_max(l_extendedprice / l_quantity, row(l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS close, sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS amount
FROM lineitem {join} GROUP BY ALL"""


def _duck_numbered(bars: str, extra: str, join: str = "") -> str:
    return f"SELECT b.*, (dense_rank() OVER (ORDER BY session))::BIGINT AS sx, {extra} FROM ({bars}) b {join}"


DUCK = {
    "p1": _duck_numbered(_DUCK_BARS.format(key="l_suppkey", unit="month", join=""), "s_nationkey::BIGINT AS grp, s_acctbal + 1001 AS cap", "JOIN supplier ON s_suppkey = b.instrument"),
    "p2": _duck_numbered(_DUCK_BARS.format(key="s_nationkey", unit="week", join="JOIN supplier ON s_suppkey = l_suppkey"), "b.instrument % 5 AS grp, 100.0::DOUBLE + b.instrument AS cap"),
    "p3": "SELECT user_id AS instrument, ts::DATE AS session, event_type, round(sum(value), 6) AS value, count(*) AS n FROM events GROUP BY ALL",
    "p4": "SELECT c_nationkey::BIGINT AS instrument, date_trunc('week', o_orderdate)::DATE AS session, "
    + ", ".join(f"round(sum(CASE WHEN left(o_orderpriority, 1) = '{k}' THEN o_totalprice ELSE 0 END), 2) AS amount_{k}" for k in range(1, 6))
    + ", "
    + ", ".join(f"sum(CASE WHEN left(o_orderpriority, 1) = '{k}' THEN 1.0::DOUBLE ELSE 0 END) AS n_{k}" for k in range(1, 6))
    + " FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL",
    "ev": "SELECT user_id, event_type, event_id, ts, value, props, lag(event_id) OVER k AS prev_id, lead(ts) OVER k AS ts_to FROM events WINDOW k AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)",
    "ledger": f"""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events),
c AS (SELECT e.*, '{GENESIS}' AS previous_hash, sha256(concat(seq, '|', '{GENESIS}', '|', event_id, '|', event_type)) AS entry_hash FROM e WHERE seq = 1
UNION ALL SELECT e.*, c.entry_hash, sha256(concat(e.seq, '|', c.entry_hash, '|', e.event_id, '|', e.event_type)) FROM e JOIN c ON e.user_id = c.user_id AND e.seq = c.seq + 1) SELECT * FROM c""",
    "revs": revisions_text("ev"),
    "vendor": vendor_text("p1"),
    "obs": observations_text(base.DUCK).replace("{bars}", "p1"),
    "obs2": observations_text(base.DUCK).replace("{bars}", "p2"),
    "cands": candidates_text(base.DUCK).replace("{obs}", "obs"),
    "store": store_text("orders", "customer"),
    "regimes": f"SELECT session, regime FROM ({regime_text(base.DUCK).replace('{bars}', 'p1')}) AS r",
}
NEEDS = {"obs": ["p1"], "obs2": ["p2"], "revs": ["ev"], "vendor": ["p1"], "cands": ["p1", "obs"], "regimes": ["p1"]}
SPARK = {
    "p1": monthly_bars,
    "p2": weekly_bars,
    "p3": user_days,
    "p4": order_flow,
    "ev": raw_events,
    "ledger": ledger,
    "revs": lambda spark, sf_dir: run(revisions_text("{ev}"), ev=raw_events(spark, sf_dir)),
    "vendor": lambda spark, sf_dir: run(vendor_text("{bars}"), bars=monthly_bars(spark, sf_dir)),
    "obs": lambda spark, sf_dir: observations(monthly_bars(spark, sf_dir)),
    "obs2": lambda spark, sf_dir: observations(weekly_bars(spark, sf_dir)),
    "store": lambda spark, sf_dir: run(store_text("{orders}", "{customer}"), orders=_table(spark, sf_dir, "orders"), customer=_table(spark, sf_dir, "customer")),
    "regimes": lambda spark, sf_dir: run(f"SELECT session, regime FROM ({regime_text(base.SPARK)}) AS r", bars=monthly_bars(spark, sf_dir)),
    "cands": lambda spark, sf_dir: candidates(observations(monthly_bars(spark, sf_dir))),
}
