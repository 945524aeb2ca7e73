"""Queries that write files, train models or run streams: checked by rows and by tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import models, panel, validation
from panelforge.operators.base import SPARK, run, scratch
from panelforge.plans import twins
from panelforge.sources import announcements, files, hashtree, panels, vendor
from panelforge.streaming import forward

#: Tables that a dataset's folder holds.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def a3_read_bars_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    bars = panels.weekly_bars(spark, sf_dir).selectExpr("instrument AS code", "session AS trade_date", "open", "high", "low", "close", "volume AS vol", "amount")
    bars.write.option("header", True).csv(path)
    price = [F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")]
    return files.read_bars_long(spark, path).select("instrument", "session", *price, "volume", F.round("amount", 2).alias("amount"), "bad")


#: Header names of the three kinds of file that the query writes.
STYLES = (
    ("日期", "代码", "开盘价", "最高价", "最低价", "收盘价", "成交量(手)", "成交额(千元)", "复权因子"),
    ("Trade_Date", "TS_Code", "open", "high", "low", "close", "vol", "amount", "adj_factor"),
    ("date", "instrument", "开盘", "最高", "最低", "收盘", "vol", "amount", "adjustment_factor"),
)


def a1_read_daily_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vendor's bars as one folder of files a day, with three kinds of header and some rows in the wrong file."""
    path = scratch(spark)
    bars = panels.SPARK["vendor"](spark, sf_dir).selectExpr("*", "date_format(date_add(session, CASE WHEN file_sx <> sx THEN 1 ELSE 0 END), 'yyyyMMdd') AS file", "date_format(session, 'yyyyMMdd') AS day")
    columns = ("day", "instrument", "open", "high", "low", "close", "volume", "amount", "adjustment")
    for i, names in enumerate(STYLES):
        part = bars.where(F.col("sx") % 3 == i).repartition("file")
        part.select("file", *[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)]).write.partitionBy("file").option("header", True).mode("append").csv(path)
    price = [F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")]
    return vendor.read_daily(spark, path, "back_ratio").select("instrument", "session", *price, F.round("volume", 2).alias("volume"), F.round("amount", 0).alias("amount"), "adjustment_factor", "reason")


#: Event types that stand for columns of the alternative source that the query writes.
STANDINS = dict(zip(vendor.FIELDS["fund_flow"], ("click", "error", "purchase", "signup", "view"), strict=False))


def a4_read_alternative_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of events by user and day as a wide source, a folder of files a day, read back as long rows."""
    path = scratch(spark)
    wide = panels.user_days(spark, sf_dir).groupBy("instrument", "session").pivot("event_type", list(STANDINS.values())).agg(F.first("value"))
    cells = [F.col(STANDINS[f]).alias(c) if f in STANDINS else F.lit(None).cast("double").alias(c) for f, (c, _) in vendor.FIELDS["fund_flow"].items()]
    day = F.date_format("session", "yyyyMMdd")
    wide.select(day.alias("file"), day.alias("日期"), F.col("instrument").alias("代码"), *cells).repartition("file").write.partitionBy("file").option("header", True).csv(path)
    return vendor.read_alternative(spark, path, "fund_flow", lag_days=1).withColumn("value", F.round("value", 2))


def a13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as announcements in JSON lines, written and read as text: some repeated, some delivered again
    under another id, some of these with a document, some marked, some cut off."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stamp = "yyyy-MM-dd HH:mm:ss"
    word = "CASE event_type WHEN 'purchase' THEN '业绩预告' WHEN 'signup' THEN '业绩快报' WHEN 'error' THEN 'notice' ELSE 'report' END"
    fields = f"""concat({word}, ' ', event_id) AS title, CASE WHEN event_type = 'error' THEN 'other' ELSE '年度报告' END AS announcementType, event_type AS announcementTypeCode, date_format(ts, '{stamp}') AS publishTime,
      CASE WHEN event_id % 3 > 0 THEN date_format(ts + INTERVAL 1 HOUR, '{stamp}') END AS actualPublishTime, concat(date_format(date_trunc('month', ts), 'yyyy-MM-dd'), ' 00:00:00') AS endDate, 'A' AS market, array() AS industryTag, event_id % 2 = 0 AS hasPdf,
      CASE WHEN event_id % 5 = 0 THEN array(named_struct('name', 'n', 'code', concat('u', user_id)), named_struct('name', 'm', 'code', concat('g', user_id % 10))) ELSE array(named_struct('name', 'n', 'code', concat('u', user_id))) END AS stockTag, event_id % 23 = 0 AS _pitQuarantined"""
    copies = "CASE WHEN event_id % 11 = 0 THEN array('e', 'e') ELSE array('e') END", "CASE WHEN event_id % 13 = 0 THEN array('f') ELSE array() END", "CASE WHEN event_id % 17 = 0 THEN array('d') ELSE array() END"
    each = events.selectExpr("*", f"explode(concat({', '.join(copies)})) AS letter")
    text = each.selectExpr("event_id", f"to_json(struct(concat(letter, event_id) AS announcementId, CASE WHEN letter = 'd' THEN sha2(CAST(event_id AS STRING), 256) END AS sourceDocumentHash, {fields})) AS value")
    path = scratch(spark)
    text.selectExpr("value").unionByName(text.where("event_id % 19 = 0").selectExpr("left(value, 20) AS value")).write.text(path)
    return announcements.classified(spark.read.text(path))


def a13_json_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return announcements.revisions(a13_lines(spark, sf_dir)).select("code", "report_period", "report_type", "revision_id", "document_id", "source_type", "time_quality", "available_at", "effective_at", "supersedes")


def a13_json_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return announcements.ledger(a13_lines(spark, sf_dir))


def a6_read_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    panels.raw_events(spark, sf_dir).selectExpr("'industry' AS kind", "ts AS effective_at", "ts + INTERVAL 1 HOUR AS available_at", "ts + INTERVAL 1 DAY AS ingested_at", "user_id AS instrument", "event_type AS group_id", "event_type AS group_name").write.option("header", True).option("timestampFormat", files.STAMP).csv(path)
    return files.read_memberships(spark, path)


def a7_universe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also the sink of universes (A10)."""
    path = scratch(spark)
    files.write_universe(run(panel.dynamic_universe.text(SPARK), bars=panels.SPARK["vendor"](spark, sf_dir)), path)
    return files.read_universe(spark, path, 10)


def a10_universe_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first version, a second one with all members, and a third that never gets its manifest."""
    path = scratch(spark)
    members = run(panel.universe_text(), bars=panels.SPARK["vendor"](spark, sf_dir)).select("session", "instrument", "place")
    files.write_tiers(members.where("place <= 5"), path)
    files.write_tiers(members, path)
    files.write_tiers(members.where("place = 1"), path, finish=False)
    return files.read_tiers(spark, path)


def a8_read_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    panels.weekly_bars(spark, sf_dir).groupBy("session").agg(F.avg("open").alias("open")).write.option("header", True).csv(path)
    return files.read_index(spark, path).withColumn("open", F.round("open", 6))


def a11_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the given tables' own files: their names stay, so the hash repeats."""
    return files.snapshot(spark, [f"{sf_dir}/{t}.parquet" for t in ("region", "nation", "customer", "supplier", "part")])


def a11_snapshot_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file of every given table by blocks, whatever its size."""
    return hashtree.snapshot_tree(spark, [f"{sf_dir}/{t}.parquet" for t in TABLES], base=sf_dir.rstrip("/").rsplit("/", 1)[-1])


def a14_write_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    files.write_bundle(panels.raw_events(spark, sf_dir).select("event_id", "event_type", "user_id"), path)
    return spark.read.text(path)


def j12_deflated_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = panels.observations(panels.monthly_bars(spark, sf_dir))
    return models.deflated_sharpe(run(validation.deflated_sharpe_inputs.text(SPARK), obs=obs))


def m1_forward_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily observations arrive as files, every third one twice; the stream appends each once."""
    base = scratch(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    daily = forward.observations(events).withColumn("part", F.dayofyear("session") % 4)
    daily.unionByName(daily.where(F.dayofyear("session") % 3 == 0)).repartition("part").write.parquet(f"{base}/in")
    return forward.stream_to_table(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", "2024-01-10").select("session", "event_type", F.round("ret", 6).alias("ret"), "n")


def m1_stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily observations arrive out of order in eight files, every third one again with a larger figure."""
    base = scratch(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    daily = forward.observations(events).withColumn("ret", F.col("ret") / 1000)
    again = daily.where(F.dayofyear("session") % 3 == 0).withColumn("ret", F.col("ret") + 1)
    part = F.pmod(F.xxhash64("session", "event_type", "ret"), F.lit(8))
    daily.unionByName(again).repartitionByRange(8, part).write.parquet(f"{base}/in")
    found = forward.stream_summary(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", "2024-01-10")
    return found.select("source", "sessions", F.round("cumulative", 6).alias("cumulative"), F.round("sharpe", 6).alias("sharpe"))


M1_SUMMARY_TWIN = """
SELECT source, count(*) AS sessions, CASE WHEN count(*) >= 10 THEN round(sum(ln(1 + ret)), 6) END AS cumulative, CASE WHEN count(*) >= 10 THEN round(avg(ret) / stddev_pop(ret), 6) END AS sharpe
FROM (SELECT event_type AS source, ts::DATE AS session, avg(value) / 1000 AS ret FROM events WHERE ts::DATE > DATE '2024-01-10' GROUP BY ALL) GROUP BY source"""
M1_TWIN = "SELECT ts::DATE AS session, event_type, round(avg(value), 6) AS ret, count(*) AS n FROM events WHERE ts::DATE > DATE '2024-01-10' GROUP BY ALL"

QUERIES = {
    "a1_read_daily_files": (a1_read_daily_files, twins.A1),
    "a4_read_alternative_files": (a4_read_alternative_files, twins.alternative(vendor.FIELDS["fund_flow"], STANDINS)),
    "a13_json_revisions": (a13_json_revisions, twins.A13_REVISIONS),
    "a13_json_ledger": (a13_json_ledger, twins.A13_LEDGER),
    "a3_read_bars_long": (a3_read_bars_long, twins.A3),
    "a6_read_memberships": (a6_read_memberships, twins.A6),
    "a7_a10_universe_round_trip": (a7_universe_round_trip, twins.A7),
    "a10_universe_tiers": (a10_universe_tiers, twins.A10),
    "a8_read_index": (a8_read_index, twins.A8),
    "a11_snapshot": (a11_snapshot, None),
    "a11_snapshot_tree": (a11_snapshot_tree, None),
    "a14_write_bundle": (a14_write_bundle, twins.A14),
    "j12_deflated_sharpe": (j12_deflated_sharpe, None),
    "m1_forward_stream": (m1_forward_stream, M1_TWIN),
    "m1_stream_summary": (m1_stream_summary, M1_SUMMARY_TWIN),
}
