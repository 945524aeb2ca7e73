"""Point-in-time revisions from announcements in JSON: duplicates, quarantine, availability, chains.

Every line is one announcement. Content is hashed over its canonical JSON, so that a delivery's own
identifiers, which change, never enter a stored key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The fields that make up an announcement's content, in the order of canonical JSON.
STABLE = ("actualPublishTime", "announcementType", "announcementTypeCode", "endDate", "hasPdf", "industryTag", "market", "publishTime", "stockTag", "title")
#: Words in titles or types of periodic reports, forecasts and flashes.
PERIODIC = ("定期报告", "年度报告", "年报", "季度报告", "季报", "中期报告", "半年报", "业绩预告", "业绩快报")
FORECAST, FLASH = "业绩预告", "业绩快报"
#: What became of a line.
OUTCOMES = ("admitted", "corrupt", "duplicate", "quarantined", "incomplete", "not_periodic")


def _json(key: str) -> Column:
    """A field as canonical JSON: keys sorted, nothing between them; null if it is not there."""
    return F.coalesce(F.to_json(F.try_variant_get("v", f"$.{key}", "variant")), F.lit("null"))


def _text(key: str) -> Column:
    return F.try_variant_get("v", f"$.{key}", "string")


def _moment(key: str, offset: str) -> Column:
    """A time with its own offset, or with the given one."""
    raw = F.replace(F.trim(_text(key)), F.lit(" "), F.lit("T"))
    zoned = raw.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & (F.length(raw) > 10)
    return F.try_to_timestamp(F.when(zoned, raw).otherwise(F.concat(raw, F.lit(offset))))


def classified(lines: DataFrame, offset: str = "+08:00") -> DataFrame:
    """Every line (column value) with its parsed fields and outcome.

    corrupt: no JSON object. duplicate: an announcementId or a content that is there already (of lines with
    one id the one with the smallest JSON text counts). quarantined: marked as such by _pitQuarantined; or
    of the same metadata as another one, both without sourceDocumentHash; or without it beside one that has
    it. not_periodic: neither title nor type says it is a report. incomplete: a report without id, period,
    publication time or stock codes.
    """
    v = lines.select("value", F.try_parse_json("value").alias("v"))
    v = v.withColumn("is_object", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    parts = [F.lit(f'"{k}":') for k in STABLE]
    metadata = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(p, _json(k)) for p, k in zip(parts, STABLE, strict=True)]), F.lit("}"))
    words = F.concat_ws(" ", F.coalesce(_text("title"), F.lit("")), F.coalesce(_text("announcementType"), F.lit("")))
    document = F.lower(F.nullif(_text("sourceDocumentHash"), F.lit("")))
    d = v.select(
        "value", "is_object", F.nullif(_text("announcementId"), F.lit("")).alias("delivery_id"), F.coalesce(F.try_variant_get("v", "$._pitQuarantined", "boolean"), F.lit(False)).alias("marked"), words.alias("words"), metadata.alias("metadata"), document.alias("document_hash"),
        F.coalesce(F.nullif(_text("announcementTypeCode"), F.lit("")), _text("announcementType"), F.lit("")).alias("report_type"), F.expr("try_to_date(left(try_variant_get(v, '$.endDate', 'string'), 10))").alias("report_period"),
        _moment("publishTime", offset).alias("announced_at"), _moment("actualPublishTime", offset).alias("actual_at"), F.nullif(F.trim(_text("actualPublishTime")), F.lit("")).isNotNull().alias("says_actual"),
        F.transform(F.try_variant_get("v", "$.stockTag", "array<variant>"), lambda s: F.upper(F.trim(F.try_variant_get(s, "$.code", "string")))).alias("codes"),
    )
    d = d.withColumn("metadata_hash", F.sha2("metadata", 256))
    with_document = F.concat(F.expr("left(metadata, instr(metadata, '\"stockTag\":') - 1)"), F.lit('"sourceDocumentHash":"'), F.col("document_hash"), F.lit('",'), F.expr("substr(metadata, instr(metadata, '\"stockTag\":'))"))
    d = d.withColumn("source_hash", F.when(F.col("document_hash").isNull(), F.col("metadata_hash")).otherwise(F.sha2(with_document, 256)))
    periodic = F.greatest(*[F.contains("words", F.lit(w)) for w in PERIODIC])
    incomplete = F.col("delivery_id").isNull() | F.col("report_period").isNull() | F.col("announced_at").isNull() | (F.col("says_actual") & F.col("actual_at").isNull()) | ~F.coalesce((F.size("codes") > 0) & F.forall("codes", lambda c: F.coalesce(c != "", F.lit(False))), F.lit(False))
    same_id = F.row_number().over(Window.partitionBy(F.coalesce("delivery_id", F.concat(F.lit("\n"), F.col("value")))).orderBy("value"))
    first = (
        F.when(~F.col("is_object"), "corrupt")
        .when(F.col("delivery_id").isNotNull() & (same_id > 1), "duplicate")
        .when(F.col("marked"), F.when(F.col("delivery_id").isNull(), "incomplete").otherwise("quarantined"))
        .when(~periodic, "not_periodic")
        .when(incomplete, "incomplete")
    )
    d = d.withColumn("outcome", first)
    open_ = F.col("outcome").isNull()
    peers = Window.partitionBy("metadata_hash", open_)
    documented = F.count(F.when(F.col("document_hash").isNotNull(), 1)).over(peers)
    bare = F.count(F.when(F.col("document_hash").isNull(), 1)).over(peers)
    copy = F.row_number().over(Window.partitionBy("source_hash", open_).orderBy("delivery_id"))
    second = F.when(F.col("document_hash").isNull() & ((documented > 0) | (bare > 1)), "quarantined").when(copy > 1, "duplicate").otherwise("admitted")
    return d.withColumn("outcome", F.when(open_, second).otherwise(F.col("outcome"))).drop("is_object", "marked", "metadata")


def revisions(found: DataFrame, source: str = "announcement", offset: str = "+08:00") -> DataFrame:
    """One row for each admitted announcement and stock code, linked to the revision it supersedes.

    An announcement with an actual time is available when it is both announced and published, another
    one a day after it was announced. Forecasts and flashes take effect when they are available, reports
    at the end of their period. Revisions of a code, period and report type are chained in the order in
    which they become available.
    """
    iso = F.when(F.col("says_actual"), F.date_format(F.from_utc_timestamp(F.to_utc_timestamp("actual_at", F.current_timezone()), offset), "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.lit(None))
    actual = F.coalesce(F.concat(iso, F.lit(offset)), F.lit("None"))
    key = F.concat_ws("|", F.col("report_period").cast("string"), "report_type", actual, "source_hash")
    available = F.when(F.col("says_actual"), F.greatest("announced_at", "actual_at")).otherwise(F.col("announced_at") + F.expr("INTERVAL 1 DAY"))
    kind = F.when(F.contains("words", F.lit(FORECAST)), "earnings_forecast").when(F.contains("words", F.lit(FLASH)), "earnings_flash").otherwise("periodic_report")
    period_end = F.to_timestamp(F.concat(F.col("report_period").cast("string"), F.lit(f"T23:59:59{offset}")))
    d = found.where("outcome = 'admitted'").select(
        F.explode("codes").alias("code"), "report_period", "report_type", "announced_at", "actual_at", F.substring(F.sha2(key, 256), 1, 24).alias("revision_id"), F.sha2(F.concat(F.lit(f"{source}|"), F.col("source_hash")), 256).alias("document_id"), "source_hash",
        kind.alias("source_type"), F.when(F.col("says_actual"), "actual").otherwise("nominal_plus_delay").alias("time_quality"), available.alias("available_at"), period_end.alias("period_end"),
    )
    d = d.withColumn("effective_at", F.when(F.col("source_type") == "periodic_report", F.col("period_end")).otherwise(F.col("available_at"))).drop("period_end")
    chain = Window.partitionBy("code", "report_period", "report_type").orderBy("available_at", "revision_id")
    return d.withColumn("supersedes", F.lag("revision_id").over(chain))


def ledger(found: DataFrame) -> DataFrame:
    """One row: lines received, what became of them, and admitted ones with a day's delay."""
    counts = [F.coalesce(F.sum((F.col("outcome") == o).cast("long")), F.lit(0)).alias(o) for o in OUTCOMES]
    delayed = F.coalesce(F.sum(((F.col("outcome") == "admitted") & ~F.col("says_actual")).cast("long")), F.lit(0))
    return found.agg(F.count("*").alias("received"), *counts, delayed.alias("delayed"))
