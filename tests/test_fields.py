"""The field store: each field as of its own time, and presets that tell fields apart."""

from datetime import datetime, timedelta

from panelforge.functions import factors, fields
from panelforge.operators.base import SPARK


def test_each_field_is_taken_as_of_its_own_time(spark):
    monday = lambda w: datetime(2024, 1, 1) + timedelta(weeks=w)
    bars = spark.createDataFrame([(1, monday(w)) for w in range(4)], "instrument long, at timestamp").selectExpr("instrument", "to_date(at) AS session")
    rows = [("close_is_not_a_field", 0, 0, 1.0), ("auction_amount", 0, 9, 10.0), ("auction_amount", 1, 12, 11.0), ("chip_cost_5", 0, 30, 20.0), ("chip_cost_5", 0, 31, 21.0), ("large_buy_amount", 0, 8 * 24, 30.0)]
    store = spark.createDataFrame([(1, f, monday(w), monday(w) + timedelta(hours=h), v) for f, w, h, v in rows], "instrument long, field string, session timestamp, available_at timestamp, value double")
    got = fields.field_store(bars=bars, store=store).orderBy("session").collect()
    # Known at noon itself is too late; of two revisions before noon the later counts.
    assert [r.auction_amount for r in got] == [10.0, 10.0, 11.0, 11.0]
    assert [r.chip_cost_5 for r in got] == [None, 21.0, 21.0, 21.0]
    assert [r.large_buy_amount for r in got] == [None, None, 30.0, 30.0]
    assert all(r.chip_cost_95 is None for r in got)


def test_every_preset_has_a_name_and_every_field_a_use():
    formulas = factors.presets(SPARK)
    assert len(fields.PRESET_NAMES) == len(formulas) == 85 and fields.preset_number("price_momentum") == 1
    used = " ".join(f for _, f in formulas.values())
    assert [f for f in factors.FIELDS if f not in used] == []
