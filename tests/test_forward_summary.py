"""The running summary of the forward log: late, repeated and out-of-order files."""

import math
import os
from datetime import date

import pandas as pd
import pytest

from panelforge.streaming import forward


def test_late_repeated_and_out_of_order_files(spark, tmp_path):
    day = lambda d: date(2024, 2, d)
    files = [
        [(4, 0.04, 1), (2, 0.02, 1), (1, 0.01, 1), (5, 0.50, 1)],
        [(12, 0.12, 1), (5, 0.05, 1), (3, 0.03, 1), (12, 0.12, 1)],
        [(1, -0.9, 1), (11, 0.11, 1), (20, 0.20, 1)],
        [(19, 0.19, 2), (19, 0.19, 1), (12, -0.9, 1)],
    ]
    os.makedirs(tmp_path / "in")
    for i, rows in enumerate(files):
        pdf = pd.DataFrame([(day(d), "a", ret, n) for d, ret, n in rows] + [(day(1), "b", 0.1 * (i + 1), 1)], columns=["session", "event_type", "ret", "n"])
        pdf.to_parquet(tmp_path / "in" / f"part-{i}.parquet", index=False)
        os.utime(tmp_path / "in" / f"part-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    found = {r.source: r for r in forward.stream_summary(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), "2024-01-31", hidden_until=5, watermark="5 days").collect()}
    # Day 5 is corrected while it is open; days 1 and 12 are closed when their corrections come.
    rets = [0.01, 0.02, 0.03, 0.04, 0.05, 0.11, 0.12, 0.19, 0.20]
    mean = sum(rets) / len(rets)
    assert found["a"].sessions == 9 and found["a"].cumulative == pytest.approx(sum(map(math.log1p, rets)))
    assert found["a"].sharpe == pytest.approx(mean / math.sqrt(sum((r - mean) ** 2 for r in rets) / 9))
    assert found["b"].sessions == 1 and found["b"].cumulative is None and found["b"].sharpe is None


def test_a_table_keeps_a_defined_row_of_repeats(spark):
    df = spark.createDataFrame([("2024-02-01", "a", 0.3, 1), ("2024-02-01", "a", 0.1, 2), ("2024-02-01", "a", 0.1, 1), ("2024-01-01", "a", 0.0, 1)], "session string, event_type string, ret double, n long")
    got = forward.forward_observations(df.selectExpr("to_date(session) AS session", "event_type", "ret", "n"), "2024-01-31").collect()
    assert [(r.ret, r.n) for r in got] == [(0.1, 1)]
