"""Regimes of sessions whose breadth ties its limit, against the operator's SQL."""

import random

import duckdb

from panelforge.operators import panel
from panelforge.operators.base import DUCK


def test_a_tied_breadth_falls_on_the_same_side_as_in_the_sql(spark):
    rng, rows = random.Random(3), []
    for i in range(5):
        close = 100.0
        for sx in range(1, 401):
            close *= 1 + rng.choice([-0.01, 0.01]) * (1 + i / 7)
            rows.append((i, sx, close, 1000.0 + rng.random()))
    values = ", ".join(map(str, rows))
    bars = f"SELECT instrument, sx, DATE '2000-01-01' + CAST(sx AS INT) AS session, CAST(close AS DOUBLE) AS close, CAST(amount AS DOUBLE) AS amount FROM (VALUES {values}) AS t(instrument, sx, close, amount)"
    wanted = dict(duckdb.sql(f"WITH p2 AS MATERIALIZED ({bars}) {panel.prior_regimes.text(DUCK).replace('{bars}', 'p2')}").fetchall())
    found = {r.session: r.regime for r in panel.prior_regimes(bars=spark.sql(bars)).collect()}
    assert {s: r for s, r in found.items() if wanted[s] != r} == {} and len(found) == len(wanted) == 400
