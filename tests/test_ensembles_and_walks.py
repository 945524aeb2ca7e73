"""Ensembles over any number of factors, and walk-forward signals, on hand-made panels."""

import pytest

from panelforge.operators import scores, validation, xs


@pytest.fixture(scope="module")
def obs(spark):
    rows = [(i, s, f, 1, float((i * k + s) % 7), float(i)) for s in range(1, 13) for i in range(7) for k, f in ((1, "a"), (2, "b"), (3, "c"), (4, "d"))]
    rows += [(9, 1, "a", 1, 0.5, 0.0)]
    df = spark.createDataFrame(rows, "instrument long, sx long, factor_id string, horizon long, v double, fwd double")
    return df.selectExpr("*", "date_add(DATE '2020-01-01', CAST(sx AS INT)) AS session", "1e0 AS cap").cache()


def test_ensembles_take_their_factors_as_arguments(obs):
    parts = {"a": (0.4, 1), "b": (0.3, -1), "c": (0.2, 1), "d": (0.1, 1)}
    assert xs.blend_ranks(obs=obs, parts=parts).count() == xs.ensemble_mean_rank(obs=obs, factors=tuple(parts)).count() == 12 * 7
    assert xs.ensemble_z(obs=obs, weights={"a": 1.0, "d": 1.0}).count() == 12 * 7
    one = xs.blend_ranks(obs=obs.where("sx = 2"), parts={"a": (2.0, -1)}).orderBy("instrument").collect()
    assert [r.value for r in one] == pytest.approx([1 - ((i + 2) % 7) / 6 for i in range(7)], abs=1e-6)


def test_walk_forward_emits_the_signals_of_the_chosen_factor(obs):
    chosen = {r.block: r.factor_id for r in validation.walk_forward(obs=obs, blocks=4).collect()}
    rows = validation.walk_forward_signals(obs=obs, blocks=4).collect()
    assert {r.block for r in rows} == {2, 3, 4} == chosen.keys() and len(rows) == 3 * 3 * 7
    assert all(r.factor_id == chosen[r.block] for r in rows)
    want = {(r.session, r.instrument, r.factor_id): r.v for r in obs.collect()}
    assert all(r.signal == pytest.approx(want[r.session, r.instrument, r.factor_id]) for r in rows)


def test_codes_name_what_is_wrong(spark, obs):
    rows = {r.factor_id: r for r in scores.diagnostic_codes(obs=obs.where("instrument < 7"), turnover=0.2).collect()}
    assert all("EXCESS_TURNOVER" in r.codes for r in rows.values())
    steady = spark.createDataFrame([(i, s, "x", 1, i + s / 1000, 0.01 * i * (1 if s % 2 else -0.5)) for s in range(40) for i in range(10)], "instrument long, sx long, factor_id string, horizon long, v double, fwd double")
    row = scores.diagnostic_codes(obs=steady.selectExpr("*", "date_add(DATE '2020-01-01', CAST(sx AS INT)) AS session")).first()
    assert (row.codes, row.coverage, row.stale, row.turnover) == ("PASS", 1.0, 0.0, 0.0) and row.q5 > row.q1
