"""Fold-local ridge, components and clusters, and cohorts gated by regimes, against plain loops."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from panelforge.operators import linear, portfolio, risk, validation
from panelforge.operators.base import SPARK, run


@pytest.fixture(scope="module")
def obs(spark):
    rng, rows = random.Random(4), []
    for sx in range(1, 97):
        for i in range(12 if sx % 9 else 8):
            a, b, adv = rng.gauss(0, 1), rng.gauss(0, 1), math.exp(5 + rng.gauss(0, 1))
            for f, v in (("rev5", a + 0.5 * b), ("strength", b), ("width", 2 * a - b + 0.1 * rng.gauss(0, 1))):
                rows.append((i, sx, adv, f, v, 1))
    df = spark.createDataFrame(rows, "instrument long, sx long, adv double, factor_id string, v double, horizon long")
    return df.selectExpr("*", "date_add(DATE '2020-01-01', CAST(sx AS INT)) AS session", "0e0 AS fwd").cache()


@pytest.fixture(scope="module")
def table(obs):
    """{(sx, instrument): {factor: value, log_adv}} and {fold: {sx: role}}."""
    cells, roles = defaultdict(dict), defaultdict(dict)
    for r in obs.collect():
        cells[r.sx, r.instrument][r.factor_id] = r.v
        cells[r.sx, r.instrument]["log_adv"] = math.log(r.adv)
    for r in run(validation.purge_embargo.text(SPARK), obs=obs).collect():
        roles[r.fold][r.sx] = r.role
    return cells, roles


def test_ridge_equals_the_normal_equations_of_every_fold(obs, table):
    cells, roles = table
    wanted = {}
    for fold, role in roles.items():
        train = [c for (sx, _), c in cells.items() if role[sx] == "train"]
        x = np.array([[1.0, c["rev5"], c["strength"]] for c in train])
        y = np.array([c["width"] for c in train])
        beta = np.linalg.solve(x.T @ x + np.diag([0.0, 1.0, 1.0]), x.T @ y)
        for (sx, i), c in cells.items():
            if role[sx] == "test":
                wanted[fold, sx, i] = c["width"] - beta @ [1.0, c["rev5"], c["strength"]]
    day = {r.session: r.sx for r in obs.select("session", "sx").distinct().collect()}
    found = {(r.fold, day[r.session], r.instrument): r.residual for r in risk.ridge_residual(obs=obs).collect()}
    assert found.keys() == wanted.keys()
    assert max(abs(found[k] - wanted[k]) for k in wanted) < 2e-6


def test_held_out_residuals_by_component_and_cluster(obs, table):
    cells, roles = table
    names = ("strength", "width", "log_adv")
    found = defaultdict(dict)
    day = {r.session: r.sx for r in obs.select("session", "sx").distinct().collect()}
    for r in risk.component_and_cluster(obs=obs).collect():
        found[r.fold, day[r.session]][r.instrument] = r
    assert not any(sx % 9 == 0 for _, sx in found)
    full = [f for f in sorted(roles) if list(roles[f].values()).count("train") >= 15]
    for fold in full[:1] + full[-2:]:
        role = roles[fold]
        x = np.array([[c[n] for n in names] for (sx, _), c in sorted(cells.items()) if role[sx] == "train"])
        mid, lo, hi = (np.quantile(x, q, axis=0) for q in (0.5, 0.01, 0.99))
        scale = lambda v: (np.clip(v, lo, hi) - mid) / (1.4826 * np.median(np.abs(x - mid), axis=0))  # noqa: B023, E731
        z = scale(x)
        top = np.array([1.0, 2.0, 3.0])
        for _ in range(50):
            top = np.cov(z.T) @ top
            top /= np.sqrt(top @ top)
        top *= np.sign(top[0])
        unique = sorted(set(map(tuple, z.tolist())))
        centres = np.array([unique[round(i * (len(unique) - 1) / 7)] for i in range(8)])
        for _ in range(20):
            near = linear.nearest(z, centres)
            centres = np.array([z[near == j].mean(0) if (near == j).any() else centres[j] for j in range(8)])
        for sx in (s for s in role if role[s] == "test" and s % 9):
            mine = {i: c for (s, i), c in cells.items() if s == sx}
            t = np.array([scale(np.array([c[n] for n in names])) for c in mine.values()])
            signal, pc, group = np.array([c["rev5"] for c in mine.values()]), (t - z.mean(0)) @ top, linear.nearest(t, centres)
            slope = np.cov(signal, pc, bias=True)[0, 1] / pc.var()
            for k, i in enumerate(mine):
                r = found[fold, sx][i]
                peers = signal[group == group[k]]
                assert r.pc == pytest.approx(pc[k], abs=1e-4) and r.cluster == group[k]
                assert r.pca_neutral == pytest.approx(signal[k] - signal.mean() - slope * (pc[k] - pc.mean()), abs=1e-4)
                assert r.cluster_neutral == pytest.approx(signal[k] - (peers.mean() if len(peers) >= 3 else signal.mean()), abs=2e-6)


def test_a_fold_with_too_few_rows_has_no_residuals(obs):
    few = obs.where("sx <= 6 AND instrument = 0")
    assert risk.component_and_cluster(obs=few).count() == 0
    assert risk.ridge_residual(obs=obs.limit(0)).count() == 0


def test_gate_follows_planted_regimes(spark):
    """A state lasts until the next change; before the first one and in other states the gate is closed."""
    rows = [(i, s, s, 0, 1.0, 2020, 1.0, 1e9, "f", float(i), 1, 0.01 * i) for s in range(1, 9) for i in range(4)]
    obs = spark.createDataFrame(rows, "instrument long, session long, sx long, grp long, cap double, subperiod int, adv double, prior_amount double, factor_id string, v double, horizon long, fwd double")
    states = spark.createDataFrame([(2, "on"), (3, "on"), (4, "off"), (6, "on"), (9, "off")], "session long, regime string")
    for hold, closed in ((False, 0.0 - 0.015), (True, 0.0)):
        got = {r.session: r for r in portfolio.cohort_events(obs=obs, regimes=states, b=2, gate=("on",), hold=hold).collect()}
        assert {s for s, r in got.items() if r.active} == {2, 3, 6, 7, 8} and len(got) == 8
        assert all(r.gross == pytest.approx(0.025 - 0.015 if r.active else closed) for r in got.values())
    none = portfolio.cohort_events(obs=obs, regimes=states.limit(0), b=2, gate=("on",)).collect()
    assert len(none) == 8 and not any(r.active for r in none)


def test_clipped_money_does_not_depend_on_the_order_of_sums(spark):
    rows = [(i, 1, 1, 0, 1.0, 2020, 1.0, p, "f", float(i), 1, 0.0) for i, p in enumerate((871_405.35, 4.25, 0.05, 1e9))]
    obs = spark.createDataFrame(rows, "instrument long, session long, sx long, grp long, cap double, subperiod int, adv double, prior_amount double, factor_id string, v double, horizon long, fwd double")
    wanted = sum(round((1e6 / 3 - p * 0.1) * 1e6) for p in (4.25, 0.05))
    row = portfolio.cohort_events(obs=obs, b=3, mode="BUY").first()
    assert row.clipped == ((wanted + 5000) // 10000) / 100
