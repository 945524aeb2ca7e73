"""Folds read rows where they stand: no copy of a row for each fold, no rank of all of a fold's rows."""

import contextlib
import io
import random

import numpy as np
import pytest

from panelforge.operators import linear, order, risk
from panelforge.operators.base import DUCK, REGISTRY
from panelforge.sources import panels


@pytest.fixture(scope="module")
def wide(spark):
    rng = random.Random(8)
    rows = [(h, sx, round(rng.gauss(0, 1), 2), float(rng.randrange(4)), rng.gauss(0, 1) ** 9) for h in (1, 5) for sx in range(1, 13) for _ in range(60)]
    return spark.createDataFrame(rows, "horizon long, sx long, e1 double, e2 double, e3 double").cache()


@pytest.fixture(scope="module")
def roles(spark):
    return spark.createDataFrame([(f, sx, "test" if (sx - 1) // 4 == f else "train") for f in range(3) for sx in range(1, 13)] + [(3, 1, "test")], "fold long, sx long, role string")


def columns(wide, roles):
    data, found = wide.collect(), {}
    for fold in {r.fold for r in roles.where("role = 'train'").collect()}:
        days = {r.sx for r in roles.where(f"fold = {fold} AND role = 'train'").collect()}
        for h in (1, 5):
            found[fold, h] = np.array([[r.e1, r.e2, r.e3] for r in data if r.sx in days and r.horizon == h])
    return found


def test_limits_of_all_folds_come_from_passes_over_the_same_rows(wide, roles, monkeypatch):
    monkeypatch.setattr(linear, "FITS", 5)
    monkeypatch.setattr(order, "BINS", 4)
    found = {(r.fold, r.horizon, r.e): (r.mid, r.lo, r.hi, r.mad) for r in linear.robust_limits(wide, roles).collect()}
    assert len(found) == 18
    for (fold, h), x in columns(wide, roles).items():
        for e in (1, 2, 3):
            mid, lo, hi = np.quantile(x[:, e - 1], (0.5, 0.01, 0.99))
            assert found[fold, h, e] == pytest.approx((mid, lo, hi, np.median(np.abs(x[:, e - 1] - mid))), abs=1e-12)


def test_first_centres_stand_at_places_of_distinct_rows_whatever_the_ranges(wide, roles, monkeypatch):
    monkeypatch.setattr(linear, "RANGE", 40)
    names, limits = ["e1", "e2", "e3"], linear.robust_limits(wide, roles)
    found = linear._starts(wide, linear._Folds(limits, roles, 3), names, 8)
    wanted = linear._starts_by_places(wide, roles, limits, names, 8)
    assert found.keys() == wanted.keys() and len(found) == 6
    assert all((found[k] == wanted[k]).all() for k in found)


def test_residuals_of_folds_are_not_sorted_by_fold(spark, sf_dir):
    entry = REGISTRY["j17_component_and_cluster"]
    with contextlib.redirect_stdout(io.StringIO()) as out:
        entry.run({"obs": panels.SPARK["obs"](spark, sf_dir)}).explain()
    assert "Window" not in out.getvalue() and "FlatMapGroupsInArrow" in out.getvalue()
    assert "{held_out}" not in risk.component_and_cluster.text(DUCK)
