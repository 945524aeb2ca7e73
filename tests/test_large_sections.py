"""What large cross-sections go through: groups instead of packed rows, no copies of rows for blends, no window over a whole factor."""

import contextlib
import io
import random
import re
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import models, portfolio, scores, validation
from panelforge.operators.base import SPARK, run
from panelforge.operators.sqlkit import DAILY
from panelforge.sources import panels


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [(f, 1, sx, i, round(rng.gauss(0, 1), 1), rng.gauss(0, 1)) for sx in (1, 2, 3) for f in "ab" for i in range(12) if (sx, f) != (3, "b") and rng.random() < 0.8]


def test_blends_meet_their_session_in_one_group(spark, rows):
    need = [(n, 1, sx, f, w) for sx in (1, 2, 3) for n, parts in (("a", {"a": 1.0}), ("ab", {"a": 0.25, "b": 0.75})) for f, w in parts.items()]
    df = spark.createDataFrame(rows, "factor_id string, horizon long, sx long, instrument long, v double, fwd double")
    asked = spark.createDataFrame(need, "blend string, horizon long, sx long, factor_id string, weight double")
    found = {(r.blend, r.sx): r.ic for r in models.blend_ics(df, asked).collect()}

    def ranks(x):
        return np.array([sum(b < a for b in x) + (sum(b == a for b in x) + 1) / 2 for a in x])

    for sx in (1, 2, 3):
        unit, fwd = {}, {}
        for f in "ab":
            mine = [r for r in rows if r[0] == f and r[2] == sx]
            unit[f] = dict(zip([r[3] for r in mine], (ranks([r[4] for r in mine]) - 1) / max(len(mine) - 1, 1), strict=True)) if mine else {}
            for r in mine:
                fwd[r[3]] = max(fwd.get(r[3], -9), r[5]) if f == "b" else r[5]
        own = sorted(unit["a"])
        first = {r[3]: r[5] for r in rows if r[0] == "a" and r[2] == sx}
        assert found["a", sx] == pytest.approx(np.corrcoef(ranks([unit["a"][i] for i in own]), ranks([first[i] for i in own]))[0, 1])
        both = sorted(set(unit["a"]) & set(unit["b"]))
        if len(both) < 3:
            assert ("ab", sx) not in found
        else:
            value = [round(0.25 * unit["a"][i] + 0.75 * unit["b"][i], 9) for i in both]
            assert found["ab", sx] == pytest.approx(np.corrcoef(ranks(value), ranks([fwd[i] for i in both]))[0, 1])


def test_marginal_sections_take_rows_as_they_are(spark):
    rng = random.Random(6)
    data = [("w", 1, "s", 7, i, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(11)]
    df = spark.createDataFrame(data, "factor_id string, horizon long, session string, sx long, instrument long, x double, y double, fwd double")
    roles = spark.createDataFrame([(0, 7, "test"), (1, 7, "train"), (2, 7, "test")], "fold long, sx long, role string")
    betas = spark.createDataFrame([(f, "w", 1, 9.0, 0.5, 0.1, 0.2) for f in (0, 1, 2)], "fold long, factor_id string, horizon long, n double, beta double, mx double, my double")
    found = {r.fold: r for r in models.marginal_sections(df, roles, betas).collect()}
    best = [i for *_, i, _, _, _ in sorted(data, key=lambda r: (r[5], r[4]))][-3:]
    assert sorted(found) == [0, 2] and all(r.held_ref == best and r.n == 11 and len(r.held_aug) == 3 for r in found.values())
    assert found[0].se == pytest.approx(sum(r[6] - 0.2 - 0.5 * (r[5] - 0.1) for r in data))


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("operator", [scores.diagnostic_codes, validation.walk_forward_signals])
def test_rows_never_meet_by_factor_or_horizon_alone(spark, sf_dir, operator):
    obs = panels.SPARK["obs"](spark, sf_dir)
    spread = [line for line in plan(operator(obs=obs)).splitlines() if "dense_rank" in line or re.search(r"SortMergeJoin \[(horizon|h|horizon#\d+L)\], ", line)]
    assert not spread


def test_a_count_of_lines_gives_the_partitions(spark, monkeypatch):
    lines = spark.range(1000)
    assert panels.partitions(lines) is None
    monkeypatch.setattr(panels, "ROWS", 100)
    assert panels.partitions(lines) == 10 and panels.dealt(lines, 10, "id").rdd.getNumPartitions() == 10


def test_pairs_are_dealt_by_cross_section():
    text = scores.redundancy_text(replace(SPARK, sections=7))
    assert "REPARTITION(7, fa, fb, horizon, session)" in text and "REPARTITION" not in scores.redundancy_text(SPARK)


def test_only_names_held_are_numbered_by_session():
    text = portfolio.jaccard_turnover.text(SPARK)
    assert text.index("dense_rank") < text.index("AS place FROM")


def test_slices_keep_the_cohorts_and_the_control_of_whole_sections(spark, sf_dir):
    obs = panels.SPARK["obs"](spark, sf_dir).where("instrument % 3 < 2 OR sx % 7 > 0").withColumn("cap", F.floor(F.col("cap") / 2000).cast("double")).cache()
    slices = portfolio._slices(run(portfolio.slice_rows_text(SPARK), obs=obs), 2).cache()
    plain = portfolio.events_text(SPARK, (2,)), portfolio.control_text(SPARK)
    for new, old in zip(portfolio.sliced_events(SPARK, 2), plain, strict=True):
        rounded = [F.round(c, 9).alias(c) for c in ("gross", "turnover", "net")]
        keys = ["factor_id", "horizon", "b", "offset_no", "seq", "session", "active", "clipped", "clipped_orders"]
        a, b = (x.select(*keys, *rounded) for x in (run(new, obs=obs, slices=slices), run(old.replace("{obs}", f"({portfolio.sliced_text()})"), obs=obs)))
        assert b.count() > 100 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    dealt = plan(run(portfolio.sliced_events(SPARK, 2)[1], obs=obs.repartition("instrument"), slices=slices))
    assert not re.search(r"hashpartitioning\([^)]*offset_no[^)]*instrument", dealt)
    ics = run(f"SELECT factor_id, horizon, session, round(rank_ic, 9) AS ic FROM ({DAILY})".replace("{obs}", f"({portfolio.sliced_text()})"), obs=obs)
    found = slices.where("rank_ic IS NOT NULL").selectExpr("factor_id", "horizon", "session", "round(rank_ic, 9) AS ic")
    assert ics.exceptAll(found).isEmpty() and found.exceptAll(ics).isEmpty()


def test_a_session_is_shuffled_once_for_all_its_sections(spark):
    """Sections with other names take their own out of the session's order: the same as if shuffled alone."""
    rng, reps, seed = random.Random(9), 5, 7
    data = [(f, h, sx, sx, i, round(rng.gauss(0, 1), 1), round(rng.gauss(0, 1), 1)) for sx in (3, 4) for f in "ab" for h in (1, 5) for i in range(3_000_000_000, 3_000_000_040) if f == "a" or rng.random() < 0.7]
    data += [("c", 1, 3, 3, i, 1.0, float(i)) for i in (1, 2, 3)]
    df = spark.createDataFrame(data, "factor_id string, horizon long, session long, sx long, instrument long, v double, fwd double")
    found = {(r.factor_id, r.horizon, r.session, r.method, r.rep): r.ic for r in models.shuffled_ics(df, reps, seed).collect()}
    assert len(found) == 9 * (2 * reps + 1) and all(found["c", 1, 3, m, r] is None for m in (0, 1) for r in range(1, reps + 1))
    p = models.PRIME
    for f, h, sx in {d[:3] for d in data if d[0] != "c"}:
        mine = sorted((d[4], d[5], d[6]) for d in data if d[:3] == (f, h, sx))
        rv, rf = (models.average_ranks(np.array([m[k] for m in mine])) for k in (1, 2))
        assert found[f, h, sx, 0, 0] == pytest.approx(np.corrcoef(rv, rf)[0, 1])
        for method in (0, 1):
            for rep in range(1, reps + 1):
                first = [(i * models.BY_NAME + rep * models.BY_REP + sx * models.BY_SESSION + method * models.BY_METHOD + seed * models.BY_SEED) % p for i, *_ in mine]
                second = [x * x % p + rep for x in first]
                order = sorted(range(len(mine)), key=lambda k: (second[k] ** 2 % p, k))
                still, moved = (rv, rf) if method == 0 else (rf, rv)
                assert found[f, h, sx, method, rep] == pytest.approx(np.corrcoef(still, moved[order])[0, 1])
