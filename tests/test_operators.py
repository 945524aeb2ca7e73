"""Operators on tiny hand-made panels, planted signals, and DuckDB twins at the smallest scale."""

import math
import random
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest

from panelforge.functions import factors
from panelforge.operators import panel, portfolio, scores, validation, xs
from panelforge.operators.base import DUCK, REGISTRY, SPARK, duck_text, run
from panelforge.plans import registry, twins
from panelforge.sources import panels

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TWINS = ["e1_period_return_5", "e15_relative_strength_60", "e24e_max_drawdown_10", "f8_residualise_3", "h1_daily_ic", "h3_rank_turnover", "h12_diagnostics", "h14_objective", "h20_stability", "d1_asof_strict", "g4_membership_turnover", "j5_fit_transform", "j6_cpcv_scores", "j8_pbo_paths", "j11_placebo", "j18_marginal", "j19_duplicate_matrix", "l2_dedupe_quota", "l5_prune", "c10_confirm", "a3_read_bars_long", "a6_read_memberships", "a14_write_bundle", "m1_forward_stream"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _rows(pdf):
    """Whole rows, sorted; numbers to five places, so that an integer column may come back as doubles."""

    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, float):
            return str(int(v)) if v.is_integer() else f"{v:.5f}"
        return str(v).removesuffix(" 00:00:00")

    return sorted(tuple(cell(v) for v in row) for row in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", [*TWINS, *twins.TEXTS])
def test_twin(spark, duck, sf_dir, name):
    ours, theirs = registry.queries()[name](spark, sf_dir).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    assert _rows(ours) == _rows(theirs)


@pytest.mark.parametrize("name", twins.TEXTS)
def test_second_formulas_share_no_text_but_agree(duck, name):
    theirs, own = registry.oracle_sql()[name], duck_text(REGISTRY[name], panels.DUCK, panels.NEEDS)
    assert theirs != own and _rows(duck.execute(theirs).df()) == _rows(duck.execute(own).df())


def test_every_operator_renders_for_both_engines():
    for entry in REGISTRY.values():
        assert entry.text(SPARK, **entry.params) and entry.text(DUCK, **entry.params)


@pytest.fixture(scope="module")
def obs(spark):
    rng, rows = random.Random(3), []
    for sx in range(1, 25):
        for i in range(12):
            v = rng.random()
            rows.append((i, f"2020-01-{sx:02d}", sx, i % 3, 100.0 + i, 2020, 1000.0 + i, "rev5", v, 1, v + 0.05 * rng.random()))
            rows.append((i, f"2020-01-{sx:02d}", sx, i % 3, 100.0 + i, 2020, 1000.0 + i, "width", rng.random(), 1, v))
    df = spark.createDataFrame(rows, "instrument long, session string, sx long, grp long, cap double, subperiod int, adv double, factor_id string, v double, horizon long, fwd double")
    return df.selectExpr("instrument", "to_date(session) AS session", "sx", "grp", "cap", "subperiod", "adv", "factor_id", "v", "horizon", "fwd").cache()


def test_planted_signal_is_found_and_noise_is_not(obs):
    got = {r["factor_id"]: r for r in scores.ic_summary(obs=obs).collect()}
    assert got["rev5"]["mean_rank_ic"] > 0.95 and abs(got["width"]["mean_rank_ic"]) < 0.2


def test_placebo_destroys_a_planted_signal(obs):
    p = {r["factor_id"]: r["p_value"] for r in validation.placebo(obs=obs, reps=19).collect()}
    assert p["rev5"] == pytest.approx(0.05) and p["width"] > 0.05


def test_average_rank_shares_ties(spark):
    df = spark.createDataFrame([(i, "f", 1, 1, v) for i, v in enumerate([3.0, 1.0, 3.0, 2.0])], "instrument long, factor_id string, horizon long, session long, v double")
    assert [r["value"] for r in xs.average_rank(obs=df).orderBy("instrument").collect()] == [3.5, 1.0, 3.5, 2.0]


def test_residual_is_orthogonal_to_its_controls(obs):
    got = xs.residualise(obs=obs).join(obs.select("factor_id", "session", "instrument", "cap"), ["factor_id", "session", "instrument"])
    worst = got.groupBy("factor_id", "session").agg({"value": "avg"}).selectExpr("max(abs(`avg(value)`))").first()[0]
    assert worst < 1e-5


def test_window_with_a_gap_is_null(spark):
    bars = spark.createDataFrame([(1, s, s, 1.0, 2.0, 1.0, float(s), 5.0, 5.0) for s in [1, 2, 3, 5, 6, 7]], "instrument long, session long, sx long, open double, high double, low double, close double, volume double, amount double")
    got = run(factors.factor_query(factors.period_return("close", 2), 3), bars=bars).collect()
    assert {r["session"]: r["value"] for r in got} == {3: 2.0, 7: pytest.approx(7 / 5 - 1, abs=1e-6)}


def test_purge_by_running_maximum_equals_pairs(obs):
    roles = {(r["fold"], r["sx"]): r["role"] for r in run(validation.purge_embargo.text(SPARK), obs=obs).collect()}
    h, embargo = 5, 3
    for (fold, sx), role in roles.items():
        tests = [s for (f, s), r in roles.items() if f == fold and r == "test"]
        if role == "test":
            continue
        wanted = "purged" if any(t <= sx + h and t + h >= sx for t in tests) else "embargoed" if any(sx - 1 - embargo <= t + h < sx - 1 for t in tests) else "train"
        assert role == wanted, (fold, sx)
    assert len({f for f, _ in roles}) == math.comb(6, 3)


def test_audit_flags_a_broken_bar(spark):
    bars = spark.createDataFrame([(1, 5.0, 4.0, 3.0, 4.0, 1.0, 1.0), (1, 2.0, 3.0, 1.0, 2.0, 1.0, 1.0)], "grp long, open double, high double, low double, close double, volume double, amount double")
    row = panel.bar_violations(bars=bars).first()
    assert (row["bars"], row["violations"]) == (2, 1)


@pytest.mark.parametrize("name", ["b5_timing_audit", "b11_audit_chain"])
def test_audits_pass_what_is_clean_and_equal_their_twins(spark, duck, sf_dir, name):
    ours, theirs = registry.queries()[name](spark, sf_dir).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert _rows(ours) == _rows(theirs) and len(ours)
    wrong = [c for c in ours.columns if c in ("late_signals", "early_signals", "bad_labels", "duplicates", "not_finite", "gaps", "unlinked", "altered", "repeated")]
    assert wrong and not ours[wrong].to_numpy().any()


def test_timing_audit_finds_planted_violations(spark, sf_dir):
    clean = registry._frame(spark, sf_dir, "obs").where("factor_id = 'rev5' AND horizon = 1").orderBy("sx", "instrument").limit(40).toPandas()
    bad = clean.copy()
    bad.loc[0, "feature_at"] = bad.loc[0, "label_start"]
    bad.loc[1, "signal_at"] = bad.loc[1, "label_end"]
    bad.loc[2, "label_end"] = bad.loc[2, "signal_at"]
    bad.loc[3, "v"], bad.loc[4, "fwd"] = float("inf"), float("nan")
    schema = registry._frame(spark, sf_dir, "obs").schema
    row = panel.timing_audit(obs=spark.createDataFrame(list(bad.itertuples(index=False, name=None)), schema)).first()
    assert (row["observations"], row["late_signals"], row["early_signals"], row["bad_labels"], row["not_finite"]) == (40, 1, 1, 1, 2)


def test_chain_audit_finds_broken_links_and_altered_entries(spark, sf_dir):
    ledger = registry._frame(spark, sf_dir, "ledger").toPandas()
    user = ledger.groupby("user_id").size().idxmax()
    chain = ledger[ledger.user_id == user].sort_values("seq", ignore_index=True).head(6)
    assert len(chain) >= 5
    schema = "user_id long, event_id long, event_type string, seq long, previous_hash string, entry_hash string"

    def found(pdf):
        row = panel.audit_chain(ledger=spark.createDataFrame(list(pdf.itertuples(index=False, name=None)), schema)).first()
        return row["gaps"], row["unlinked"], row["altered"], row["repeated"]

    assert found(chain) == (0, 0, 0, 0)
    altered, broken = chain.copy(), chain.copy()
    altered.loc[2, "event_type"] = "forged"
    broken.loc[2, "previous_hash"] = "f" * 64
    assert found(altered) == (0, 0, 1, 0)
    assert found(broken) == (0, 1, 1, 0)
    assert found(chain.drop(index=2)) == (1, 1, 0, 0)


def test_audits_count_planted_faults(spark, duck, sf_dir):
    for name in ("b7_revision_violations", "b8_interval_overlaps", "b9_leakage_summary"):
        ours, theirs = registry.queries()[name](spark, sf_dir).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
        assert _rows(ours) == _rows(theirs)
    found = dict(registry.queries()["b9_leakage_summary"](spark, sf_dir).select("class", "violations").collect())
    assert all(found[k] > 0 for k in ("unlinked", "mislinked", "early", "nominal_early", "empty", "overlapping"))


def _chain(spark, rows):
    columns = "user_id long, event_type string, event_id long, value double, visible_at timestamp, predecessor long, announced_at timestamp, published_at timestamp, available_at timestamp, nominal boolean, effective_from timestamp, effective_to timestamp"
    t = lambda x: None if x is None else datetime(2024, 1, 1) + timedelta(hours=x)
    return spark.createDataFrame([(1, "a", i, 1.0, t(v), p, t(an), t(an), t(av), nom, t(f), t(to)) for i, v, p, an, av, nom, f, to in rows], columns)


def test_clean_chains_pass_and_each_fault_is_its_own_class(spark):
    clean = [(1, 10, None, 5, 10, False, 10, 20), (2, 20, 1, 15, 20, False, 20, 40), (3, 60, 2, 30, 60, True, 40, None)]
    rows = panel.revision_violations(revs=_chain(spark, clean)).first().asDict()
    gaps = panel.interval_overlaps(revs=_chain(spark, clean)).first().asDict()
    assert [rows[k] for k in ("false_start", "unlinked", "mislinked", "early", "nominal_early")] == [0] * 5 and [gaps[k] for k in ("empty", "overlapping", "open_inside")] == [0] * 3
    bad = [(1, 10, 9, 5, 4, False, 10, 8), (2, 20, None, 15, 20, False, 20, 45), (3, 60, 1, 50, 60, True, 40, None), (4, 70, 3, 50, 70, False, 50, 60)]
    rows = panel.revision_violations(revs=_chain(spark, bad)).first().asDict()
    gaps = panel.interval_overlaps(revs=_chain(spark, bad)).first().asDict()
    assert [rows[k] for k in ("false_start", "unlinked", "mislinked", "early", "nominal_early")] == [1] * 5 and [gaps[k] for k in ("empty", "overlapping", "open_inside")] == [1] * 3


def test_fold_weights_sum_to_one_and_paths_differ_by_them(obs):
    cands = run(panels.candidates_text(SPARK), obs=obs)
    got = validation.fit_weights(obs=obs, cands=cands).toPandas()
    sums = got[got.scheme != "signed"].groupby(["fold", "horizon", "candidate", "scheme"]).weight.sum()
    assert sums.to_numpy() == pytest.approx(1.0, abs=1e-5)
    assert (got[(got.scheme == "best") & (got.factor_id == "rev5")].weight == 1).all()
    paths = validation.path_scores(obs=obs, cands=cands).toPandas()
    spread = paths.groupby("config").score.agg(lambda x: x.max() - x.min())
    # What learns nothing scores the same on every path: only weights learned in a fold set paths apart.
    assert (spread[spread.index.str.endswith("equal") | spread.index.str.endswith("single")] < 1e-5).all()
    row = validation.pbo_paths(obs=obs, cands=cands).first()
    assert row["splits"] == 252 and 0 <= row["pbo"] <= 1


def test_cohorts_by_hand(spark):
    """Three names, two sessions apart: orders are clipped, turnover counts entries and exits."""
    rows = [(i, s, s, 0, 1.0, 2020, 1.0, prior, "f", v, 1, r) for s, values in ((1, (3, 2, 1)), (2, (1, 3, 2)), (3, (1, 3, 2))) for i, (v, r, prior) in enumerate(zip(map(float, values), (0.1, 0.2, 0.3), (1e9, 1e9, 5e5), strict=True))]
    obs = spark.createDataFrame(rows, "instrument long, session long, sx long, grp long, cap double, subperiod int, adv double, prior_amount double, factor_id string, v double, horizon long, fwd double")
    got = [r.asDict() for r in portfolio.cohort_events(obs=obs, b=2).orderBy("seq").collect()]
    # Best two are (0, 1), then (1, 2): name 2 may trade 5e5 * 0.1 of 1e6 only.
    assert [round(r["turnover"], 6) for r in got] == [0.5, 0.275, 0.0]
    assert [r["gross"] for r in got] == pytest.approx([0.15 - 0.2, 0.1 + 0.05 * 0.3 - 0.2, 0.1 + 0.05 * 0.3 - 0.2])
    assert [r["clipped"] for r in got] == [0.0, 450_000.0, 450_000.0]
    avoid = [r.asDict() for r in portfolio.cohort_events(obs=obs, b=2, mode="AVOID").orderBy("seq").collect()]
    assert [r["turnover"] for r in avoid] == [0.5, 1.0, 0.0] and [r["gross"] for r in avoid] == pytest.approx([0.1 - 0.2, 0.2 - 0.2, 0.2 - 0.2])


def test_stream_appends_each_observation_once(spark, sf_dir):
    got = registry.queries()["m1_forward_stream"](spark, sf_dir)
    assert got.count() == got.select("session", "event_type").distinct().count() > 0


def test_placebo_has_both_methods_and_horizons(obs):
    both = obs.unionByName(obs.withColumn("horizon", obs["horizon"] * 5))
    got = {(r["factor_id"], r["horizon"], r["method"]): r["p_value"] for r in validation.placebo(obs=both).collect()}
    assert len(got) == 8 and {got["rev5", h, m] for h in (1, 5) for m in ("return", "signal")} == {0.005}
