"""Scores of factors: information coefficients, turnover, quantile shapes, performance, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelforge.operators import order
from panelforge.operators.base import Dialect, Stage, operator
from panelforge.operators.sqlkit import DAILY, RETURNS, XS, avg_rank, ordinal, performance, r6, size, states_text, unit
from panelforge.operators.xs import bucket_text

OBS = {"obs": "obs"}
_SUMMARY = f"count(*) AS days, {r6('avg(ic)')} AS mean_ic, {r6('avg(rank_ic)')} AS mean_rank_ic, {r6('avg(rank_ic) / nullif(stddev_samp(rank_ic), 0) * sqrt(252)')} AS icir, {r6('avg(CASE WHEN rank_ic > 0 THEN 1e0 ELSE 0e0 END)')} AS hit_rate"


@operator("entry_reversal_ic", OBS, by_section=True)
@operator("h2_ic_summary", OBS, by_section=True)
def ic_summary(d: Dialect) -> str:
    return f"SELECT factor_id, horizon, {_SUMMARY} FROM ({DAILY}) AS daily GROUP BY factor_id, horizon"


@operator("h1_daily_ic", OBS, by_section=True)
def daily_ic(d: Dialect) -> str:
    return f"SELECT {XS}, {r6('ic')} AS ic, {r6('rank_ic')} AS rank_ic, names FROM ({DAILY}) AS daily"


def _turnover(extra: str = "") -> str:
    return f"""
SELECT factor_id, horizon, a.session, a.instrument, a.v AS va, b.v AS vb FROM (SELECT o.*, t.i FROM {{obs}} AS o JOIN days AS t USING (factor_id, horizon, session)) AS a
JOIN (SELECT o.factor_id, o.horizon, o.instrument, o.v, t.i FROM {{obs}} AS o JOIN days AS t USING (factor_id, horizon, session)) AS b USING (factor_id, horizon, instrument) WHERE a.i = b.i + 1{extra}"""


_DAYS = "days AS (SELECT factor_id, horizon, session, row_number() OVER (PARTITION BY factor_id, horizon ORDER BY session) AS i FROM (SELECT DISTINCT factor_id, horizon, session FROM {obs}) AS x)"


@operator("h3_rank_turnover", OBS)
def rank_turnover(d: Dialect) -> str:
    """Mean change of rank between neighbouring sessions, ranked anew on the names in both."""
    return f"""
WITH {_DAYS}, pairs AS ({_turnover()}),
ranked AS (SELECT factor_id, horizon, session, {avg_rank('va')} AS ra, {avg_rank('vb')} AS rb, {size()} AS n FROM pairs)
SELECT factor_id, horizon, {r6('avg(t)')} AS turnover FROM (SELECT factor_id, horizon, session, avg(abs(ra - rb)) / (max(n) - 1) AS t FROM ranked WHERE n > 1 GROUP BY factor_id, horizon, session) AS x GROUP BY factor_id, horizon"""


@operator("h4_ic_by_subperiod", OBS, by_section=True)
def ic_by_subperiod(d: Dialect) -> str:
    """By year, with the total over all years (a null subperiod) from the same pass."""
    return f"SELECT factor_id, horizon, subperiod, {_SUMMARY} FROM (SELECT *, year(session) AS subperiod FROM ({DAILY}) AS daily) AS x GROUP BY GROUPING SETS ((factor_id, horizon, subperiod), (factor_id, horizon))"


@operator("h5_card", OBS, by_section=True)
def card(d: Dialect) -> str:
    """One long card: every horizon's summary and every subperiod's RankIC."""
    return f"""
SELECT factor_id, horizon, 'all' AS slice, {r6('avg(rank_ic)')} AS mean_rank_ic, count(*) AS days FROM ({DAILY}) AS a GROUP BY factor_id, horizon
UNION ALL SELECT factor_id, horizon, CAST(year(session) AS {'STRING' if d.name == 'spark' else 'VARCHAR'}), {r6('avg(rank_ic)')}, count(*) FROM ({DAILY}) AS b GROUP BY factor_id, horizon, year(session)"""


def redundancy_text(d: Dialect) -> str:
    """Mean daily rank correlation of every pair of factors."""
    pairs = f"""
SELECT {d.deal('fa, fb, horizon, session')}a.factor_id AS fa, b.factor_id AS fb, a.horizon AS horizon, a.session AS session, a.instrument AS instrument, a.v AS va, b.v AS vb
FROM {{obs}} AS a JOIN {{obs}} AS b ON a.horizon = b.horizon AND a.session = b.session AND a.instrument = b.instrument AND a.factor_id < b.factor_id"""
    return f"""
SELECT fa, fb, horizon, avg(rho) AS rho, count(*) AS days FROM (
  SELECT fa, fb, horizon, session, corr(ra, rb) AS rho FROM (SELECT *, {avg_rank('va', 'fa, fb, horizon, session')} AS ra, {avg_rank('vb', 'fa, fb, horizon, session')} AS rb FROM ({pairs}) AS p) AS q
  GROUP BY fa, fb, horizon, session HAVING count(*) >= 3 AND min(va) < max(va) AND min(vb) < max(vb)) AS x GROUP BY fa, fb, horizon"""


@operator("h6_redundancy", OBS)
def redundancy(d: Dialect, limit: float = 0.7) -> str:
    """Mean daily rank correlation of every pair of factors, high ones flagged."""
    return f"SELECT fa, fb, horizon, {r6('rho')} AS rho, days, abs(rho) > {limit} AS redundant FROM ({redundancy_text(d)}) AS r"


@operator("h7_quantile_shape", OBS)
def quantile_shape(d: Dialect, q: int = 5) -> str:
    return f"""
WITH daily AS (SELECT factor_id, horizon, session, bucket, avg(fwd) AS ret FROM (SELECT *, {bucket_text(q)} AS bucket FROM {{obs}}) AS a GROUP BY factor_id, horizon, session, bucket),
means AS (SELECT factor_id, horizon, bucket, avg(ret) AS ret FROM daily GROUP BY factor_id, horizon, bucket),
ranked AS (SELECT *, {avg_rank('ret', 'factor_id, horizon')} AS rr FROM means)
SELECT factor_id, horizon, {r6('corr(bucket, rr)')} AS monotonicity, {r6(f'max(CASE WHEN bucket = {q} THEN ret END)')} AS top, {r6('max(CASE WHEN bucket = 1 THEN ret END)')} AS bottom, {r6(f'max(CASE WHEN bucket = {q} THEN ret END) - max(CASE WHEN bucket = 1 THEN ret END)')} AS spread
FROM ranked GROUP BY factor_id, horizon"""


@operator("h7_tail_share", OBS)
def tail_share(d: Dialect) -> str:
    """Share of the absolute spread that comes from the tenth of sessions with the largest one."""
    return f"""
WITH daily AS (SELECT factor_id, horizon, session, avg(CASE WHEN b = 5 THEN fwd END) - avg(CASE WHEN b = 1 THEN fwd END) AS spread FROM (SELECT *, {bucket_text(5)} AS b FROM {{obs}}) AS a GROUP BY factor_id, horizon, session),
k AS (SELECT *, row_number() OVER (PARTITION BY factor_id, horizon ORDER BY abs(spread) DESC, session) AS i, count(*) OVER (PARTITION BY factor_id, horizon) AS n FROM daily WHERE spread IS NOT NULL)
SELECT factor_id, horizon, {r6('sum(CASE WHEN i <= greatest(1, ceil(n * 0.1e0)) THEN abs(spread) ELSE 0 END) / nullif(sum(abs(spread)), 0)')} AS tail_share FROM k GROUP BY factor_id, horizon"""


@operator("h8_attribution", OBS, by_section=True)
def attribution(d: Dialect) -> str:
    """RankIC before and after taking out log size, with failure labels."""
    resid = f"v - avg(v) OVER (PARTITION BY {XS}) - coalesce(covar_pop(v, ln(cap)) OVER (PARTITION BY {XS}) / nullif(var_pop(ln(cap)) OVER (PARTITION BY {XS}), 0), 0) * (ln(cap) - avg(ln(cap)) OVER (PARTITION BY {XS}))"
    return f"""
WITH r AS (SELECT *, round({resid}, 12) AS e FROM {{obs}}),
k AS (SELECT *, {avg_rank('v')} AS rv, {avg_rank('e')} AS re, {avg_rank('fwd')} AS rf FROM r),
daily AS (SELECT factor_id, horizon, session, corr(rv, rf) AS raw, corr(re, rf) AS rest FROM k GROUP BY factor_id, horizon, session HAVING count(*) >= 3 AND min(v) < max(v) AND min(fwd) < max(fwd))
SELECT factor_id, horizon, {r6('avg(raw)')} AS raw_rank_ic, {r6('avg(rest)')} AS residual_rank_ic, CASE WHEN avg(raw) <= 0 THEN 'no_raw_signal' WHEN avg(rest) <= 0 THEN 'explained_by_size' WHEN avg(rest) < 0.5 * avg(raw) THEN 'weakened_by_size' ELSE 'kept' END AS label FROM daily GROUP BY factor_id, horizon"""


@operator("h9_daily_spread", OBS)
def daily_spread(d: Dialect) -> str:
    return f"""
SELECT {XS}, {r6('top - bottom')} AS spread, {r6('top - everyone')} AS top_excess FROM (
  SELECT {XS}, avg(CASE WHEN k > n - q THEN fwd END) AS top, avg(CASE WHEN k <= q THEN fwd END) AS bottom, avg(fwd) AS everyone FROM (
    SELECT *, {ordinal('v')} AS k, {size()} AS n, greatest(1, floor({size()} / 5e0)) AS q FROM {{obs}}) AS a GROUP BY {XS}) AS b"""


@operator("h9_year_score", OBS)
def year_score(d: Dialect) -> str:
    return f"SELECT factor_id, year(session) AS subperiod, count(*) AS days, {r6('avg(ret)')} AS mean_excess, {r6('avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12)')} AS sharpe FROM ({RETURNS}) AS r GROUP BY factor_id, year(session)"


@operator("h10_year_stability", OBS, by_section=True)
def year_stability(d: Dialect) -> str:
    """Share of years with a positive mean RankIC, and change of unit rank on full cross-sections."""
    return f"""
WITH years AS (SELECT factor_id, horizon, avg(rank_ic) AS ic FROM ({DAILY}) AS a GROUP BY factor_id, horizon, year(session)),
y AS (SELECT factor_id, horizon, avg(CASE WHEN ic > 0 THEN 1e0 ELSE 0e0 END) AS positive FROM years GROUP BY factor_id, horizon),
{_DAYS}, u AS (SELECT o.factor_id, o.horizon, o.instrument, t.i, {unit(avg_rank('v', 'o.factor_id, o.horizon, o.session'), size('o.factor_id, o.horizon, o.session'))} AS u FROM {{obs}} AS o JOIN days AS t ON t.factor_id = o.factor_id AND t.horizon = o.horizon AND t.session = o.session),
t AS (SELECT a.factor_id, a.horizon, avg(abs(a.u - b.u)) AS turnover FROM u AS a JOIN u AS b ON a.factor_id = b.factor_id AND a.horizon = b.horizon AND a.instrument = b.instrument AND a.i = b.i + 1 GROUP BY a.factor_id, a.horizon)
SELECT y.factor_id, y.horizon, {r6('positive')} AS positive_years, {r6('turnover')} AS turnover FROM y JOIN t ON y.factor_id = t.factor_id AND y.horizon = t.horizon"""


@operator("h11_decay_alarm", OBS, by_section=True)
def decay_alarm(d: Dialect) -> str:
    return f"""
SELECT factor_id, horizon, {r6('max(CASE WHEN k = 1 THEN ic END)')} AS last_quarter, {r6('max(CASE WHEN k = 2 THEN ic END)')} AS quarter_before, max(CASE WHEN k <= 2 THEN ic END) < 0 AS alarm FROM (
  SELECT *, row_number() OVER (PARTITION BY factor_id, horizon ORDER BY q DESC) AS k FROM (SELECT factor_id, horizon, date_trunc('quarter', session) AS q, avg(rank_ic) AS ic FROM ({DAILY}) AS a GROUP BY factor_id, horizon, date_trunc('quarter', session)) AS b) AS c GROUP BY factor_id, horizon"""


@operator("h12_diagnostics", OBS)
def diagnostics(d: Dialect) -> str:
    """Coverage, pooled and size-free IC, stale share, concentration by group and session, style
    correlations, and what turnover leaves of the spread; one aggregation after one window."""
    return f"""
WITH x AS (SELECT *, ln(cap) AS lc, ln(adv) AS la, CASE WHEN v = lag(v, 1) OVER (PARTITION BY factor_id, horizon, instrument ORDER BY session) THEN 1e0 ELSE 0e0 END AS stale FROM {{obs}}),
g AS (SELECT factor_id, horizon, max(share) AS top_group FROM (SELECT factor_id, horizon, grp, count(*) / CAST(sum(count(*)) OVER (PARTITION BY factor_id, horizon) AS DOUBLE) AS share FROM {{obs}} GROUP BY factor_id, horizon, grp) AS s GROUP BY factor_id, horizon),
t AS (SELECT factor_id, horizon, max(share) AS top_session FROM (SELECT factor_id, horizon, session, count(*) / CAST(sum(count(*)) OVER (PARTITION BY factor_id, horizon) AS DOUBLE) AS share FROM {{obs}} GROUP BY factor_id, horizon, session) AS s GROUP BY factor_id, horizon),
c AS (SELECT factor_id, horizon, count(*) AS cells, {d.distinct('session')} AS sessions, {d.distinct('instrument')} AS instruments, corr(v, fwd) AS vf, corr(v, lc) AS vc, corr(fwd, lc) AS fc, corr(v, la) AS va, avg(stale) AS stale FROM x GROUP BY factor_id, horizon)
SELECT c.factor_id, c.horizon, cells, sessions, instruments, {r6('cells / CAST(sessions * instruments AS DOUBLE)')} AS coverage, {r6('vf')} AS pooled_ic, {r6('(vf - vc * fc) / nullif(sqrt((1 - vc * vc) * (1 - fc * fc)), 0)')} AS residual_ic, {r6('stale')} AS stale_share, {r6('top_group')} AS top_group, {r6('top_session')} AS top_session, {r6('vc')} AS size_correlation, {r6('va')} AS liquidity_correlation
FROM c JOIN g ON g.factor_id = c.factor_id AND g.horizon = c.horizon JOIN t ON t.factor_id = c.factor_id AND t.horizon = c.horizon"""


@operator("h12_diagnostic_codes", OBS, by_section=True)
def diagnostic_codes(d: Dialect, coverage: float = 0.8, stale: float = 0.05, turnover: float = 0.35, date_share: float = 0.1, regime_share: float = 0.8, cost_bps: float = 10.0) -> str:
    """What speaks against a factor before it is tested at length, with the figures behind it.

    Quintiles are pooled over sessions with five names or more; turnover is the mean change of a name's
    unit rank to the next session it shares; shares are those of the largest session in the absolute
    spread and of the larger regime (rising or falling sessions) in the absolute sum of v * fwd.
    """
    part = "factor_id, horizon"
    code = lambda test, name: f"CASE WHEN {test} THEN '{name}' END"
    codes = ", ".join([
        code(f"coverage < {coverage}e0", "LOW_COVERAGE"), code(f"stale > {stale}e0", "STALE_SIGNAL"), code("q5 <= q1", "FLAT_QUANTILES"), code(f"turnover > {turnover}e0", "EXCESS_TURNOVER"),
        code(f"date_share > {date_share}e0", "DATE_CONCENTRATION"), code(f"regime_share > {regime_share}e0", "REGIME_CONCENTRATION"), code(f"q5 - q1 - turnover * {cost_bps / 1e4}e0 <= 0", "COST_ERASED"),
    ])
    last = f"OVER (PARTITION BY {part}, instrument ORDER BY session)"
    placed = f"SELECT *, dense_rank() OVER (PARTITION BY {part} ORDER BY session) AS place FROM x"
    if d.name == "spark":  # from the few sessions, so that no task sorts all rows of a factor
        placed = f"SELECT /*+ BROADCAST(c) */ x.*, c.place FROM x JOIN (SELECT {XS}, row_number() OVER (PARTITION BY {part} ORDER BY session) AS place FROM (SELECT DISTINCT {XS} FROM {{obs}}) AS b) AS c USING ({XS})"
    return f"""
WITH x AS (
  SELECT *, {ordinal('v')} AS k, {size()} AS n, {unit(avg_rank('v'), size())} AS u, avg(fwd) OVER (PARTITION BY {XS}) AS market FROM {{obs}}),
m AS (
  SELECT *, lag(v, 1) {last} AS v_before, lag(u, 1) {last} AS u_before, lag(place, 1) {last} AS place_before FROM ({placed}) AS y),
g AS (
  SELECT {part}, count(*) / CAST({d.distinct('session')} * {d.distinct('instrument')} AS DOUBLE) AS coverage, avg(CASE WHEN v = v_before THEN 1e0 ELSE 0e0 END) AS stale,
    {', '.join(f'avg(CASE WHEN n >= 5 AND floor((k - 1) * 5 / CAST(n AS DOUBLE)) = {q} THEN fwd END) AS q{q + 1}' for q in range(5))},
    coalesce(avg(CASE WHEN place_before = place - 1 THEN abs(u - u_before) END), 0) AS turnover, sum(CASE WHEN market >= 0 THEN fwd * v END) AS up, sum(CASE WHEN market < 0 THEN fwd * v END) AS down FROM m GROUP BY {part}),
s AS (
  SELECT {part}, max(abs(spread)) / nullif(sum(abs(spread)), 0) AS date_share FROM (
    SELECT {XS}, avg(CASE WHEN k > n - greatest(1, floor(n / 5e0)) THEN fwd END) - avg(CASE WHEN k <= greatest(1, floor(n / 5e0)) THEN fwd END) AS spread FROM x WHERE n >= 5 GROUP BY {XS}) AS d GROUP BY {part}),
f AS (
  SELECT g.*, coalesce(s.date_share, 1) AS date_share, coalesce(greatest(abs(coalesce(up, 0)), abs(coalesce(down, 0))) / nullif(abs(coalesce(up, 0)) + abs(coalesce(down, 0)), 0), 1) AS regime_share
  FROM g JOIN s ON s.factor_id = g.factor_id AND s.horizon = g.horizon)
SELECT {part}, {', '.join(f'{r6(c)} AS {c}' for c in ('coverage', 'stale', 'q1', 'q2', 'q3', 'q4', 'q5', 'turnover', 'date_share', 'regime_share'))}, {r6(f'q5 - q1 - turnover * {cost_bps / 1e4}e0')} AS net_spread,
  CASE WHEN concat_ws('+', {codes}) = '' THEN 'PASS' ELSE concat_ws('+', {codes}) END AS codes FROM f"""


def cells_text(d: Dialect) -> str:
    """Every observation in the regime of its session."""
    regime = f"CASE WHEN avg(fwd) OVER (PARTITION BY {XS}) >= 0 THEN 'up' ELSE 'down' END"
    return f"SELECT factor_id, horizon, session, v, fwd, {regime} AS regime FROM {{obs}}"


#: What ranks are pooled over.
_POOL = ["factor_id", "horizon", "regime"]


def _pooled(cells: DataFrame) -> DataFrame:
    return order.ranked(order.ranked(cells, _POOL, {"v": ["v"], "both": ["v", "fwd"]}), _POOL, {"fwd": ["fwd"]}, cells)


def pooled_text(d: Dialect) -> str:
    """The same places by plain windows."""
    part = ", ".join(_POOL)
    places = [
        f"rank() OVER (PARTITION BY {part} ORDER BY {x}) - 1 AS {name}_before, count(*) OVER (PARTITION BY {part}, {x}) AS {name}_ties"
        for x, name in (("v", "v"), ("fwd", "fwd"), ("v, fwd", "both"))
    ]
    return f"SELECT *, {', '.join(places)} FROM {{cells}} AS c"


@operator("h13_regime_evidence", OBS, {"cells": cells_text, "pooled": Stage(lambda d: "SELECT * FROM {cells}", _pooled, pooled_text, stored=False)})
def regime_evidence(d: Dialect, least_cells: int = 10) -> str:
    """Pooled RankIC and excess of the top fifth in sessions that the market rose and fell in.

    A regime with fewer than least_cells observations is left out, and one of constant signals has no
    RankIC; it counts as positive if both figures are. Ranks are exact and never gather a regime in one
    task; the top fifth is taken by signal, then by return.
    """
    rank = lambda x: f"{x}_before + ({x}_ties + 1) / 2e0"
    chosen = "greatest(0, least(both_ties, both_before + both_ties - n + greatest(1, floor(n / 5e0)))) / CAST(both_ties AS DOUBLE)"
    return f"""
WITH sized AS (
  SELECT p.*, s.n, s.mid FROM {{pooled}} AS p
  JOIN (SELECT factor_id, horizon, regime, count(*) AS n, avg(fwd) AS mid FROM {{cells}} GROUP BY factor_id, horizon, regime) AS s
    ON s.factor_id = p.factor_id AND s.horizon = p.horizon AND s.regime = p.regime),
e AS (
  SELECT factor_id, horizon, regime, count(*) AS cells, count(DISTINCT session) AS sessions,
    CASE WHEN min(v) < max(v) AND min(fwd) < max(fwd) THEN corr({rank('v')}, {rank('fwd')}) END AS rank_ic, sum(fwd * {chosen}) / sum({chosen}) - max(mid) AS top_excess
  FROM sized GROUP BY factor_id, horizon, regime HAVING count(*) >= {least_cells})
SELECT factor_id, horizon, regime, cells, sessions, {r6('rank_ic')} AS rank_ic, {r6('top_excess')} AS top_excess, coalesce(rank_ic > 0 AND top_excess > 0, FALSE) AS positive,
  {r6("avg(CASE WHEN rank_ic > 0 AND top_excess > 0 THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY factor_id, horizon)")} AS positive_share
FROM e"""


@operator("h14_objective", OBS)
def objective(d: Dialect, lookback: str = "CASE factor_id WHEN 'rev5' THEN 5e0 ELSE 1e0 END", family: str = "CASE factor_id WHEN 'rev5' THEN 'price' ELSE 'bar' END") -> str:
    """Weighted sum of seven percentile scores: RankIC, top excess, monotonicity, share of positive
    regimes and novelty of the family for it, concentration on few sessions and complexity against it."""
    score = lambda x: f"((dense_rank() OVER (PARTITION BY horizon ORDER BY {x}) - 1) / CAST(greatest({d.levels(x)} - 1, 1) AS DOUBLE))"
    weights = {"ic": 0.25, "top": 0.25, "mono": 0.15, "regime": 0.15, "novelty": 0.1, "concentration": -0.05, "complexity": -0.05}
    total = " + ".join(f"({w}e0) * {score(x)}" for x, w in weights.items())
    return f"""
WITH b AS (SELECT *, {bucket_text(5)} AS q FROM {{obs}}),
day AS (SELECT factor_id, horizon, session, avg(CASE WHEN q = 5 THEN fwd END) AS top, avg(fwd) AS everyone, avg(CASE WHEN q = 5 THEN fwd END) - avg(CASE WHEN q = 1 THEN fwd END) AS spread FROM b GROUP BY factor_id, horizon, session),
placed AS (SELECT *, row_number() OVER (PARTITION BY factor_id, horizon ORDER BY abs(spread) DESC, session) AS i, count(*) OVER (PARTITION BY factor_id, horizon) AS n FROM day),
shape AS (SELECT factor_id, horizon, avg(top - everyone) AS top, sum(CASE WHEN i <= greatest(1, ceil(n * 0.1e0)) THEN abs(spread) ELSE 0 END) / nullif(sum(abs(spread)), 0) AS concentration FROM placed GROUP BY factor_id, horizon),
means AS (SELECT factor_id, horizon, q, avg(ret) AS ret FROM (SELECT factor_id, horizon, session, q, avg(fwd) AS ret FROM b GROUP BY factor_id, horizon, session, q) AS x GROUP BY factor_id, horizon, q),
mono AS (SELECT factor_id, horizon, corr(q, r) AS mono FROM (SELECT *, {avg_rank('ret', 'factor_id, horizon')} AS r FROM means) AS y GROUP BY factor_id, horizon),
ics AS (SELECT a.factor_id, a.horizon, a.rank_ic, CASE WHEN day.everyone >= 0 THEN 'up' ELSE 'down' END AS regime FROM ({DAILY}) AS a JOIN day ON day.factor_id = a.factor_id AND day.horizon = a.horizon AND day.session = a.session),
reg AS (SELECT factor_id, horizon, sum(s) / sum(n) AS ic, avg(CASE WHEN s > 0 THEN 1e0 ELSE 0e0 END) AS regime FROM (SELECT factor_id, horizon, regime, sum(rank_ic) AS s, CAST(count(*) AS DOUBLE) AS n FROM ics GROUP BY factor_id, horizon, regime) AS z GROUP BY factor_id, horizon),
t AS (SELECT shape.factor_id, shape.horizon, round(ic, 9) AS ic, round(top, 9) AS top, round(mono, 9) AS mono, regime, round(concentration, 9) AS concentration, round(ln(1 + {lookback.replace('factor_id', 'shape.factor_id')}), 9) AS complexity, round(1e0 / count(*) OVER (PARTITION BY shape.horizon, {family.replace('factor_id', 'shape.factor_id')}), 9) AS novelty
  FROM shape JOIN mono ON mono.factor_id = shape.factor_id AND mono.horizon = shape.horizon JOIN reg ON reg.factor_id = shape.factor_id AND reg.horizon = shape.horizon)
SELECT factor_id, horizon, {r6(total)} AS objective FROM t"""


@operator("h15_moments", OBS)
def moments(d: Dialect) -> str:
    """Population skewness and excess kurtosis, and the bias-corrected sample versions."""
    return f"""
SELECT factor_id, n, {r6('skew')} AS skew, {r6('kurt')} AS excess_kurtosis, {r6('skew * sqrt(n * (n - 1e0)) / (n - 2)')} AS sample_skew, {r6('((n + 1e0) * kurt + 6) * (n - 1) / ((n - 2e0) * (n - 3))')} AS sample_kurtosis FROM (
  SELECT factor_id, count(*) AS n, avg(power(ret - mu, 3)) / power(avg(power(ret - mu, 2)), 1.5e0) AS skew, avg(power(ret - mu, 4)) / power(avg(power(ret - mu, 2)), 2) - 3 AS kurt
  FROM (SELECT *, avg(ret) OVER (PARTITION BY factor_id) AS mu FROM ({RETURNS}) AS r) AS a GROUP BY factor_id HAVING count(*) > 3) AS b"""


@operator("h16_performance", OBS)
def returns_performance(d: Dialect) -> str:
    return performance(RETURNS)


@operator("h17_tail_loss", OBS)
def tail_loss(d: Dialect) -> str:
    """Mean of the worst twentieth of returns, and the return at that place."""
    return f"""
SELECT factor_id, {r6('avg(CASE WHEN k <= c THEN ret END)')} AS mean_tail, {r6('max(CASE WHEN k = c THEN ret END)')} AS value_at_risk FROM (
  SELECT *, row_number() OVER (PARTITION BY factor_id ORDER BY ret, session) AS k, ceil(count(*) OVER (PARTITION BY factor_id) * 0.05e0) AS c FROM ({RETURNS}) AS r) AS a GROUP BY factor_id"""


@operator("h18_temporal", OBS)
def temporal(d: Dialect, k: int = 12) -> str:
    """Summaries of every rolling window of k returns, then the worst of them."""
    return f"""
WITH s AS (SELECT factor_id, session, ret, row_number() OVER (PARTITION BY factor_id ORDER BY session) AS i FROM ({RETURNS}) AS r),
w AS (SELECT a.factor_id, a.i AS window_end, sum(b.ret) AS total, avg(b.ret) / nullif(stddev_samp(b.ret), 0) AS sharpe, count(*) AS n FROM s AS a JOIN s AS b ON a.factor_id = b.factor_id AND b.i BETWEEN a.i - {k - 1} AND a.i GROUP BY a.factor_id, a.i)
SELECT factor_id, count(*) AS windows, {r6('min(total)')} AS worst_total, {r6('min(sharpe)')} AS worst_sharpe, {r6('avg(CASE WHEN total > 0 THEN 1e0 ELSE 0e0 END)')} AS positive_windows FROM w WHERE n = {k} GROUP BY factor_id"""


def segments_text(c: int) -> str:
    return f"SELECT *, CAST(floor((i * {c} - 1) / CAST(n AS DOUBLE)) AS BIGINT) AS segment FROM (SELECT *, row_number() OVER (PARTITION BY factor_id ORDER BY session) AS i, count(*) OVER (PARTITION BY factor_id) AS n FROM ({RETURNS}) AS r) AS a"


@operator("h19_subwindows", OBS)
def subwindows(d: Dialect, c: int = 4) -> str:
    """Performance in c equal chronological segments."""
    return performance(f"SELECT factor_id, segment, session, ret FROM ({segments_text(c)}) AS s", "factor_id, segment")


def _top_text(breadths: tuple, d: Dialect) -> str:
    """Excess return of the best b names of every cross-section with more names than that."""
    return f"SELECT concat(factor_id, ':', horizon) AS factor_id, b, session, avg(CASE WHEN k <= b THEN fwd END) - avg(fwd) AS ret FROM (SELECT *, {ordinal('v', desc=True)} AS k, {size()} AS n FROM {{obs}}) AS o {d.explode(d.array(list(breadths)), 'b')} WHERE n > b GROUP BY factor_id, horizon, b, session"


@operator("h20_stability", OBS)
def stability(d: Dialect, c: int = 4, breadths: tuple = (5, 10, 20), robust: float = 0.6) -> str:
    """Sharpe by chronological segment and breadth: median, worst, share of segments with a gain, share
    of the neighbouring breadths that hold up, and the reasons against the candidate."""
    return f"""
WITH s AS (SELECT factor_id, b, ret, CAST(floor((i * {c} - 1) / CAST(n AS DOUBLE)) AS BIGINT) AS segment FROM (SELECT *, row_number() OVER (PARTITION BY factor_id, b ORDER BY session) AS i, count(*) OVER (PARTITION BY factor_id, b) AS n FROM ({_top_text(breadths, d)}) AS r) AS a),
g AS (SELECT factor_id, b, segment, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) AS sharpe, sum(ret) AS total FROM s GROUP BY factor_id, b, segment),
m AS (SELECT factor_id, b, {d.percentile('sharpe', 0.5)} AS median_sharpe, min(sharpe) AS worst_sharpe, avg(CASE WHEN total > 0 THEN 1e0 ELSE 0e0 END) AS positive_share FROM g GROUP BY factor_id, b),
e AS (SELECT *, avg(CASE WHEN worst_sharpe > 0 AND positive_share >= {robust}e0 THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY factor_id) AS neighbours FROM m)
SELECT factor_id, CAST(b AS BIGINT) AS breadth, {r6('median_sharpe')} AS median_sharpe, {r6('worst_sharpe')} AS worst_sharpe, positive_share, {r6('neighbours')} AS breadth_robustness,
  concat_ws('+', CASE WHEN positive_share < {robust}e0 THEN 'subwindow_sign_instability' END, CASE WHEN coalesce(worst_sharpe, -1) <= 0 THEN 'negative_worst_subwindow' END, CASE WHEN neighbours < {robust}e0 THEN 'breadth_fragility' END) AS reasons FROM e"""


@operator("h20_regime_increment", OBS | {"regimes": "regimes"})
def regime_increment(d: Dialect, c: int = 4, breadths: tuple = (5, 10, 20), required: float = 0.0, penalty: float = 0.05) -> str:
    """What trading a candidate in one regime only adds to trading it always.

    Outside of its regime a candidate is flat. The objective is the median Sharpe of chronological
    segments, less a penalty for the condition; the condition is proven if that gains more than required
    and the worst segment gets better.
    """
    part = "factor_id, b, regime"
    return f"""
WITH top AS ({_top_text(breadths, d)}), st AS ({states_text()}),
r AS (
  SELECT factor_id, b, session, 'all' AS regime, ret FROM top
  UNION ALL SELECT top.factor_id, top.b, top.session, g.regime, CASE WHEN st.regime = g.regime THEN ret ELSE 0e0 END FROM top CROSS JOIN (SELECT DISTINCT regime FROM {{regimes}}) AS g LEFT JOIN st ON st.session = top.session),
s AS (SELECT {part}, ret, CAST(floor((i * {c} - 1) / CAST(n AS DOUBLE)) AS BIGINT) AS segment FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY session) AS i, count(*) OVER (PARTITION BY {part}) AS n FROM r) AS a),
m AS (
  SELECT {part}, {d.percentile('sharpe', 0.5)} AS objective, min(sharpe) AS worst FROM (
    SELECT {part}, segment, coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252), 0) AS sharpe FROM s GROUP BY {part}, segment) AS g GROUP BY {part})
SELECT m.factor_id, CAST(m.b AS BIGINT) AS breadth, m.regime, {r6('m.objective - ' + str(penalty) + 'e0')} AS objective, {r6('m.objective - u.objective')} AS increment, {r6('m.worst')} AS worst_sharpe,
  CASE WHEN m.objective - u.objective < {required}e0 OR m.worst <= u.worst THEN 'regime_increment_not_proven' ELSE '' END AS reasons
FROM m JOIN m AS u ON u.factor_id = m.factor_id AND u.b = m.b AND u.regime = 'all' WHERE m.regime <> 'all'"""


_INDEX = "SELECT session, sx, level, level / lag(level, 1) OVER (ORDER BY sx) - 1 AS bench FROM (SELECT session, sx, avg(close) AS level FROM {bars} GROUP BY session, sx) AS i"


@operator("h21_vs_benchmark", {"obs": "obs2", "bars": "p2"})
def vs_benchmark(d: Dialect) -> str:
    return f"""
SELECT factor_id, count(*) AS periods, {r6('avg(ret - bench)')} AS mean_excess, {r6('stddev_samp(ret - bench)')} AS tracking_error, {r6('avg(ret - bench) / nullif(stddev_samp(ret - bench), 0) * sqrt(52)')} AS information_ratio, {r6('avg(bench) / nullif(stddev_samp(bench), 0) * sqrt(52)')} AS benchmark_sharpe
FROM ({RETURNS}) AS r JOIN ({_INDEX}) AS b USING (session) WHERE bench IS NOT NULL GROUP BY factor_id"""


@operator("h24_trial_report", {"ev": "ev"})
def trial_report(d: Dialect) -> str:
    """Trials by family: counts by status, the best accepted one, spread of scores."""
    return f"SELECT event_type AS family, count(*) AS trials, CAST(sum(CASE WHEN value > 0 THEN 1 ELSE 0 END) AS BIGINT) AS accepted, max_by(event_id, {d.pair('value', '-event_id')}) AS best_trial, {r6('stddev_samp(value)')} AS score_spread, {r6('max(value)')} AS best_score FROM {{ev}} GROUP BY event_type"


@operator("h25_failure_patterns", {"ev": "ev"})
def failure_patterns(d: Dialect) -> str:
    code = "CASE WHEN value < 1 THEN 'weak' WHEN value < 20 THEN 'unstable' ELSE 'passed' END"
    return f"""
SELECT event_type AS family, code, count(*) AS occurrences, count(DISTINCT user_id) AS candidates, max(event_id) AS latest, CASE WHEN code = 'passed' THEN 'keep' WHEN count(*) >= 100 THEN 'retire_family' ELSE 'mutate' END AS action
FROM (SELECT *, {code} AS code FROM {{ev}}) AS e GROUP BY event_type, code"""


@operator("h27_adv_slices", OBS, by_section=True)
def adv_slices(d: Dialect) -> str:
    """Mean RankIC in thirds of average daily value."""
    part = f"{XS}, slice"
    return f"""
SELECT factor_id, horizon, slice, count(*) AS days, {r6('avg(ric)')} AS mean_rank_ic FROM (
  SELECT factor_id, horizon, session, slice, corr(rv, rf) AS ric FROM (SELECT *, {avg_rank('v', part)} AS rv, {avg_rank('fwd', part)} AS rf FROM (SELECT *, {bucket_text(3, 'adv')} AS slice FROM {{obs}}) AS a) AS b
  GROUP BY factor_id, horizon, session, slice HAVING count(*) >= 3 AND min(v) < max(v) AND min(fwd) < max(fwd)) AS c GROUP BY factor_id, horizon, slice"""
