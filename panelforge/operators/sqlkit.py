"""Short pieces of SQL that the cross-sectional operators share."""

from __future__ import annotations

#: A cross-section: one factor and horizon on one session.
XS = "factor_id, horizon, session"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def avg_rank(x: str, part: str = XS) -> str:
    """Rank with ties sharing the mean of their places."""
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2e0)"


def ordinal(x: str, part: str = XS, desc: bool = False) -> str:
    return f"row_number() OVER (PARTITION BY {part} ORDER BY {x}{' DESC' if desc else ''}, instrument)"


def size(part: str = XS) -> str:
    return f"count(*) OVER (PARTITION BY {part})"


def unit(rank: str, n: str) -> str:
    return f"(({rank} - 1) / CAST(greatest({n} - 1, 1) AS DOUBLE))"


#: Daily IC and RankIC of cross-sections with enough names and spread.
DAILY = f"""
SELECT factor_id, horizon, session, corr(v, fwd) AS ic, corr(rv, rf) AS rank_ic, count(*) AS names FROM (
  SELECT *, {avg_rank('v')} AS rv, {avg_rank('fwd')} AS rf FROM {{obs}}) AS ranked
GROUP BY factor_id, horizon, session HAVING count(*) >= 3 AND min(v) < max(v) AND min(fwd) < max(fwd)"""

#: Top-quintile return over the cross-section's mean, by session; a factor at a horizon is a candidate
#: of its own, named factor:horizon.
RETURNS = f"""
SELECT concat(factor_id, ':', horizon) AS factor_id, session, avg(CASE WHEN k <= greatest(1, floor(n / 5e0)) THEN fwd END) - avg(fwd) AS ret, count(*) AS names FROM (
  SELECT *, {ordinal('v', desc=True)} AS k, {size()} AS n FROM {{obs}}) AS ordered
GROUP BY factor_id, horizon, session HAVING count(*) >= 5"""


def series(returns: str, part: str = "factor_id") -> str:
    """returns with a session number i of n and the running wealth."""
    return f"SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY session) AS i, count(*) OVER (PARTITION BY {part}) AS n, exp(sum(ln(1 + greatest(ret, -0.99e0))) OVER (PARTITION BY {part} ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS wealth FROM ({returns}) AS returns"


def states_text() -> str:
    """The regime of every session of {obs}: that of the interval between two changes of state it lies in.

    {regimes} has (session, regime), each known by its session; sessions without a row carry the state on.
    """
    return """
SELECT s.session, i.regime FROM (SELECT DISTINCT session FROM {obs}) AS s
JOIN (
  SELECT since, regime, lead(since, 1) OVER (ORDER BY since) AS until FROM (
    SELECT session AS since, regime, lag(regime, 1) OVER (ORDER BY session) AS regime_before FROM {regimes}) AS r WHERE regime_before IS NULL OR regime_before <> regime) AS i
  ON s.session >= i.since AND (i.until IS NULL OR s.session < i.until)"""


#: Compounding floors a period's loss at 99 %: excess returns can fall below -1.
GROWTH = "ln(1 + greatest(ret, -0.99e0))"


def performance(returns: str, part: str = "factor_id") -> str:
    """Log and annualised return, Sharpe and drawdown by part (part columns come first)."""
    return f"""
SELECT {part}, count(*) AS periods, {r6(f'sum({GROWTH})')} AS log_return, {r6(f'exp(sum({GROWTH}) * 12 / count(*)) - 1')} AS annualised,
  {r6('avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12)')} AS sharpe, {r6('min(wealth / peak - 1)')} AS max_drawdown
FROM (SELECT *, greatest(1, max(wealth) OVER (PARTITION BY {part} ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak FROM ({series(returns, part)}) AS walked) AS peaked
GROUP BY {part}"""
