"""Cross-sectional operators: ranks, normalisation, residuals, ensembles, buckets."""

from __future__ import annotations

from panelforge.operators.base import Dialect, operator
from panelforge.operators.sqlkit import DAILY, XS, avg_rank, ordinal, r6, size, unit

KEYS = "factor_id, horizon, session, instrument"
OBS = {"obs": "obs"}


@operator("f1_avg_rank", OBS)
def average_rank(d: Dialect) -> str:
    return f"SELECT {KEYS}, {avg_rank('v')} AS value FROM {{obs}}"


@operator("f2_pearson", OBS)
def pearson(d: Dialect) -> str:
    return f"SELECT {XS}, {r6('corr(v, fwd)')} AS value FROM {{obs}} GROUP BY {XS} HAVING count(*) >= 3 AND min(v) < max(v) AND min(fwd) < max(fwd)"


@operator("f3_spearman", OBS, by_section=True)
def spearman(d: Dialect) -> str:
    return f"SELECT {XS}, {r6('rank_ic')} AS value FROM ({DAILY}) AS daily"


@operator("f4_unit_rank", OBS)
def unit_rank(d: Dialect) -> str:
    return f"SELECT {KEYS}, {r6(unit(avg_rank('v'), size()))} AS value FROM {{obs}}"


@operator("f5_normalise", OBS)
def normalise(d: Dialect, frac: float = 0.05) -> str:
    """Winsorised by interpolated quantiles, less the group mean, over the root mean square."""
    low, high = (f"{d.percentile('v', p)} OVER (PARTITION BY {XS})" for p in (frac, 1 - frac))
    return f"""
SELECT {KEYS}, {r6('CASE WHEN n < 3 THEN v WHEN scale = 0 THEN 0 ELSE centred / scale END')} AS value FROM (
  SELECT *, sqrt(avg(centred * centred) OVER (PARTITION BY {XS})) AS scale FROM (
    SELECT *, w - avg(w) OVER (PARTITION BY {XS}, grp) AS centred FROM (
      SELECT *, least(greatest(v, {low}), {high}) AS w, {size()} AS n FROM {{obs}}) AS a) AS b) AS c"""


def winsor_z_text(frame: str, part: str = XS) -> str:
    """v clipped at its 5 % and 95 % places (by index) and standardised, as column z."""
    return f"""
SELECT *, CASE WHEN sd > 0 THEN (w - mu) / sd ELSE 0 END AS z FROM (
  SELECT *, avg(w) OVER (PARTITION BY {part}) AS mu, stddev_samp(w) OVER (PARTITION BY {part}) AS sd FROM (
    SELECT *, least(greatest(v, max(CASE WHEN k = lo THEN v END) OVER (PARTITION BY {part})), max(CASE WHEN k = hi THEN v END) OVER (PARTITION BY {part})) AS w FROM (
      SELECT *, greatest(0, CAST(floor(0.05e0 * n) AS BIGINT) - 1) + 1 AS lo, least(n - 1, CAST(floor(0.95e0 * n) AS BIGINT)) + 1 AS hi FROM (
        SELECT *, {ordinal('v', part)} AS k, {size(part)} AS n FROM {frame}) AS a) AS b) AS c) AS e"""


@operator("f6_winsor_z", OBS)
def winsor_z(d: Dialect) -> str:
    return f"SELECT {KEYS}, {r6('z')} AS value FROM ({winsor_z_text('{obs}')}) AS z"


@operator("f7_neutralise", OBS)
def neutralise(d: Dialect, names: int = 3) -> str:
    """Less the mean of the group (of the market if the group is small), then off log size."""
    return f"""
SELECT {KEYS}, {r6('y - (ybar + coalesce(slope, 0) * (x - xbar))')} AS value FROM (
  SELECT *, avg(y) OVER (PARTITION BY {XS}) AS ybar, avg(x) OVER (PARTITION BY {XS}) AS xbar, covar_pop(y, x) OVER (PARTITION BY {XS}) / nullif(var_pop(x) OVER (PARTITION BY {XS}), 0) AS slope FROM (
    SELECT *, ln(cap) AS x, v - CASE WHEN count(*) OVER (PARTITION BY {XS}, grp) >= {names} THEN avg(v) OVER (PARTITION BY {XS}, grp) ELSE avg(v) OVER (PARTITION BY {XS}) END AS y FROM {{obs}}) AS a) AS b"""


@operator("f8_residualise", OBS)
@operator("f8_residualise_3", OBS, controls=("ln(cap)", "ln(adv)", "CAST(grp AS DOUBLE)"))
def residualise(d: Dialect, controls: tuple = ("ln(cap)", "ln(adv)")) -> str:
    """Residual on any number of controls with intercept: each control is freed of those before it, then
    the factor of each of them, which equals least squares on all of them at once."""
    slope = lambda y, x: f"coalesce(covar_pop({y}, {x}) OVER (PARTITION BY {XS}) / nullif(var_pop({x}) OVER (PARTITION BY {XS}), 0), 0)"
    mean = lambda x: f"avg({x}) OVER (PARTITION BY {XS})"
    text = f"SELECT {KEYS}, v AS y, {', '.join(f'{c} AS x{i}' for i, c in enumerate(controls))} FROM {{obs}}"
    for i in range(len(controls)):
        freed = [f"{c} - {mean(c)} - {slope(c, f'x{i}')} * (x{i} - {mean(f'x{i}')}) AS {c}" for c in ("y", *(f"x{j}" for j in range(i + 1, len(controls))))]
        text = f"SELECT {KEYS}, {', '.join(freed)} FROM ({text}) AS e{i}"
    return f"SELECT {KEYS}, {r6('y')} AS value FROM ({text}) AS e"


@operator("f9_orthogonalise", OBS)
def orthogonalise(d: Dialect, target: str = "rev5", others: tuple = ("strength", "width")) -> str:
    """The target in winsorised z, less its projections on the others, one after another (no intercept)."""
    part = "horizon, session"
    text = f"SELECT horizon, session, instrument, max(CASE WHEN factor_id = '{target}' THEN z END) AS e, {', '.join(f"max(CASE WHEN factor_id = '{f}' THEN z END) AS x{i}" for i, f in enumerate(others))} FROM ({winsor_z_text('{obs}')}) AS z GROUP BY horizon, session, instrument"
    text = f"SELECT * FROM ({text}) AS wide WHERE e IS NOT NULL AND {' AND '.join(f'x{i} IS NOT NULL' for i in range(len(others)))}"
    for i in range(len(others)):
        beta = f"coalesce(sum(e * x{i}) OVER (PARTITION BY {part}) / nullif(sum(x{i} * x{i}) OVER (PARTITION BY {part}), 0), 0)"
        text = f"SELECT horizon, session, instrument, e - {beta} * x{i} AS e{''.join(f', x{j}' for j in range(i + 1, len(others)))} FROM ({text}) AS s{i}"
    return f"SELECT horizon, session, instrument, {r6('e')} AS value FROM ({text}) AS r"


@operator("f10_demean_by_label", {"obs": "obs", "bars": "vendor"})
def demean_by_label(d: Dialect, label: str = "label") -> str:
    """Less the mean of the names that had the same label one session ago; groups of two or more."""
    return f"""
SELECT {KEYS}, {r6(f'v - avg(v) OVER (PARTITION BY {XS}, label)')} AS value FROM (
  SELECT *, count(*) OVER (PARTITION BY {XS}, label) AS peers FROM (
    SELECT o.*, b.{label} AS label FROM {{obs}} AS o JOIN {{bars}} AS b ON b.instrument = o.instrument AND b.sx = o.sx - 1) AS a) AS c WHERE peers >= 2"""


#: Registered ensembles: factors with their weights (and directions).
BLEND = {"rev5": (0.5, 1), "strength": (0.3, -1), "width": (0.2, 1)}
WEIGHTED = {"rev5": 0.6, "strength": 0.25, "width": 0.15}


def _by_factor(values: dict[str, float]) -> str:
    return "CASE factor_id " + " ".join(f"WHEN '{f}' THEN {float(x)!r}e0" for f, x in values.items()) + " END"


def _members(factors: object) -> str:
    return "factor_id IN (" + ", ".join(f"'{f}'" for f in factors) + ")"


@operator("f11_blend_ranks", OBS)
def blend_ranks(d: Dialect, parts: dict = BLEND) -> str:
    """Weighted sum of direction-adjusted unit ranks of the factors in parts, {factor: (weight, 1 or -1)};
    weights are divided by their sum, and a name needs every factor."""
    weight = _by_factor({f: w for f, (w, _) in parts.items()})
    turned = f"{_by_factor({f: sign for f, (_, sign) in parts.items()})} * v"
    return f"""
SELECT horizon, session, instrument, {r6(f'sum(({weight}) * u) / sum({weight})')} AS value FROM (
  SELECT {KEYS}, {unit(avg_rank(turned), size())} AS u FROM {{obs}} WHERE {_members(parts)}) AS a GROUP BY horizon, session, instrument HAVING count(*) = {len(parts)}"""


@operator("f12_ensemble_mean_rank", OBS)
def ensemble_mean_rank(d: Dialect, factors: tuple = tuple(BLEND)) -> str:
    """Mean ordinal unit rank over the factors; a name needs every one."""
    return f"SELECT horizon, session, instrument, {r6('avg(u)')} AS value FROM (SELECT {KEYS}, {unit(ordinal('v'), size())} AS u FROM {{obs}} WHERE {_members(factors)}) AS a GROUP BY horizon, session, instrument HAVING count(*) = {len(factors)}"


@operator("f13_ensemble_z", OBS)
def ensemble_z(d: Dialect, weights: dict = WEIGHTED) -> str:
    """Weighted sum of winsorised z-scores over the factors in weights; a name needs every one."""
    return f"SELECT horizon, session, instrument, {r6(f'sum(({_by_factor(weights)}) * z)')} AS value FROM ({winsor_z_text('{obs}')}) AS z WHERE {_members(weights)} GROUP BY horizon, session, instrument HAVING count(*) = {len(weights)}"


@operator("f14_percentile_score", OBS)
def percentile_score(d: Dialect) -> str:
    """Place among the distinct values, 0 to 1."""
    return f"SELECT {KEYS}, {r6(f'(k - 1) / CAST(greatest(max(k) OVER (PARTITION BY {XS}) - 1, 1) AS DOUBLE)')} AS value FROM (SELECT *, dense_rank() OVER (PARTITION BY {XS} ORDER BY v) AS k FROM {{obs}}) AS a"


def bucket_text(q: int, x: str = "v", part: str = XS) -> str:
    return f"CAST(floor(({ordinal(x, part)} - 1) * {q} / CAST({size(part)} AS DOUBLE)) AS BIGINT) + 1"


@operator("f15_bucket", OBS)
def bucket(d: Dialect, q: int = 5) -> str:
    return f"SELECT {KEYS}, {bucket_text(q)} AS value FROM {{obs}}"


@operator("f16_size_liquidity_buckets", {"bars": "p1"})
def size_liquidity_buckets(d: Dialect) -> str:
    """Size 30/40/30 and liquidity thirds by ordinal cuts, by session."""
    return f"""
SELECT instrument, session, CASE WHEN ks <= floor(n * 0.3e0) THEN 'small' WHEN ks <= floor(n * 0.7e0) THEN 'mid' ELSE 'large' END AS size_bucket, CASE WHEN kl <= floor(n / 3e0) THEN 'low' WHEN kl <= floor(n * 2 / 3e0) THEN 'mid' ELSE 'high' END AS liquidity_bucket
FROM (SELECT *, {ordinal('cap', 'session')} AS ks, {ordinal('amount', 'session')} AS kl, {size('session')} AS n FROM {{bars}}) AS a"""


@operator("f17_hash_sample", {"bars": "p1"})
def hash_sample(d: Dialect, n: int = 2) -> str:
    """The n names of each session and group with the smallest hash: a stable sample."""
    return f"SELECT session, grp, instrument FROM (SELECT *, row_number() OVER (PARTITION BY session, grp ORDER BY {d.sha256('CAST(instrument AS VARCHAR(20))' if d.name != 'spark' else 'CAST(instrument AS STRING)')}, instrument) AS k FROM {{bars}}) AS a WHERE k <= {n}"


@operator("f18_ensemble_weights", OBS)
def ensemble_weights(d: Dialect) -> str:
    """Weights of factors under three schemes from their mean RankIC and its ratio."""
    return f"""
SELECT horizon, factor_id, method, {r6('w / sum(w) OVER (PARTITION BY horizon, method)')} AS weight FROM (
  SELECT horizon, factor_id, 'equal' AS method, 1e0 AS w FROM ({DAILY}) AS a GROUP BY horizon, factor_id
  UNION ALL SELECT horizon, factor_id, 'ic', greatest(0.001e0, avg(rank_ic)) FROM ({DAILY}) AS b GROUP BY horizon, factor_id
  UNION ALL SELECT horizon, factor_id, 'inverse_sharpe', 1 / greatest(0.01e0, abs(avg(rank_ic) / nullif(stddev_samp(rank_ic), 0))) FROM ({DAILY}) AS c GROUP BY horizon, factor_id) AS e"""
