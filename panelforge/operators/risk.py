"""Held-out residuals: fold-local ridge on controls, first component and clusters of exposures."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame

from panelforge.operators import linear
from panelforge.operators.base import Dialect, Stage, operator
from panelforge.operators.sqlkit import r6
from panelforge.operators.validation import OBS, ROLES

#: The registered target with its controls, and the registered signal with its exposures.
TARGET, CONTROLS = "width", ("rev5", "strength")
SIGNAL, EXPOSURES = "rev5", ("strength", "width", "log_adv")
CLUSTERS, MEMBERS, NAMES = 8, 3, 10


def _pivot(columns: dict[str, str]) -> str:
    """One row for each name on each session and horizon; a factor it lacks leaves it out."""
    expr = lambda f: "max(ln(adv))" if f == "log_adv" else f"max(CASE WHEN factor_id = '{f}' THEN v END)"
    inner = ", ".join(f"{expr(f)} AS {alias}" for alias, f in columns.items())
    return f"SELECT * FROM (SELECT horizon, session, sx, instrument, {inner} FROM {{obs}} GROUP BY horizon, session, sx, instrument) AS w WHERE " + " AND ".join(f"{alias} IS NOT NULL" for alias in columns)


def controls_text(d: Dialect) -> str:
    return _pivot({"y": TARGET} | {f"x{i}": f for i, f in enumerate(CONTROLS, 1)})


def sums_text(d: Dialect) -> str:
    """Sums and products of every session, once; folds add up sessions."""
    xs = [f"x{i}" for i in range(1, len(CONTROLS) + 1)]
    products = [*xs, *[f"{a} * {b}" for a in xs for b in xs], "y", *[f"{a} * y" for a in xs]]
    return f"SELECT horizon, sx, count(*) AS n, {', '.join(f'sum({p}) AS s{i}' for i, p in enumerate(products))} FROM {{wide}} GROUP BY horizon, sx"


def fold_sums_text(d: Dialect) -> str:
    k = len(CONTROLS)
    s = lambda a, b: d.array_of(*[f"sum(s{i})" for i in range(a, b)])
    return f"""
SELECT r.fold, s.horizon, CAST(sum(s.n) AS BIGINT) AS n, {s(0, k)} AS xs, {s(k, k + k * k)} AS xx, sum(s{k + k * k}) AS y, {s(k + k * k + 1, k + k * k + 1 + k)} AS xy
FROM {{sums}} AS s JOIN {{roles}} AS r ON r.sx = s.sx WHERE r.role = 'train' GROUP BY r.fold, s.horizon"""


def cramer_text(d: Dialect, penalty: float = 1.0) -> str:
    """Two controls by Cramer's rule on centred rows, the penalty on the diagonal."""
    return f"""
WITH w AS (SELECT r.fold, w.* FROM {{wide}} AS w JOIN {{roles}} AS r ON r.sx = w.sx WHERE r.role = 'train'),
m AS (SELECT fold, horizon, count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2 FROM w GROUP BY fold, horizon),
s AS (
  SELECT w.fold, w.horizon, any_value(m.n) AS n, any_value(my) AS my, any_value(m1) AS m1, any_value(m2) AS m2, sum((x1 - m1) * (x1 - m1)) + {penalty}e0 AS aa, sum((x2 - m2) * (x2 - m2)) + {penalty}e0 AS bb,
    sum((x1 - m1) * (x2 - m2)) AS ab, sum((x1 - m1) * (y - my)) AS ay, sum((x2 - m2) * (y - my)) AS yb
  FROM w JOIN m ON m.fold = w.fold AND m.horizon = w.horizon GROUP BY w.fold, w.horizon),
c AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS c1, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS c2 FROM s WHERE n >= 3)
SELECT fold, horizon, n, my - c1 * m1 - c2 * m2 AS c0, c1, c2 FROM c"""


@operator("j16_ridge_residual", OBS, ROLES | {"wide": controls_text, "sums": sums_text, "coefs": Stage(fold_sums_text, functools.partial(linear.ridge, width=len(CONTROLS)), cramer_text)})
def ridge_residual(d: Dialect) -> str:
    """The target less a ridge fit on its controls: learned on a fold's train sessions, taken off its test
    sessions, for all folds and horizons in one plan."""
    fit = " + ".join(["c.c0", *[f"c.c{i} * w.x{i}" for i in range(1, len(CONTROLS) + 1)]])
    return f"""
SELECT r.fold, w.horizon, w.session, w.instrument, {r6(f'w.y - ({fit})')} AS residual
FROM {{wide}} AS w JOIN {{roles}} AS r ON r.sx = w.sx AND r.role = 'test' JOIN {{coefs}} AS c ON c.fold = r.fold AND c.horizon = w.horizon"""


def exposures_text(d: Dialect) -> str:
    return _pivot({"signal": SIGNAL} | {f"e{i}": f for i, f in enumerate(EXPOSURES, 1)})


def train_exposures_text(d: Dialect) -> str:
    """(fold, horizon, e, x) of every train row, joined from two stored tables each time it is read."""
    items = ", ".join(f"e{i}" for i in range(1, len(EXPOSURES) + 1))
    lateral = f"LATERAL VIEW posexplode(array({items})) AS seat, x" if d.name == "spark" else f", unnest([{items}]) WITH ORDINALITY AS _(x, seat)"
    number = "seat + 1" if d.name == "spark" else "seat"
    return f"SELECT fold, horizon, CAST({number} AS BIGINT) AS e, x FROM (SELECT r.fold, w.* FROM {{wide}} AS w JOIN {{roles}} AS r ON r.sx = w.sx WHERE r.role = 'train') AS t {lateral}"


def limits_text(d: Dialect, lower: float = 0.01, upper: float = 0.99) -> str:
    at = lambda p: d.percentile("x", p)
    return f"""
WITH t AS ({train_exposures_text(d)}), q AS (SELECT fold, horizon, e, {at(0.5)} AS mid, {at(lower)} AS lo, {at(upper)} AS hi FROM t GROUP BY fold, horizon, e),
m AS (SELECT t.fold, t.horizon, t.e, {d.percentile('abs(x - mid)', 0.5)} AS mad FROM t JOIN q ON q.fold = t.fold AND q.horizon = t.horizon AND q.e = t.e GROUP BY t.fold, t.horizon, t.e)
SELECT q.*, m.mad FROM q JOIN m ON m.fold = q.fold AND m.horizon = q.horizon AND m.e = q.e"""


def _z(i: int) -> str:
    return f"CASE WHEN l{i}.mad > 0 THEN (least(greatest(w.e{i}, l{i}.lo), l{i}.hi) - l{i}.mid) / (l{i}.mad * {linear.MAD}e0) ELSE 0e0 END"


def scaled_text(role: str) -> str:
    """Every row of that role in every fold with the fold's scaled exposures z1, z2 ..."""
    numbers = range(1, len(EXPOSURES) + 1)
    joins = " ".join(f"JOIN {{limits}} AS l{i} ON l{i}.fold = r.fold AND l{i}.horizon = w.horizon AND l{i}.e = {i}" for i in numbers)
    return f"SELECT r.fold, w.horizon, w.session, w.instrument, w.signal, {', '.join(f'{_z(i)} AS z{i}' for i in numbers)} FROM {{wide}} AS w JOIN {{roles}} AS r ON r.sx = w.sx AND r.role = '{role}' {joins}"


def _distance(centre: str) -> str:
    return " + ".join(f"(z{i} - {centre}{i}) * (z{i} - {centre}{i})" for i in range(1, len(EXPOSURES) + 1))


def states_text(d: Dialect) -> str:
    """Power steps as a recursion and cluster steps as one table after another, for DuckDB."""
    n = range(1, len(EXPOSURES) + 1)
    zs = ", ".join(f"z{i}" for i in n)
    cov = ", ".join(f"covar_samp(z{i}, z{j}) AS v{i}{j}" for i in n for j in n)
    norm = "sqrt(" + " + ".join(f"u{i} * u{i}" for i in n) + ")"
    step = ", ".join("(" + " + ".join(f"v{i}{j} * p{j}" for j in n) + f") AS u{i}" for i in n)
    first = sum(i * i for i in n) ** 0.5
    on = lambda a, b: f"{b}.fold = {a}.fold AND {b}.horizon = {a}.horizon"
    tables = [
        f"z AS MATERIALIZED ({scaled_text('train')})",
        f"uq AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY fold, horizon ORDER BY {zs}) - 1 AS i, count(*) OVER (PARTITION BY fold, horizon) AS n FROM (SELECT DISTINCT fold, horizon, {zs} FROM z) AS q)",
        f"b0 AS MATERIALIZED (SELECT fold, horizon, j, {', '.join(f'z{i} AS b{i}' for i in n)} FROM uq, range({CLUSTERS}) AS _(j) WHERE n >= {CLUSTERS} AND i = CAST(round_even(j * (n - 1) / {CLUSTERS - 1}.0::DOUBLE, 0) AS BIGINT))",
        f"cov AS MATERIALIZED (SELECT fold, horizon, count(*) AS n, {', '.join(f'avg(z{i}) AS m{i}' for i in n)}, {cov} FROM z GROUP BY fold, horizon)",
        f"it AS (SELECT fold, horizon, 0 AS k, {', '.join(f'{i / first!r}::DOUBLE AS p{i}' for i in n)} FROM cov UNION ALL SELECT fold, horizon, k + 1, {', '.join(f'u{i} / {norm}' for i in n)} FROM (SELECT it.fold, it.horizon, it.k, {step} FROM it JOIN cov ON {on('it', 'cov')} WHERE it.k < {linear.POWER_STEPS}) AS s)",
    ]
    for t in range(linear.CLUSTER_STEPS):
        tables += [
            f"a{t} AS MATERIALIZED (SELECT z.fold, z.horizon, {zs}, arg_min(j, ({_distance('b')}, j)) AS j FROM (SELECT row_number() OVER () AS rid, * FROM z) AS z JOIN b{t} AS b ON {on('z', 'b')} GROUP BY z.fold, z.horizon, rid, {zs})",
            f"b{t + 1} AS MATERIALIZED (SELECT b.fold, b.horizon, b.j, {', '.join(f'coalesce(c{i}, b{i}) AS b{i}' for i in n)} FROM b{t} AS b LEFT JOIN (SELECT fold, horizon, j, {', '.join(f'avg(z{i}) AS c{i}' for i in n)} FROM a{t} GROUP BY fold, horizon, j) AS c ON {on('b', 'c')} AND c.j = b.j)",
        ]
    sign = "CASE WHEN p1 < 0 THEN -1 ELSE 1 END"
    return f"""
WITH RECURSIVE {', '.join(tables)}
SELECT cov.fold, cov.horizon, cov.n, [{', '.join(f'm{i}' for i in n)}] AS means, [{', '.join(f'{sign} * p{i}' for i in n)}] AS loadings, c.centres
FROM cov JOIN it ON {on('cov', 'it')} AND it.k = {linear.POWER_STEPS} JOIN (SELECT fold, horizon, list([{', '.join(f'b{i}' for i in n)}] ORDER BY j) AS centres FROM b{linear.CLUSTER_STEPS} GROUP BY fold, horizon) AS c ON {on('cov', 'c')}"""


def _wide(d: Dialect) -> str:
    return "SELECT * FROM {wide}"


def _held_out(wide: DataFrame, roles: DataFrame, limits: DataFrame, states: DataFrame, least_members: int = MEMBERS, least_names: int = NAMES) -> DataFrame:
    return linear.neutral_sections(wide, roles, limits, states, len(EXPOSURES), least_members, least_names)


RISK = ROLES | {
    "wide": exposures_text,
    "limits": Stage(_wide, lambda wide, roles, **_: linear.robust_limits(wide, roles, len(EXPOSURES)), limits_text, ("roles",)),
    "states": Stage(_wide, lambda wide, roles, limits, **_: linear.risk_states(wide, roles, limits, len(EXPOSURES), CLUSTERS), states_text, ("roles", "limits")),
    "held_out": Stage(_wide, _held_out, None, ("roles", "limits", "states"), stored=False),
}


@operator("j17_component_and_cluster", OBS, RISK)
def component_and_cluster(d: Dialect, least_members: int = MEMBERS, least_names: int = NAMES) -> str:
    """Held-out signals without what a fold's first component explains, and without their cluster's mean.

    Exposures are scaled by the fold's train medians and deviations; component and centres are fitted on
    the train sessions of every fold. On a test session the signal is regressed on the component's score
    with an intercept, and its cluster's mean is taken off, or the session's where the cluster has fewer
    than least_members there. Sessions under least_names names are skipped.
    """
    if d.name == "spark":  # a session is one group for all folds that test it
        return f"SELECT fold, horizon, session, instrument, {r6('pc')} AS pc, cluster, {r6('pca_neutral')} AS pca_neutral, {r6('cluster_neutral')} AS cluster_neutral FROM {{held_out}}"
    n = range(1, len(EXPOSURES) + 1)
    first = 1
    score = " + ".join(f"(z{i} - s.means[{i - 1 + first}]) * s.loadings[{i - 1 + first}]" for i in n)
    centre = lambda j: " + ".join(f"(z{i} - s.centres[{j + first}][{i - 1 + first}]) * (z{i} - s.centres[{j + first}][{i - 1 + first}])" for i in n)
    distances = d.array_of(*[centre(j) for j in range(CLUSTERS)])
    place = "list_position(ds, list_min(ds)) - 1"
    part = "fold, horizon, session"
    return f"""
WITH t AS ({scaled_text('test')}),
p AS (SELECT t.fold, t.horizon, t.session, t.instrument, t.signal, {score} AS pc, {distances} AS ds FROM t JOIN {{states}} AS s ON s.fold = t.fold AND s.horizon = t.horizon),
c AS (SELECT *, CAST({place} AS BIGINT) AS cluster, count(*) OVER (PARTITION BY {part}) AS names FROM p),
w AS (
  SELECT fold, horizon, session, instrument, signal, pc, cluster, avg(signal) OVER (PARTITION BY {part}) AS mid, avg(pc) OVER (PARTITION BY {part}) AS pc_mid,
    coalesce(covar_pop(signal, pc) OVER (PARTITION BY {part}) / nullif(var_pop(pc) OVER (PARTITION BY {part}), 0), 0) AS beta,
    count(*) OVER (PARTITION BY {part}, cluster) AS members, avg(signal) OVER (PARTITION BY {part}, cluster) AS cluster_mid
  FROM c WHERE names >= {least_names})
SELECT fold, horizon, session, instrument, {r6('pc')} AS pc, cluster, {r6('signal - mid - beta * (pc - pc_mid)')} AS pca_neutral, {r6(f'signal - CASE WHEN members >= {least_members} THEN cluster_mid ELSE mid END')} AS cluster_neutral FROM w"""
