"""Portfolios from signals, candidate tables, and forward observation."""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelforge.operators import models
from panelforge.operators.base import Dialect, Stage, operator
from panelforge.operators.scores import redundancy_text
from panelforge.operators.sqlkit import DAILY, XS, ordinal, r6, size, states_text
from panelforge.operators.xs import bucket_text, winsor_z_text

OBS, EV = {"obs": "obs"}, {"ev": "ev"}
ONE = "SELECT * FROM {obs} WHERE horizon = 1"


@operator("k1_target_weights", OBS)
def target_weights(d: Dialect, reserve: float = 0.1, cap: float = 0.2, k: int = 10, fraction: float = 0.2) -> str:
    """Five ranking policies; each spreads 1 - reserve over its names, at most cap for one."""
    policies = {"top_k": (f"place <= {k}", "1e0"), "all_eligible": ("TRUE", "1e0"), "top_fraction": (f"place <= ceil(n * {fraction}e0)", "1e0"), "exclude_bottom": (f"place <= n - ceil(n * {fraction}e0)", "1e0"), "underweight_bottom": ("TRUE", f"CASE WHEN place <= n - ceil(n * {fraction}e0) THEN 1e0 ELSE 0.5e0 END")}
    ranked = f"SELECT factor_id, session, instrument, {ordinal('v', desc=True)} AS place, {size()} AS n FROM ({ONE}) AS o"
    parts = " UNION ALL ".join(f"SELECT '{name}' AS policy, factor_id, session, instrument, {w} AS raw FROM ranked WHERE {keep}" for name, (keep, w) in policies.items())
    return f"WITH ranked AS ({ranked}) SELECT policy, factor_id, session, instrument, {r6(f'least({cap}e0, (1 - {reserve}e0) * raw / sum(raw) OVER (PARTITION BY policy, factor_id, session))')} AS weight FROM ({parts}) AS p"


@operator("k2_trade_cost", OBS)
def trade_cost(d: Dialect, nav: float = 1000000.0) -> str:
    """Commission, sell tax, slippage and square-root impact of trading 1 % of nav in a name."""
    notional = f"{nav * 0.01}e0"
    return f"SELECT factor_id, session, instrument, {r6(f'{notional} * (0.0003e0 + 0.0005e0 + 0.001e0 + 0.1e0 * sqrt({notional} / greatest(adv, 1)))')} AS sell_cost, {r6(f'{notional} * (0.0003e0 + 0.0005e0 + 0.1e0 * sqrt({notional} / greatest(adv, 1)))')} AS buy_cost FROM ({ONE}) AS o"


#: Round-trip cost of a cohort: commission, slippage and impact both ways and the tax on sales.
COST = 0.002
EVENT_KEYS = "factor_id, horizon, b, nav, part"


def money(x: str, places: int = 2) -> str:
    """Sums of millionths as amounts, half up: whole numbers, so that no order of summing changes them."""
    unit = 10 ** (6 - places)
    return f"floor(({x} + {unit // 2}) / {unit}e0) / {10**places}e0 + 0.0"


def events_text(d: Dialect, breadths: tuple = (10,), mode: str = "BUY", navs: tuple = (1e6,), parts: tuple = (0.1,), gate: tuple | None = None, hold: bool = False, base: str = "rev5", cost: float = COST, ranked: str = "", counted: str = "") -> str:
    """Cohorts of every factor and horizon over a grid of breadths, NAVs and participations, in one plan.

    A factor with labels over h sessions has h staggered offsets; each cohort puts 1 / h of the NAV into
    its names, each order at most part of the name's prior amount. BUY holds the best b, AVOID all but
    the worst b (b = 0: everything, the control), TIMING those of the best b of the base factor whose
    own signal is at least the upper median, at 1 / b each. A cohort of b names or fewer is skipped; one
    whose session's regime is not one of gate (or not known) is flat, or holds everything alike. What could
    not be placed (clipped) is counted in millionths, see money. Turnover is half the sum of weight changes
    against the offset's last cohort: a name that is held again changes by the difference, one that is
    not held again leaves in the next cohort; a window over the name's own rows tells which. ranked and
    counted stand for the ranked rows and the sizes and markets of the cross-sections where these are known,
    the latter few enough for every task.
    """
    raw = {"BUY": "CASE WHEN down <= b THEN 1e0 / b END", "AVOID": "CASE WHEN up > b THEN 1e0 / (n - b) END", "TIMING": "CASE WHEN base_down <= b AND v >= threshold THEN 1e0 / b END"}[mode]
    timing, joined, active = "", "", "TRUE"
    if gate is not None:
        active = f"coalesce(st.regime IN ({', '.join(repr(g) for g in gate)}), FALSE)"
        joined = f"LEFT JOIN ({states_text()}) AS st ON st.session = c.session"
    if mode == "TIMING":
        timing = f", max(CASE WHEN factor_id = '{base}' THEN down END) OVER (PARTITION BY horizon, session, instrument) AS base_down, max(CASE WHEN up = floor(n_own / 2e0) + 1 THEN v END) OVER (PARTITION BY {XS}) AS threshold"
    ranked = ranked or f"SELECT *{timing} FROM (SELECT *, {ordinal('v', desc=True)} AS down, {ordinal('v')} AS up, {size()} AS n_own FROM {{obs}}) AS x"
    few = "/*+ BROADCAST(c) */ " if counted else ""
    counted = counted or "SELECT factor_id, horizon, session, count(*) AS n, avg(fwd) AS market FROM {obs} GROUP BY factor_id, horizon, session"
    return f"""
SELECT {EVENT_KEYS}, offset_no, seq, max(session) AS session, max(CASE WHEN active THEN 1 ELSE 0 END) = 1 AS active, sum(ret) - max(market) AS gross, sum(abs(dw)) / 2 AS turnover, sum(ret) - max(market) - {cost}e0 * sum(abs(dw)) / 2 AS net,
  sum(clipped) AS clipped, CAST(sum(CASE WHEN clipped > 0 THEN 1 ELSE 0 END) AS BIGINT) AS clipped_orders FROM (
  SELECT {EVENT_KEYS}, offset_no, seq + k AS seq, CASE WHEN k = 0 THEN session END AS session, k = 0 AND active AS active, CASE WHEN k = 0 THEN market END AS market, CASE WHEN k = 0 THEN w * fwd ELSE 0e0 END AS ret, CASE WHEN k = 0 THEN clipped ELSE 0 END AS clipped,
    CASE WHEN k = 1 THEN -w WHEN seq_before = seq - 1 THEN w - w_before ELSE w END AS dw FROM (
    SELECT *, lag(seq, 1) OVER kept AS seq_before, lag(w, 1) OVER kept AS w_before, lead(seq, 1) OVER kept AS seq_after FROM (
      SELECT *, least(nav / horizon * w0, coalesce(prior_amount, 0) * part) / nav AS w, CAST(round(greatest(nav / horizon * w0 - coalesce(prior_amount, 0) * part, 0e0) * 1e6) AS BIGINT) AS clipped FROM (
        SELECT {few}o.factor_id, o.horizon, o.session, o.instrument, o.fwd, o.prior_amount, o.down, c.b, c.offset_no, c.seq, c.active, c.market / o.horizon AS market,
          coalesce(CASE WHEN c.active THEN {raw} WHEN {str(hold).upper()} THEN 1e0 / n END, 0e0) AS w0 FROM (
          {ranked}) AS o
        JOIN (
          SELECT *, row_number() OVER (PARTITION BY factor_id, horizon, offset_no, b ORDER BY session) - 1 AS seq FROM (
            SELECT *, (row_number() OVER (PARTITION BY factor_id, horizon ORDER BY session) - 1) % horizon AS offset_no FROM (
              SELECT c.*, {active} AS active FROM ({counted}) AS c {joined}) AS c0) AS c1 {d.explode(d.array(list(breadths)), 'b')} WHERE n > b) AS c
        ON c.factor_id = o.factor_id AND c.horizon = o.horizon AND c.session = o.session) AS weighted {d.explode(d.doubles(navs), 'nav')} {d.explode(d.doubles(parts), 'part')} WHERE w0 > 0 OR down = 1) AS executed
    WINDOW kept AS (PARTITION BY {EVENT_KEYS}, offset_no, instrument ORDER BY seq)) AS walked {d.explode(d.array([0, 1]), 'k')} WHERE k = 0 OR (w > 0 AND seq_after IS DISTINCT FROM seq + 1)) AS moved
GROUP BY {EVENT_KEYS}, offset_no, seq HAVING max(session) IS NOT NULL"""


def control_text(d: Dialect) -> str:
    """The no-signal control: all names alike."""
    return events_text(d, (0,), "AVOID")


@operator("k3_cohort_events", OBS)
@operator("k3_cohort_avoid", OBS, mode="AVOID")
@operator("k3_cohort_timing", OBS, mode="TIMING")
@operator("k3_cohort_gated", OBS | {"regimes": "regimes"}, gate=("risk_on", "mixed"), hold=True)
@operator("k3_cohort_gated_flat", OBS | {"regimes": "regimes"}, gate=("risk_on", "mixed"))
def cohort_events(d: Dialect, b: int = 10, mode: str = "BUY", gate: tuple | None = None, hold: bool = False) -> str:
    """Dated cohorts; gate names the regimes of the frame regimes in which they are open."""
    return f"SELECT factor_id, horizon, offset_no, CAST(seq AS BIGINT) AS seq, session, active, {r6('gross')} AS gross, {r6('turnover')} AS turnover, {r6('net')} AS net, {money('clipped')} AS clipped FROM ({events_text(d, (b,), mode, gate=gate, hold=hold)}) AS e"


@operator("k4_weighting", OBS)
def weighting(d: Dialect, b: int = 10) -> str:
    """Equal, rank and clipped-z weights of the best b names."""
    return f"SELECT factor_id, session, instrument, {r6('1e0 / count(*) OVER (PARTITION BY factor_id, session)')} AS equal, {r6(f'({b} + 1 - place) / sum({b} + 1e0 - place) OVER (PARTITION BY factor_id, session)')} AS by_rank, {r6('zc / nullif(sum(zc) OVER (PARTITION BY factor_id, session), 0)')} AS by_z FROM (SELECT factor_id, session, instrument, place, least(greatest(z, 0), 3) AS zc FROM (SELECT *, {ordinal('v', desc=True)} AS place FROM ({winsor_z_text(f'({ONE}) AS o')}) AS z) AS a WHERE place <= {b}) AS c"


@operator("k5_path_summary", OBS)
def path_summary(d: Dialect) -> str:
    """Increments over the control by offset; median, lower quartile by index, positives."""
    return f"""
WITH p AS (SELECT a.factor_id, a.horizon, a.offset_no, avg(a.net - c.net) / nullif(stddev_samp(a.net - c.net), 0) AS sharpe FROM ({events_text(d)}) AS a JOIN ({control_text(d)}) AS c ON c.factor_id = a.factor_id AND c.horizon = a.horizon AND c.session = a.session GROUP BY a.factor_id, a.horizon, a.offset_no),
k AS (SELECT *, row_number() OVER (PARTITION BY factor_id, horizon ORDER BY sharpe, offset_no) AS i, count(*) OVER (PARTITION BY factor_id, horizon) AS n FROM p)
SELECT factor_id, horizon, {r6(d.percentile('sharpe', 0.5))} AS median_sharpe, {r6('max(CASE WHEN i = floor(0.25e0 * (n - 1)) + 1 THEN sharpe END)')} AS lower_quartile, CAST(sum(CASE WHEN sharpe > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive_paths FROM k GROUP BY factor_id, horizon"""


@operator("k6_quantile_portfolio", OBS)
def quantile_portfolio(d: Dialect, fraction: float = 0.2) -> str:
    return f"""
SELECT factor_id, session, {r6('avg(CASE WHEN k > n - q THEN fwd END)')} AS long_return, {r6('avg(CASE WHEN k > n - q THEN fwd END) - avg(CASE WHEN k <= q THEN fwd END)')} AS long_short, round(min(CASE WHEN k > n - q THEN adv END), 2) AS capacity FROM (
  SELECT *, {ordinal('v')} AS k, {size()} AS n, greatest(1, floor({size()} * {fraction}e0)) AS q FROM ({ONE}) AS o) AS a GROUP BY factor_id, session"""


@operator("k6_jaccard_turnover", OBS, by_section=True)
def jaccard_turnover(d: Dialect, b: int = 10) -> str:
    held = f"SELECT factor_id, instrument, i FROM (SELECT *, {ordinal('v', desc=True)} AS place, dense_rank() OVER (PARTITION BY factor_id ORDER BY session) AS i FROM ({ONE}) AS o) AS a WHERE place <= {b}"
    if d.name == "spark":  # every session has a first name: numbered after the others have gone
        held = f"SELECT factor_id, instrument, dense_rank() OVER (PARTITION BY factor_id ORDER BY session) AS i FROM (SELECT *, {ordinal('v', desc=True)} AS place FROM ({ONE}) AS o) AS a WHERE place <= {b}"
    return f"""
WITH t AS ({held}), n AS (SELECT factor_id, i, count(*) AS c FROM t GROUP BY factor_id, i),
s AS (SELECT a.factor_id, a.i, count(*) AS shared FROM t AS a JOIN t AS b ON a.factor_id = b.factor_id AND a.instrument = b.instrument AND b.i = a.i - 1 GROUP BY a.factor_id, a.i)
SELECT n.factor_id, {r6('avg(1 - coalesce(shared, 0) / CAST(n.c + p.c - coalesce(shared, 0) AS DOUBLE))')} AS turnover FROM n JOIN n AS p ON p.factor_id = n.factor_id AND p.i = n.i - 1 LEFT JOIN s ON s.factor_id = n.factor_id AND s.i = n.i GROUP BY n.factor_id"""


@operator("k7_stress", OBS)
def stress(d: Dialect, navs: tuple = (1e5, 1e6, 1e7), parts: tuple = (0.05, 0.1), multipliers: tuple = (1.0, 2.0, 4.0)) -> str:
    """Net results, clipped notional and turnover over NAV by participation by cost multiplier, in one plan."""
    return f"SELECT factor_id, horizon, nav, part, multiplier, count(*) AS cohorts, {r6(f'avg(gross - {COST}e0 * multiplier * turnover)')} AS mean_net, {r6(f'avg(gross - {COST}e0 * multiplier * turnover) / nullif(stddev_samp(gross - {COST}e0 * multiplier * turnover), 0)')} AS sharpe, {r6('avg(turnover)')} AS turnover, {money('sum(clipped)', 0)} AS clipped FROM ({events_text(d, navs=navs, parts=parts)}) AS g {d.explode(d.doubles(multipliers), 'multiplier')} GROUP BY factor_id, horizon, nav, part, multiplier"


@operator("h22_accounting", OBS)
def accounting(d: Dialect) -> str:
    return f"SELECT a.factor_id, a.horizon, count(*) AS cohorts, {r6('sum(a.gross)')} AS gross, {r6('sum(a.net)')} AS net, {r6('sum(a.gross - a.net)')} AS cost, {r6('sum(c.net)')} AS control, {r6('sum(a.net - c.net)')} AS value_added FROM ({events_text(d)}) AS a JOIN ({control_text(d)}) AS c ON c.factor_id = a.factor_id AND c.horizon = a.horizon AND c.session = a.session GROUP BY a.factor_id, a.horizon"


@operator("h23_conversion", OBS)
def conversion(d: Dialect, breadths: tuple = (5, 10)) -> str:
    """Gross against net by horizon, breadth and year, and the cost that would eat all of it."""
    return f"SELECT factor_id, horizon, CAST(b AS BIGINT) AS breadth, year(session) AS y, {r6('avg(gross)')} AS gross, {r6('avg(net)')} AS net, {r6('avg(gross - net)')} AS drag, {r6('sum(gross) / nullif(sum(turnover), 0)')} AS cost_tolerance FROM ({events_text(d, breadths)}) AS g GROUP BY factor_id, horizon, b, year(session)"


@operator("h26_run_totals", OBS)
def run_totals(d: Dialect, nav: float = 1e7) -> str:
    """Turnover, cost, notional that could not be placed, and how many orders were cut."""
    return f"SELECT factor_id, horizon, count(*) AS cohorts, {r6('sum(turnover)')} AS turnover, {r6('sum(gross - net)')} AS cost, {money('sum(clipped)', 0)} AS clipped_notional, CAST(sum(clipped_orders) AS BIGINT) AS clipped_orders FROM ({events_text(d, navs=(nav,))}) AS e GROUP BY factor_id, horizon"


@operator("k8_hysteresis", OBS)
def hysteresis(d: Dialect, k: int = 10, buffer: int = 5) -> str:
    """In at rank k or better, out beyond rank k + buffer, else as before. The held number floats."""
    state = f"CASE WHEN place <= {k} THEN 1 WHEN place > {k + buffer} THEN 0 END"
    last = f"last({state}, true)" if d.name == "spark" else f"last_value({state} IGNORE NULLS)"
    return f"SELECT factor_id, session, instrument FROM (SELECT factor_id, session, instrument, {last} OVER (PARTITION BY factor_id, instrument ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM (SELECT *, {ordinal('v', desc=True)} AS place FROM ({ONE}) AS o) AS a) AS b WHERE held = 1"


@operator("k9_by_slice", OBS)
def by_slice(d: Dialect) -> str:
    """Top-quintile excess within thirds of size."""
    return f"SELECT factor_id, size_slice, count(*) AS sections, {r6('avg(ret)')} AS mean_excess FROM (SELECT factor_id, session, size_slice, avg(CASE WHEN place <= greatest(1, floor(m / 5e0)) THEN fwd END) - avg(fwd) AS ret FROM (SELECT *, row_number() OVER (PARTITION BY {XS}, size_slice ORDER BY v DESC, instrument) AS place, count(*) OVER (PARTITION BY {XS}, size_slice) AS m FROM (SELECT *, {bucket_text(3, 'cap')} AS size_slice FROM ({ONE}) AS o) AS a) AS b GROUP BY factor_id, session, size_slice) AS c GROUP BY factor_id, size_slice"


def sliced_text() -> str:
    """Observations under a factor of their own for each third of size and of liquidity in their cross-section."""
    kinds = " UNION ALL ".join(f"SELECT concat(factor_id, '|{kind}|', {bucket_text(3, x)}) AS factor_id, horizon, session, instrument, v, fwd, prior_amount FROM {{obs}}" for kind, x in (("size", "cap"), ("liquidity", "adv")))
    return f"SELECT * FROM ({kinds}) AS u"


def slice_rows_text(d: Dialect) -> str:
    return "SELECT factor_id, horizon, session, instrument, v, fwd, prior_amount, cap, adv FROM {obs}"


def _slices(rows: DataFrame, b: int = 3) -> DataFrame:
    return models.slices(rows, {"size": "cap", "liquidity": "adv"}, b)


def sliced_events(d: Dialect, b: int) -> tuple[str, str]:
    """The cohorts and the control of sliced_text, from one row for each slice of a cross-section.

    The best names are in that row. The control holds every name: rows stay where they are, by instrument,
    and find their slices by the first name of each.
    """
    counted = "SELECT factor_id, horizon, session, n, market FROM {slices}"
    best = "SELECT factor_id, horizon, session, z.instrument, z.fwd, z.prior_amount, i + 1 AS down FROM {slices} LATERAL VIEW posexplode(held) AS i, z"
    first = lambda kind, k: f"max(CASE WHEN kind = '{kind}' AND slice = {k} THEN named_struct('x', first_x, 'i', first_name) END) AS {kind}{k}"
    marks = f"SELECT base, horizon, session, {', '.join(first(kind, k) for kind in ('size', 'liquidity') for k in (2, 3))} FROM {{slices}} GROUP BY base, horizon, session"
    within = lambda kind, x: f"concat(o.factor_id, '|{kind}|', CASE WHEN named_struct('x', {x}, 'i', o.instrument) >= m.{kind}3 THEN 3 WHEN named_struct('x', {x}, 'i', o.instrument) >= m.{kind}2 THEN 2 ELSE 1 END)"
    rows = f"SELECT /*+ BROADCAST(m) */ o.horizon, o.session, o.instrument, o.fwd, o.prior_amount, array({within('size', 'o.cap')}, {within('liquidity', 'o.adv')}) AS ids FROM {{obs}} AS o JOIN ({marks}) AS m ON m.base = o.factor_id AND m.horizon = o.horizon AND m.session = o.session"
    everyone = f"SELECT factor_id, horizon, session, instrument, fwd, prior_amount, 1 AS down, 1 AS up FROM ({rows}) AS r LATERAL VIEW explode(ids) AS factor_id"
    return events_text(d, (b,), ranked=best, counted=counted), events_text(d, (0,), "AVOID", ranked=everyone, counted=counted)


@operator("k9_cohorts_by_slice", OBS, {"slices": Stage(slice_rows_text, _slices, None)})
def cohorts_by_slice(d: Dialect, b: int = 3) -> str:
    """Cohorts (K3), their offset paths against the control (K5) and RankIC (H1) in each third of size and liquidity."""
    within = lambda text: text.replace("{obs}", f"({sliced_text()})")
    if d.name == "spark":
        events, control = sliced_events(d, b)
        daily = "SELECT factor_id, horizon, rank_ic FROM {slices} WHERE rank_ic IS NOT NULL"
    else:
        events, control, daily = within(events_text(d, (b,))), within(control_text(d)), within(DAILY)
    return f"""
WITH e AS ({events}), c AS ({control}),
p AS (SELECT e.factor_id, e.horizon, e.offset_no, avg(e.net - c.net) / nullif(stddev_samp(e.net - c.net), 0) AS sharpe FROM e JOIN c ON c.factor_id = e.factor_id AND c.horizon = e.horizon AND c.session = e.session GROUP BY e.factor_id, e.horizon, e.offset_no),
k AS (SELECT factor_id, horizon, count(*) AS cohorts, avg(net) AS net, avg(turnover) AS turnover FROM e GROUP BY factor_id, horizon),
q AS (SELECT factor_id, horizon, {d.percentile('sharpe', 0.5)} AS median_path, CAST(sum(CASE WHEN sharpe > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive_paths FROM p GROUP BY factor_id, horizon),
i AS (SELECT factor_id, horizon, avg(rank_ic) AS rank_ic FROM ({daily}) AS d GROUP BY factor_id, horizon)
SELECT k.factor_id, k.horizon, cohorts, {r6('net')} AS mean_net, {r6('turnover')} AS turnover, {r6('median_path')} AS median_path_sharpe, positive_paths, {r6('rank_ic')} AS mean_rank_ic
FROM k JOIN q ON q.factor_id = k.factor_id AND q.horizon = k.horizon JOIN i ON i.factor_id = k.factor_id AND i.horizon = k.horizon"""


@operator("k10_sleeves", OBS)
def sleeves(d: Dialect, b: int = 10) -> str:
    """Sharpe of each offset's sleeve under the cost of a full turn."""
    return f"SELECT factor_id, horizon, {r6('avg(sharpe)')} AS mean_sharpe, {r6('min(sharpe)')} AS worst_sharpe FROM (SELECT factor_id, horizon, offset_no, avg(gross - {COST}e0) / nullif(stddev_samp(gross - {COST}e0), 0) AS sharpe FROM ({events_text(d, (b,))}) AS e GROUP BY factor_id, horizon, offset_no) AS x GROUP BY factor_id, horizon"


# --- candidate tables ------------------------------------------------------------------------------

_GRID = "SELECT DISTINCT event_type AS template FROM {ev}"


@operator("l1_candidate_grid", EV)
def candidate_grid(d: Dialect) -> str:
    """Template by window by horizon by direction, each with a content id. The grid is a few hundred rows."""
    t = "STRING" if d.name == "spark" else "VARCHAR"
    content = f"concat(template, '|', CAST(wnd AS {t}), '|', CAST(horizon AS {t}), '|', CAST(direction AS {t}))"
    return f"SELECT template, CAST(wnd AS BIGINT) AS wnd, CAST(horizon AS BIGINT) AS horizon, CAST(direction AS BIGINT) AS direction, {d.sha256(content)} AS candidate_id FROM ({_GRID}) AS g {d.explode(d.array([5, 20, 60]), 'wnd')} {d.explode(d.array([1, 5, 20]), 'horizon')} {d.explode(d.array([-1, 1]), 'direction')}"


@operator("l2_dedupe_quota", EV)
def dedupe_quota(d: Dialect, quota: int = 40, block: int = 100_000) -> str:
    """First of each (type, rounded value) is a candidate; each domain admits quota of them in order.

    The running number of a domain is the sum of its earlier blocks of event ids and the place within
    the block, so no task orders a whole domain.
    """
    return f"""
WITH k AS (SELECT event_type, event_id, CAST(floor(event_id / {block}e0) AS BIGINT) AS blk, CASE WHEN row_number() OVER (PARTITION BY event_type, round(value, 1) ORDER BY event_id) = 1 THEN 1 ELSE 0 END AS firsts FROM {{ev}}),
p AS (SELECT event_type, blk, coalesce(sum(firsts) OVER (PARTITION BY event_type ORDER BY blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM (SELECT event_type, blk, sum(firsts) AS firsts FROM k GROUP BY event_type, blk) AS b)
SELECT event_type AS domain, status, count(*) AS candidates FROM (
  SELECT n.event_type, CASE WHEN n.firsts = 0 THEN 'duplicate' WHEN p.earlier + n.place > {quota} THEN 'over_budget' ELSE 'admitted' END AS status FROM (
    SELECT *, sum(firsts) OVER (PARTITION BY event_type, blk ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS place FROM k) AS n JOIN p ON p.event_type = n.event_type AND p.blk = n.blk) AS s GROUP BY event_type, status"""


_EVIDENCE = f"SELECT factor_id, horizon, count(*) AS days, avg(rank_ic) AS ic, avg(rank_ic) / nullif(stddev_samp(rank_ic), 0) AS icir, avg(CASE WHEN rank_ic > 0 THEN 1e0 ELSE 0e0 END) AS hit FROM ({DAILY}) AS a GROUP BY factor_id, horizon"


@operator("l3_gate", OBS)
def gate(d: Dialect) -> str:
    """Failed gates of each candidate, joined by a plus sign, and the decision."""
    gates = {"days": "days >= 50", "ic": "ic > 0.01", "icir": "icir > 0.1", "hit": "hit > 0.5"}
    failed = "concat_ws('+', " + ", ".join(f"CASE WHEN NOT coalesce({c}, FALSE) THEN '{n}' END" for n, c in gates.items()) + ")"
    return f"SELECT factor_id, horizon, {failed} AS failed, {failed} = '' AS accepted FROM ({_EVIDENCE}) AS e"


@operator("l4_funnel", OBS)
def funnel(d: Dialect, train_budget: int = 4, final_budget: int = 2) -> str:
    return f"""
SELECT factor_id, horizon, CASE WHEN days < 50 THEN 'data' WHEN k1 > {train_budget} THEN 'training_budget' WHEN k2 > {final_budget} THEN 'execution_budget' ELSE 'survived' END AS stage FROM (
  SELECT *, row_number() OVER (PARTITION BY CASE WHEN days >= 50 AND k1 <= {train_budget} THEN 1 ELSE 0 END ORDER BY round(icir, 9) DESC, factor_id, horizon) AS k2 FROM (
    SELECT *, row_number() OVER (PARTITION BY CASE WHEN days >= 50 THEN 1 ELSE 0 END ORDER BY round(ic, 9) DESC, factor_id, horizon) AS k1 FROM ({_EVIDENCE}) AS e) AS a) AS b"""


@operator("l5_prune", OBS)
def prune(d: Dialect, limit: float = 0.3) -> str:
    """Dropped is any factor that correlates above the limit with a better-ranked one (dominance)."""
    return f"""
WITH e AS (SELECT factor_id, horizon, ic, row_number() OVER (PARTITION BY horizon ORDER BY round(ic, 9) DESC, factor_id) AS k FROM ({_EVIDENCE}) AS x), r AS (SELECT fa AS a, fb AS b, horizon, rho FROM ({redundancy_text(d)}) AS p UNION ALL SELECT fb, fa, horizon, rho FROM ({redundancy_text(d)}) AS q)
SELECT e.horizon, e.factor_id, e.k AS place, max(CASE WHEN o.k < e.k AND abs(r.rho) > {limit} THEN 1 ELSE 0 END) = 1 AS dropped FROM e LEFT JOIN r ON r.a = e.factor_id AND r.horizon = e.horizon LEFT JOIN e AS o ON o.factor_id = r.b AND o.horizon = e.horizon GROUP BY e.horizon, e.factor_id, e.k"""


@operator("l6_select_factors", OBS)
def select_factors(d: Dialect, m: int = 2) -> str:
    """Weighted score less a penalty for correlation with better-ranked factors; top m by horizon."""
    return f"""
WITH p AS ({prune.text(d)}), s AS (SELECT e.horizon, e.factor_id, 0.7e0 * e.ic + 0.3e0 * 0.1e0 * e.icir - CASE WHEN p.dropped THEN 0.02e0 ELSE 0e0 END AS score FROM ({_EVIDENCE}) AS e JOIN p ON p.factor_id = e.factor_id AND p.horizon = e.horizon)
SELECT horizon, factor_id, {r6('score')} AS score, {r6('greatest(score, 0) / nullif(sum(greatest(score, 0)) OVER (PARTITION BY horizon), 0)')} AS weight FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY round(score, 9) DESC, factor_id) AS k FROM s) AS x WHERE k <= {m}"""


@operator("l7_best", OBS)
def best(d: Dialect) -> str:
    """The largest (worst year, mean, id) by horizon, compared in that order."""
    return f"SELECT horizon, factor_id, {r6('worst')} AS worst_year, {r6('ic')} AS mean_rank_ic FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY round(worst, 9) DESC, round(ic, 9) DESC, factor_id DESC) AS k FROM (SELECT factor_id, horizon, min(y) AS worst, avg(y) AS ic FROM (SELECT factor_id, horizon, avg(rank_ic) AS y FROM ({DAILY}) AS a GROUP BY factor_id, horizon, year(session)) AS b GROUP BY factor_id, horizon) AS c) AS e WHERE k = 1"


@operator("m1_forward_summary", EV)
def forward_summary(d: Dialect, freeze: str = "2024-01-10", n: int = 10) -> str:
    """Observations after the freeze, one per session; results stay hidden until n sessions are in."""
    return f"""
SELECT source, sessions, CASE WHEN sessions >= {n} THEN {r6('total')} END AS cumulative, CASE WHEN sessions >= {n} THEN {r6('mean / nullif(sd, 0)')} END AS sharpe FROM (
  SELECT source, count(*) AS sessions, sum(ln(1 + ret)) AS total, avg(ret) AS mean, stddev_pop(ret) AS sd FROM (SELECT event_type AS source, CAST(ts AS DATE) AS session, avg(value) / 1000 AS ret FROM {{ev}} WHERE CAST(ts AS DATE) > DATE '{freeze}' GROUP BY event_type, CAST(ts AS DATE)) AS s GROUP BY source) AS x"""
