"""Rolling factors of one instrument, as columns over its calendar sessions.

A factor is a formula over windows of an instrument's rows; it is null unless all sessions that it
looks back on are there. All formulas of a panel share one partitioning and order, so Spark sorts
once however many of them are selected.
"""

from __future__ import annotations

from panelforge.operators.base import Dialect, operator

W = "PARTITION BY instrument ORDER BY sx"


def lag(x: str, k: int) -> str:
    return f"lag({x}, {k}) OVER ({W})"


def over(function: str, x: str, n: int, end: int = 0) -> str:
    """function of x over the n rows that end end rows before this one."""
    return f"{function}({x}) OVER ({W} ROWS BETWEEN {n - 1 + end} PRECEDING AND {f'{end} PRECEDING' if end else 'CURRENT ROW'})"


def mean(x: str, n: int, end: int = 0) -> str:
    return over("avg", x, n, end)


def ratio(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def period_return(x: str, n: int) -> str:
    return f"({ratio(x, lag(x, n))} - 1)"


def sma_ratio(x: str, short: int, long: int) -> str:
    return f"({ratio(mean(x, short), mean(x, long))} - 1)"


def complete(n: int) -> str:
    """Whether the n sessions up to this one are all there."""
    return f"(sx - {lag('sx', n - 1)} = {n - 1})" if n > 1 else "TRUE"


def drawdown(d: Dialect, x: str, n: int) -> str:
    """The deepest fall from a peak within the window, 0 or less."""
    if d.name == "spark":
        values = f"collect_list({x}) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        return f"aggregate({values}, named_struct('p', CAST(0 AS DOUBLE), 'd', CAST(0 AS DOUBLE)), (a, v) -> named_struct('p', greatest(a.p, CAST(v AS DOUBLE)), 'd', least(a.d, v / nullif(greatest(a.p, v), 0) - 1)), a -> a.d)"
    values = f"list({x}) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"least(0, list_min(list_transform({values}, lambda v, i: v / nullif(list_max(list_slice(list({x}) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 1, i)), 0) - 1)))"


#: Per-row terms that the windows run over; the previous close counts only one session back.
BASE = """
SELECT *, close / pc - 1 AS r, open / pc - 1 AS gap, close / open - 1 AS intra, high - low AS width,
  greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, ln(high / low) * ln(high / low) AS lh2, CASE WHEN high = low THEN 0 ELSE (2 * close - high - low) / (high - low) END AS cl
FROM (SELECT *, CASE WHEN sx - lag(sx, 1) OVER (PARTITION BY instrument ORDER BY sx) = 1 THEN lag(close, 1) OVER (PARTITION BY instrument ORDER BY sx) END AS pc FROM {bars}) AS base"""

DOWN, UP = "CASE WHEN r < 0 THEN r * r END", "CASE WHEN r > 0 THEN r * r END"
AMIHUD = "CASE WHEN amount > 0 THEN abs(r) / amount END"


def _skew(x: str, n: int) -> str:
    m1, m2, m3 = mean(x, n), mean(f"{x} * {x}", n), mean(f"{x} * {x} * {x}", n)
    var = f"(({m2}) - ({m1}) * ({m1}))"
    return f"CASE WHEN {var} <= 1e-14 THEN 0 ELSE (({m3}) - 3 * ({m1}) * ({m2}) + 2 * ({m1}) * ({m1}) * ({m1})) / power({var}, 1.5) END"


def _limit_move(x: str) -> str:
    return f"({x}) / 0.1"


#: name -> (sessions that must be there, formula); formulas over prices, volume and amount.
PRICE = {
    "e1_period_return_5": (6, period_return("close", 5)),
    "e1_period_return_20": (21, period_return("close", 20)),
    "e1_period_return_60": (61, period_return("close", 60)),
    "e3_trend_efficiency_20": (21, f"CASE WHEN {over('sum', 'abs(close - pc)', 20)} = 0 THEN 0 ELSE abs(close - {lag('close', 20)}) / {over('sum', 'abs(close - pc)', 20)} END"),
    "e4_range_position_20": (20, f"CASE WHEN {over('max', 'high', 20)} > {over('min', 'low', 20)} THEN (close - {over('min', 'low', 20)}) / ({over('max', 'high', 20)} - {over('min', 'low', 20)}) END"),
    "e5_intraday_strength_20": (20, mean("intra", 20)),
    "e6_volume_surprise_5_20": (20, sma_ratio("volume", 5, 20)),
    "e7_signed_volume_momentum_20": (21, f"{period_return('close', 20)} * {ratio(mean('volume', 5), mean('volume', 20))}"),
    "e8_dollar_liquidity_20": (20, f"ln({mean('amount', 20)})"),
    "e9_parkinson_volatility_20": (20, f"sqrt({mean('lh2', 20)} / (4 * ln(2)))"),
    "e10_overnight_gap_20": (21, mean("gap", 20)),
    "e11_close_location_20": (20, mean("cl", 20)),
    "e12_ma_ratio_20_60": (60, sma_ratio("close", 20, 60)),
    "e14_trend_slope_20": (20, f"regr_slope(close, sx) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) / {mean('close', 20)}"),
    "e16_volume_ratio_20_60": (60, sma_ratio("volume", 20, 60)),
    "e17_turnover_20": (20, mean("volume / cap", 20)),
    "e18_amihud_20": (21, f"CASE WHEN {over('min', 'amount', 20)} > 0 THEN 1000000 * {mean('abs(r) / amount', 20)} END"),
    "e19_volatility_20": (21, over("stddev_pop", "r", 20)),
    "e19_volatility_60": (61, over("stddev_pop", "r", 60)),
    "e20_downside_volatility_20": (21, f"sqrt({mean('least(r, 0) * least(r, 0)', 20)})"),
    "e22_atr_20": (21, f"{mean('tr', 20)} / close"),
    "e24a_ohlc_return_high_10": (11, period_return("high", 10)),
    "e24b_volume_return_10": (11, period_return("volume", 10)),
    "e24b_amount_return_10": (11, period_return("amount", 10)),
    "e24c_volatility_10": (11, over("stddev_samp", "r", 10)),
    "e24d_risk_adjusted_return_10": (11, ratio(period_return("close", 10), over("stddev_samp", "r", 10))),
    "e24f_amihud_10": (11, f"CASE WHEN {over('min', 'amount', 10)} > 0 THEN 1000000 * {mean('abs(r) / amount', 10)} END"),
    "e24g_sma_ratio_20": (21, f"({mean('close', 5)} / {mean('close', 21)} - 1)"),
    "e24h_price_volume_interaction_10": (11, f"{period_return('close', 10)} * {period_return('volume', 10)}"),
    "e24i_price_amihud_interaction_10": (11, f"1000000 * {period_return('close', 10)} * {mean(AMIHUD, 10)}"),
    "e24j_trend_curvature_10": (11, f"({ratio('close', lag('close', 5))} - {ratio(lag('close', 5), lag('close', 10))})"),
    "e24k_breakout_position_10": (11, f"CASE WHEN {over('max', 'high', 11)} > {over('min', 'low', 11)} THEN (close - {over('min', 'low', 11)}) / ({over('max', 'high', 11)} - {over('min', 'low', 11)}) END"),
    "e24l_drawdown_recovery_10": (11, f"(close / {over('min', 'close', 11)} - 1)"),
    "e24m_downside_volatility_10": (11, f"coalesce(sqrt({mean(DOWN, 10)}), 0)"),
    "e24m_upside_volatility_10": (11, f"coalesce(sqrt({mean(UP, 10)}), 0)"),
    "e24n_range_volatility_10": (10, mean("width / close", 10)),
    "e24o_gap_mean_10": (11, mean("gap", 10)),
    "e24p_intraday_mean_10": (10, mean("intra", 10)),
    "e24q_overnight_momentum_10": (11, f"(exp({over('sum', 'ln(1 + gap)', 10)}) - 1)"),
    "e24r_volume_price_divergence_10": (11, f"({period_return('close', 10)} - {period_return('volume', 10)})"),
    "e24s_liquidity_change_10": (11, f"({ratio(mean(AMIHUD, 5), mean(AMIHUD, 5, 5))} - 1)"),
    "e24t_return_skewness_10": (11, _skew("r", 10)),
    "e24u_price_level": (1, "ln(close)"),
    "e24v_delayed_feedback_10": (11, f"least(r, 0) * {ratio('amount', mean('amount', 9, 1))}"),
    "e24w_negative_return_asymmetry_10": (11, f"({mean('least(r, 0)', 10)} - {mean('greatest(r, 0)', 10)})"),
    "e24x_overnight_intraday_divergence_10": (11, f"({mean('gap', 10)} - {mean('intra', 10)})"),
    "e24y_gap_fill_pressure_10": (11, mean("-gap * intra", 10)),
    "e24z_limit_proximity_10": (11, mean(_limit_move("r"), 10)),
    "e24z_limit_exhaustion_10": (11, mean(f"greatest({_limit_move('gap')}, 0) * -intra", 10)),
}
#: The same, with lookbacks that only the weekly panel can fill.
LONG = {"e1_period_return_120": (121, period_return("close", 120)), "e2_momentum_120_skip_20": (121, f"({ratio(lag('close', 20), lag('close', 120))} - 1)"), "e13_price_to_ma_120": (120, f"(close / {mean('close', 120)} - 1)")}


def factor_query(formula: str, sessions: int, frame: str = "bars") -> str:
    """instrument, session, value of one factor, complete windows only."""
    base = BASE.replace("{bars}", "{" + frame + "}")
    return f"SELECT instrument, session, round(value, 6) + 0.0 AS value FROM (SELECT instrument, session, CASE WHEN {complete(sessions)} THEN {formula} END AS value FROM ({base}) AS x) AS y WHERE value IS NOT NULL"


def _register(name: str, sessions: int, formula: str, panel: str) -> None:
    def text(d: Dialect, formula: str = formula, sessions: int = sessions) -> str:
        return factor_query(formula, sessions)

    operator(name, {"bars": panel})(text)


for _name, (_sessions, _formula) in PRICE.items():
    _register(_name, _sessions, _formula, "p1")
for _name, (_sessions, _formula) in LONG.items():
    _register(_name, _sessions, _formula, "p2")


@operator("e15_relative_strength_20", {"bars": "p2"})
@operator("e15_relative_strength_60", {"bars": "p2"}, n=60)
def relative_strength(d: Dialect, n: int = 20) -> str:
    """Own return less the return of the equal-weight index of closes."""
    return f"""
SELECT instrument, session, round(own - (level / nullif(before, 0) - 1), 6) + 0.0 AS value FROM (
  SELECT instrument, session, sx, CASE WHEN {complete(n + 1)} THEN {period_return('close', n)} END AS own FROM {{bars}}) AS o
JOIN (SELECT sx, level, lag(level, {n}) OVER (ORDER BY sx) AS before FROM (SELECT sx, avg(close) AS level FROM {{bars}} GROUP BY sx) AS c) AS i USING (sx)
WHERE own IS NOT NULL AND before IS NOT NULL"""


@operator("e21_max_drawdown_20", {"bars": "p1"})
@operator("e21_max_drawdown_61", {"bars": "p1"}, n=61)
def max_drawdown(d: Dialect, n: int = 20) -> str:
    return factor_query(drawdown(d, "close", n), n)


@operator("e24e_max_drawdown_10", {"bars": "p1"})
def max_drawdown_closed(d: Dialect, n: int = 10) -> str:
    """Over the n + 1 closes of n returns."""
    return factor_query(drawdown(d, "close", n + 1), n + 1)


@operator("e_factor_panel", {"bars": "p1"})
def factor_panel(d: Dialect) -> str:
    """All price factors in long form from one pass: one sort by instrument, then one unpivot."""
    columns = ", ".join(f"CASE WHEN {complete(n)} THEN CAST({f} AS DOUBLE) END AS {name}" for name, (n, f) in PRICE.items())
    names = list(PRICE)
    if d.name == "spark":
        stack = f"stack({len(names)}, " + ", ".join(f"'{x}', {x}" for x in names) + ") AS (factor_id, value)"
        return f"SELECT instrument, session, factor_id, round(value, 6) + 0.0 AS value FROM (SELECT instrument, session, {stack} FROM (SELECT instrument, session, {columns} FROM ({BASE}) AS x) AS y) AS z WHERE value IS NOT NULL"
    return f"SELECT instrument, session, factor_id, round(value, 6) + 0.0 AS value FROM (UNPIVOT (SELECT instrument, session, {columns} FROM ({BASE}) AS x) ON {', '.join(names)} INTO NAME factor_id VALUE value) AS z WHERE value IS NOT NULL"


@operator("e23_generic", {"bars": "p1"})
def generic(d: Dialect, f: str = "volume", g: str = "amount", n: int = 10) -> str:
    """The generic builders on any field f, some against a second field g; division by zero is null."""
    change = f"({ratio(f, lag(f, 1))} - 1)"
    columns = {"mean": mean(f, n), "sma_ratio": sma_ratio(f, max(2, n // 2), n), "relative_strength": f"{period_return(f, n)} - {period_return(g, n)}", "volatility": over("stddev_pop", "chg", n), "amihud": f"1000000 * {mean(f'abs(chg) / nullif({g}, 0)', n)}", "max_drawdown": drawdown(d, f, n)}
    picked = ", ".join(f"round(CASE WHEN {complete(n + 1)} THEN {x} END, 6) + 0.0 AS {name}" for name, x in columns.items())
    return f"SELECT * FROM (SELECT instrument, session, {picked} FROM (SELECT *, {change} AS chg FROM {{bars}}) AS x) AS y WHERE mean IS NOT NULL"


# --- presets over several sources ------------------------------------------------------------------

#: Source fields, bound in this order to the order-flow columns amount_1..5, n_1..5.
FIELDS = ["auction_amount", "auction_return", "auction_volume_ratio_1", "chip_cost_15", "chip_cost_5", "chip_cost_50", "chip_cost_85", "chip_cost_95", "chip_weighted_cost", "chip_win_rate", "extra_large_buy_amount", "extra_large_sell_amount", "kpl_close_seal_amount", "kpl_float_market_cap", "kpl_limit_up_flag", "kpl_main_net_amount", "kpl_max_seal_amount", "kpl_turnover_amount", "large_buy_amount", "large_sell_amount", "margin_financing_balance", "margin_financing_buy", "margin_financing_repay", "net_inflow_amount"]
COLUMNS = [*(f"amount_{k}" for k in range(1, 6)), *(f"n_{k}" for k in range(1, 6))]


def share(x: str, n: int) -> str:
    """Mean of a flow against mean turnover; the added one keeps it finite."""
    return f"({mean(x, n)} / ({mean('amount', n)} + 1.0))"


def net(kind: str, n: int) -> str:
    return f"({mean(f'{kind}_buy_amount', n)} - {mean(f'{kind}_sell_amount', n)})"


def net_share(kind: str, n: int) -> str:
    return f"({net(kind, n)} / ({mean('amount', n)} + 1.0))"


def financing(n: int) -> str:
    return f"(({mean('margin_financing_buy', n)} - {mean('margin_financing_repay', n)}) / ({mean('amount', n)} + 1.0))"


def activity(n: int) -> str:
    return f"({mean('margin_financing_buy', n)} / ({mean('margin_financing_repay', n)} + 1.0))"


def band(n: int) -> str:
    """Width of the holder-cost band against the weighted cost."""
    return f"(({mean('chip_cost_85', n)} - {mean('chip_cost_15', n)}) / ({mean('chip_weighted_cost', n)} + 1.0))"


def tail(n: int) -> str:
    return f"((({mean('chip_cost_95', n)} - {mean('chip_cost_50', n)}) - ({mean('chip_cost_50', n)} - {mean('chip_cost_5', n)})) / ({mean('chip_weighted_cost', n)} + 1.0))"


COST_GAP = f"({mean('close', 5)} / ({mean('chip_weighted_cost', 5)} + 1.0) - 1.0)"
WIN_RATE = f"({mean('chip_win_rate', 5)} - {mean('chip_win_rate', 20)})"
R, BALANCE = period_return, "margin_financing_balance"


def risk_adjusted(n: int) -> str:
    return f"({R('close', n)} / ({over('stddev_pop', 'r', n)} + 0.000001))"


def amihud(n: int) -> str:
    return mean("abs(r) / nullif(amount, 0)", n)


def presets(d: Dialect) -> dict[str, tuple[int, str]]:
    """Preset number -> (sessions, formula); the counter-direction of each is its negative."""
    flow, dd = "net_inflow_amount", lambda n: f"({R('close', n)} / (-({drawdown(d, 'close', n)}) + 0.000001))"
    out = {
        1: (21, R("close", 20)), 2: (6, R("close", 5)), 3: (21, risk_adjusted(20)), 4: (20, mean(flow, 20)), 5: (20, mean("auction_return", 20)),
        6: (20, ratio(mean("margin_financing_buy", 20), mean(BALANCE, 20))), 7: (20, share(flow, 20)), 8: (20, net_share("large", 20)), 9: (20, net_share("extra_large", 20)),
        10: (21, f"{share(flow, 20)} - {R('close', 20)}"), 11: (20, share("margin_financing_buy", 20)), 12: (20, financing(20)), 13: (20, f"{mean('auction_return', 20)} * {mean('auction_volume_ratio_1', 20)}"),
        14: (20, share("auction_amount", 20)), 15: (21, f"{share(flow, 20)} * {R('close', 20)}"), 16: (20, f"{share('margin_financing_buy', 20)} + {share(flow, 20)}"),
        17: (20, f"{share('margin_financing_buy', 5)} - {share('margin_financing_buy', 20)}"),
        18: (20, f"{share('margin_financing_buy', 5)} - {share('margin_financing_buy', 20)} + {net_share('extra_large', 5)} - {net_share('extra_large', 20)}"),
        19: (6, f"{mean('auction_return', 5)} - {R('close', 5)}"), 20: (21, amihud(20)), 21: (21, f"{R(BALANCE, 20)} * {R('close', 20)}"),
        22: (20, f"{net_share('extra_large', 5)} - {net_share('extra_large', 20)} - ({share('margin_financing_buy', 5)} - {share('margin_financing_buy', 20)})"),
        23: (5, COST_GAP), 24: (5, f"{mean('chip_win_rate', 5)} * {COST_GAP}"), 25: (6, f"{R('close', 5)} * (1.0 - {band(5)})"), 26: (20, WIN_RATE), 27: (20, f"{band(5)} - {band(20)}"),
        28: (6, f"{R('chip_weighted_cost', 5)} * {R('close', 5)}"), 29: (20, mean("kpl_limit_up_flag", 20)), 30: (5, share("kpl_main_net_amount", 5)),
        31: (5, f"{mean('kpl_close_seal_amount', 5)} / ({mean('kpl_turnover_amount', 5)} + 1.0)"), 32: (61, f"{share(flow, 60)} - {R('close', 60)}"),
        33: (60, f"{share(flow, 5)} - {share(flow, 60)}"), 34: (60, f"{share(flow, 20)} - {share(flow, 60)}"), 35: (60, f"{net_share('large', 5)} - {net_share('large', 60)}"),
        36: (60, f"{net_share('extra_large', 5)} - {net_share('extra_large', 60)}"), 37: (21, f"{share(flow, 20)} * -{R('close', 20)}"), 38: (21, R("close", 20)), 39: (60, net_share("large", 60)),
        40: (21, risk_adjusted(20)), 41: (61, risk_adjusted(60)), 42: (21, dd(20)), 43: (61, dd(60)), 44: (21, amihud(20)), 45: (61, amihud(60)), 46: (60, f"{share(flow, 5)} - {share(flow, 60)}"),
        47: (60, f"{net('large', 5)} / ({mean('large_buy_amount', 60)} + {mean('large_sell_amount', 60)} + 1.0)"), 48: (60, f"{net('extra_large', 5)} / ({mean('extra_large_buy_amount', 60)} + {mean('extra_large_sell_amount', 60)} + 1.0)"),
        49: (20, f"({net('large', 20)} - {net('extra_large', 20)}) / ({mean('large_buy_amount', 20)} + {mean('large_sell_amount', 20)} + 1.0)"), 50: (21, R(BALANCE, 20)), 51: (20, sma_ratio(BALANCE, 5, 20)),
        52: (5, activity(5)), 53: (20, WIN_RATE), 54: (20, band(20)), 55: (20, tail(20)), 56: (21, R("chip_weighted_cost", 20)), 57: (21, f"{share(flow, 20)} * -{R('close', 20)}"),
        58: (21, f"{share(flow, 20)} / ({over('stddev_pop', 'r', 20)} + 0.000001)"), 59: (21, f"{R(BALANCE, 20)} - {R('close', 20)}"), 60: (20, financing(20)), 61: (5, COST_GAP),
        62: (21, f"{R('close', 20)} - {R('chip_weighted_cost', 20)}"), 63: (21, f"{R('close', 20)} * (1.0 - {band(20)})"), 64: (20, f"{share(flow, 20)} * {financing(20)}"),
        65: (21, f"{net_share('large', 20)} * {R(BALANCE, 20)}"), 66: (20, f"{net_share('extra_large', 20)} * {activity(20)}"), 67: (20, f"({share(flow, 5)} - {share(flow, 20)}) * {sma_ratio(BALANCE, 5, 20)}"),
        68: (20, f"{share(flow, 20)} * {COST_GAP}"), 69: (20, f"{net_share('large', 20)} * {WIN_RATE}"), 70: (20, f"{net_share('extra_large', 20)} * (1.0 - {band(20)})"),
        71: (20, f"({share(flow, 5)} - {share(flow, 20)}) * {tail(20)}"), 72: (20, f"{financing(20)} * {COST_GAP}"), 73: (21, f"{R(BALANCE, 20)} * {R('chip_weighted_cost', 20)}"),
        74: (20, f"{activity(20)} * {WIN_RATE}"), 75: (20, f"{sma_ratio(BALANCE, 5, 20)} * (1.0 - {band(20)})"), 76: (21, f"{risk_adjusted(20)} * {share(flow, 20)}"), 77: (21, f"{dd(20)} * {financing(20)}"),
        78: (21, f"{amihud(20)} * {share(flow, 20)}"), 79: (21, f"{risk_adjusted(20)} * (1.0 - {band(20)})"), 80: (5, financing(5)), 81: (21, f"{R(BALANCE, 20)} - {R('close', 20)}"),
        82: (5, f"{mean('auction_return', 5)} * {mean('auction_volume_ratio_1', 5)}"), 83: (6, f"{share('auction_amount', 5)} * (0.0 - {R('close', 5)})"),
        84: (5, f"{mean('kpl_close_seal_amount', 5)} / ({mean('kpl_max_seal_amount', 5)} + 1.0)"), 85: (5, f"{mean('kpl_main_net_amount', 5)} / ({mean('kpl_float_market_cap', 5)} + 1.0)"),
    }
    return out


#: Bars with every source field joined by instrument and session, and the previous close.
SOURCES = (
    "SELECT b.*, close / pc - 1 AS r, " + ", ".join(f"f.{COLUMNS[i % 10]} AS {name}" for i, name in enumerate(FIELDS)) + " FROM (SELECT *, CASE WHEN sx - lag(sx, 1) OVER (PARTITION BY instrument ORDER BY sx) = 1 THEN lag(close, 1) OVER (PARTITION BY instrument ORDER BY sx) END AS pc FROM {bars}) AS b"
    " JOIN {flow} AS f ON f.instrument = b.instrument AND f.session = b.session"
)


def preset_query(d: Dialect, number: int) -> str:
    sessions, formula = presets(d)[number]
    digits = 1 if number in (13, 82) else 6  # products of two amounts: ten digits before the point
    return f"SELECT instrument, session, round(value, {digits}) + 0.0 AS value, round(-value, {digits}) + 0.0 AS inverse FROM (SELECT instrument, session, CASE WHEN {complete(sessions)} THEN CAST({formula} AS DOUBLE) END AS value FROM ({SOURCES}) AS x) AS y WHERE value IS NOT NULL"


def _register_preset(number: int) -> None:
    def text(d: Dialect, number: int = number) -> str:
        return preset_query(d, number)

    operator(f"e28_preset_{number:02d}", {"bars": "p2", "flow": "p4"})(text)


for _number in range(1, 86):
    _register_preset(_number)
