"""A store of source fields, each known at times of its own, and all presets over it in one plan.

The store is long: a row for each instrument, session, field, time at which it became known, and value.
Every decision takes each field's latest value known before it; fields are pivoted once, after each row
has been put to the first decision that may see it, and carried on from there.
"""

from __future__ import annotations

from panelforge.functions.factors import FIELDS, complete, presets
from panelforge.operators.base import Dialect, operator
from panelforge.operators.sqlkit import r6

#: The presets' names in the order of their numbers.
PRESET_NAMES = [
    "price_momentum",
    "price_reversal",
    "risk_adjusted_momentum",
    "fund_flow_pressure",
    "auction_strength",
    "margin_financing_demand",
    "fund_flow_intensity",
    "large_flow_intensity",
    "extra_large_flow_intensity",
    "flow_price_divergence",
    "margin_buy_intensity",
    "margin_balance_surprise",
    "auction_liquidity_strength",
    "auction_amount_intensity",
    "flow_confirmation",
    "margin_flow_confirmation",
    "margin_demand_acceleration_5_20",
    "leveraged_informed_acceleration_5_20",
    "auction_price_absorption_5",
    "liquidity_stress_reversal_20",
    "margin_crowding_reversal_20",
    "cash_absorbs_deleveraging_5_20",
    "chip_cost_gap_reversal_5",
    "chip_profit_crowding_reversal_5",
    "chip_concentrated_momentum_5",
    "chip_win_rate_acceleration_5_20",
    "chip_cost_band_compression_5_20",
    "chip_cost_basis_momentum_confirmation_5",
    "limit_up_persistence_20",
    "limit_up_main_net_intensity_5",
    "limit_up_seal_strength_5",
    "flow_price_divergence_parent",
    "fund_flow_surprise_5_60",
    "fund_flow_surprise_20_60",
    "large_flow_surprise_5_60",
    "extra_large_flow_surprise_5_60",
    "flow_reversal_interaction",
    "price_reversal_control",
    "large_flow_control",
    "price_risk: twenty-day risk-adjusted momentum",
    "price_risk: sixty-day risk-adjusted momentum",
    "price_path: twenty-day return-to-drawdown",
    "price_path: sixty-day return-to-drawdown",
    "liquidity: twenty-day amihud pressure",
    "liquidity: sixty-day amihud pressure",
    "fund_flow_surprise: net-flow five-versus-sixty surprise",
    "fund_flow_surprise: large-order five-versus-sixty surprise",
    "fund_flow_surprise: extra-large-order five-versus-sixty surprise",
    "fund_flow_composition: large-versus-extra-large flow composition",
    "margin_demand: margin-balance momentum",
    "margin_demand: margin-balance trend",
    "margin_demand: margin buy-to-repay pressure",
    "chip_structure: chip win-rate acceleration",
    "chip_structure: chip central dispersion",
    "chip_structure: chip tail asymmetry",
    "chip_structure: weighted holder-cost momentum",
    "flow_price_interaction: normalized flow during price weakness",
    "flow_price_interaction: flow per unit volatility",
    "margin_price_interaction: leverage-price divergence",
    "margin_price_interaction: net financing pressure by turnover",
    "chip_price_interaction: price-to-holder-cost gap",
    "chip_price_interaction: price-versus-holder-cost momentum",
    "chip_price_interaction: momentum conditioned by chip concentration",
    "flow_margin_confirmation: net-flow and financing confirmation",
    "flow_margin_confirmation: large-flow and financing-balance confirmation",
    "flow_margin_confirmation: extra-large flow and financing activity",
    "flow_margin_confirmation: flow impulse and margin trend",
    "flow_chip_confirmation: flow and holder-cost gap",
    "flow_chip_confirmation: large flow and win-rate acceleration",
    "flow_chip_confirmation: extra-large flow conditioned by chip concentration",
    "flow_chip_confirmation: flow impulse and chip-tail asymmetry",
    "margin_chip_confirmation: financing pressure and holder-cost gap",
    "margin_chip_confirmation: financing-balance and holder-cost migration",
    "margin_chip_confirmation: financing activity and win-rate acceleration",
    "margin_chip_confirmation: margin trend conditioned by chip concentration",
    "path_confirmation: risk-adjusted return and net-flow confirmation",
    "path_confirmation: return-to-drawdown and financing confirmation",
    "path_confirmation: illiquidity absorption",
    "path_confirmation: risk-adjusted return conditioned by chip concentration",
    "margin_net_demand_intensity_5",
    "margin_balance_price_divergence_20",
    "auction_liquidity_pressure_5",
    "auction_amount_absorption_5",
    "limit_seal_retention_5",
    "limit_main_flow_to_float_cap_5",
]

#: A decision on a session's bar is made at noon of its date; bars are weekly, dated by their Monday.
NOON = 12


def asof_text(d: Dialect) -> str:
    """(instrument, session, one column a field): what is known before noon of each bar's session."""
    last = lambda x: f"last({x}, true)" if d.name == "spark" else f"last_value({x} IGNORE NULLS)"
    own = lambda f, x: f"CASE WHEN field = '{f}' THEN {x} END"
    carried = ", ".join(f"{last(f)} OVER (PARTITION BY instrument ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {f}" for f in FIELDS)
    return f"""
SELECT b.instrument, b.session, {', '.join(f'c.{f}' for f in FIELDS)} FROM {{bars}} AS b JOIN (
  SELECT instrument, session, {carried} FROM (
    SELECT k.instrument, k.session, {', '.join(f'w.{f}' for f in FIELDS)} FROM (
      SELECT instrument, session FROM {{bars}} UNION SELECT instrument, {seen_text()} FROM {{store}}) AS k
    LEFT JOIN (SELECT instrument, {seen_text()} AS session, {', '.join(f"max_by({own(f, 'value')}, {own(f, 'available_at')}) AS {f}" for f in FIELDS)} FROM {{store}} GROUP BY instrument, {seen_text()}) AS w
      ON w.instrument = k.instrument AND w.session = k.session) AS j) AS c
ON c.instrument = b.instrument AND c.session = b.session"""


def seen_text() -> str:
    """The first Monday whose noon comes after available_at."""
    return f"CAST(date_trunc('week', available_at + INTERVAL {7 * 24 - NOON} HOUR) AS DATE)"


@operator("e28_field_store", {"bars": "p2", "store": "store"})
def field_store(d: Dialect) -> str:
    return f"SELECT instrument, session, {', '.join(f'{r6(f)} AS {f}' for f in FIELDS)} FROM ({asof_text(d)}) AS s"


@operator("e28_presets_by_fields", {"bars": "p2", "store": "store"})
def presets_by_fields(d: Dialect) -> str:
    """All presets of a bar in one row, over twenty-four series that differ; incomplete ones are null."""
    formulas = presets(d)
    columns = ", ".join(f"CASE WHEN {complete(n)} THEN CAST({formula} AS DOUBLE) END AS p{number:02d}" for number, (n, formula) in sorted(formulas.items()))
    rounded = ", ".join(f"round(p{number:02d}, {1 if number in (13, 82) else 6}) + 0.0 AS p{number:02d}" for number in sorted(formulas))
    before = "OVER (PARTITION BY instrument ORDER BY sx)"
    return f"""
SELECT instrument, session, {rounded} FROM (SELECT instrument, session, {columns} FROM (
  SELECT b.*, close / pc - 1 AS r, {', '.join(f'f.{x}' for x in FIELDS)} FROM (SELECT *, CASE WHEN sx - lag(sx, 1) {before} = 1 THEN lag(close, 1) {before} END AS pc FROM {{bars}}) AS b
  JOIN ({asof_text(d)}) AS f ON f.instrument = b.instrument AND f.session = b.session) AS x) AS y"""


def preset_number(name: str) -> int:
    """The number of a preset by its name."""
    return PRESET_NAMES.index(name) + 1
