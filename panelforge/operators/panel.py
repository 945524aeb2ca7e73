"""Panel operators: sources, audits, filters, as-of joins, universes (all point in time)."""

from __future__ import annotations

import functools

from panelforge.operators.base import Dialect, operator
from panelforge.operators.sqlkit import RETURNS, XS, ordinal, r6, size

P1, P2, EV, OBS = {"bars": "p1"}, {"bars": "p2"}, {"ev": "ev"}, {"obs": "obs"}
VENDOR, REVS = {"bars": "vendor"}, {"revs": "revs"}
W = "PARTITION BY instrument ORDER BY sx"
FLAGS = "high < greatest(open, close) OR low > least(open, close) OR least(open, high, low, close) <= 0 OR volume < 0 OR amount < 0"


#: What the first entry of a ledger names as its predecessor's hash.
GENESIS = "0" * 64


def text_type(d: Dialect) -> str:
    return "STRING" if d.name == "spark" else "VARCHAR"


# --- sources and sinks -----------------------------------------------------------------------------


@operator("a1_daily_bars", VENDOR)
def daily_bars(d: Dialect, adjustment: str = "adjustment", date_from_file: str = "file_sx") -> str:
    """Vendor units to canonical ones: lots to shares, thousands to units, prices times the adjustment
    column; a row whose own date is not that of its file is marked, not dropped."""
    price = ", ".join(f"{r6(f'{c} * {adjustment}')} AS {c}" for c in ("open", "high", "low", "close"))
    return f"SELECT instrument, session, {price}, round(volume * 100, 2) AS volume, round(amount * 1000, 0) AS amount, sx, sx <> {date_from_file} AS quarantined FROM {{bars}}"


@operator("a2_select_sessions", P2)
def select_sessions(d: Dialect, start: str = "1997-01-01", end: str = "1998-12-31", include_next: bool = True) -> str:
    """Sessions of a range, with the first one after it if asked for."""
    extra = f" OR session = (SELECT min(session) FROM {{bars}} WHERE session > DATE '{end}')" if include_next else ""
    return f"SELECT instrument, session, {r6('close')} AS close FROM {{bars}} WHERE session BETWEEN DATE '{start}' AND DATE '{end}'{extra}"


#: What each kind of alternative source measures in, and when it takes effect and is known.
ALTERNATIVES = {
    "click": ("flow", 10000.0, "15:00:00", "18:00:00", 0), "error": ("limit_event", 1.0, "15:00:00", "20:00:00", 0), "purchase": ("margin", 10000.0, "15:00:00", "09:00:00", 1),
    "signup": ("fundamental", 100.0, "00:00:00", "09:00:00", 1), "view": ("auction", 1000.0, "09:25:00", "09:26:00", 0), "*": ("chip", 1.0, "15:00:00", "21:00:00", 0),
}


@operator("a4_read_alternative", {"cells": "p3"})
def read_alternative(d: Dialect, kinds: dict = ALTERNATIVES, lag_days: int = 0) -> str:
    """Long observations of six kinds of source: values in base units, and the stamps at which they take
    effect and become known (some kinds a day later, all of them lag_days on top)."""
    default = kinds["*"]
    pick = lambda i, show: "CASE event_type " + " ".join(f"WHEN '{k}' THEN {show(v[i])}" for k, v in kinds.items() if k != "*") + f" ELSE {show(default[i])} END"
    quoted, number = lambda x: f"'{x}'", lambda x: f"{x}e0" if isinstance(x, float) else str(x)
    later = f"({pick(4, number)} + {lag_days})"
    day = f"date_add(session, {later})" if d.name == "spark" else f"(session + {later}::INTEGER)::DATE"
    stamp = lambda date, clock: f"CAST(concat(CAST({date} AS {text_type(d)}), ' ', {clock}) AS TIMESTAMP)"
    return f"SELECT instrument, event_type AS field, {pick(0, quoted)} AS kind, session, round(value * {pick(1, number)}, 2) AS value, {stamp('session', pick(2, quoted))} AS effective_at, {stamp(day, pick(3, quoted))} AS available_at FROM {{cells}}"


@operator("a5_densify", {"cells": "p3"})
def densify(d: Dialect) -> str:
    """Full user by day grid of a sparse event: absent is 0 with flag 0, present-but-missing stays null."""
    return f"""
WITH days AS (SELECT DISTINCT session FROM {{cells}}), names AS (SELECT DISTINCT instrument FROM {{cells}}),
e AS (SELECT instrument, session, max(value) AS value, max_by(value, abs(value)) AS largest FROM {{cells}} WHERE event_type = 'error' GROUP BY instrument, session)
SELECT n.instrument, t.session, CASE WHEN e.instrument IS NULL THEN 0e0 ELSE e.value END AS value, CASE WHEN e.instrument IS NULL THEN 0e0 ELSE e.largest END AS largest, CASE WHEN e.instrument IS NULL THEN 0 ELSE 1 END AS flag
FROM days AS t CROSS JOIN names AS n LEFT JOIN e ON e.instrument = n.instrument AND e.session = t.session"""


@operator("a9_read_labels", P1)
def read_labels(d: Dialect) -> str:
    return "SELECT session, instrument, grp AS label FROM {bars} WHERE grp IS NOT NULL"


@operator("a12_coverage", EV)
def coverage(d: Dialect, cutoff: str = "2024-01-10") -> str:
    """Sessions of each source after a cut-off, its latest one, and how many all sources share."""
    return f"""
WITH s AS (SELECT DISTINCT event_type AS source, CAST(ts AS DATE) AS session FROM {{ev}} WHERE CAST(ts AS DATE) > DATE '{cutoff}'),
c AS (SELECT count(*) AS common FROM (SELECT session FROM s GROUP BY session HAVING count(*) = (SELECT count(DISTINCT source) FROM s)) AS x)
SELECT source, count(*) AS sessions, max(session) AS latest, max(common) AS common FROM s, c GROUP BY source"""


@operator("a13_announcements", REVS)
def announcements(d: Dialect) -> str:
    """Exact duplicates dropped and counted, keys with differing rows quarantined; a nominal row is known
    one day after it was announced, an actual one when it was announced and published."""
    key = "user_id, event_type, CAST(visible_at AS DATE)"
    return f"""
SELECT event_type, nominal, count(*) AS raw, CAST(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicates, CAST(sum(CASE WHEN k = 1 AND variants > 1 THEN 1 ELSE 0 END) AS BIGINT) AS quarantined, CAST(sum(CASE WHEN k = 1 AND variants = 1 THEN 1 ELSE 0 END) AS BIGINT) AS admitted, CAST(sum(CASE WHEN k = 1 AND variants = 1 AND available_at < known_at THEN 1 ELSE 0 END) AS BIGINT) AS early, min(CASE WHEN k = 1 AND variants = 1 THEN known_at END) AS first_known FROM (
  SELECT *, CASE WHEN nominal THEN announced_at + INTERVAL 1 DAY ELSE greatest(announced_at, published_at) END AS known_at, max(variant) OVER (PARTITION BY {key}) AS variants FROM (
    SELECT *, dense_rank() OVER (PARTITION BY {key} ORDER BY round(value, 0)) AS variant, row_number() OVER (PARTITION BY {key}, round(value, 0) ORDER BY event_id) AS k FROM {{revs}}) AS a) AS b GROUP BY event_type, nominal"""


# --- validation and audit --------------------------------------------------------------------------


@operator("b1_bar_violations", P1)
def bar_violations(d: Dialect) -> str:
    return f"SELECT grp, count(*) AS bars, CAST(sum(CASE WHEN {FLAGS} THEN 1 ELSE 0 END) AS BIGINT) AS violations, CAST(sum(CASE WHEN high = low THEN 1 ELSE 0 END) AS BIGINT) AS flat FROM {{bars}} GROUP BY grp"


@operator("b2_layer_audit", VENDOR)
def layer_audit(d: Dialect, value: str = "close_seen") -> str:
    """Missing cells, duplicate keys and changes against the last non-blank value, in one pass."""
    return f"""
WITH p AS (SELECT *, {'last(' + value + ', true)' if d.name == 'spark' else 'last_value(' + value + ' IGNORE NULLS)'} OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS px FROM {{bars}})
SELECT count(*) AS cells, CAST(sum(CASE WHEN {value} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, {r6(f'avg(CASE WHEN {value} IS NULL THEN 1e0 ELSE 0e0 END)')} AS missing_rate, count(*) - {d.distinct('instrument', 'sx')} AS duplicates, CAST(sum(CASE WHEN {FLAGS} THEN 1 ELSE 0 END) AS BIGINT) AS invalid, count(DISTINCT instrument) AS instruments, min(session) AS first_session, max(session) AS last_session, CAST(sum(CASE WHEN {value} <> px THEN 1 ELSE 0 END) AS BIGINT) AS changes FROM p"""


@operator("b3_admit_fields", VENDOR)
def admit_fields(d: Dialect, fields: tuple = ("close", "close_thin", "volume", "cap_thin", "close_seen"), mandatory: tuple = ("close", "close_seen")) -> str:
    """Admission class of each field by its missing rate and whether it is mandatory, from one scan."""
    rates = ", ".join(f"avg(CASE WHEN {x} IS NULL THEN 1e0 ELSE 0e0 END) AS {x}" for x in fields)
    pick = "CASE field " + " ".join(f"WHEN '{x}' THEN r.{x}" for x in fields) + " END"
    must = "field IN (" + ", ".join(f"'{x}'" for x in mandatory) + ")"
    return f"SELECT field, {r6('rate')} AS missing_rate, CASE WHEN must AND rate > 0.05 THEN 'REJECT' WHEN rate = 0 THEN 'A' WHEN rate <= 0.05 THEN 'B' WHEN rate <= 0.5 THEN 'C' ELSE 'REJECT' END AS class FROM (SELECT field, {pick} AS rate, {must} AS must FROM (SELECT {rates} FROM {{bars}}) AS r {d.explode(d.array(list(fields)), 'field')}) AS f"


_LABELS = "SELECT instrument, session, year(session) AS y, CASE WHEN n_1 >= n_2 AND n_1 >= n_3 AND n_1 >= n_4 AND n_1 >= n_5 THEN '1' WHEN n_2 >= n_3 AND n_2 >= n_4 AND n_2 >= n_5 THEN '2' WHEN n_3 >= n_4 AND n_3 >= n_5 THEN '3' WHEN n_4 >= n_5 THEN '4' ELSE '5' END AS label FROM {flow}"


@operator("b4_label_audit", {"flow": "p4"})
def label_audit(d: Dialect) -> str:
    """Yearly Jensen-Shannon divergence (log 2) of the label shares against the year before."""
    return f"""
WITH l AS ({_LABELS}), s AS (SELECT y, label, count(*) / CAST(sum(count(*)) OVER (PARTITION BY y) AS DOUBLE) AS p FROM l GROUP BY y, label),
k AS (SELECT DISTINCT label FROM s), ys AS (SELECT DISTINCT y FROM s), g AS (SELECT ys.y, k.label, coalesce(s.p, 0e0) AS p FROM ys CROSS JOIN k LEFT JOIN s ON s.y = ys.y AND s.label = k.label),
j AS (SELECT a.y, a.label, a.p AS p, b.p AS q, (a.p + b.p) / 2 AS m FROM g AS a JOIN g AS b ON a.label = b.label AND a.y = b.y + 1)
SELECT y, {r6('sum(CASE WHEN p > 0 THEN 0.5e0 * p * log2(p / m) ELSE 0 END + CASE WHEN q > 0 THEN 0.5e0 * q * log2(q / m) ELSE 0 END)')} AS divergence FROM j GROUP BY y"""


@operator("b4_label_transitions", {"flow": "p4"})
def label_transitions(d: Dialect, at_least: int = 20) -> str:
    return f"SELECT instrument, count(*) AS labels, CAST(sum(CASE WHEN label <> before THEN 1 ELSE 0 END) AS BIGINT) AS transitions FROM (SELECT *, lag(label, 1) OVER (PARTITION BY instrument ORDER BY session) AS before FROM ({_LABELS}) AS l) AS x GROUP BY instrument HAVING count(*) >= {at_least}"


@operator("b5_timing_audit", OBS)
def timing_audit(d: Dialect) -> str:
    """Signals must be taken by the time they are known, and known before their label starts; labels
    must not end before they start, keys must be unique and values finite."""
    odd = lambda x: f"{x} IS NULL OR isnan({x}) OR abs({x}) = CAST('Infinity' AS DOUBLE)"
    count = lambda x: f"CAST(sum(CASE WHEN {x} THEN 1 ELSE 0 END) AS BIGINT)"
    return f"""
SELECT factor_id, horizon, count(*) AS observations, {count('feature_at IS NULL OR label_start IS NULL OR feature_at >= label_start')} AS late_signals, {count('signal_at IS NULL OR signal_at > feature_at')} AS early_signals, {count('label_end IS NULL OR label_end < label_start')} AS bad_labels, count(*) - {d.distinct('sx', 'instrument')} AS duplicates, {count(f"{odd('v')} OR {odd('fwd')}")} AS not_finite FROM {{obs}} GROUP BY factor_id, horizon"""


@operator("b6_overlap_audit", OBS)
def overlap_audit(d: Dialect) -> str:
    """Return windows of neighbouring sessions that run into each other (touching is fine)."""
    return "SELECT factor_id, horizon, count(*) AS sections, CAST(sum(CASE WHEN nxt < sx + horizon THEN 1 ELSE 0 END) AS BIGINT) AS overlapping FROM (SELECT factor_id, horizon, sx, lead(sx, 1) OVER (PARTITION BY factor_id, horizon ORDER BY sx) AS nxt FROM (SELECT DISTINCT factor_id, horizon, sx FROM {obs}) AS s) AS t GROUP BY factor_id, horizon"


def _tally(**conditions: str) -> str:
    return ", ".join(f"CAST(sum(CASE WHEN {x} THEN 1 ELSE 0 END) AS BIGINT) AS {name}" for name, x in conditions.items())


@operator("b7_revision_violations", REVS)
def revision_violations(d: Dialect) -> str:
    """A chain's first row names no predecessor, every later one the revision before it; no row is
    available before it was announced and published, nominal ones not before the next day."""
    chain = "OVER (PARTITION BY user_id, event_type ORDER BY visible_at, event_id)"
    return f"""
SELECT event_type, count(*) AS rows_seen, {_tally(false_start='k = 1 AND predecessor IS NOT NULL', unlinked='k > 1 AND predecessor IS NULL', mislinked='k > 1 AND predecessor <> before', early='NOT nominal AND available_at < greatest(announced_at, published_at)', nominal_early='nominal AND available_at < announced_at + INTERVAL 1 DAY')}
FROM (SELECT *, row_number() {chain} AS k, lag(event_id, 1) {chain} AS before FROM {{revs}}) AS e GROUP BY event_type"""


@operator("b8_interval_overlaps", REVS)
def interval_overlaps(d: Dialect) -> str:
    """Intervals that end before they start, start before the one before them ends, or are open inside."""
    chain = "OVER (PARTITION BY user_id, event_type ORDER BY effective_from, event_id)"
    return f"""
SELECT event_type, count(*) AS intervals, {_tally(empty='effective_to <= effective_from', overlapping='before > effective_from', open_inside='effective_to IS NULL AND after IS NOT NULL')}
FROM (SELECT *, lag(effective_to, 1) {chain} AS before, lead(event_id, 1) {chain} AS after FROM {{revs}}) AS e GROUP BY event_type"""


@operator("b9_leakage_summary", REVS)
def leakage_summary(d: Dialect) -> str:
    """Violations of each class and whether the gate stays open."""
    return f"""
SELECT class, violations, violations = 0 AS passed FROM (
  SELECT class, CASE class WHEN 'false_start' THEN false_start WHEN 'unlinked' THEN unlinked WHEN 'mislinked' THEN mislinked WHEN 'early' THEN early ELSE nominal_early END AS violations FROM (SELECT {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('false_start', 'unlinked', 'mislinked', 'early', 'nominal_early'))} FROM ({revision_violations.text(d)}) AS a) AS x {d.explode(d.array(['false_start', 'unlinked', 'mislinked', 'early', 'nominal_early']), 'class')}
  UNION ALL SELECT class, CASE class WHEN 'empty' THEN empty WHEN 'overlapping' THEN overlapping ELSE open_inside END FROM (SELECT {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('empty', 'overlapping', 'open_inside'))} FROM ({interval_overlaps.text(d)}) AS b) AS y {d.explode(d.array(['empty', 'overlapping', 'open_inside']), 'class')}) AS z"""


@operator("b11_audit_chain", {"ledger": "ledger"})
def audit_chain(d: Dialect) -> str:
    """Every row is checked against its stored predecessor: sequence, previous hash, own hash."""
    t = text_type(d)
    own = d.sha256(f"concat(CAST(seq AS {t}), '|', previous_hash, '|', CAST(event_id AS {t}), '|', event_type)")
    count = lambda x: f"CAST(sum(CASE WHEN {x} THEN 1 ELSE 0 END) AS BIGINT)"
    return f"""
WITH p AS (SELECT *, {own} AS own_hash, coalesce(lag(seq, 1) OVER (PARTITION BY user_id ORDER BY seq, event_id), 0) AS before, row_number() OVER (PARTITION BY user_id ORDER BY seq, event_id) AS k, lag(entry_hash, 1) OVER (PARTITION BY user_id ORDER BY seq, event_id) AS stored FROM {{ledger}})
SELECT user_id, count(*) AS entries, {count('seq IS DISTINCT FROM before + 1')} AS gaps, {count(f"previous_hash IS DISTINCT FROM CASE WHEN k = 1 THEN '{GENESIS}' ELSE stored END")} AS unlinked, {count('entry_hash IS DISTINCT FROM own_hash')} AS altered, count(*) - count(DISTINCT event_id) AS repeated, max_by(entry_hash, seq) AS last_hash FROM p GROUP BY user_id"""


# --- filters and predicates ------------------------------------------------------------------------


@operator("c1_open_tradability", P1)
def open_tradability(d: Dialect, rate: float = 0.1) -> str:
    """At the upper limit an open can't be bought, at the lower one not sold; outside: no limit."""
    return f"""
SELECT instrument, session, up AS upper_limit, down AS lower_limit, NOT (open > up OR open < down) AND abs(open - up) < 0.005 AS at_upper, CASE WHEN pc IS NULL THEN NULL WHEN open > up OR open < down THEN TRUE ELSE open < up - 0.005 END AS can_buy, CASE WHEN pc IS NULL THEN NULL WHEN open > up OR open < down THEN TRUE ELSE open > down + 0.005 END AS can_sell FROM (
  SELECT *, floor(pc * {1 + rate} * 100 + 0.5e0) / 100 AS up, floor(pc * {1 - rate} * 100 + 0.5e0) / 100 AS down FROM (SELECT *, lag(close, 1) OVER ({W}) AS pc FROM {{bars}}) AS a) AS b WHERE pc IS NOT NULL"""


#: Dated price-limit rules: board, first session, rate, how good the evidence is. An example; give your own.
LIMIT_RULES = (("main", "1900-01-01", 0.1, "dated"), ("growth", "1900-01-01", 0.1, "inferred"), ("growth", "1998-01-01", 0.2, "dated"))


@operator("c2_price_limit_rule", VENDOR)
def price_limit_rule(d: Dialect, rules: tuple = LIMIT_RULES) -> str:
    """The limit rate of the bar's board that was in force on its session; unknown boards have none."""
    rows = " UNION ALL ".join(f"SELECT '{b}' AS board, DATE '{since}' AS since, {rate}e0 AS rate, '{e}' AS evidence" for b, since, rate, e in rules)
    return f"""
WITH r AS (SELECT *, lead(since, 1) OVER (PARTITION BY board ORDER BY since) AS until FROM ({rows}) AS x)
SELECT instrument, session, b.board, r.rate, coalesce(r.evidence, 'unknown') AS evidence FROM {{bars}} AS b LEFT JOIN r ON r.board = b.board AND b.session >= r.since AND (r.until IS NULL OR b.session < r.until)"""


@operator("c3_is_equity", P1)
def is_equity(d: Dialect, pattern: str = "^0000[0-4]") -> str:
    """Security type by the prefix of the six-digit code."""
    code = f"lpad(CAST(instrument AS {text_type(d)}), 6, '0')"
    match = f"{code} RLIKE '{pattern}'" if d.name == "spark" else f"regexp_matches({code}, '{pattern}')"
    return f"SELECT instrument, {match} AS is_equity, count(*) AS bars FROM {{bars}} GROUP BY instrument, {match}"


@operator("c4_adjust_prices", VENDOR)
def adjust_prices(d: Dialect, ratio: str = "ratio") -> str:
    """Prices times the product of all action ratios up to the bar's session."""
    return f"SELECT instrument, session, {r6(f'close * exp(sum(ln({ratio})) OVER (PARTITION BY instrument ORDER BY sx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))')} AS adjusted FROM {{bars}}"


@operator("c5_market_cap", P1)
def market_cap(d: Dialect) -> str:
    """Shares times price, from sessions before the decision."""
    return f"SELECT instrument, session, {r6('ln(floor(cap) * (lag(close, 1) OVER (PARTITION BY instrument ORDER BY sx)))')} AS log_market_cap FROM {{bars}}"


@operator("c6_trim_warmup", OBS)
def trim_warmup(d: Dialect, names: int = 5) -> str:
    """Sections from the first one with enough names on; all of them if none has."""
    return f"""
WITH n AS (SELECT factor_id, horizon, sx, count(*) AS c FROM {{obs}} GROUP BY factor_id, horizon, sx), f AS (SELECT factor_id, horizon, min(CASE WHEN c >= {names} THEN sx END) AS first_sx FROM n GROUP BY factor_id, horizon)
SELECT n.factor_id, n.horizon, n.sx, n.c FROM n JOIN f ON n.factor_id = f.factor_id AND n.horizon = f.horizon WHERE first_sx IS NULL OR n.sx >= first_sx"""


@operator("c7_non_overlapping", OBS)
def non_overlapping(d: Dialect, h: int = 5, names: int = 5) -> str:
    return f"SELECT factor_id, horizon, session, c FROM (SELECT *, row_number() OVER (PARTITION BY factor_id, horizon ORDER BY session) AS k FROM (SELECT factor_id, horizon, session, count(*) AS c FROM {{obs}} GROUP BY factor_id, horizon, session HAVING count(*) >= {names}) AS n) AS x WHERE (k - 1) % {h} = 0"


@operator("c8_mirror", OBS)
def mirror(d: Dialect) -> str:
    return f"SELECT factor_id, horizon, session, instrument, {r6('-v')} AS value FROM {{obs}}"


@operator("c9_fundamental_components", P1)
def fundamental_components(d: Dialect) -> str:
    """Ratios that need a positive denominator, else null."""
    return f"SELECT instrument, session, {r6('CASE WHEN close > 0 THEN cap / close END')} AS book_to_price, {r6('CASE WHEN cap > 0 THEN (close - open) / cap END')} AS earnings_to_book, {r6('CASE WHEN amount > 0 THEN (close - open) * volume / amount END')} AS margin FROM {{bars}}"


@operator("c10_confirm", {"cells": "p3"})
def confirm(d: Dialect, k: int = 2) -> str:
    """A new value counts only after k equal snapshots; until then the last confirmed one stays."""
    return f"""
WITH dom AS (SELECT instrument, session, event_type AS x FROM (SELECT *, row_number() OVER (PARTITION BY instrument, session ORDER BY n DESC, event_type DESC) AS r FROM {{cells}}) AS a WHERE r = 1),
c AS (SELECT *, CASE WHEN x = lag(x, 1) OVER (PARTITION BY instrument ORDER BY session) THEN 0 ELSE 1 END AS new FROM dom),
g AS (SELECT *, sum(new) OVER (PARTITION BY instrument ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY instrument, run ORDER BY session) AS place FROM g)
SELECT instrument, session, x AS snapshot, {'last(CASE WHEN place >= ' + str(k) + ' THEN x END, true)' if d.name == 'spark' else 'last_value(CASE WHEN place >= ' + str(k) + ' THEN x END IGNORE NULLS)'} OVER (PARTITION BY instrument ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS confirmed, place < {k} AS withheld FROM r"""


# --- joins -----------------------------------------------------------------------------------------


def last_seen(d: Dialect, x: str, part: str, order: str) -> str:
    """The last non-null x up to this row."""
    f = f"last({x}, true)" if d.name == "spark" else f"last_value({x} IGNORE NULLS)"
    return f"{f} OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@operator("d1_asof_strict", {"cells": "p3"})
def asof_strict(d: Dialect) -> str:
    """Newest value available strictly before a decision, by one union and one window; it must be
    of the day before, or the row is not eligible."""
    before = "datediff(session, seen)" if d.name == "spark" else "date_diff('day', seen, session)"
    return f"""
WITH v AS (SELECT instrument, session, value FROM {{cells}} WHERE event_type = 'click'), q AS (SELECT DISTINCT instrument, session FROM {{cells}}),
u AS (SELECT instrument, session, 0 AS kind, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS DATE) AS tm FROM q UNION ALL SELECT instrument, session, 1, value, session FROM v),
s AS (SELECT *, {last_seen(d, 'value', 'instrument', 'session, kind')} AS found, {last_seen(d, 'tm', 'instrument', 'session, kind')} AS seen FROM u)
SELECT instrument, session, found AS value, seen, coalesce({before} = 1, FALSE) AS eligible FROM s WHERE kind = 0"""


@operator("d2_multi_asof", {"bars": "p2", "flow": "p4"})
def multi_asof(d: Dialect, n: int = 4) -> str:
    """Bars with the mean of the last n order-flow rows that were visible before the week began."""
    return f"""
WITH f AS (SELECT instrument, session, avg(amount_1) OVER (PARTITION BY instrument ORDER BY session ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS m, count(*) OVER (PARTITION BY instrument ORDER BY session ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c FROM {{flow}}),
u AS (SELECT instrument, session, 0 AS kind, CAST(NULL AS DOUBLE) AS m FROM {{bars}} UNION ALL SELECT instrument, session, 1, CASE WHEN c = {n} THEN m END FROM f)
SELECT instrument, session, round(value, 4) AS value FROM (SELECT *, {last_seen(d, 'm', 'instrument', 'session, kind')} AS value FROM u) AS x WHERE kind = 0 AND value IS NOT NULL"""


@operator("d3_visible_revision", EV)
def visible_revision(d: Dialect, asof: str = "2024-01-15 00:00:00") -> str:
    return f"SELECT user_id, event_type, max(event_id) AS event_id, max(ts) AS visible_at, count(*) AS revisions FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM {{ev}} WHERE ts <= TIMESTAMP '{asof}') AS e WHERE k = 1 GROUP BY user_id, event_type"


@operator("d4_interval_asof", EV)
def interval_asof(d: Dialect) -> str:
    """Which interval of its key holds at noon of each day with an event: starts and questions in one
    ordered stream, so no range join is needed."""
    noon = "CAST(concat(CAST(CAST(ts AS DATE) AS {t}), ' 12:00:00') AS TIMESTAMP)".replace("{t}", text_type(d))
    return f"""
WITH q AS (SELECT DISTINCT user_id, event_type, {noon} AS tm FROM {{ev}}),
u AS (SELECT user_id, event_type, tm, 1 AS kind, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS TIMESTAMP) AS ts_to FROM q UNION ALL SELECT user_id, event_type, ts, 0, event_id, coalesce(ts_to, TIMESTAMP '2999-01-01 00:00:00') FROM {{ev}}),
s AS (SELECT *, {last_seen(d, 'event_id', 'user_id, event_type', 'tm, kind, event_id')} AS found, {last_seen(d, 'ts_to', 'user_id, event_type', 'tm, kind, event_id')} AS until FROM u)
SELECT user_id, event_type, tm, CASE WHEN tm < until THEN found END AS interval_id FROM s WHERE kind = 1"""


@operator("d5_pit_groups", EV)
def pit_groups(d: Dialect) -> str:
    """Latest group of each user by day; two groups at the latest moment are ambiguous."""
    return "SELECT user_id, session, count(DISTINCT event_type) > 1 AS ambiguous, min(event_type) AS grp FROM (SELECT *, CAST(ts AS DATE) AS session, rank() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY date_trunc('hour', ts) DESC) AS k FROM {ev}) AS e WHERE k = 1 GROUP BY user_id, session"


@operator("d6_execution_membership", P1)
def execution_membership(d: Dialect, n: int = 20) -> str:
    """Members decided on a session can be traded on the next one."""
    return f"WITH cal AS (SELECT session, lead(session, 1) OVER (ORDER BY session) AS execution FROM (SELECT DISTINCT session FROM {{bars}}) AS s) SELECT m.instrument, m.session AS decided, execution FROM (SELECT * FROM (SELECT instrument, session, row_number() OVER (PARTITION BY session ORDER BY amount DESC, instrument) AS k FROM {{bars}}) AS a WHERE k <= {n}) AS m JOIN cal ON cal.session = m.session WHERE execution IS NOT NULL"


@operator("d7_forward_labels", P1)
def forward_labels(d: Dialect, h: int = 3, history: int = 6) -> str:
    """open(t + h) / open(t) - 1 where the history, t and t + h are all there and turnover is known."""
    return f"""
SELECT instrument, session, {r6('label')} AS label, full_history AND label IS NOT NULL AND adv > 0 AS eligible FROM (
  SELECT instrument, session, CASE WHEN (lead(sx, {h}) OVER ({W})) - sx = {h} THEN (lead(open, {h}) OVER ({W})) / open - 1 END AS label, coalesce(sx - (lag(sx, {history}) OVER ({W})) = {history}, FALSE) AS full_history, coalesce(avg(amount) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS adv FROM {{bars}}) AS x"""


@operator("d8_match_panels", OBS)
def match_panels(d: Dialect) -> str:
    """Keys of two factors that match, and those that only one has."""
    return "SELECT horizon, CAST(sum(CASE WHEN a AND b THEN 1 ELSE 0 END) AS BIGINT) AS matched, CAST(sum(CASE WHEN a AND NOT b THEN 1 ELSE 0 END) AS BIGINT) AS only_rev5, CAST(sum(CASE WHEN b AND NOT a THEN 1 ELSE 0 END) AS BIGINT) AS only_width FROM (SELECT horizon, session, instrument, max(CASE WHEN factor_id = 'rev5' THEN 1 ELSE 0 END) = 1 AS a, max(CASE WHEN factor_id = 'width' THEN 1 ELSE 0 END) = 1 AS b FROM {obs} GROUP BY horizon, session, instrument) AS k GROUP BY horizon"


@operator("d9_benchmark_returns", P2)
def benchmark_returns(d: Dialect, h: int = 4) -> str:
    return f"WITH i AS (SELECT sx, session, avg(close) AS level FROM {{bars}} GROUP BY sx, session) SELECT a.session AS period_start, b.session AS period_end, {r6('b.level / a.level - 1')} AS bench FROM i AS a JOIN i AS b ON b.sx = a.sx + {h} WHERE a.sx % {h} = 1"


@operator("d10_peer_join", OBS)
def peer_join(d: Dialect) -> str:
    return f"SELECT a.factor_id AS fa, b.factor_id AS fb, a.horizon, count(*) AS cells, {r6('corr(a.v, b.v)')} AS pooled FROM {{obs}} AS a JOIN {{obs}} AS b ON a.horizon = b.horizon AND a.session = b.session AND a.instrument = b.instrument AND a.factor_id < b.factor_id GROUP BY a.factor_id, b.factor_id, a.horizon"


@operator("d11_missing_members", {"cells": "p3"})
def missing_members(d: Dialect) -> str:
    """Users of a day without a click row."""
    return "SELECT DISTINCT instrument, session FROM {cells} AS c WHERE NOT EXISTS (SELECT 1 FROM {cells} AS v WHERE v.event_type = 'click' AND v.instrument = c.instrument AND v.session = c.session)"


@operator("d12_grid", P1)
def grid(d: Dialect) -> str:
    """The full session by name grid (two short dimension lists) and how much of it is there."""
    return "SELECT s.session, count(*) AS cells, count(b.instrument) AS present FROM (SELECT DISTINCT session FROM {bars}) AS s CROSS JOIN (SELECT DISTINCT instrument FROM {bars}) AS n LEFT JOIN {bars} AS b ON b.session = s.session AND b.instrument = n.instrument GROUP BY s.session"


@operator("d13_overlaps", OBS)
def overlaps(d: Dialect) -> str:
    """Sessions whose label interval meets that of an earlier session: a running maximum of ends."""
    return "SELECT factor_id, horizon, sx, coalesce(latest >= sx, FALSE) AS overlaps FROM (SELECT *, max(sx + horizon) OVER (PARTITION BY factor_id, horizon ORDER BY sx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM (SELECT DISTINCT factor_id, horizon, sx FROM {obs}) AS s) AS t"


# --- rolling risk exposures ------------------------------------------------------------------------

MARKET = "SELECT sx, median(r) AS market FROM (SELECT *, close / nullif(lag(close, 1) OVER (PARTITION BY instrument ORDER BY sx), 0) - 1 AS r FROM {bars}) AS q GROUP BY sx HAVING count(r) >= 10"


@operator("e25_price_exposures", P2)
def price_exposures(d: Dialect, n: int = 20) -> str:
    """Beta, volatility, log turnover, reversal and momentum from rows before the decision."""
    frame = f"OVER ({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"""
WITH m AS ({MARKET}), x AS (SELECT b.*, close / nullif(lag(close, 1) OVER (PARTITION BY b.instrument ORDER BY b.sx), 0) - 1 AS r, market FROM {{bars}} AS b JOIN m ON m.sx = b.sx)
SELECT instrument, session, {r6('beta')} AS beta, {r6('vol')} AS volatility, {r6('liq')} AS log_adv, {r6('rev')} AS reversal FROM (
  SELECT instrument, session, count(r) {frame} AS c, covar_samp(r, market) {frame} / nullif(var_samp(market) {frame}, 0) AS beta, stddev_samp(r) {frame} AS vol, ln(avg(amount) {frame}) AS liq, (lag(close, 1) OVER ({W})) / (lag(close, 6) OVER ({W})) - 1 AS rev FROM x) AS y WHERE c = {n}"""


@operator("e26_market_proxy", P2)
def market_proxy(d: Dialect) -> str:
    return f"SELECT sx, {r6('market')} AS median_return, {r6('ln(100) + sum(ln(1 + market)) OVER (ORDER BY sx)')} AS log_level FROM ({MARKET}) AS m"


@operator("e27_style_controls", P1)
def style_controls(d: Dialect) -> str:
    return f"SELECT instrument, session, {ordinal('cap', 'session')} * 3 / {size('session')} AS size_place, {r6(f'CASE WHEN sx - (lag(sx, 20) OVER ({W})) = 20 THEN close / (lag(close, 20) OVER ({W})) - 1 END')} AS momentum FROM {{bars}}"


# --- universes -------------------------------------------------------------------------------------

#: Reason for leaving a name out of a session's universe, first match; OK otherwise.
_REASON = "CASE WHEN flagged THEN 'flagged' WHEN seen < {h} THEN 'short_history' WHEN adv < {floor} THEN 'illiquid' ELSE 'OK' END"
_DAILY = f"SELECT *, count(*) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen, avg(amount) OVER ({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS adv FROM {{bars}}"


def universe_text(h: int = 12, floor: float = 150000.0, top: int = 30) -> str:
    return f"SELECT instrument, session, sx, grp, cap, adv, row_number() OVER (PARTITION BY session ORDER BY adv DESC, instrument) AS place FROM (SELECT *, {_REASON.format(h=h, floor=floor)} AS reason FROM ({_DAILY}) AS a) AS b WHERE reason = 'OK'"


@operator("g1_training_universe", VENDOR)
def training_universe(d: Dialect, n: int = 50) -> str:
    """Names there on every session and not flagged, the n with the largest mean turnover."""
    return f"SELECT instrument, round(mean_amount, 2) AS mean_amount, place FROM (SELECT *, row_number() OVER (ORDER BY mean_amount DESC, instrument) AS place FROM (SELECT instrument, avg(amount) AS mean_amount FROM {{bars}} WHERE NOT flagged GROUP BY instrument HAVING count(*) = (SELECT count(DISTINCT session) FROM {{bars}})) AS a) AS b WHERE place <= {n}"


@operator("g2_dynamic_universe", VENDOR)
def dynamic_universe(d: Dialect, top: int = 30) -> str:
    return f"SELECT instrument, session, place FROM ({universe_text()}) AS u WHERE place <= {top}"


@operator("g3_market_universe", VENDOR)
def market_universe(d: Dialect) -> str:
    """All eligible names with flags for the largest ones and a stable hash sample."""
    code = f"CAST(instrument AS {text_type(d)})"
    return f"SELECT instrument, session, place <= 10 AS top10, place <= 50 AS top50, row_number() OVER (PARTITION BY session ORDER BY {d.sha256(code)}) <= 20 AS sampled FROM ({universe_text()}) AS u"


@operator("g4_membership_turnover", VENDOR)
def membership_turnover(d: Dialect, top: int = 30) -> str:
    return f"""
WITH m AS (SELECT instrument, session, dense_rank() OVER (ORDER BY session) AS i FROM ({universe_text()}) AS u WHERE place <= {top}), n AS (SELECT i, min(session) AS session, count(*) AS members FROM m GROUP BY i),
e AS (SELECT a.i, count(*) AS entries FROM m AS a LEFT JOIN m AS b ON a.instrument = b.instrument AND b.i = a.i - 1 WHERE b.i IS NULL GROUP BY a.i), x AS (SELECT a.i + 1 AS i, count(*) AS exits FROM m AS a LEFT JOIN m AS b ON a.instrument = b.instrument AND b.i = a.i + 1 WHERE b.i IS NULL GROUP BY a.i + 1)
SELECT n.session, n.members, coalesce(entries, 0) AS entries, CASE WHEN n.i = 1 THEN 0 ELSE coalesce(exits, 0) END AS exits, {r6('CASE WHEN n.i = 1 THEN 0 ELSE (coalesce(entries, 0) + coalesce(exits, 0)) / (2e0 * greatest(p.members, n.members, 1)) END')} AS turnover
FROM n LEFT JOIN n AS p ON p.i = n.i - 1 LEFT JOIN e ON e.i = n.i LEFT JOIN x ON x.i = n.i"""


@operator("g5_universe_report", VENDOR)
def universe_report(d: Dialect) -> str:
    return f"SELECT session, reason, count(*) AS names FROM (SELECT *, {_REASON.format(h=12, floor=150000.0)} AS reason FROM ({_DAILY}) AS a) AS b GROUP BY session, reason"


@operator("g6_forced_exits", VENDOR)
def forced_exits(d: Dialect, top: int = 30, every: int = 3) -> str:
    """Names chosen at an earlier rebalance that are no members on a session."""
    return f"""
WITH m AS (SELECT instrument, sx, place FROM ({universe_text()}) AS u WHERE place <= {top}), f AS (SELECT instrument, min(sx) AS first_sx FROM m WHERE sx % {every} = 0 AND place <= 10 GROUP BY instrument), cal AS (SELECT DISTINCT sx FROM m)
SELECT c.sx, count(*) AS exits FROM cal AS c JOIN f ON f.first_sx < c.sx LEFT JOIN m ON m.instrument = f.instrument AND m.sx = c.sx WHERE m.sx IS NULL GROUP BY c.sx"""


# --- regimes ---------------------------------------------------------------------------------------

#: Sessions whose sum a mean over sessions takes as one, where the frame holds all of them.
_RUN = 16


def _mean_before(d: Dialect, x: str, n: int = 20) -> str:
    """Mean of x over the n sessions before; for Spark over of_k, the list of the sessions before session i.

    A mean that ties its limit (half of all names rose) falls on a side of it by the order in which its
    doubles are added. Both engines add alike: an aligned run of sixteen sessions within the frame goes
    in as its own sum, other sessions one by one.
    """
    if d.name == "duckdb":
        return f"avg({x}) OVER k" if n == 20 else f"(avg({x}) OVER (ORDER BY sx ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING))"
    of, v = f"filter(of_k, e -> e.i >= i - {n})", f"coalesce(e.{x}, 0e0)"
    run = f"e.i - e.i % {_RUN} >= e.till - {n} AND e.i - e.i % {_RUN} + {_RUN} <= e.till"
    whole = f"CASE WHEN NOT ({run}) THEN a.whole + {v} WHEN e.i % {_RUN} = {_RUN - 1} THEN a.whole + (a.part + {v}) ELSE a.whole END"
    part = f"CASE WHEN {run} AND e.i % {_RUN} < {_RUN - 1} THEN a.part + {v} ELSE 0e0 END"
    held = f"transform({of}, e -> struct(e.i, e.{x}, i AS till))"
    return f"(aggregate({held}, struct(0e0 AS whole, 0e0 AS part), (a, e) -> struct({whole} AS whole, {part} AS part)).whole / nullif(size(filter({of}, e -> e.{x} IS NOT NULL)), 0))"


def regime_text(d: Dialect) -> str:
    """The regime of each session from the sessions before it."""
    daily = f"""
    SELECT sx, session, avg(r) AS mret, avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END) AS up, sum(amount) AS amt FROM (SELECT *, close / nullif(lag(close, 1) OVER ({W}), 0) - 1 AS r FROM {{bars}}) AS q GROUP BY sx, session"""
    mean = functools.partial(_mean_before, d)
    k = "(ORDER BY sx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
    if d.name == "duckdb":
        count, source = "count(*) OVER k", f"({daily}) AS a\n  WINDOW k AS {k}"
    else:
        numbered = f"SELECT *, row_number() OVER (ORDER BY sx) - 1 AS i FROM ({daily}) AS a"
        count, source = "size(of_k)", f"(SELECT *, collect_list(struct(i, mret, up, amt)) OVER {k} AS of_k FROM ({numbered}) AS b) AS l"
    return f"""
SELECT sx, session, CASE WHEN c < 20 THEN 'warmup' WHEN liq < 0.8 THEN 'liquidity_shock' WHEN trend < 0 AND breadth < 0.5 THEN 'risk_off' WHEN trend > 0 AND breadth > 0.5 THEN 'risk_on' ELSE 'mixed' END AS regime FROM (
  SELECT sx, session, {count} AS c, {mean('mret')} AS trend, {mean('up')} AS breadth, {mean('amt', 5)} / ({mean('amt')}) AS liq FROM {source}) AS b"""


@operator("i1_prior_regimes", P2)
def prior_regimes(d: Dialect) -> str:
    return f"SELECT session, regime FROM ({regime_text(d)}) AS x"


@operator("i2_trend_vol_regimes", P2)
def trend_vol_regimes(d: Dialect, n: int = 12) -> str:
    """Up or down by trailing compounded return, high or low by the median of all volatility so far."""
    frame = f"OVER (ORDER BY sx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"""
SELECT sx, CASE WHEN trend >= 0 THEN 'up' ELSE 'down' END AS trend, CASE WHEN vol > typical THEN 'high' ELSE 'low' END AS vol FROM (
  SELECT sx, trend, vol, {d.percentile('vol', 0.5)} OVER (ORDER BY sx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS typical FROM (
    SELECT sx, sum(ln(1 + market)) {frame} AS trend, stddev_samp(market) {frame} AS vol, count(*) {frame} AS c FROM ({MARKET}) AS m) AS a WHERE c = {n}) AS b"""


@operator("i3_signal_regime", OBS)
def signal_regime(d: Dialect) -> str:
    return f"SELECT {XS}, CASE WHEN {d.percentile('v', 0.5)} >= 0 THEN 'RISK_ON' ELSE 'RISK_OFF' END AS regime FROM {{obs}} GROUP BY {XS}"


@operator("i4_apply_policy", OBS)
def apply_policy(d: Dialect) -> str:
    """The reversal signal in calm sections, the control signal elsewhere, nothing if both are missing."""
    return f"""
WITH g AS (SELECT horizon, session, {d.percentile('v', 0.5)} AS mid FROM {{obs}} WHERE factor_id = 'rev5' GROUP BY horizon, session), k AS (SELECT horizon, session, instrument, max(CASE WHEN factor_id = 'rev5' THEN v END) AS a, max(CASE WHEN factor_id = 'strength' THEN v END) AS b FROM {{obs}} GROUP BY horizon, session, instrument)
SELECT k.horizon, k.session, k.instrument, {r6('CASE WHEN g.mid >= 0 THEN a ELSE b END')} AS signal, coalesce(CASE WHEN g.mid >= 0 THEN a ELSE b END IS NOT NULL, FALSE) AS eligible FROM k LEFT JOIN g ON g.horizon = k.horizon AND g.session = k.session"""


@operator("i5_performance_by_regime", {"obs": "obs2", "bars": "p2"})
def performance_by_regime(d: Dialect) -> str:
    return f"SELECT factor_id, regime, count(*) AS periods, {r6('avg(ret)')} AS mean_return, {r6('avg(ret) / nullif(stddev_samp(ret), 0)')} AS sharpe FROM ({RETURNS}) AS r JOIN ({regime_text(d)}) AS g ON g.session = r.session GROUP BY factor_id, regime"
