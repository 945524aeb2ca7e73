"""Second formulas for DuckDB: twins that share no text with the operator they check.

Most operators are rendered for DuckDB from their own text, which checks engines, nulls and ties. The
operators here are written again, by definition: pairs instead of running windows, sorted lists
instead of percentile functions, normal equations instead of successive residuals.
"""

from __future__ import annotations

from panelforge.operators.panel import universe_text
from panelforge.sources import panels

_KEYS = "factor_id, horizon, session, instrument"
_R = "round({}, 6) + 0.0"


def _r6(x: str) -> str:
    return _R.format(x)


def _quantile(values: str, p: float) -> str:
    """Linear interpolation in a sorted list."""
    at = f"({p} * (len({values}) - 1))"
    low, high = f"{values}[floor({at})::BIGINT + 1]", f"{values}[ceil({at})::BIGINT + 1]"
    return f"({low} + ({at} - floor({at})) * ({high} - {low}))"


MAX_DRAWDOWN = """
WITH w AS (SELECT b.instrument, b.session, b.sx, a.sx AS at, a.close FROM p1 b JOIN p1 a ON a.instrument = b.instrument AND a.sx BETWEEN b.sx - {n} + 1 AND b.sx),
f AS (SELECT instrument, session FROM w GROUP BY ALL HAVING count(*) = {n})
SELECT x.instrument, x.session, round(least(0, min(y.close / x.close - 1)), 6) + 0.0 AS value
FROM w x JOIN w y ON y.instrument = x.instrument AND y.session = x.session AND y.at >= x.at JOIN f ON f.instrument = x.instrument AND f.session = x.session GROUP BY ALL"""

NORMALISE = f"""
WITH q AS (SELECT factor_id, horizon, session, list_sort(list(v)) AS vs FROM obs GROUP BY ALL),
w AS (SELECT o.*, len(q.vs) AS n, CASE WHEN v < {_quantile('q.vs', 0.05)} THEN {_quantile('q.vs', 0.05)} WHEN v > {_quantile('q.vs', 0.95)} THEN {_quantile('q.vs', 0.95)} ELSE v END AS clipped FROM obs o JOIN q USING (factor_id, horizon, session)),
g AS (SELECT factor_id, horizon, session, grp, sum(clipped) / count(*) AS centre FROM w GROUP BY ALL),
c AS (SELECT w.*, clipped - centre AS e FROM w JOIN g USING (factor_id, horizon, session, grp)),
s AS (SELECT factor_id, horizon, session, sqrt(sum(e * e) / count(*)) AS scale FROM c GROUP BY ALL)
SELECT {_KEYS}, {_r6('CASE WHEN n < 3 THEN v WHEN scale = 0 THEN 0 ELSE e / scale END')} AS value FROM c JOIN s USING (factor_id, horizon, session)"""

#: Normal equations of two controls and an intercept, solved by Cramer's rule on centred values.
RESIDUALISE = f"""
WITH m AS (SELECT factor_id, horizon, session, sum(v) / count(*) AS mv, sum(ln(cap)) / count(*) AS m1, sum(ln(adv)) / count(*) AS m2 FROM obs GROUP BY ALL),
c AS (SELECT o.factor_id, o.horizon, o.session, instrument, v - mv AS y, ln(cap) - m1 AS a, ln(adv) - m2 AS b FROM obs o JOIN m USING (factor_id, horizon, session)),
s AS (SELECT factor_id, horizon, session, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS yb, count(*) AS n FROM c GROUP BY ALL),
k AS (SELECT *, aa * bb - ab * ab AS det FROM s),
z AS (SELECT factor_id, horizon, session, CASE WHEN det > 1e-9 * aa * bb THEN (ay * bb - yb * ab) / det WHEN aa > 0 THEN ay / aa ELSE 0 END AS s1, CASE WHEN det > 1e-9 * aa * bb THEN (yb * aa - ay * ab) / det ELSE 0 END AS s2 FROM k)
SELECT {_KEYS}, {_r6('y - s1 * a - s2 * b')} AS value FROM c JOIN z USING (factor_id, horizon, session)"""

INTERVALS = """
WITH q AS (SELECT DISTINCT user_id, event_type, ts::DATE + INTERVAL 12 HOUR AS tm FROM ev),
m AS (SELECT q.*, arg_max(e.event_id, (e.ts, e.event_id)) AS event_id FROM q LEFT JOIN ev e ON e.user_id = q.user_id AND e.event_type = q.event_type AND e.ts <= q.tm GROUP BY ALL)
SELECT m.user_id, m.event_type, tm, CASE WHEN e.ts_to IS NULL OR tm < e.ts_to THEN m.event_id END AS interval_id FROM m LEFT JOIN ev e ON e.event_id = m.event_id"""

_FOLDS = """
days AS (SELECT sx, row_number() OVER (ORDER BY sx) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT sx FROM obs)),
g AS (SELECT sx, CASE WHEN i < (n % 6) * (n // 6 + 1) THEN i // (n // 6 + 1) ELSE (i - n % 6) // (n // 6) END AS grp_no FROM days),
trios AS (SELECT a, b, c, row_number() OVER (ORDER BY a, b, c) - 1 AS fold FROM range(6) x(a), range(6) y(b), range(6) z(c) WHERE a < b AND b < c),
member AS (SELECT fold, sx, grp_no, grp_no IN (a, b, c) AS is_test FROM trios, g)"""

PURGE = f"""
WITH {_FOLDS}
SELECT m.fold, m.sx, CASE WHEN is_test THEN 'test'
  WHEN EXISTS (SELECT 1 FROM member t WHERE t.fold = m.fold AND t.is_test AND t.sx <= m.sx + 5 AND t.sx + 5 >= m.sx) THEN 'purged'
  WHEN EXISTS (SELECT 1 FROM member t WHERE t.fold = m.fold AND t.is_test AND t.sx + 5 < m.sx - 1 AND t.sx + 5 >= m.sx - 1 - 3) THEN 'embargoed' ELSE 'train' END AS role FROM member m"""

#: Regimes from ranked lists: the top fifth is the end of the sorted list of (signal, return).
REGIMES = f"""
WITH m AS (SELECT o.*, CASE WHEN d.mid >= 0 THEN 'up' ELSE 'down' END AS regime FROM obs o JOIN (SELECT factor_id, horizon, session, avg(fwd) AS mid FROM obs GROUP BY ALL) d USING (factor_id, horizon, session)),
k AS (SELECT factor_id, horizon, regime, session, v, fwd, rank() OVER (PARTITION BY factor_id, horizon, regime ORDER BY v) + (count(*) OVER (PARTITION BY factor_id, horizon, regime, v) - 1) / 2.0::DOUBLE AS rv, rank() OVER (PARTITION BY factor_id, horizon, regime ORDER BY fwd) + (count(*) OVER (PARTITION BY factor_id, horizon, regime, fwd) - 1) / 2.0::DOUBLE AS rf FROM m),
g AS (SELECT factor_id, horizon, regime, count(*) AS cells, count(DISTINCT session) AS sessions, corr(rv, rf) AS ic, list(fwd ORDER BY v, fwd) AS ends, avg(fwd) AS mid FROM k GROUP BY ALL HAVING cells >= 10),
e AS (SELECT *, list_avg(ends[cells - greatest(1, cells // 5) + 1 : cells]) - mid AS top FROM g)
SELECT factor_id, horizon, regime, cells, sessions, {_r6('ic')} AS rank_ic, {_r6('top')} AS top_excess, ic > 0 AND top > 0 AS positive, {_r6('avg(CASE WHEN ic > 0 AND top > 0 THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY factor_id, horizon)')} AS positive_share FROM e"""

#: Weights of a cohort and of the one before it meet in a full join.
COHORTS = """
WITH c0 AS (SELECT factor_id, horizon, session, count(*) AS n, avg(fwd) / horizon AS market FROM obs GROUP BY factor_id, horizon, session),
c1 AS (SELECT *, (dense_rank() OVER (PARTITION BY factor_id, horizon ORDER BY session) - 1) % horizon AS offset_no FROM c0),
c AS (SELECT *, dense_rank() OVER (PARTITION BY factor_id, horizon, offset_no ORDER BY session) - 1 AS seq FROM c1 WHERE n > 10),
w AS (SELECT factor_id, horizon, offset_no, seq, instrument, fwd, least(1e6 / horizon / 10, coalesce(prior_amount, 0) * 0.1) / 1e6 AS w, round(greatest(1e6 / horizon / 10 - coalesce(prior_amount, 0) * 0.1, 0) * 1e6)::BIGINT AS cut
  FROM (SELECT o.*, c.offset_no, c.seq FROM obs o JOIN c USING (factor_id, horizon, session)) QUALIFY row_number() OVER (PARTITION BY factor_id, horizon, seq, offset_no ORDER BY v DESC, instrument) <= 10),
t AS (SELECT coalesce(a.factor_id, b.factor_id) AS factor_id, coalesce(a.horizon, b.horizon) AS horizon, coalesce(a.offset_no, b.offset_no) AS offset_no, coalesce(a.seq, b.seq + 1) AS seq, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) / 2 AS turnover
  FROM w a FULL JOIN w b ON b.factor_id = a.factor_id AND b.horizon = a.horizon AND b.offset_no = a.offset_no AND b.seq = a.seq - 1 AND b.instrument = a.instrument GROUP BY ALL),
g AS (SELECT factor_id, horizon, offset_no, seq, sum(w * fwd) AS ret, sum(cut) AS cut FROM w GROUP BY ALL)
SELECT c.factor_id, c.horizon, c.offset_no, c.seq, c.session, TRUE AS active, round(ret - market, 6) + 0.0 AS gross, round(turnover, 6) + 0.0 AS turnover, round(ret - market - 0.002 * turnover, 6) + 0.0 AS net, ((cut + 5000) // 10000) / 100.0::DOUBLE + 0.0 AS clipped
FROM c JOIN g USING (factor_id, horizon, offset_no, seq) JOIN t USING (factor_id, horizon, offset_no, seq)"""

#: name -> (panels that the text names, text)
TEXTS: dict[str, tuple[list[str], str]] = {
    "e21_max_drawdown_20": (["p1"], MAX_DRAWDOWN.format(n=20)),
    "e21_max_drawdown_61": (["p1"], MAX_DRAWDOWN.format(n=61)),
    "f5_normalise": (["p1", "obs"], NORMALISE),
    "f8_residualise": (["p1", "obs"], RESIDUALISE),
    "d4_interval_asof": (["ev"], INTERVALS),
    "j3_purge_embargo": (["p1", "obs"], PURGE),
    "h13_regime_evidence": (["p1", "obs"], REGIMES),
    "k3_cohort_events": (["p1", "obs"], COHORTS),
}


def with_panels(names: list[str], text: str) -> str:
    tables = ", ".join(f"{p} AS MATERIALIZED ({panels.DUCK[p]})" for p in names)
    return f"WITH {tables} SELECT * FROM ({text}) AS result"


def texts() -> dict[str, str]:
    return {name: with_panels(names, text) for name, (names, text) in TEXTS.items()}


#: For queries that write files or fit models: what must come back, from the panels alone.
A3 = with_panels(["p2"], "SELECT instrument::VARCHAR AS instrument, session, round(open, 6) + 0.0 AS open, round(high, 6) + 0.0 AS high, round(low, 6) + 0.0 AS low, round(close, 6) + 0.0 AS close, volume, round(amount, 2) AS amount, FALSE AS bad FROM p2")
A6 = "SELECT 'industry' AS kind, ts AS effective_at, ts + INTERVAL 1 HOUR AS available_at, ts + INTERVAL 1 DAY AS ingested_at, user_id::VARCHAR AS instrument, event_type AS group_id, event_type AS group_name, TRUE AS in_order FROM events"
A7 = with_panels(["p1", "vendor"], f"SELECT session, instrument, place FROM ({universe_text().replace('{bars}', 'vendor')}) AS u WHERE place <= 10")
A10 = with_panels(["p1", "vendor"], f"SELECT session, instrument, place, place <= 10 AS top10, place <= 50 AS top50 FROM ({universe_text().replace('{bars}', 'vendor')}) AS u")
A8 = with_panels(["p2"], "SELECT session, round(avg(open), 6) + 0.0 AS open, 1::BIGINT AS rows_seen, 0::BIGINT AS blank FROM p2 GROUP BY session")
A14 = """SELECT concat('{"event_id":', event_id, ',"event_type":"', event_type, '","user_id":', user_id, '}') AS value FROM events"""
A1 = with_panels(["p1", "vendor"], "SELECT instrument::VARCHAR AS instrument, session, "
    + ", ".join(f"CASE WHEN sx = file_sx THEN round({c} * adjustment, 6) + 0.0 END AS {c}" for c in ("open", "high", "low", "close"))
    + ", CASE WHEN sx = file_sx THEN round(volume * 100, 2) END AS volume, CASE WHEN sx = file_sx THEN round(amount * 1000, 0) END AS amount, CASE WHEN sx = file_sx THEN adjustment END AS adjustment_factor, CASE WHEN sx <> file_sx THEN 'date_differs_from_file' END AS reason FROM vendor")


def alternative(fields: dict[str, tuple[str, float]], standins: dict[str, str]) -> str:
    """Every user and day with all fields of a source, those without an event null; China's clock in UTC, a day late."""
    rows = ", ".join(f"('{f}', '{standins.get(f, '-')}', {scale}::DOUBLE)" for f, (_, scale) in fields.items())
    return with_panels(["p3"], f"""
SELECT k.instrument::VARCHAR AS instrument, k.session, f.field, round(p.value * f.scale, 2) AS value, k.session + INTERVAL 7 HOUR AS effective_at, k.session + INTERVAL 34 HOUR AS available_at, NULL::VARCHAR AS reason
FROM (SELECT DISTINCT instrument, session FROM p3) AS k CROSS JOIN (VALUES {rows}) AS f(field, kind, scale) LEFT JOIN p3 AS p ON p.instrument = k.instrument AND p.session = k.session AND p.event_type = f.kind""")


#: Announcements by what each event stands for: letters e (twice where 11 divides), f and d as a13_lines makes them.
_SENT = """
base AS (SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S') AS said, CASE WHEN event_id % 3 > 0 THEN strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') END AS actual, date_trunc('month', ts)::DATE AS period, CASE event_type WHEN 'purchase' THEN '业绩预告' WHEN 'signup' THEN '业绩快报' WHEN 'error' THEN 'notice' ELSE 'report' END AS word FROM events),
sent AS (
  SELECT *, 'e' AS letter, 1 AS turn FROM base UNION ALL SELECT *, 'e', 2 FROM base WHERE event_id % 11 = 0 UNION ALL SELECT *, 'f', 1 FROM base WHERE event_id % 13 = 0 UNION ALL SELECT *, 'd', 1 FROM base WHERE event_id % 17 = 0),
outcome AS (
  SELECT *, CASE WHEN turn = 2 THEN 'duplicate' WHEN event_id % 23 = 0 THEN 'quarantined' WHEN event_type = 'error' THEN 'not_periodic' WHEN letter <> 'd' AND (event_id % 13 = 0 OR event_id % 17 = 0) THEN 'quarantined' ELSE 'admitted' END AS outcome FROM sent)"""
A13_LEDGER = f"""
WITH {_SENT}, bad AS (SELECT count(*) AS n FROM sent WHERE event_id % 19 = 0)
SELECT count(*) + any_value(bad.n) AS received, {", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in ("admitted", "duplicate", "quarantined", "incomplete", "not_periodic"))}, any_value(bad.n) AS corrupt, count(*) FILTER (outcome = 'admitted' AND actual IS NULL) AS delayed FROM outcome, bad"""
A13_REVISIONS = f"""
WITH {_SENT},
stable AS (SELECT *, concat('{{"actualPublishTime":', coalesce('"' || actual || '"', 'null'), ',"announcementType":"年度报告","announcementTypeCode":"', event_type, '","endDate":"', period, ' 00:00:00","hasPdf":', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END, ',"industryTag":[],"market":"A","publishTime":"', said, '",') AS head,
  concat('"stockTag":[{{"code":"u', user_id, '","name":"n"}}', CASE WHEN event_id % 5 = 0 THEN concat(',{{"code":"g', user_id % 10, '","name":"m"}}') ELSE '' END, '],"title":"', word, ' ', event_id, '"}}') AS tail FROM outcome WHERE outcome = 'admitted'),
h AS (SELECT *, sha256(head || CASE WHEN letter = 'd' THEN concat('"sourceDocumentHash":"', sha256(event_id::VARCHAR), '",') ELSE '' END || tail) AS source_hash FROM stable),
c AS (SELECT *, 'U' || user_id AS code FROM h UNION ALL SELECT *, 'G' || (user_id % 10) FROM h WHERE event_id % 5 = 0),
r AS (SELECT code, period AS report_period, event_type AS report_type, left(sha256(concat(period, '|', event_type, '|', coalesce(replace(actual, ' ', 'T') || '+08:00', 'None'), '|', source_hash)), 24) AS revision_id, sha256('announcement|' || source_hash) AS document_id,
  CASE word WHEN '业绩预告' THEN 'earnings_forecast' WHEN '业绩快报' THEN 'earnings_flash' ELSE 'periodic_report' END AS source_type, CASE WHEN actual IS NULL THEN 'nominal_plus_delay' ELSE 'actual' END AS time_quality,
  date_trunc('second', ts) + CASE WHEN actual IS NULL THEN INTERVAL 24 HOUR ELSE INTERVAL 1 HOUR END - INTERVAL 8 HOUR AS available_at FROM c)
SELECT *, CASE WHEN source_type = 'periodic_report' THEN report_period + INTERVAL 1 DAY - INTERVAL 1 SECOND - INTERVAL 8 HOUR ELSE available_at END AS effective_at, lag(revision_id) OVER (PARTITION BY code, report_period, report_type ORDER BY available_at, revision_id) AS supersedes FROM r"""
