"""Validation science: combinatorial purged folds, overfitting probability, placebos, walk-forward."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame

from panelforge.operators import models, order, splits
from panelforge.operators.base import Dialect, Stage, operator, run
from panelforge.operators.scores import redundancy_text
from panelforge.operators.sqlkit import DAILY, RETURNS, avg_rank, r6, size, unit

OBS = {"obs": "obs"}
G, K = 6, 3


def groups_text(g: int = G) -> str:
    """Sessions in g groups of time, larger groups first."""
    return f"SELECT sx, ntile({g}) OVER (ORDER BY sx) - 1 AS grp_no FROM (SELECT DISTINCT sx FROM {{obs}}) AS s"


def folds_text(d: Dialect, g: int = G, k: int = K) -> str:
    """(fold, grp_no) of the test groups: masks with k bits, group 0 as the high bit."""
    bit = lambda m, i: f"(({m} & {d.shift_left(i)}) > 0)"
    return f"""
SELECT fold, j AS grp_no FROM (SELECT m, row_number() OVER (ORDER BY m DESC) - 1 AS fold FROM (SELECT m FROM (SELECT 1 AS one) AS o {d.explode(d.sequence('0', str(2**g - 1)), 'm')}) AS a WHERE bit_count(m) = {k}) AS f {d.explode(d.sequence('0', str(g - 1)), 'j')} WHERE {bit('m', f'({g - 1} - j)')}"""


@operator("j1_time_groups", OBS)
def time_groups(d: Dialect) -> str:
    return f"SELECT grp_no, count(*) AS sessions, min(sx) AS first_sx, max(sx) AS last_sx FROM ({groups_text()}) AS g GROUP BY grp_no"


@operator("j2_cpcv_folds", OBS)
def cpcv_folds(d: Dialect) -> str:
    return f"SELECT f.fold, f.grp_no, g.sessions FROM ({folds_text(d)}) AS f JOIN (SELECT grp_no, count(*) AS sessions FROM ({groups_text()}) AS q GROUP BY grp_no) AS g ON g.grp_no = f.grp_no"


def roles_text(d: Dialect, h: int = 5, embargo: int = 3) -> str:
    """Role of each session in each fold, by running maxima instead of a range join."""
    return f"""
SELECT fold, sx, CASE WHEN is_test THEN 'test' WHEN latest_end >= sx THEN 'purged' WHEN end_before >= sx - 1 - {embargo} THEN 'embargoed' ELSE 'train' END AS role FROM (
  SELECT p.fold, p.sx, p.is_test, p.latest_end, e.end_before FROM (
    SELECT fold, sx, is_test, latest_end FROM (
      SELECT *, max(CASE WHEN kind = 0 THEN sx + {h} END) OVER (PARTITION BY fold ORDER BY moment, kind, sx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS latest_end FROM (
        SELECT fold, sx, sx AS moment, 0 AS kind, TRUE AS is_test FROM member WHERE is_test UNION ALL SELECT fold, sx, sx + {h}, 1, is_test FROM member) AS u) AS w WHERE kind = 1) AS p
  JOIN (SELECT fold, sx, end_before FROM (
      SELECT *, max(CASE WHEN kind = 0 THEN moment END) OVER (PARTITION BY fold ORDER BY moment, kind DESC, sx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS end_before FROM (
        SELECT fold, sx, sx + {h} AS moment, 0 AS kind FROM member WHERE is_test UNION ALL SELECT fold, sx, sx - 1, 1 FROM member) AS u) AS w WHERE kind = 1) AS e ON e.fold = p.fold AND e.sx = p.sx) AS x"""


def members_text(d: Dialect, g: int = G, k: int = K) -> str:
    return f"g AS ({groups_text(g)}), f AS ({folds_text(d, g, k)}), member AS (SELECT n.fold, g.sx, t.grp_no IS NOT NULL AS is_test FROM (SELECT DISTINCT fold FROM f) AS n CROSS JOIN g LEFT JOIN f AS t ON t.fold = n.fold AND t.grp_no = g.grp_no)"


@operator("j3_purge_embargo", OBS)
def purge_embargo(d: Dialect) -> str:
    return f"WITH {members_text(d)} SELECT fold, sx, role FROM ({roles_text(d)}) AS r"


@operator("b10_audit_folds", OBS)
def audit_folds(d: Dialect, h: int = 5) -> str:
    """Train sessions whose label meets a test label, by pairs: 0 in every fold that was purged well."""
    return f"""
WITH {members_text(d)}, r AS ({roles_text(d)})
SELECT a.fold, count(DISTINCT a.sx) AS train, CAST(sum(CASE WHEN b.sx <= a.sx + {h} AND b.sx + {h} >= a.sx THEN 1 ELSE 0 END) AS BIGINT) AS overlapping FROM r AS a JOIN r AS b ON a.fold = b.fold AND a.role = 'train' AND b.role = 'test' GROUP BY a.fold"""


@operator("j4_cpcv_paths", OBS)
def cpcv_paths(d: Dialect, g: int = G, k: int = K) -> str:
    """Which fold each path takes for each group of sessions, and how many sessions that is."""
    return f"""
SELECT p.path, p.grp_no, p.fold, t.sessions, CAST(sum(t.sessions) OVER (PARTITION BY p.path) AS BIGINT) AS path_sessions FROM ({paths_text(d, g, k)}) AS p
JOIN (SELECT grp_no, count(*) AS sessions FROM ({groups_text(g)}) AS q GROUP BY grp_no) AS t ON t.grp_no = p.grp_no"""


def paths_text(d: Dialect, g: int = G, k: int = K) -> str:
    return f"SELECT row_number() OVER (PARTITION BY grp_no ORDER BY fold) - 1 AS path, grp_no, fold FROM ({folds_text(d, g, k)}) AS pf"


# --- stages: small tables that the fold operators name more than once -------------------------------


def role_text(d: Dialect, g: int = G, k: int = K) -> str:
    return f"WITH {members_text(d, g, k)} SELECT fold, sx, role FROM ({roles_text(d)}) AS r"


def daily_text(d: Dialect) -> str:
    return f"SELECT a.factor_id, a.horizon, o.sx, a.rank_ic FROM ({DAILY}) AS a JOIN (SELECT DISTINCT session, sx FROM {{obs}}) AS o ON o.session = a.session"


def scores_text(d: Dialect) -> str:
    """Mean RankIC of every factor and horizon on the train and test sessions of every fold."""
    return "SELECT factor_id, horizon, fold, role, avg(rank_ic) AS score, count(*) AS days FROM {daily} AS i JOIN {roles} AS r ON r.sx = i.sx WHERE role IN ('train', 'test') GROUP BY factor_id, horizon, fold, role"


def weights_text(d: Dialect) -> str:
    """Weights of every candidate in every fold, learned on its train sessions.

    Candidates are rows of {cands}: (candidate, scheme, factor_id), one for each factor of each, however
    many there are. Schemes: single (one factor), equal, positive (mean train RankIC where positive,
    equal if none is), best (the one with the highest) and signed (equal, each in the direction of its
    train RankIC). A fold without train sessions learns nothing: scores of 0.
    """
    part = "c.candidate, c.scheme, s.fold, s.horizon"
    return f"""
WITH s AS (
  SELECT n.fold, x.horizon, x.factor_id, coalesce(t.score, 0e0) AS score
  FROM (SELECT DISTINCT fold FROM {{roles}}) AS n CROSS JOIN (SELECT DISTINCT factor_id, horizon FROM {{scores}}) AS x
  LEFT JOIN {{scores}} AS t ON t.fold = n.fold AND t.factor_id = x.factor_id AND t.horizon = x.horizon AND t.role = 'train'),
t AS (
  SELECT c.candidate, c.scheme, s.fold, s.horizon, s.factor_id, s.score, greatest(s.score, 0) AS gain, count(*) OVER (PARTITION BY {part}) AS n,
    row_number() OVER (PARTITION BY {part} ORDER BY round(s.score, 9) DESC, s.factor_id) AS place, sum(greatest(s.score, 0)) OVER (PARTITION BY {part}) AS total
  FROM s JOIN {{cands}} AS c ON c.factor_id = s.factor_id)
SELECT fold, horizon, candidate, scheme, factor_id,
  CASE scheme WHEN 'positive' THEN CASE WHEN total > 0 THEN gain / total ELSE 1e0 / n END WHEN 'best' THEN CASE WHEN place = 1 THEN 1e0 ELSE 0e0 END
    WHEN 'signed' THEN CASE WHEN score < 0 THEN -1e0 ELSE 1e0 END / n ELSE 1e0 / n END AS weight
FROM t"""


def blends_text(d: Dialect) -> str:
    """Names each candidate's blend in each fold by its weights: folds that learn the same share one."""
    t = "STRING" if d.name == "spark" else "VARCHAR"
    name = d.collect(f"concat(factor_id, '=', CAST(round(weight, 9) AS {t}))", "factor_id")
    joined = f"array_join({name}, ',')" if d.name == "spark" else f"array_to_string({name}, ',')"
    return f"SELECT fold, horizon, candidate, scheme, {joined} AS blend FROM {{weights}} WHERE weight <> 0 GROUP BY fold, horizon, candidate, scheme"


def blend_ics_text(d: Dialect) -> str:
    """RankIC of every blend on each session that any of its folds tests."""
    on = "b.fold = w.fold AND b.horizon = w.horizon AND b.candidate = w.candidate AND b.scheme = w.scheme"
    return f"""
WITH parts AS (SELECT b.blend, b.horizon, w.factor_id, max(w.weight) AS weight FROM {{blends}} AS b JOIN {{weights}} AS w ON {on} WHERE w.weight <> 0 GROUP BY b.blend, b.horizon, w.factor_id),
asked AS (SELECT DISTINCT b.blend, b.horizon, r.sx FROM {{blends}} AS b JOIN {{roles}} AS r ON r.fold = b.fold WHERE r.role = 'test'),
need AS (SELECT a.blend, a.horizon, a.sx, p.factor_id, p.weight, count(*) OVER (PARTITION BY a.blend, a.horizon, a.sx) AS n FROM asked AS a JOIN parts AS p ON p.blend = a.blend AND p.horizon = a.horizon),
u AS (SELECT factor_id, horizon, sx, instrument, fwd, {unit(avg_rank('v'), size())} AS u FROM {{obs}}),
x AS (
  SELECT need.blend, u.horizon, u.sx, u.instrument, round(sum(need.weight * u.u), 9) AS value, max(u.fwd) AS fwd
  FROM u JOIN need ON need.factor_id = u.factor_id AND need.horizon = u.horizon AND need.sx = u.sx GROUP BY need.blend, u.horizon, u.sx, u.instrument HAVING count(*) = max(need.n)),
k AS (SELECT blend, horizon, sx, {avg_rank('value', 'blend, horizon, sx')} AS rv, {avg_rank('fwd', 'blend, horizon, sx')} AS rf FROM x)
SELECT blend, horizon, sx, corr(rv, rf) AS ic FROM k GROUP BY blend, horizon, sx HAVING count(*) >= 3"""


def ranked_text(d: Dialect) -> str:
    return "SELECT factor_id, horizon, sx, instrument, v, fwd FROM {obs}"


def _blend_ics(rows: DataFrame, blends: DataFrame, weights: DataFrame, roles: DataFrame, **_: object) -> DataFrame:
    need = """
SELECT a.blend, a.horizon, a.sx, p.factor_id, p.weight FROM (SELECT DISTINCT b.blend, b.horizon, r.sx FROM {blends} AS b JOIN {roles} AS r ON r.fold = b.fold WHERE r.role = 'test') AS a
JOIN (
  SELECT b.blend, b.horizon, w.factor_id, max(w.weight) AS weight FROM {blends} AS b
  JOIN {weights} AS w ON b.fold = w.fold AND b.horizon = w.horizon AND b.candidate = w.candidate AND b.scheme = w.scheme WHERE w.weight <> 0 GROUP BY b.blend, b.horizon, w.factor_id) AS p
  ON p.blend = a.blend AND p.horizon = a.horizon"""
    return models.blend_ics(rows, run(need, blends=blends, weights=weights, roles=roles))


def tests_text(d: Dialect) -> str:
    """RankIC of every candidate on every test session of every fold, with that fold's weights."""
    return """
SELECT b.fold, b.horizon, b.candidate, b.scheme, r.sx, i.ic FROM {blends} AS b JOIN {roles} AS r ON r.fold = b.fold AND r.role = 'test'
JOIN {blend_ics} AS i ON i.blend = b.blend AND i.horizon = b.horizon AND i.sx = r.sx WHERE i.ic IS NOT NULL"""


def path_scores_text(d: Dialect, g: int = G, k: int = K) -> str:
    """Mean out-of-sample RankIC of every candidate on every path, each group by the path's own fold."""
    return f"""
SELECT p.path, concat(t.horizon, ':', t.candidate, ':', t.scheme) AS config, avg(t.ic) AS score
FROM ({paths_text(d, g, k)}) AS p JOIN ({groups_text(g)}) AS g ON g.grp_no = p.grp_no JOIN ({tests_text(d)}) AS t ON t.fold = p.fold AND t.sx = g.sx
GROUP BY p.path, t.horizon, t.candidate, t.scheme"""


def fold_stages(g: int = G, k: int = K) -> dict[str, dict]:
    """The stages of the fold operators for g groups of which k are tested; each set builds on the one before."""
    roles = {"roles": functools.partial(role_text, g=g, k=k)}
    scores = roles | {"daily": daily_text, "scores": scores_text}
    weights = scores | {"weights": weights_text}
    blends = weights | {"blends": blends_text, "blend_ics": Stage(ranked_text, _blend_ics, blend_ics_text, ("blends", "weights", "roles"))}
    paths = blends | {"path_scores": functools.partial(path_scores_text, g=g, k=k)}
    halves = paths | {"splits": Stage(lambda d: "SELECT * FROM {path_scores}", functools.partial(splits.half_splits, paths=math.comb(g - 1, k - 1)), functools.partial(half_splits_text, g=g, k=k))}
    return {"roles": roles, "scores": scores, "weights": weights, "blends": blends, "splits": halves}


def half_splits_text(d: Dialect, g: int = G, k: int = K) -> str:
    """All half-splits for DuckDB: a split is one half of its lower and one of its upper paths, whose sums are added."""
    paths, low = math.comb(g - 1, k - 1), math.comb(g - 1, k - 1) // 2
    logit = "ln((r / (n + 1)) / (1 - r / (n + 1)))"
    half = lambda a, b: f"SELECT m, bit_count(m) AS taken, config, sum(CASE WHEN (m & (1 << (path - {a}))) > 0 THEN x ELSE 0 END) AS inside, sum(x) AS whole FROM unnest(generate_series(0, {2 ** (b - a) - 1})) AS _(m), x WHERE path >= {a} AND path < {b} GROUP BY m, config"
    return f"""
SELECT count(*) AS splits, max(n) AS configs, (SELECT count(DISTINCT config) FROM {{path_scores}}) - max(n) AS dropped, sum(CASE WHEN {logit} <= 0 THEN 1 ELSE 0 END) AS lost, sum({logit}) AS logits FROM (
  SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY inside DESC, config DESC) AS place, {avg_rank('outside', 'a, b')} AS r, count(*) OVER (PARTITION BY a, b) AS n FROM (
    WITH whole AS (SELECT config FROM {{path_scores}} GROUP BY config HAVING count(*) = {paths}),
    x AS (SELECT path, config, CAST(round_even(score * power(2, {splits.BITS} - floor(log2((SELECT max(abs(score)) FROM {{path_scores}} WHERE config IN (SELECT config FROM whole))))), 0) AS BIGINT) AS x FROM {{path_scores}} WHERE config IN (SELECT config FROM whole)),
    lower AS MATERIALIZED ({half(0, low)}), upper AS MATERIALIZED ({half(low, paths)})
    SELECT l.m AS a, u.m AS b, l.config, CAST(l.inside + u.inside AS BIGINT) >> {splits.LOW_BITS} AS inside, CAST(l.whole + u.whole - l.inside - u.inside AS BIGINT) >> {splits.LOW_BITS} AS outside FROM lower AS l JOIN upper AS u ON u.config = l.config AND l.taken + u.taken = {paths // 2}) AS sc) AS pk WHERE place = 1"""


STAGES = fold_stages()
ROLES = STAGES["roles"]
CANDIDATES = OBS | {"cands": "cands"}

#: What a fold fits for each factor.
_FIT = ["fold", "factor_id", "horizon"]


def slim_text(d: Dialect) -> str:
    return "SELECT factor_id, horizon, sx, v FROM {obs}"


def train_text(d: Dialect) -> str:
    return "SELECT r.fold, o.factor_id, o.horizon, o.v FROM {slim} AS o JOIN {roles} AS r ON r.sx = o.sx WHERE r.role = 'train'"


def _limits(train: DataFrame, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    return order.quantiles(train, _FIT, "v", {"lo": lower, "hi": upper})


def limits_text(d: Dialect, lower: float = 0.01, upper: float = 0.99) -> str:
    return f"SELECT fold, factor_id, horizon, {d.percentile('v', lower)} AS lo, {d.percentile('v', upper)} AS hi FROM ({train_text(d)}) AS t GROUP BY fold, factor_id, horizon"


@operator("j5_fit_transform", OBS, ROLES | {"slim": slim_text, "limits": Stage(train_text, _limits, limits_text)})
def fit_transform(d: Dialect, lower: float = 0.01, upper: float = 0.99) -> str:
    """Winsor limits, mean and population scale learned on train sessions, used on both sides.

    Limits are exact quantiles whatever the unit of a factor; a fold whose clipped train values are all
    equal gives 0.
    """
    clipped = "least(greatest(v.v, q.lo), q.hi)"
    z = "CASE WHEN m.lo < m.hi THEN (least(greatest(v.v, m.lo), m.hi) - m.mu) / m.sd ELSE 0e0 END"
    on = lambda a, b: f"{a}.fold = {b}.fold AND {a}.factor_id = {b}.factor_id AND {a}.horizon = {b}.horizon"
    return f"""
WITH v AS (SELECT r.fold, r.role, o.factor_id, o.horizon, o.v FROM {{roles}} AS r JOIN {{slim}} AS o ON o.sx = r.sx WHERE role IN ('train', 'test')),
m AS (
  SELECT v.fold, v.factor_id, v.horizon, max(q.lo) AS lo, max(q.hi) AS hi, avg({clipped}) AS mu, stddev_pop({clipped}) AS sd
  FROM v JOIN {{limits}} AS q ON {on('q', 'v')} WHERE role = 'train' GROUP BY v.fold, v.factor_id, v.horizon)
SELECT v.fold, v.factor_id, v.horizon, role, count(*) AS cells, {r6(f'avg({z})')} AS mean_z, {r6(f'stddev_pop({z})')} AS scale_z
FROM v JOIN m ON {on('m', 'v')} GROUP BY v.fold, v.factor_id, v.horizon, role"""


def plain_scores_text(d: Dialect) -> str:
    """scores_text without stages: it names its tables once."""
    return scores_text(d).replace("{daily}", f"({daily_text(d)})").replace("{roles}", f"({role_text(d)})")


@operator("j6_cpcv_scores", OBS)
def cpcv_scores(d: Dialect) -> str:
    return f"SELECT factor_id, horizon, fold, role, days, {r6('score')} AS score FROM ({plain_scores_text(d)}) AS s"


@operator("j7_fit_weights", CANDIDATES, STAGES["weights"])
def fit_weights(d: Dialect) -> str:
    return f"SELECT fold, horizon, candidate, scheme, factor_id, {r6('weight')} AS weight FROM {{weights}}"


@operator("j8_path_scores", CANDIDATES, STAGES["blends"])
def path_scores(d: Dialect) -> str:
    return f"SELECT path, config, {r6('score')} AS score FROM ({path_scores_text(d)}) AS ps"


#: Seven groups of which four are tested: 35 folds and 20 paths.
WIDE = fold_stages(7, 4)["splits"]


@operator("j8_pbo_paths", CANDIDATES, STAGES["splits"])
@operator("j8_pbo_twenty_paths", CANDIDATES, WIDE)
def pbo_paths(d: Dialect) -> str:
    """Overfitting probability over all half-splits of the paths: logit of the winner's rank out of sample.

    Scores are those of candidates that learn their weights in each fold, so paths differ by what was
    learned and by nothing else. Candidates without a finite score on every path are dropped and
    counted; an odd number of paths, or fewer than four, is refused.
    """
    return f"""
SELECT CAST(sum(splits) AS BIGINT) AS splits, CAST(max(configs) AS BIGINT) AS configs, CAST(max(dropped) AS BIGINT) AS dropped,
  {r6('sum(lost) / CAST(sum(splits) AS DOUBLE)')} AS pbo, {r6('sum(logits) / sum(splits)')} AS mean_logit FROM {{splits}}"""


@operator("j9_pbo_folds", OBS)
def pbo_folds(d: Dialect) -> str:
    """The train winner of every fold and horizon and its rank on that fold's test sessions."""
    return f"""
WITH w AS (SELECT fold, horizon, factor_id, max(CASE WHEN role = 'train' THEN score END) AS a, max(CASE WHEN role = 'test' THEN score END) AS b FROM ({plain_scores_text(d)}) AS s GROUP BY fold, horizon, factor_id),
k AS (SELECT *, row_number() OVER (PARTITION BY fold, horizon ORDER BY round(a, 9) DESC, factor_id DESC) AS place, {avg_rank('b', 'fold, horizon')} AS r, count(*) OVER (PARTITION BY fold, horizon) AS n FROM w WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT fold, horizon, factor_id AS winner, {r6('r / (n + 1)')} AS relative_rank, {r6('ln((r / (n + 1)) / (1 - r / (n + 1)))')} AS logit FROM k WHERE place = 1"""


@operator("j10_pbo_blocks", OBS)
def pbo_blocks(d: Dialect, b: int = 6) -> str:
    bit = f"((m & {d.shift_left('block')}) > 0)"
    return f"""
WITH s AS (SELECT factor_id, ret, CAST(floor((row_number() OVER (PARTITION BY factor_id ORDER BY session) - 1) * {b} / CAST(count(*) OVER (PARTITION BY factor_id) AS DOUBLE)) AS BIGINT) AS block FROM ({RETURNS}) AS r), bs AS (SELECT factor_id, block, avg(ret) AS score FROM s GROUP BY factor_id, block),
ms AS (SELECT m FROM (SELECT 1 AS one) AS o {d.explode(d.sequence('0', str(2**b - 1)), 'm')} WHERE bit_count(m) = {b // 2}), sc AS (SELECT m, factor_id, avg(CASE WHEN {bit} THEN score END) AS inside, avg(CASE WHEN NOT {bit} THEN score END) AS outside FROM ms CROSS JOIN bs GROUP BY m, factor_id),
k AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY inside DESC, factor_id DESC) AS place, {avg_rank('outside', 'm')} AS r, count(*) OVER (PARTITION BY m) AS n FROM sc)
SELECT count(*) AS splits, {r6('avg(CASE WHEN r / (n + 1) <= 0.5 THEN 1e0 ELSE 0e0 END)')} AS pbo FROM k WHERE place = 1"""


_RANKED = f"SELECT factor_id, horizon, session, sx, instrument, {avg_rank('v')} AS rv, {avg_rank('fwd')} AS rf FROM {{obs}}"


def placebo_rows_text(d: Dialect) -> str:
    return "SELECT factor_id, horizon, session, sx, instrument, v, fwd FROM {obs}"


def plain_placebo_text(d: Dialect, reps: int = 199, seed: int = 7) -> str:
    """The same shuffles with one row for every name and repetition."""
    first = f"((instrument * {models.BY_NAME} + rep * {models.BY_REP} + sx * {models.BY_SESSION} + method * {models.BY_METHOD} + {seed * models.BY_SEED}) % {models.PRIME})"
    second = f"(({first} * {first}) % {models.PRIME} + rep)"
    keys = "factor_id, horizon, session, method, rep"
    return f"""
SELECT {keys}, corr(CASE WHEN method = 0 THEN seat_rv ELSE rv END, CASE WHEN method = 0 THEN rf ELSE seat_rf END) AS ic FROM (
  SELECT p.*, q.rv AS seat_rv, q.rf AS seat_rf FROM (
    SELECT k.*, method, rep, row_number() OVER (PARTITION BY {keys} ORDER BY ({second} * {second}) % {models.PRIME}, instrument) AS seat FROM ({_RANKED}) AS k, unnest(generate_series(1, {reps})) AS a(rep), unnest([0, 1]) AS b(method)) AS p
  JOIN (SELECT *, row_number() OVER (PARTITION BY factor_id, horizon, session ORDER BY instrument) AS seat FROM ({_RANKED}) AS k) AS q ON q.factor_id = p.factor_id AND q.horizon = p.horizon AND q.session = p.session AND q.seat = p.seat) AS x GROUP BY {keys}"""


@operator("j11_placebo", OBS, {"ics": Stage(placebo_rows_text, models.shuffled_ics, plain_placebo_text)})
def placebo(d: Dialect, reps: int = 199, seed: int = 7) -> str:
    """Returns shuffled against signals (return) and signals against returns (signal), within each session.

    Ranks are taken once; a session is one group, and every repetition shuffles it inside that group
    (a session's names bound it), so repetitions are never sent between tasks.
    p = (1 + repetitions with a mean RankIC at least the observed one) / (repetitions + 1).
    """
    shuffled, observed = "{ics}", f"SELECT factor_id, horizon, session, corr(rv, rf) AS ic FROM ({_RANKED}) AS k GROUP BY factor_id, horizon, session"
    if d.name == "spark":  # repetition 0 is the observed one
        shuffled, observed = "{ics} WHERE rep > 0", "SELECT factor_id, horizon, session, ic FROM {ics} WHERE rep = 0"
    return f"""
WITH m AS (SELECT factor_id, horizon, method, rep, round(avg(ic), 9) AS ic FROM {shuffled} GROUP BY factor_id, horizon, method, rep),
o AS (SELECT factor_id, horizon, round(avg(ic), 9) AS ic FROM ({observed}) AS x GROUP BY factor_id, horizon)
SELECT o.factor_id, o.horizon, CASE m.method WHEN 0 THEN 'return' ELSE 'signal' END AS method, {r6('max(o.ic)')} AS observed, {r6('(1 + sum(CASE WHEN m.ic >= o.ic THEN 1 ELSE 0 END)) / CAST(count(*) + 1 AS DOUBLE)')} AS p_value FROM o JOIN m ON m.factor_id = o.factor_id AND m.horizon = o.horizon GROUP BY o.factor_id, o.horizon, m.method"""


@operator("j12_deflated_sharpe_inputs", OBS)
def deflated_sharpe_inputs(d: Dialect) -> str:
    """What the deflated Sharpe ratio needs: trials, spread of their Sharpes, and each one's moments."""
    return f"""
WITH m AS (SELECT factor_id, count(*) AS n, avg(ret) / stddev_samp(ret) AS sharpe, avg(power(ret - mu, 3)) / power(avg(power(ret - mu, 2)), 1.5e0) AS skew, avg(power(ret - mu, 4)) / power(avg(power(ret - mu, 2)), 2) AS kurt FROM (SELECT *, avg(ret) OVER (PARTITION BY factor_id) AS mu FROM ({RETURNS}) AS r) AS a GROUP BY factor_id)
SELECT factor_id, n, {r6('sharpe')} AS sharpe, {r6('skew')} AS skew, {r6('kurt')} AS kurtosis, count(*) OVER () AS trials, {r6('stddev_samp(sharpe) OVER ()')} AS sharpe_spread, {r6('sqrt((1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) / (n - 1))')} AS sharpe_error FROM m"""


def chosen_text(blocks: int) -> str:
    """The factor of every horizon and block of time: the best mean RankIC on all blocks before it, ties by id."""
    before = "OVER (PARTITION BY factor_id, horizon ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
SELECT horizon, block, factor_id, past, here FROM (SELECT *, row_number() OVER (PARTITION BY horizon, block ORDER BY round(past, 9) DESC, factor_id) AS k FROM (
  SELECT factor_id, horizon, block, sum(s) {before} / sum(n) {before} AS past, s / n AS here FROM (
    SELECT a.factor_id, a.horizon, c.block, sum(a.rank_ic) AS s, count(*) AS n FROM ({DAILY}) AS a JOIN ({calendar_text(blocks)}) AS c ON c.horizon = a.horizon AND c.session = a.session GROUP BY a.factor_id, a.horizon, c.block) AS b) AS p
  WHERE past IS NOT NULL) AS x WHERE k = 1"""


def calendar_text(blocks: int) -> str:
    """The sessions of each horizon in blocks of time, larger blocks first."""
    return f"SELECT horizon, session, ntile({blocks}) OVER (PARTITION BY horizon ORDER BY session) AS block FROM (SELECT DISTINCT horizon, session FROM {{obs}}) AS s"


@operator("j13_walk_forward", OBS, by_section=True)
def walk_forward(d: Dialect, blocks: int = 6) -> str:
    """For each horizon and block of time the factor with the best mean RankIC on all blocks before it."""
    return f"SELECT horizon, block, factor_id, {r6('past')} AS past, {r6('here')} AS realised FROM ({chosen_text(blocks)}) AS c"


@operator("j13_walk_forward_signals", OBS, by_section=True)
def walk_forward_signals(d: Dialect, blocks: int = 6) -> str:
    """What the selection trades: on every session of a block the signals of the block's factor, for the
    names that have all factors there."""
    few = "/*+ BROADCAST(t), BROADCAST(c) */ " if d.name == "spark" else ""
    return f"""
SELECT {few}o.horizon, CAST(c.block AS BIGINT) AS block, o.factor_id, o.session, o.instrument, {r6('o.v')} AS signal, {r6('o.fwd')} AS fwd FROM (
  SELECT {'/*+ BROADCAST(w) */ ' if few else ''}n.*, count(*) OVER (PARTITION BY horizon, session, instrument) AS factors, w.wanted FROM {{obs}} AS n JOIN (SELECT horizon AS h, count(DISTINCT factor_id) AS wanted FROM {{obs}} GROUP BY horizon) AS w ON w.h = n.horizon) AS o
JOIN ({calendar_text(blocks)}) AS t ON t.horizon = o.horizon AND t.session = o.session
JOIN ({chosen_text(blocks)}) AS c ON c.horizon = o.horizon AND c.block = t.block AND c.factor_id = o.factor_id WHERE o.factors = o.wanted"""


@operator("j14_screen", OBS)
def screen(d: Dialect) -> str:
    return f"""
SELECT factor_id, horizon, days, {r6('ic')} AS mean_rank_ic, {r6('positive')} AS positive_years, CASE WHEN days < 30 THEN 'too_short' WHEN abs(ic) < 0.01 THEN 'weak' WHEN positive < 0.5 THEN 'unstable' ELSE 'admitted' END AS reason FROM (
  SELECT factor_id, horizon, sum(n) AS days, sum(s) / sum(n) AS ic, avg(CASE WHEN s > 0 THEN 1e0 ELSE 0e0 END) AS positive FROM (SELECT factor_id, horizon, year(session) AS y, CAST(count(*) AS DOUBLE) AS n, sum(rank_ic) AS s FROM ({DAILY}) AS a GROUP BY factor_id, horizon, year(session)) AS b GROUP BY factor_id, horizon) AS c"""


#: The last train session of the single split that J15 is registered with.
SPLIT = 40


def early_text(d: Dialect) -> str:
    return f"SELECT factor_id, horizon, v FROM {{obs}} WHERE sx <= {SPLIT}"


def _centre(train: DataFrame, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    return order.quantiles(train, ["factor_id", "horizon"], "v", {"mid": 0.5, "lo": lower, "hi": upper})


def centre_text(d: Dialect, lower: float = 0.01, upper: float = 0.99) -> str:
    at = lambda p: d.percentile("v", p)
    return f"SELECT factor_id, horizon, {at(0.5)} AS mid, {at(lower)} AS lo, {at(upper)} AS hi FROM {{early}} AS t GROUP BY factor_id, horizon"


def away_text(d: Dialect) -> str:
    return "SELECT t.factor_id, t.horizon, abs(t.v - q.mid) AS away FROM {early} AS t JOIN {centre} AS q ON q.factor_id = t.factor_id AND q.horizon = t.horizon"


def _spread(away: DataFrame, **_: object) -> DataFrame:
    return order.quantiles(away, ["factor_id", "horizon"], "away", {"mad": 0.5})


def spread_text(d: Dialect, **_: object) -> str:
    return f"SELECT factor_id, horizon, {d.percentile('away', 0.5)} AS mad FROM ({away_text(d)}) AS t GROUP BY factor_id, horizon"


@operator("j15_robust_scale", OBS, {"early": early_text, "centre": Stage(lambda d: "SELECT * FROM {early}", _centre, centre_text), "spread": Stage(away_text, _spread, spread_text)})
def robust_scale(d: Dialect, lower: float = 0.01, upper: float = 0.99) -> str:
    """Median and scaled MAD of the train part, applied to later sessions, clipped at train quantiles."""
    on = lambda a: f"{a}.factor_id = o.factor_id AND {a}.horizon = o.horizon"
    return f"""
SELECT o.factor_id, o.horizon, session, instrument, {r6('(least(greatest(v, lo), hi) - mid) / nullif(mad * 1.4826e0, 0)')} AS value
FROM {{obs}} AS o JOIN {{centre}} AS q ON {on('q')} JOIN {{spread}} AS m ON {on('m')} WHERE sx > {SPLIT}"""


#: The registered reference factor, its share of names that are held, and the weight of what a candidate adds.
REFERENCE, FRACTION, ADDED = "rev5", 0.2, 0.5


def beside_text(d: Dialect) -> str:
    """Every candidate's value y beside the reference's x."""
    return f"""
SELECT a.factor_id, a.horizon, a.session, a.sx, a.instrument, a.v AS y, b.v AS x, a.fwd
FROM {{obs}} AS a JOIN {{obs}} AS b ON b.horizon = a.horizon AND b.session = a.session AND b.instrument = a.instrument WHERE a.factor_id <> '{REFERENCE}' AND b.factor_id = '{REFERENCE}'"""


def betas_text(d: Dialect) -> str:
    """The regression of y on x on every fold's train sessions, from one row of sums per session."""
    return """
SELECT fold, factor_id, horizon, n, CASE WHEN sxx - sx1 * sx1 / n > 0 THEN (sxy - sx1 * sy / n) / (sxx - sx1 * sx1 / n) ELSE 0e0 END AS beta, sx1 / n AS mx, sy / n AS my FROM (
  SELECT r.fold, s.factor_id, s.horizon, CAST(sum(s.n) AS DOUBLE) AS n, sum(s.sx1) AS sx1, sum(s.sy) AS sy, sum(s.sxx) AS sxx, sum(s.sxy) AS sxy
  FROM (SELECT factor_id, horizon, sx, count(*) AS n, sum(x) AS sx1, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM {beside} AS w GROUP BY factor_id, horizon, sx) AS s
  JOIN {roles} AS r ON r.sx = s.sx WHERE r.role = 'train' GROUP BY r.fold, s.factor_id, s.horizon) AS t"""


def sections_by_name_text(d: Dialect) -> str:
    """The same figures with a row for each name and fold."""
    part = "fold, factor_id, horizon, session"
    z = lambda x: f"coalesce(({x} - avg({x}) OVER (PARTITION BY {part})) / nullif(stddev_pop({x}) OVER (PARTITION BY {part}), 0), 0)"
    long = lambda k: f"avg(CASE WHEN {k} <= c THEN fwd END)"
    short = lambda k: f"avg(CASE WHEN {k} > n - c THEN fwd END)"
    return f"""
WITH e AS (
  SELECT m.fold, w.factor_id, w.horizon, w.session, w.instrument, w.x, w.fwd, w.y - m.my - m.beta * (w.x - m.mx) AS e
  FROM {{beside}} AS w JOIN {{roles}} AS r ON r.sx = w.sx AND r.role = 'test' JOIN {{betas}} AS m ON m.fold = r.fold AND m.factor_id = w.factor_id AND m.horizon = w.horizon),
a AS (SELECT *, round({z('x')} + {ADDED}e0 * {z('e')}, 9) AS augmented FROM e),
p AS (
  SELECT *, count(*) OVER (PARTITION BY {part}) AS n, greatest(1, ceil(count(*) OVER (PARTITION BY {part}) * {FRACTION}e0)) AS c,
    row_number() OVER (PARTITION BY {part} ORDER BY x DESC, instrument DESC) AS k_ref, row_number() OVER (PARTITION BY {part} ORDER BY augmented DESC, instrument DESC) AS k_aug FROM a)
SELECT {part}, any_value(n) AS n, sum(e) AS se, sum(fwd) AS sf, sum(x) AS sx1, sum(e * e) AS see, sum(fwd * fwd) AS sff, sum(x * x) AS sxx, sum(e * fwd) AS sef, sum(x * fwd) AS sxf,
  {long('k_ref')} AS ret_ref, {long('k_aug')} AS ret_aug, {long('k_ref')} - {short('k_ref')} AS ls_ref, {long('k_aug')} - {short('k_aug')} AS ls_aug,
  list(instrument) FILTER (k_ref <= c) AS held_ref, list(instrument) FILTER (k_aug <= c) AS held_aug
FROM p GROUP BY {part}"""


MARGINAL = ROLES | {
    "beside": beside_text,
    "betas": betas_text,
    "sections": Stage(lambda d: "SELECT factor_id, horizon, session, sx, instrument, x, y, fwd FROM {beside}", functools.partial(models.marginal_sections, fraction=FRACTION, added=ADDED), sections_by_name_text, ("roles", "betas")),
}


@operator("j18_marginal", OBS, MARGINAL)
def marginal(d: Dialect, cost: float = 0.001, complexity: float = 0.0) -> str:
    """What a candidate adds to a reference factor, fold by fold.

    Each fold's train sessions give the regression of the candidate on the reference (from one row of
    sums per session); on its test sessions the residual is scored, and portfolios of the reference are
    held against those of reference and residual together, long and long-short: Sharpe, turnover,
    drawdown and tail, and the utility of the long ones. A test session of a candidate is one group,
    ranked for all folds that test it.
    """
    key = "fold, factor_id, horizon, kind"
    kinds = {"reference": ("ret_ref", "held_ref"), "augmented": ("ret_aug", "held_aug"), "reference_ls": ("ls_ref", "held_ref"), "augmented_ls": ("ls_aug", "held_aug")}
    rows = " UNION ALL ".join(f"SELECT s.fold, s.factor_id, s.horizon, '{k}' AS kind, t.i, {ret} AS ret, {held} AS held FROM {{sections}} AS s JOIN days AS t ON t.fold = s.fold AND t.session = s.session" for k, (ret, held) in kinds.items())
    running = f"OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    delta = lambda x, tail: f"max(CASE kind WHEN 'augmented{tail}' THEN {x} END) - max(CASE kind WHEN 'reference{tail}' THEN {x} END)"
    corr = lambda a: f"(n * s{a}f - s{a}{'1' if a == 'x' else ''} * sf) / nullif(sqrt((n * s{a}{a} - s{a}{'1' if a == 'x' else ''} * s{a}{'1' if a == 'x' else ''}) * (n * sff - sf * sf)), 0)"
    sums = ", ".join(f"sum({c}) AS {c}" for c in ("se", "sf", "sx1", "see", "sff", "sxx", "sef", "sxf"))
    return f"""
WITH days AS (SELECT fold, session, row_number() OVER (PARTITION BY fold ORDER BY session) AS i FROM (SELECT DISTINCT fold, session FROM {{sections}}) AS x),
o AS (SELECT {key}, i, ret, held, lag(i, 1) OVER (PARTITION BY {key} ORDER BY i) AS i_before, lag(held, 1) OVER (PARTITION BY {key} ORDER BY i) AS held_before FROM ({rows}) AS h),
dt AS (SELECT {key}, i, ret, CASE WHEN i_before = i - 1 THEN 1 - {d.shared('held', 'held_before')} / CAST({d.length('held')} + {d.length('held_before')} - {d.shared('held', 'held_before')} AS DOUBLE) END AS turn FROM o),
net AS (SELECT *, ret - {cost}e0 * coalesce(avg(turn) OVER (PARTITION BY {key}), 0) AS net FROM dt),
wealth AS (SELECT *, exp(sum(ln(greatest(1 + net, 0.01e0))) {running}) AS wealth, row_number() OVER (PARTITION BY {key} ORDER BY net, i) AS worst, count(*) OVER (PARTITION BY {key}) AS n_days FROM net),
peaks AS (SELECT *, wealth / greatest(1e0, max(wealth) {running}) - 1 AS fall FROM wealth),
pm AS (
  SELECT {key}, coalesce(avg(net) / nullif(stddev_samp(net), 0) * sqrt(252e0), 0e0) AS sharpe, coalesce(avg(turn), 0e0) AS turnover, least(0e0, min(fall)) AS drawdown, max(CASE WHEN worst = greatest(1, ceil(n_days * 0.05e0)) THEN net END) AS tail
  FROM peaks GROUP BY {key}),
dl AS (
  SELECT fold, factor_id, horizon, {delta('sharpe', '')} AS d_sharpe, {delta('turnover', '')} AS d_turnover, {delta('drawdown', '')} AS d_drawdown, {delta('tail', '')} AS d_tail,
    {delta('sharpe', '_ls')} AS ls_sharpe, {delta('drawdown', '_ls')} AS ls_drawdown, {delta('tail', '_ls')} AS ls_tail FROM pm GROUP BY fold, factor_id, horizon),
ri AS (
  SELECT fold, factor_id, horizon, {corr('e')} AS residual_ic, {corr('x')} AS reference_ic FROM (
    SELECT fold, factor_id, horizon, CAST(sum(n) AS DOUBLE) AS n, {sums} FROM {{sections}} GROUP BY fold, factor_id, horizon) AS q)
SELECT dl.fold, dl.factor_id, dl.horizon, {r6('m.beta')} AS beta, {r6('ri.reference_ic')} AS reference_ic, {r6('ri.residual_ic')} AS residual_ic, {r6('d_sharpe')} AS delta_sharpe, {r6('d_turnover')} AS delta_turnover, {r6('d_drawdown')} AS drawdown_improvement, {r6('d_tail')} AS delta_tail,
  {r6('ls_sharpe')} AS delta_ls_sharpe, {r6('ls_drawdown')} AS ls_drawdown_improvement, {r6('ls_tail')} AS delta_ls_tail,
  {r6(f'd_sharpe + 2 * ri.residual_ic + d_drawdown + d_tail - greatest(d_turnover, 0) - {complexity}e0')} AS utility
FROM dl JOIN ri ON ri.fold = dl.fold AND ri.factor_id = dl.factor_id AND ri.horizon = dl.horizon JOIN {{betas}} AS m ON m.fold = dl.fold AND m.factor_id = dl.factor_id AND m.horizon = dl.horizon"""


#: Tags of the panel's factors, for the overlap of what they mean.
TAGS = {"rev5": ("price", "reversal", "close"), "strength": ("price", "intraday", "close"), "width": ("price", "intraday", "range")}


@operator("j19_duplicate_matrix", OBS)
def duplicate_matrix(d: Dialect, tags: dict = TAGS, pearson: float = 0.98, rank: float = 0.98, residual: float = 0.95, exposure: float = 0.95) -> str:
    """Every pair of factors: Pearson, mean daily Spearman, Pearson of what log size leaves, cosine of
    their exposures (to log size, log turnover and group), overlap of tags, and the verdict."""
    rows = " UNION ALL ".join(f"SELECT '{f}' AS factor_id, '{t}' AS tag" for f, ts in tags.items() for t in ts)
    return f"""
WITH tag AS ({rows}), c AS (SELECT a.factor_id AS fa, b.factor_id AS fb, a.horizon AS horizon, count(*) AS cells, corr(a.v, b.v) AS ab, corr(a.v, ln(a.cap)) AS ac, corr(b.v, ln(a.cap)) AS bc FROM {{obs}} AS a JOIN {{obs}} AS b ON a.horizon = b.horizon AND a.session = b.session AND a.instrument = b.instrument AND a.factor_id < b.factor_id GROUP BY a.factor_id, b.factor_id, a.horizon),
x AS (SELECT factor_id, horizon, coalesce(corr(v, ln(cap)), 0) AS e1, coalesce(corr(v, ln(adv)), 0) AS e2, coalesce(corr(v, CAST(grp AS DOUBLE)), 0) AS e3 FROM {{obs}} GROUP BY factor_id, horizon),
s AS ({redundancy_text(d)}), n AS (SELECT factor_id, count(*) AS n FROM tag GROUP BY factor_id), t AS (SELECT a.factor_id AS fa, b.factor_id AS fb, count(*) AS shared FROM tag AS a JOIN tag AS b ON a.tag = b.tag AND a.factor_id < b.factor_id GROUP BY a.factor_id, b.factor_id),
f AS (SELECT c.fa, c.fb, c.horizon, c.cells, c.ab, s.rho, (c.ab - c.ac * c.bc) / nullif(sqrt((1 - c.ac * c.ac) * (1 - c.bc * c.bc)), 0) AS rest, (xa.e1 * xb.e1 + xa.e2 * xb.e2 + xa.e3 * xb.e3) / nullif(sqrt((xa.e1 * xa.e1 + xa.e2 * xa.e2 + xa.e3 * xa.e3) * (xb.e1 * xb.e1 + xb.e2 * xb.e2 + xb.e3 * xb.e3)), 0) AS cosine,
  coalesce(t.shared, 0) / CAST(coalesce(na.n, 0) + coalesce(nb.n, 0) - coalesce(t.shared, 0) AS DOUBLE) AS jaccard FROM c JOIN s ON s.fa = c.fa AND s.fb = c.fb AND s.horizon = c.horizon JOIN x AS xa ON xa.factor_id = c.fa AND xa.horizon = c.horizon JOIN x AS xb ON xb.factor_id = c.fb AND xb.horizon = c.horizon LEFT JOIN n AS na ON na.factor_id = c.fa LEFT JOIN n AS nb ON nb.factor_id = c.fb LEFT JOIN t ON t.fa = c.fa AND t.fb = c.fb)
SELECT fa, fb, horizon, cells, {r6('ab')} AS pearson, {r6('rho')} AS spearman, {r6('rest')} AS residual_pearson, {r6('cosine')} AS exposure_cosine, {r6('jaccard')} AS tag_jaccard,
  CASE WHEN abs(ab) >= {pearson} AND abs(rho) >= {rank} THEN 'NUMERICAL_DUPLICATE' WHEN abs(rest) >= {residual} AND abs(cosine) >= {exposure} THEN 'RESIDUAL_DUPLICATE' ELSE 'NOVEL' END AS code FROM f"""


@operator("j19_novelty", {"vectors": "embeddings"})
def novelty(d: Dialect) -> str:
    """Cosine of the mean vectors of every pair of labels, with a priority."""
    items = "posexplode(embedding) AS (i, x)" if d.name == "spark" else None
    flat = f"SELECT label, i, CAST(x AS DOUBLE) AS x FROM (SELECT label, {items} FROM {{vectors}}) AS e" if items else "SELECT label, unnest(generate_series(0, len(embedding) - 1)) AS i, unnest(embedding)::DOUBLE AS x FROM {vectors}"
    return f"""
WITH f AS ({flat}), m AS (SELECT label, i, avg(x) AS x FROM f GROUP BY label, i), n AS (SELECT label, sqrt(sum(x * x)) AS norm FROM m GROUP BY label)
SELECT a.label AS la, b.label AS lb, {r6('sum(a.x * b.x) / max(na.norm * nb.norm)')} AS cosine, CASE WHEN sum(a.x * b.x) / max(na.norm * nb.norm) > 0.9 THEN 'duplicate' ELSE 'novel' END AS priority FROM m AS a JOIN m AS b ON a.i = b.i AND a.label < b.label JOIN n AS na ON na.label = a.label JOIN n AS nb ON nb.label = b.label GROUP BY a.label, b.label"""


@operator("j20_composite_scores", CANDIDATES, STAGES["blends"])
def composite_scores(d: Dialect) -> str:
    """Every candidate scored on each fold's test sessions with that fold's weights."""
    return f"SELECT fold, horizon, candidate, scheme, count(*) AS days, {r6('avg(ic)')} AS score FROM ({tests_text(d)}) AS t GROUP BY fold, horizon, candidate, scheme"
