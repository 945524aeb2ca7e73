"""Linear algebra of all folds at once: ridge from Gram matrices, first components, cluster centres.

Folds overlap, so their rows are never copied: sums of products are taken once for each session and
added up by fold, and a pass over stored rows serves every fold that trains on them. What reaches the
driver has the size of the folds' states, not of their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators import order
from panelforge.operators.base import written

#: Fixed values of the risk states: what scales a median deviation, and how often states are refined.
MAD, POWER_STEPS, CLUSTER_STEPS = 1.4826, 50, 20
#: Rows that a pass takes at a time, rows of a range on average, and values of a span that are gathered at last.
CHUNK, RANGE, FITS = 65_536, 300_000, 1000


def ridge(sums: DataFrame, width: int, penalty: float = 1.0) -> DataFrame:
    """(fold, horizon, n, c0, c1 ...) for width controls from rows (fold, horizon, n, xs, xx, y, xy): the sums of the controls,
    of their products row by row, of the target, and of its products with the controls.

    The intercept is not penalised. A fold with fewer rows than coefficients is left out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy().astype(np.float64)
            xs, xx, xy = (np.array(batch.column(c).to_pylist(), np.float64).reshape(len(n), *shape) for c, shape in (("xs", (width,)), ("xx", (width, width)), ("xy", (width,))))
            y = batch.column("y").to_numpy()
            kept = n >= width + 1
            n, xs, xx, xy, y = n[kept], xs[kept], xx[kept], xy[kept], y[kept]
            gram = xx - xs[:, :, None] * xs[:, None, :] / n[:, None, None] + penalty * np.eye(width)
            slopes = np.linalg.solve(gram, (xy - xs * (y / n)[:, None])[:, :, None])[:, :, 0]
            intercept = (y - (slopes * xs).sum(1)) / n
            keys = [batch.column(c).filter(pa.array(kept)).cast(pa.int64()) for c in ("fold", "horizon", "n")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(intercept), *[pa.array(np.ascontiguousarray(s)) for s in slopes.T]], names=["fold", "horizon", "n", *[f"c{i}" for i in range(width + 1)]])

    return sums.mapInArrow(run, "fold long, horizon long, n long, " + ", ".join(f"c{i} double" for i in range(width + 1)))


def _chunks(batches: Iterator[pa.RecordBatch], exposures: int) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(horizon, sx, columns) of about CHUNK rows at a time; NaN counts as larger than anything, as in SQL."""

    def cut(held: list[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        table = pa.Table.from_batches(held)
        horizon, sx = table.column("horizon").to_numpy(), table.column("sx").to_numpy()
        xs = [table.column(f"e{i + 1}").to_numpy() for i in range(exposures)]
        xs = [np.where(np.isnan(x), np.inf, x) for x in xs]
        for h in np.unique(horizon).tolist():
            mine = np.flatnonzero(horizon == h)
            yield h, sx[mine], [x[mine] for x in xs]

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            yield from cut(held)
            held, rows = [], 0
    if held:
        yield from cut(held)


def _trains(roles: DataFrame) -> dict[int, np.ndarray]:
    """The sessions that each fold trains on."""
    train = roles.where("role = 'train'").groupBy("fold").agg(F.collect_list("sx").alias("sx"))
    return {r.fold: np.array(sorted(r.sx), np.int64) for r in train.collect()}


def _binned(wide: DataFrame, train: dict, mids: dict | None, spans: dict, exposures: int, gather: bool) -> DataFrame:
    """What lies in every open span: counts, least and largest value by bin, or (gather) the values.

    spans has a list of (lo, hi) for each (fold, horizon, e); mids turns values into distances from them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list[np.ndarray]] = {}
        for h, sx, xs in _chunks(batches, exposures):
            days, at = np.unique(sx, return_inverse=True)
            for fold, sessions in train.items():
                mine = None
                for e, x in enumerate(xs, 1):
                    key = fold, h, e
                    if key not in spans:
                        continue
                    if mine is None:
                        mine = np.flatnonzero(np.isin(days, sessions)[at])
                    v = x[mine]
                    v = np.abs(v - mids[key]) if mids else v
                    for place, (lo, hi) in enumerate(spans[key]):
                        part = v[(v >= lo) & (v <= hi)]
                        if not len(part):
                            continue
                        part.sort()
                        if gather:
                            total.setdefault((*key, place), []).append(part)
                            continue
                        bins = np.minimum(((part - lo) / (hi - lo) * order.BINS).astype(np.int64), order.BINS - 1)
                        first = np.flatnonzero(np.diff(bins, prepend=-1))
                        ends = np.append(first[1:], len(bins))
                        n, low, high = total.setdefault((*key, place), [np.zeros(order.BINS, np.int64), np.full(order.BINS, np.inf), np.full(order.BINS, -np.inf)])
                        b = bins[first]
                        n[b] += ends - first
                        low[b], high[b] = np.minimum(low[b], part[first]), np.maximum(high[b], part[ends - 1])
        for key, t in total.items():
            if gather:
                v = np.concatenate(t)
                bins, n, low, high = np.zeros(len(v), np.int64), np.ones(len(v), np.int64), v, v
            else:
                bins = np.flatnonzero(t[0])
                n, low, high = (c[bins] for c in t)
            keys = [pa.array(np.full(len(bins), k, np.int64)) for k in key]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(bins), pa.array(n), pa.array(low), pa.array(high)], names=["fold", "horizon", "e", "place", "bin_no", "n", "lo", "hi"])

    found = wide.mapInArrow(run, "fold long, horizon long, e long, place long, bin_no long, n long, lo double, hi double")
    if gather:
        return found
    return found.groupBy("fold", "horizon", "e", "place", "bin_no").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _quantiles(wide: DataFrame, train: dict, mids: dict | None, ends: dict, at: tuple[float, ...], exposures: int) -> dict[tuple, list[float]]:
    """Quantiles of every (fold, horizon, e) with linear interpolation; ends has (n, lo, hi) of each.

    Rows are never copied for the folds: a pass over them counts bins around the places that are still
    open, for all folds that train on a row, until a span holds few values.
    """
    asked = {key: sorted({int(f(p * (n - 1))) for p in at for f in (np.floor, np.ceil)}) for key, (n, _, _) in ends.items()}
    value: dict[tuple, float] = {}
    now = {key: [(lo, hi, 0, n)] for key, (n, lo, hi) in ends.items()}
    while now:
        gather = all(n <= FITS for spans in now.values() for _, _, _, n in spans)
        spans = {key: [s[:2] for s in spans] for key, spans in now.items()}
        inside: dict[tuple, list] = {}
        for r in _binned(wide, train, mids, spans, exposures, gather).collect():
            inside.setdefault((r.fold, r.horizon, r.e, r.place), []).append((r.lo, r.hi, r.n))
        later: dict[tuple, list] = {}
        for key, open_spans in now.items():
            for place, (_, _, before, n) in enumerate(open_spans):
                mine = [k for k in asked[key] if before <= k < before + n and (*key, k) not in value]
                start = before
                for lo, hi, m in sorted(inside[(*key, place)]):
                    here = [k for k in mine if start <= k < start + m]
                    if here and lo == hi:
                        value |= {(*key, k): lo for k in here}
                    elif here:
                        later.setdefault(key, []).append((lo, hi, start, m))
                    start += m
        now = later
    out = {}
    for key, (n, _, _) in ends.items():
        places = [p * (n - 1) for p in at]
        lows, highs = ([value[(*key, int(f(x)))] for x in places] for f in (np.floor, np.ceil))
        out[key] = [low + (x - np.floor(x)) * (high - low) for x, low, high in zip(places, lows, highs, strict=True)]
    return out


def robust_limits(wide: DataFrame, roles: DataFrame, exposures: int = 3, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """(fold, horizon, e, mid, lo, hi, mad) of rows (horizon, sx, e1, e2 ...): exact median, clipping
    quantiles and median deviation of every exposure on the rows a fold trains on."""
    train = _trains(roles)
    finite = lambda i: F.when(F.abs(f"e{i}") < float("inf"), F.col(f"e{i}"))
    numbers = range(1, exposures + 1)
    sessions = wide.groupBy("horizon", "sx").agg(*[f(finite(i)).alias(f"{name}{i}") for i in numbers for name, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).collect()
    ends: dict[tuple, tuple] = {}
    for fold, days in train.items():
        for r in sessions:
            if r.sx in set(days.tolist()):
                for i in numbers:
                    n, lo, hi = r[f"n{i}"], r[f"lo{i}"], r[f"hi{i}"]
                    if n:
                        m, a, b = ends.get((fold, r.horizon, i), (0, lo, hi))
                        ends[fold, r.horizon, i] = m + n, min(a, lo), max(b, hi)
    q = _quantiles(wide, train, None, ends, (0.5, lower, upper), exposures)
    away = {key: (n, 0.0, max(abs(lo - q[key][0]), abs(hi - q[key][0]))) for key, (n, lo, hi) in ends.items()}
    flat = {key for key, (_, _, hi) in away.items() if hi == 0}
    mad = _quantiles(wide, train, {k: v[0] for k, v in q.items()}, {k: v for k, v in away.items() if k not in flat}, (0.5,), exposures) | {key: [0.0] for key in flat}
    rows = [(*key, *map(float, q[key]), float(mad[key][0])) for key in sorted(ends)]
    return wide.sparkSession.createDataFrame(rows, "fold long, horizon long, e long, mid double, lo double, hi double, mad double")


def scaled(x: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Exposures (rows x exposures) clipped and scaled by limits (exposures x mid, lo, hi, mad); 0 without spread."""
    mid, lo, hi, mad = limits.T
    return np.where(mad > 0, (np.clip(x, lo, hi) - mid) / np.where(mad > 0, mad * MAD, 1), 0.0)


def first_component(covariance: np.ndarray, steps: int = POWER_STEPS) -> np.ndarray:
    """The first component of each covariance matrix by power steps from 1, 2, 3 ...; its first loading that
    is not 0 is positive, and a matrix of zeros gives zeros."""
    v = np.tile(np.arange(1.0, covariance.shape[-1] + 1), (len(covariance), 1))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for _ in range(steps):
        v = (covariance @ v[:, :, None])[:, :, 0]
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 1e-15)
    lead = np.take_along_axis(v, (np.abs(v) > 1e-12).argmax(1)[:, None], 1)
    return np.where(lead < 0, -v, v)


def nearest(z: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre next to each row; of equally near ones the first."""
    return _nearest([np.ascontiguousarray(c) for c in z.T], centres)


def _nearest(columns: list[np.ndarray], centres: np.ndarray) -> np.ndarray:
    """The same from columns, one centre after the other, so that no row is copied for every centre."""
    best, place = np.full(len(columns[0]), np.inf), np.zeros(len(columns[0]), np.int64)
    for j, centre in enumerate(centres):
        far = sum((c - x) ** 2 for c, x in zip(columns, centre, strict=True))
        nearer = far < best
        place[nearer] = j
        np.minimum(best, far, out=best)
    return place


def _scaled(columns: list[np.ndarray], limits: np.ndarray) -> list[np.ndarray]:
    """scaled by columns."""
    return [(np.clip(x, lo, hi) - mid) / (mad * MAD) if mad > 0 else np.zeros(len(x)) for x, (mid, lo, hi, mad) in zip(columns, limits.tolist(), strict=True)]


class _Folds:
    """States of all folds by horizon, and the sessions that each fold trains on."""

    def __init__(self, limits: DataFrame, roles: DataFrame, exposures: int) -> None:
        self.limits: dict[tuple[int, int], np.ndarray] = {}
        rows = limits.collect()
        for r in rows:
            self.limits.setdefault((r.fold, r.horizon), np.zeros((exposures, 4)))[r.e - 1] = r.mid, r.lo, r.hi, r.mad
        seen = {(r.fold, r.horizon, r.e) for r in rows}
        self.train = _trains(roles)
        self.keys = sorted(k for k in self.limits if k[0] in self.train and all((*k, e) in seen for e in range(1, exposures + 1)))


def _sums(folds: _Folds, centres: dict | None, exposures: int):
    """Counts and sums of the scaled exposures by fold, horizon and nearest centre; without centres their products too."""
    groups = len(next(iter(centres.values()))) if centres else 1
    width = 1 + exposures + (0 if centres else exposures * exposures)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros((groups, width)) for k in folds.keys}
        for h, sx, xs in _chunks(batches, exposures):
            days, at = np.unique(sx, return_inverse=True)
            for key in folds.keys:
                if key[1] != h:
                    continue
                mine = np.flatnonzero(np.isin(days, folds.train[key[0]])[at])
                z = _scaled([x[mine] for x in xs], folds.limits[key])
                if centres:
                    group = _nearest(z, centres[key])
                    total[key] += np.column_stack([np.bincount(group, w, groups) for w in (None, *z)])
                else:
                    total[key][0] += [len(mine), *(c.sum() for c in z), *(a @ b for a in z for b in z)]
        rows = [(*k, g, i, v) for k, t in total.items() for g, row in enumerate(t) for i, v in enumerate(row.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["fold", "horizon", "grp", "at", "value"])

    return run, groups, width


def _added(wide: DataFrame, folds: _Folds, centres: dict | None, exposures: int) -> dict[tuple[int, int], np.ndarray]:
    run, groups, width = _sums(folds, centres, exposures)
    parts = wide.mapInArrow(run, "fold long, horizon long, grp long, at long, value double")
    out = {k: np.zeros((groups, width)) for k in folds.keys}
    for r in parts.groupBy("fold", "horizon", "grp", "at").agg(F.sum("value").alias("value")).collect():
        out[r.fold, r.horizon][r.grp, r.at] = r.value
    return out


def risk_states(wide: DataFrame, roles: DataFrame, limits: DataFrame, exposures: int = 3, clusters: int = 8, steps: int = CLUSTER_STEPS) -> DataFrame:
    """(fold, horizon, n, means, loadings, centres) of rows (horizon, sx, e1, e2 ...) that each fold trains on.

    The component comes from the covariance of the scaled exposures. Centres start at evenly spaced
    places of the distinct scaled rows in order and move to the means of their rows so many times;
    centres without rows stay. A fold with fewer distinct rows than clusters is left out.
    """
    names = [f"e{i + 1}" for i in range(exposures)]
    folds = _Folds(limits, roles, exposures)
    start = _starts(wide, folds, names, clusters)
    if start is None:
        start = _starts_by_places(wide, roles, limits, names, clusters)
    folds.keys = [k for k in folds.keys if k in start]
    schema = "fold long, horizon long, n long, means array<double>, loadings array<double>, centres array<array<double>>"
    if not folds.keys:
        return wide.sparkSession.createDataFrame([], schema)
    whole = _added(wide, folds, None, exposures)
    centres = {k: start[k] for k in folds.keys}
    for _ in range(steps):
        moved = _added(wide, folds, centres, exposures)
        centres = {k: np.where(moved[k][:, :1] > 0, moved[k][:, 1 : 1 + exposures] / np.maximum(moved[k][:, :1], 1), centres[k]) for k in folds.keys}
    rows = []
    for k in folds.keys:
        n, mean = whole[k][0, 0], whole[k][0, 1 : 1 + exposures] / whole[k][0, 0]
        products = whole[k][0, 1 + exposures :].reshape(exposures, exposures)
        loading = first_component(((products - n * np.outer(mean, mean)) / max(n - 1, 1))[None])[0]
        rows.append((*k, int(n), mean.tolist(), loading.tolist(), centres[k].tolist()))
    return wide.sparkSession.createDataFrame(rows, schema)


def _starts(wide: DataFrame, folds: _Folds, names: list[str], clusters: int) -> dict[tuple[int, int], np.ndarray] | None:
    """The scaled rows at places round(i * (distinct - 1) / (clusters - 1)) of each fold's distinct ones.

    Rows are dealt by ranges of the first exposure, once for all folds: scaling keeps its order, and what
    a fold clips to one value stays in the first or the last range. A range that would part equal scaled
    values of a fold is joined to the next. None if a range would be too large for a task.
    """
    if any(folds.limits[k][0, 3] <= 0 for k in folds.keys):
        return None
    first = F.when(F.isnan(names[0]), float("inf")).otherwise(F.col(names[0]))
    sizes = {r.horizon: r.n for r in wide.groupBy("horizon").agg(F.count("*").alias("n")).collect()}
    cuts: dict[int, np.ndarray] = {}
    for h, n in sizes.items():
        mine = [folds.limits[k][0] for k in folds.keys if k[1] == h]
        if mine:
            ranges = -(-n // RANGE)
            probs = [float(i) / ranges for i in range(1, ranges)]
            found = wide.where(F.col("horizon") == h).agg(F.percentile_approx(first, probs, 10_000)).first()[0] if probs else []
            low, high = max(m[1] for m in mine), min(m[2] for m in mine)
            cuts[h] = np.array(sorted({x for x in found or [] if low < x < high}))
    while True:
        ranged = written(wide.mapInArrow(_ranged(cuts, names), "horizon long, sx long, " + ", ".join(f"{n} double" for n in names) + ", range_no long"))
        if any(r.n > 10 * RANGE for r in ranged.groupBy("horizon", "range_no").agg(F.count("*").alias("n")).collect()):
            return None
        counted: dict[tuple, list] = {}
        for r in _distinct(ranged, folds, names, None).collect():
            counted.setdefault((r.fold, r.horizon), []).append((r.range_no, r.n, r.z1, r.last))
        parted: dict[int, set] = {}
        for key, found in counted.items():
            found.sort()
            for a, b in zip(found, found[1:], strict=False):
                if a[3] == b[2]:
                    parted.setdefault(key[1], set()).update(range(a[0], b[0]))
        if not parted:
            break
        cuts = {h: np.delete(c, sorted(parted.get(h, ()))) for h, c in cuts.items()}
    wanted: dict[tuple, list[int]] = {}
    for key, found in counted.items():
        n = sum(f[1] for f in found)
        if n < clusters:
            continue
        places, before = [round(float(i) * (n - 1) / (clusters - 1)) for i in range(clusters)], 0
        for range_no, m, _, _ in found:
            here = [p - before for p in places if before <= p < before + m]
            if here:
                wanted[(*key, range_no)] = here
            before += m
    if not wanted:
        return {}
    few = ranged.sparkSession.createDataFrame(sorted({k[1:] for k in wanted}), "horizon long, range_no long")
    out: dict[tuple[int, int], list] = {}
    for r in _distinct(ranged.join(F.broadcast(few), ["horizon", "range_no"]), folds, names, wanted).collect():
        out.setdefault((r.fold, r.horizon), []).append((r.range_no, r.n, [r[f"z{i + 1}"] for i in range(len(names))]))
    return {k: np.array([z for *_, z in sorted(rows)]) for k, rows in out.items() if len(rows) == clusters}


def _ranged(cuts: dict[int, np.ndarray], names: list[str]):
    """Rows with the number of the range that their first exposure lies in; horizons without folds go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, sx, xs in _chunks(batches, len(names)):
            if h in cuts:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sx), h, np.int64)), pa.array(sx), *map(pa.array, xs), pa.array(np.searchsorted(cuts[h], xs[0], "right").astype(np.int64))], names=["horizon", "sx", *names, "range_no"])

    return run


def _distinct(ranged: DataFrame, folds: _Folds, names: list[str], wanted: dict | None) -> DataFrame:
    """Each fold's distinct scaled rows of a range in order: their number n, the first row and the last z1, or
    the rows at the wanted places n."""
    schema = "fold long, horizon long, range_no long, n long, last double, " + ", ".join(f"z{i + 1} double" for i in range(len(names)))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        horizon, range_no = (k.as_py() for k in key)
        sx = group.column("sx").to_numpy()
        xs = [group.column(n).to_numpy() for n in names]
        ordered = np.lexsort(xs[::-1])  # nearly the order of every fold: what it clips is sorted again
        sx, xs = sx[ordered], [x[ordered] for x in xs]
        days, at = np.unique(sx, return_inverse=True)
        rows = []
        for fold, h in folds.keys:
            if h != horizon or (wanted is not None and (fold, h, range_no) not in wanted):
                continue
            mine = np.flatnonzero(np.isin(days, folds.train[fold])[at])
            if not len(mine):
                continue
            z = _scaled([x[mine] for x in xs], folds.limits[fold, h])
            by = np.lexsort(z[::-1])
            z = [c[by] for c in z]
            new = np.ones(len(by), bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in z])
            at_new = np.flatnonzero(new)
            for i in [None] if wanted is None else wanted[fold, h, range_no]:
                rows.append((fold, h, range_no, len(at_new) if i is None else i, float(z[0][-1]), *[float(c[at_new[i or 0]]) for c in z]))
        kinds = [pa.int64()] * 4 + [pa.float64()] * (1 + len(names))
        cells = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.table([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], names=["fold", "horizon", "range_no", "n", "last", *[f"z{i + 1}" for i in range(len(names))]])

    return ranged.groupBy("horizon", "range_no").applyInArrow(run, schema)


def neutral_sections(wide: DataFrame, roles: DataFrame, limits: DataFrame, states: DataFrame, exposures: int, least_members: int, least_names: int) -> DataFrame:
    """(fold, horizon, session, instrument, pc, cluster, pca_neutral, cluster_neutral) of every fold that tests a row.

    A session of a horizon is one group, taken fold by fold, so no row is copied for the folds before it
    is a result.
    """
    folds = _Folds(limits, roles, exposures)
    fitted = {(r.fold, r.horizon): (np.array(r.means), np.array(r.loadings), np.array(r.centres)) for r in states.collect()}
    tested: dict[int, list[int]] = {}
    for r in roles.where("role = 'test'").select("fold", "sx").collect():
        tested.setdefault(r.sx, []).append(r.fold)
    kinds = dict(wide.dtypes)
    names = ["fold", "horizon", "session", "instrument", "pc", "cluster", "pca_neutral", "cluster_neutral"]
    schema = ", ".join(f"{n} {kinds.get(n, 'double' if n not in ('fold', 'cluster') else 'long')}" for n in names)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        horizon, session, sx = (k.as_py() for k in key)
        n = group.num_rows
        use = [f for f in sorted(tested.get(sx, ())) if (f, horizon) in fitted] if n >= least_names else []
        signal = group.column("signal").to_numpy()
        xs = [np.where(np.isnan(x), np.inf, x) for x in (group.column(f"e{i + 1}").to_numpy() for i in range(exposures))]
        ids = group.column("instrument").combine_chunks()
        same = [pa.repeat(k, n).cast(group.schema.field(c).type) for k, c in zip(key[:2], ("horizon", "session"), strict=True)]
        parts = []
        for fold in use:
            means, loadings, centres = fitted[fold, horizon]
            z = _scaled(xs, folds.limits[fold, horizon])
            pc = sum((c - m) * w for c, m, w in zip(z, means, loadings, strict=True))
            cluster = _nearest(z, centres)
            off, across = signal - signal.mean(), pc - pc.mean()
            beta = off @ across / (across @ across) if pc.min() < pc.max() else 0.0
            members = np.bincount(cluster, None, len(centres))
            mid = np.bincount(cluster, signal, len(centres)) / np.maximum(members, 1)
            mid = np.where(members >= least_members, mid, signal.mean())
            parts.append(pa.table([pa.array(np.full(n, fold, np.int64)), *same, ids, pa.array(pc), pa.array(cluster), pa.array(off - beta * across), pa.array(signal - mid[cluster])], names=names))
        if parts:
            return pa.concat_tables(parts)
        types = [pa.int64(), *[a.type for a in same], ids.type, pa.float64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array([], t) for t in types], names=names)

    return wide.groupBy("horizon", "session", "sx").applyInArrow(run, schema)


def _starts_by_places(wide: DataFrame, roles: DataFrame, limits: DataFrame, names: list[str], clusters: int) -> dict[tuple[int, int], np.ndarray]:
    """The same for exposures with so many equal values that a range of one would not fit a task: by ranks of whole rows."""
    by = ["fold", "horizon"]
    z = wide.join(F.broadcast(roles.where("role = 'train'").select("fold", "sx")), "sx")
    for name in names:
        one = limits.where(F.col("e") == int(name[1:])).select(*by, "mid", "lo", "hi", "mad")
        value = (F.least(F.greatest(F.col(name), F.col("lo")), F.col("hi")) - F.col("mid")) / (F.col("mad") * MAD)
        z = order.joined(z, one, by).withColumn(name, F.when(F.col("mad") > 0, value).otherwise(0.0)).drop("mid", "lo", "hi", "mad")
    distinct = written(z.select(*by, *names).distinct())
    sizes = written(distinct.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= clusters))
    placed = order.joined(order.places(distinct, by, names, "z"), sizes, by)
    wanted = F.array(*[F.bround(F.lit(float(i)) * (F.col("n") - 1) / (clusters - 1), 0).cast("long") for i in range(clusters)])
    out: dict[tuple[int, int], list] = {}
    for r in placed.where(F.array_contains(wanted, F.col("z_before"))).select(*by, "z_before", *names).orderBy(*by, "z_before").collect():
        out.setdefault((r.fold, r.horizon), []).append([r[n] for n in names])
    return {k: np.array(rows) for k, rows in out.items() if len(rows) == clusters}
