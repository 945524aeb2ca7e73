"""Operators that need more than SQL: normal quantiles and shuffled cross-sections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EULER = 0.5772156649015329


@F.pandas_udf(T.DoubleType())
def deflated_probability(sharpe: pd.Series, spread: pd.Series, trials: pd.Series, error: pd.Series) -> pd.Series:
    """Probability that a Sharpe ratio beats the best that so many trials give by chance."""
    normal = NormalDist()

    def one(s: float, sd: float, n: float, e: float) -> float | None:
        if not all(map(math.isfinite, (s, sd, e))) or n < 2 or e <= 0:
            return None
        best = sd * ((1 - _EULER) * normal.inv_cdf(1 - 1 / n) + _EULER * normal.inv_cdf(1 - 1 / (n * math.e)))
        return normal.cdf((s - best) / e)

    return pd.Series([one(*row) for row in zip(sharpe, spread, trials, error, strict=True)])


def deflated_sharpe(inputs: DataFrame) -> DataFrame:
    """Adds dsr to one summary row per candidate (see j12_deflated_sharpe_inputs)."""
    return inputs.withColumn("dsr", F.round(deflated_probability("sharpe", "sharpe_spread", F.col("trials").cast("double"), "sharpe_error"), 6))


#: Fixed values of the shuffle: a prime, and what the parts of its seed are multiplied by.
PRIME, BY_NAME, BY_REP, BY_SESSION, BY_METHOD, BY_SEED = 2147483647, 48271, 69621, 16807, 7919, 104729

#: Bits that a name's place in its cross-section may take.
PLACE_BITS = 24


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, 2^31 - 1, for x from 0 below 2^62, without a division."""
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    return np.where(x >= PRIME, x - PRIME, x)


def shuffled_ics(rows: DataFrame, reps: int = 199, seed: int = 7) -> DataFrame:
    """(factor_id, horizon, session, method, rep, ic): RankICs of cross-sections with one side shuffled.

    Rows are (factor_id, horizon, session, sx, instrument, v, fwd). Method 0 shuffles the returns, 1 the
    signals, by squares modulo a prime; repetition 0 is the cross-section as it is. A constant side gives
    no ic. A session is one group: the order of a repetition depends on names and session only, so names are
    sorted once for all factors and horizons, and a cross-section takes its own names out of that order.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("factor_id", "horizon", "session")) + ", method int, rep int, ic double"

    def ordered(x: pa.ChunkedArray) -> np.ndarray:
        return np.nan_to_num(x.cast(pa.float64()).fill_null(-np.inf).to_numpy(), nan=np.inf, posinf=np.inf, neginf=-np.inf)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        sx = key[1].as_py()
        group = group.combine_chunks()
        names, at = np.unique(group.column("instrument").to_numpy(), return_inverse=True)
        if len(names) >> PLACE_BITS:
            raise ValueError(f"a session of {len(names)} names is too large to be shuffled in one group")
        v, fwd = ordered(group.column("v")), ordered(group.column("fwd"))
        factor = group.column("factor_id").combine_chunks().dictionary_encode()
        horizon = group.column("horizon").combine_chunks().dictionary_encode()
        code = factor.indices.to_numpy() * len(horizon.dictionary) + horizon.indices.to_numpy()
        same: dict[bytes, tuple[np.ndarray | None, list]] = {}
        for c in np.unique(code).tolist():
            mine = np.flatnonzero(code == c)
            mine = mine[np.argsort(at[mine], kind="stable")]
            ranks = [average_ranks(x[mine]) for x in (v, fwd)]
            ranks = [r - r.mean() for r in ranks]
            spread = math.sqrt((ranks[0] @ ranks[0]) * (ranks[1] @ ranks[1]))
            seat = np.full(len(names), -1, np.int64)
            seat[at[mine]] = np.arange(len(mine))
            whole = None if len(mine) == len(names) else seat
            same.setdefault(b"" if whole is None else seat.tobytes(), (whole, []))[1].append((c, ranks, spread))
        out: list[tuple] = [(c, 0, 0, float(r[0] @ r[1]) / s if s else None) for _, sections in same.values() for c, r, s in sections]
        mixed = _folded((names * BY_NAME) % PRIME)
        places = np.arange(len(names))
        for method in (0, 1):
            for rep in range(1, reps + 1):
                first = _folded(mixed + (rep * BY_REP + sx * BY_SESSION + method * BY_METHOD + seed * BY_SEED) % PRIME)
                second = _folded(first * first) + rep
                # The place stands in the low bits: one sort gives the order, ties by name.
                order = np.sort(_folded(second * second) << PLACE_BITS | places) & ((1 << PLACE_BITS) - 1)
                for seat, sections in same.values():
                    taken = order
                    if seat is not None:
                        taken = seat[order]
                        taken = taken[taken >= 0]
                    for c, (rv, rf), spread in sections:
                        moved, still = (rf, rv) if method == 0 else (rv, rf)
                        out.append((c, method, rep, float(moved[taken] @ still) / spread if spread else None))
        found, method, rep, ic = zip(*out, strict=True)
        found = np.array(found)
        which = [d.dictionary.take(pa.array(i)) for d, i in ((factor, found // len(horizon.dictionary)), (horizon, found % len(horizon.dictionary)))]
        return pa.table([*which, pa.repeat(key[0], len(ic)).cast(group.schema.field("session").type), pa.array(method, pa.int32()), pa.array(rep, pa.int32()), pa.array(ic, pa.float64())], names=["factor_id", "horizon", "session", "method", "rep", "ic"])

    return rows.groupBy("session", "sx").applyInArrow(run, schema)


def marginal_sections(rows: DataFrame, roles: DataFrame, betas: DataFrame, fraction: float = 0.2, added: float = 0.5) -> DataFrame:
    """Figures of a candidate's residual on every fold's test sessions: a row for each fold and session.

    Rows are (factor_id, horizon, session, sx, instrument, x, y, fwd): the reference x, the candidate y
    and the returns. A cross-section is one group, taken fold by fold: sums for correlations, the long and
    long-short returns of the reference and of both together, and the names held come out, as arrays all
    the way. What the tasks get beside the rows are the folds' regressions and which sessions they test.
    """
    tested: dict[int, list[int]] = {}
    for r in roles.where("role = 'test'").select("fold", "sx").collect():
        tested.setdefault(r.sx, []).append(r.fold)
    fits = {(r.fold, r.factor_id, r.horizon): (r.beta, r.mx, r.my) for r in betas.collect()}
    keys = ["factor_id", "horizon", "session", "sx"]
    figures = ("se", "sf", "sx1", "see", "sff", "sxx", "sef", "sxf", "ret_ref", "ret_aug", "ls_ref", "ls_aug")
    kinds = dict(rows.dtypes)
    schema = "fold long, " + ", ".join(f"{c} {kinds[c]}" for c in keys[:3]) + ", n long, " + ", ".join(f"{c} double" for c in figures) + ", held_ref array<long>, held_aug array<long>"

    def standard(v: np.ndarray) -> np.ndarray:
        spread = v.std()
        return (v - v.mean()) / spread if spread > 0 else np.zeros_like(v)

    def held(names: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, names)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(names)))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        factor, horizon, _, sx = (k.as_py() for k in key)
        folds = [f for f in sorted(tested.get(sx, ())) if (f, factor, horizon) in fits]
        types = [group.schema.field(c).type for c in keys[:3]]
        if not folds:
            empty = [pa.array([], t) for t in (pa.int64(), *types, pa.int64(), *[pa.float64()] * len(figures), *[pa.list_(pa.int64())] * 2)]
            return pa.table(empty, names=names)
        ids, x, y, fwd = (group.column(c).to_numpy() for c in ("instrument", "x", "y", "fwd"))
        by_name = np.argsort(ids, kind="stable")
        ids, x, y, fwd = ids[by_name], x[by_name], y[by_name], fwd[by_name]
        count = max(1, math.ceil(len(ids) * fraction))
        by_reference, zx = np.argsort(x, kind="stable"), standard(x)
        found, kept = [], ([], [])
        for fold in folds:
            beta, mx, my = fits[fold, factor, horizon]
            e = y - my - beta * (x - mx)
            orders = by_reference, np.argsort(np.round(zx + added * standard(e), 9), kind="stable")
            tops, ends = [o[-count:] for o in orders], [o[:count] for o in orders]
            long = [fwd[t].mean() for t in tops]
            spread = [a - fwd[b].mean() for a, b in zip(long, ends, strict=True)]
            found.append([e.sum(), fwd.sum(), x.sum(), e @ e, fwd @ fwd, x @ x, e @ fwd, x @ fwd, *long, *spread])
            for k, t in zip(kept, tops, strict=True):
                k.append(ids[t])
        same = [pa.repeat(k, len(folds)).cast(t) for k, t in zip(key[:3], types, strict=True)]
        columns = [pa.array(folds, pa.int64()), *same, pa.array([len(ids)] * len(folds), pa.int64()), *[pa.array(c) for c in np.array(found, np.float64).T.copy()], *map(held, kept)]
        return pa.table(columns, names=names)

    names = ["fold", *keys[:3], "n", *figures, "held_ref", "held_aug"]
    return rows.groupBy(*keys).applyInArrow(run, schema)


def slices(rows: DataFrame, kinds: dict[str, str], b: int, parts: int = 3) -> DataFrame:
    """A row for each of the equal parts of every cross-section by size, liquidity ... (kinds: name and column).

    Rows are (factor_id, horizon, session, instrument, v, fwd, prior_amount) with the columns of kinds; a
    cross-section is one group. n names with their mean return (market) and RankIC (three names and spread at
    least, else null), the first of them in the order that cuts the parts, and the b largest v, held.
    """
    types = dict(rows.dtypes)
    schema = f"base string, factor_id string, kind string, slice long, horizon {types['horizon']}, session {types['session']}, n long, market double, rank_ic double, first_x double, first_name {types['instrument']}, held array<struct<instrument {types['instrument']}, fwd double, prior_amount double>>"

    def ordered(x: pa.ChunkedArray) -> np.ndarray:
        return x.fill_null(-np.inf).to_numpy()

    def run(key: tuple, group: pa.Table) -> pa.Table:
        factor, horizon, session = (k.as_py() for k in key)
        group = group.combine_chunks()
        ids, n, out = group.column("instrument").to_numpy(), group.num_rows, []
        v, fwd = ordered(group.column("v")), group.column("fwd").to_numpy()
        best = np.lexsort((ids, -v))
        for kind, column in kinds.items():
            by = np.lexsort((ids, ordered(group.column(column))))
            cut = np.empty(n, np.int64)
            cut[by] = np.floor(np.arange(n) * parts / n)
            for k in range(parts):
                mine = np.flatnonzero(cut == k)
                if not len(mine):
                    continue
                x, y, first = v[mine], fwd[mine], by[cut[by].searchsorted(k)]
                ic = None
                if len(mine) >= 3 and x.min() < x.max() and y.min() < y.max():
                    rx, ry = (r - r.mean() for r in (average_ranks(x), average_ranks(y)))
                    ic = float(rx @ ry / math.sqrt((rx @ rx) * (ry @ ry)))
                held = group.select(["instrument", "fwd", "prior_amount"]).take(pa.array(best[cut[best] == k][:b])).to_pylist()
                out.append((factor, f"{factor}|{kind}|{k + 1}", kind, k + 1, horizon, session, len(mine), float(y.mean()), ic, group.column(column)[int(first)].as_py(), int(ids[first]), held))
        fields = [group.schema.field(c).type for c in ("horizon", "session", "instrument")]
        row = pa.struct([("instrument", fields[2]), ("fwd", pa.float64()), ("prior_amount", pa.float64())])
        arrow = [pa.string(), pa.string(), pa.string(), pa.int64(), fields[0], fields[1], pa.int64(), pa.float64(), pa.float64(), pa.float64(), fields[2], pa.list_(row)]
        names = ["base", "factor_id", "kind", "slice", "horizon", "session", "n", "market", "rank_ic", "first_x", "first_name", "held"]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], names=names)

    return rows.groupBy("factor_id", "horizon", "session").applyInArrow(run, schema)


def average_ranks(v: np.ndarray) -> np.ndarray:
    """Ranks from 1, equal values sharing the mean of their places."""
    order = np.argsort(v, kind="stable")
    s = v[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    ties = np.diff(np.append(first, len(v)))
    out = np.empty(len(v))
    out[order] = np.repeat(first + (ties + 1) / 2, ties)
    return out


def blend_ics(rows: DataFrame, need: DataFrame) -> DataFrame:
    """(blend, horizon, sx, ic): RankIC of every blend on the names of a session that have all its factors.

    rows are (factor_id, horizon, sx, instrument, v, fwd); need has a row (blend, horizon, sx, factor_id,
    weight) for each factor of each blend that a session is asked for. A session's rows and blends meet
    in one group, where factors are ranked once and blends are taken one by one, so no row is copied.
    """

    def run(key: tuple, section: pa.Table, wanted: pa.Table) -> pa.Table:
        out: dict[str, list] = {"blend": [], "ic": []}
        if section.num_rows and wanted.num_rows:
            names, at = np.unique(section.column("instrument").to_numpy(), return_inverse=True)
            coded = section.column("factor_id").combine_chunks().dictionary_encode()
            factor, known = coded.indices.to_numpy(), {f: i for i, f in enumerate(coded.dictionary.to_pylist())}
            v, fwd = (section.column(c).to_numpy() for c in ("v", "fwd"))
            units, times, best = np.zeros((len(known), len(names))), np.zeros((len(known), len(names)), np.int32), np.full((len(known), len(names)), -np.inf)
            for i in known.values():
                mine = factor == i
                np.add.at(units[i], at[mine], (average_ranks(v[mine]) - 1) / max(mine.sum() - 1, 1))
                np.add.at(times[i], at[mine], 1)
                np.maximum.at(best[i], at[mine], fwd[mine])
            blends: dict[str, list[tuple[str, float]]] = {}
            for b, f, w in zip(*(wanted.column(c).to_pylist() for c in ("blend", "factor_id", "weight")), strict=True):
                blends.setdefault(b, []).append((f, w))
            returns: dict[tuple, tuple] = {}
            for blend, parts in blends.items():
                parts = sorted(parts)
                use = tuple(known[f] for f, _ in parts if f in known)
                if (use, len(parts)) not in returns:
                    mask = np.flatnonzero(times[list(use)].sum(0) == len(parts)) if use else np.zeros(0, np.int64)
                    rank = average_ranks(best[list(use)][:, mask].max(0)) if len(mask) else np.zeros(0)
                    returns[use, len(parts)] = mask, rank - rank.mean() if len(mask) else rank
                mask, rf = returns[use, len(parts)]
                if len(mask) < 3:
                    continue
                rv = average_ranks(np.round(sum(w * units[known[f]][mask] for f, w in parts if f in known), 9))
                rv -= rv.mean()
                spread = math.sqrt((rv @ rv) * (rf @ rf))
                out["blend"].append(blend)
                out["ic"].append(float(rv @ rf) / spread if spread else None)
        n = len(out["blend"])
        return pa.table([pa.array(out["blend"], pa.string()), *[pa.repeat(k, n).cast(pa.int64()) for k in key], pa.array(out["ic"], pa.float64())], names=["blend", "horizon", "sx", "ic"])

    on = ["horizon", "sx"]
    return rows.groupBy(*on).cogroup(need.groupBy(*on)).applyInArrow(run, "blend string, horizon long, sx long, ic double")
