"""Nearest walls for whole Arrow batches of plans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Pairs of an opening and a wall that are looked at together; bounds the memory, however large a plan is.
PAIRS = 1 << 18
NONE = np.iinfo(np.int64).max


def floats(a: pa.ListArray) -> np.ndarray:
    return np.asarray(a.values.to_numpy(zero_copy_only=False), np.float64)


def whole(a: pa.ListArray, missing: int) -> np.ndarray:
    return np.asarray(a.values.cast(pa.int64()).fill_null(missing).to_numpy(zero_copy_only=False), np.int64)


def bounds(a: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    at = np.asarray(a.offsets).astype(np.int64)
    return at[:-1], np.where(np.asarray(a.is_valid()), at[1:], at[:-1])


def distances(x, y, sx, sy, ex, ey) -> np.ndarray:
    """geometry.segment_distance() of numbers, by the same steps."""
    dx, dy = ex - sx, ey - sy
    sq = dx * dx + dy * dy
    with np.errstate(all="ignore"):
        t = np.maximum(0.0, np.minimum(1.0, ((x - sx) * dx + (y - sy) * dy) / sq))
        px, py = x - (sx + t * dx), y - (sy + t * dy)
        return np.where(sq < 1e-10, np.sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)), np.sqrt(px * px + py * py))


def nearest(x, y, ord, at, index, sx, sy, ex, ey, earlier_only: bool) -> pa.Array:
    """For each row's openings, array<struct<i,d>>: the nearest wall, of equal ones the lowest index, and its distance.

    Walls at an unknown distance come last, with null; without any wall both are null.
    """
    n = len(x)
    start, end = bounds(x)
    first, last = bounds(at)
    count = end - start
    plan = np.repeat(np.arange(n), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + start[plan]
    ox, oy, oo = floats(x)[place], floats(y)[place], whole(ord, np.iinfo(np.int64).min)[place]
    wa, wi, w = whole(at, NONE), whole(index, NONE), [floats(c) for c in (sx, sy, ex, ey)]
    walls = (last - first)[plan]
    best_i, best_d = np.full(len(plan), NONE), np.full(len(plan), np.nan)
    some = np.flatnonzero(walls > 0)
    total = np.cumsum(walls[some])
    lo = 0
    while lo < len(some):
        begun = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, begun + PAIRS, side="right")))
        o = some[lo:hi]
        c = walls[o]
        starts = np.cumsum(c) - c
        k = np.repeat(np.arange(len(o)), c)
        j = np.arange(len(k)) - starts[k] + first[plan[o]][k]
        d = distances(ox[o][k], oy[o][k], *[v[j] for v in w])
        d = np.where(np.isnan(d), np.inf, d)
        i = wi[j]
        if earlier_only:
            out = wa[j] >= oo[o][k]
            d, i = np.where(out, np.inf, d), np.where(out, NONE, i)
        least = np.minimum.reduceat(d, starts)
        best_i[o] = np.minimum.reduceat(np.where(d == least[k], i, NONE), starts)
        best_d[o] = least
        lo = hi
    none = best_i == NONE
    found = pa.StructArray.from_arrays([pa.array(np.where(none, 0, best_i), pa.int64(), mask=none), pa.array(best_d, pa.float64(), mask=none | ~np.isfinite(best_d))], names=["i", "d"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), found)
