"""What is wrong with rings, and their areas, for whole Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

FAULTS = np.array([None, "few points", "bad point", "no area", "repeated point", "crossing"], object)
FEW, BAD, FLAT, REPEATED, CROSSING = range(1, 6)

#: Corners that are looked at together; bounds the memory, whatever the number and size of rings.
CORNERS = 1 << 18


def turn(ax, ay, bx, by, cx, cy) -> np.ndarray:
    t = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return (t > 1e-9).astype(np.int8) - (t < -1e-9)


def equal_rings(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Faults of rings (a row each) of the same number of finite corners."""
    n = x.shape[1]
    fault = np.zeros(len(x), np.int8)
    flat = (turn(x[:, :1], y[:, :1], x[:, 1:-1], y[:, 1:-1], x[:, 2:], y[:, 2:]) == 0).all(axis=1)
    repeated, crossing = np.zeros(len(x), bool), np.zeros(len(x), bool)
    i = np.arange(n)
    for apart in range(1, n // 2 + 1):  # each two corners, and the sides that begin there
        a, b = np.minimum(i, (i + apart) % n), np.maximum(i, (i + apart) % n)
        repeated |= ((x[:, a] == x[:, b]) & (y[:, a] == y[:, b])).any(axis=1)
        if apart == 1:
            continue
        c, d = (a + 1) % n, (b + 1) % n
        ax, ay, bx, by, cx, cy, dx, dy = x[:, a], y[:, a], x[:, b], y[:, b], x[:, c], y[:, c], x[:, d], y[:, d]
        first, last = turn(ax, ay, cx, cy, bx, by), turn(ax, ay, cx, cy, dx, dy)
        other = turn(bx, by, dx, dy, ax, ay) != turn(bx, by, dx, dy, cx, cy)
        touch = np.ones(ax.shape, bool)
        for p, q, r, s in ((ax, cx, bx, dx), (ay, cy, by, dy)):
            touch &= np.maximum(np.minimum(p, q), np.minimum(r, s)) <= np.minimum(np.maximum(p, q), np.maximum(r, s))
        crossing |= (((first != last) & other) | ((first == 0) & (last == 0) & touch)).any(axis=1)
    fault[crossing], fault[repeated], fault[flat] = CROSSING, REPEATED, FLAT
    return fault


def corners(rings: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x and y of all corners of array<array<double>>, whether each is two finite numbers, and start and end of each ring."""
    points = rings.values
    at = np.asarray(points.offsets).astype(np.int64)
    numbers = np.append(np.asarray(points.values.to_numpy(zero_copy_only=False), np.float64), [np.nan, np.nan])
    x, y = numbers[at[:-1]], numbers[at[:-1] + 1]
    fine = (np.diff(at) == 2) & np.asarray(points.is_valid()) & np.isfinite(x) & np.isfinite(y)
    bounds = np.asarray(rings.offsets).astype(np.int64)
    start, end = bounds[:-1], np.where(np.asarray(rings.is_valid()), bounds[1:], bounds[:-1])
    return x, y, fine, start, end


def by_size(start: np.ndarray, end: np.ndarray, chosen: np.ndarray):
    """Places of the chosen rings, those of equal size together, and their corners' places, a row for each ring."""
    size = end - start
    for n in np.unique(size[chosen]):
        same = np.flatnonzero(chosen & (size == n))
        step = max(1, CORNERS // int(n))
        for k in range(0, len(same), step):
            yield same[k : k + step], start[same[k : k + step], None] + np.arange(n)


def fault_codes(rings: pa.ListArray) -> np.ndarray:
    """A number for each ring, see FAULTS; 0 where nothing is wrong. Null has few points."""
    x, y, fine, start, end = corners(rings)
    faulty = np.concatenate(([0], np.cumsum(~fine)))
    code = np.where(end - start < 3, FEW, np.where(faulty[end] > faulty[start], BAD, 0)).astype(np.int8)
    for at, k in by_size(start, end, code == 0):
        code[at] = equal_rings(x[k], y[k])
    return code


def ring_faults(rings: pa.ListArray) -> pa.Array:
    return pa.array(FAULTS[fault_codes(rings)], pa.string())


def list_faults(lists: pa.ListArray) -> pa.Array:
    """ring_faults() of lists of rings, list by list."""
    at = np.asarray(lists.offsets)
    end = np.where(np.asarray(lists.is_valid()), at[1:], at[:-1])
    faults = pa.array(FAULTS[fault_codes(lists.values)], pa.string())
    if (end == at[1:]).all():
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), faults)
    return pa.array([faults[a:b].to_pylist() for a, b in zip(at[:-1], end, strict=True)], pa.list_(pa.string()))


def rounded(v: np.ndarray, digits: int) -> np.ndarray:
    """geometry.round_exact() of numbers."""
    k = float(10**digits)
    a = np.abs(v)
    p = a * k
    whole = np.floor(p)
    part = p - whole
    upper = a * 134217729.0 - (a * 134217729.0 - a)
    error = (upper * k - p) + (a - upper) * k
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (whole % 2.0 == 1.0))))
    out = np.where(p < 4503599627370496.0, (whole + up) / k, a)
    return np.where(v < 0, -out, out)


def areas(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """geometry.polygon_area() of rings (a row each) of the same number of corners."""
    x, y = x - x[:, :1], y - y[:, :1]
    total = np.zeros(len(x))
    n = x.shape[1]
    for i in range(n):
        j = (i + 1) % n
        total = total + x[:, i] * y[:, j] - x[:, j] * y[:, i]
    return np.abs(total) / 2.0
