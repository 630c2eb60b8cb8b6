"""Douglas-Peucker of rings that keeps their topology: a step that would make the ring meet itself isn't taken."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from .rings import areas, by_size, corners, rounded

#: Rings of up to so many points are simplified by plain numbers, larger ones by arrays; both take the same steps.
FEW = 64


def turns(ax, ay, bx, by, cx, cy) -> np.ndarray:
    """1 where c lies left of the line from a to b, -1 right of it, 0 on it."""
    return np.sign((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def distances(x: np.ndarray, y: np.ndarray, a: int, b: int) -> np.ndarray:
    """Distances of the points between a and b to the segment from a to b."""
    px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
    dx, dy = x[b] - x[a], y[b] - y[a]
    size = dx * dx + dy * dy
    t = np.clip((px * dx + py * dy) / size, 0, 1) if size else 0.0
    return np.hypot(px - t * dx, py - t * dy)


class Ring:
    """A closed ring whose sections are replaced by their chord one after the other; x[n] is x[0] again."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = np.append(x, x[0]), np.append(y, y[0])
        self.n = self.left = len(x)
        self.follows = np.arange(1, self.n + 1)  # the next point that is left, of each that is
        self.there = np.ones(self.n, bool)

    def clear(self, a: int, b: int) -> bool:
        """Whether the chord from a to b meets no side outside its section, but for its neighbours at a and b."""
        x, y = self.x, self.y
        i = np.flatnonzero(self.there)
        i = i[(i < a) | (i >= b)]
        j = self.follows[i]
        (x0, x1), (y0, y1) = sorted((x[a], x[b])), sorted((y[a], y[b]))
        near = (np.minimum(x[i], x[j]) <= x1) & (np.maximum(x[i], x[j]) >= x0) & (np.minimum(y[i], y[j]) <= y1) & (np.maximum(y[i], y[j]) >= y0)
        i, j = i[near], j[near]
        first, last = turns(x[a], y[a], x[b], y[b], x[i], y[i]), turns(x[a], y[a], x[b], y[b], x[j], y[j])
        other = turns(x[i], y[i], x[j], y[j], x[a], y[a]) != turns(x[i], y[i], x[j], y[j], x[b], y[b])
        meets = (first != last) & other | (first == 0) & (last == 0)
        # A neighbour meets the chord where they join; it may not lie on it, which is to turn back.
        into, out = j % self.n == a % self.n, i % self.n == b % self.n
        along = (x[i] - x[a]) * (x[b] - x[a]) + (y[i] - y[a]) * (y[b] - y[a]) > 0
        meets[into] = ((first == 0) & along)[into]
        along = (x[j] - x[b]) * (x[a] - x[b]) + (y[j] - y[b]) * (y[a] - y[b]) > 0
        meets[out] = ((last == 0) & along)[out]
        return not meets.any()

    def replace(self, a: int, b: int) -> None:
        self.there[a + 1 : b] = False
        self.left -= b - a - 1
        self.follows[a] = b


def turns_plain(ax, ay, bx, by, cx, cy) -> int:
    t = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return (t > 0) - (t < 0)


def clear_plain(x: list[float], y: list[float], left: list[int], a: int, b: int) -> bool:
    """Ring.clear() of a ring whose points left are given."""
    n = len(x) - 1
    xa, ya, xb, yb = x[a], y[a], x[b], y[b]
    x0, x1 = (xa, xb) if xa < xb else (xb, xa)
    y0, y1 = (ya, yb) if ya < yb else (yb, ya)
    for k, i in enumerate(left):
        if a <= i < b:
            continue
        j = left[k + 1] if k + 1 < len(left) else n
        xi, yi, xj, yj = x[i], y[i], x[j], y[j]
        if (xi < x0 and xj < x0) or (xi > x1 and xj > x1) or (yi < y0 and yj < y0) or (yi > y1 and yj > y1):
            continue
        first, last = turns_plain(xa, ya, xb, yb, xi, yi), turns_plain(xa, ya, xb, yb, xj, yj)
        if i % n == b % n:
            meets = last == 0 and (xj - xb) * (xa - xb) + (yj - yb) * (ya - yb) > 0
        elif j % n == a % n:
            meets = first == 0 and (xi - xa) * (xb - xa) + (yi - ya) * (yb - ya) > 0
        else:
            meets = (first == 0 and last == 0) or (first != last and turns_plain(xi, yi, xj, yj, xa, ya) != turns_plain(xi, yi, xj, yj, xb, yb))
        if meets:
            return False
    return True


def simplify_few(x: list[float], y: list[float], tolerance: float) -> list[int]:
    """Places of the points that simplify_ring() keeps."""
    n = len(x)
    x, y = [*x, x[0]], [*y, y[0]]
    left = list(range(n))
    far = max(left, key=lambda i: (x[i] - x[0]) ** 2 + (y[i] - y[0]) ** 2)
    todo = [(far, n), (0, far)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        size, most, at = dx * dx + dy * dy, -1.0, a + 1
        for i in range(a + 1, b):
            px, py = x[i] - x[a], y[i] - y[a]
            t = min(max((px * dx + py * dy) / size, 0.0), 1.0) if size else 0.0
            d = math.hypot(px - t * dx, py - t * dy)
            if d > most:
                most, at = d, i
        if most <= tolerance and len(left) - (b - a - 1) >= 3 and clear_plain(x, y, left, a, b):
            left = [i for i in left if not a < i < b]
        else:
            todo += [(at, b), (a, at)]
    return left


def simplify_ring(x: np.ndarray, y: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The ring, open or closed, without points that are within tolerance of what replaces them; open, of three or more.

    It is split at its first point and the one farthest from it; those stay. A section goes if its points are all near
    its chord, if the chord meets no other side of what the ring is by then, and if three points are left; otherwise it
    is split at its farthest point. Points that repeat the one before go first.
    """
    same = np.append(False, (x[1:] == x[:-1]) & (y[1:] == y[:-1]))
    x, y = x[~same], y[~same]
    if len(x) > 1 and x[0] == x[-1] and y[0] == y[-1]:
        x, y = x[:-1], y[:-1]
    if len(x) < 4:
        return x, y
    if len(x) <= FEW:
        there = simplify_few(x.tolist(), y.tolist(), tolerance)
        return x[there], y[there]
    ring = Ring(x, y)
    far = int(np.argmax((x - x[0]) ** 2 + (y - y[0]) ** 2))
    todo = [(far, ring.n), (0, far)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = distances(ring.x, ring.y, a, b)
        at = int(np.argmax(d))
        if d[at] <= tolerance and ring.left - (b - a - 1) >= 3 and ring.clear(a, b):
            ring.replace(a, b)
        else:
            todo += [(a + 1 + at, b), (a, a + 1 + at)]
    return x[ring.there], y[ring.there]


def simplified(contours: pa.Array, tolerance: float) -> pa.Array:
    """Rings of a batch, array<struct<x,y>>, as array<array<double>>: empty for null, for under three points, and where a number is missing."""
    starts = np.asarray(contours.offsets)
    flat = contours.values
    xs, ys = (np.asarray(flat.field(k).to_numpy(zero_copy_only=False), np.float64) for k in ("x", "y"))
    if flat.null_count:
        xs = np.where(np.asarray(flat.is_valid()), xs, np.nan)
    some = np.asarray(contours.is_valid())
    out, counts = [], []
    for r in range(len(contours)):
        x, y = xs[starts[r] : starts[r + 1]], ys[starts[r] : starts[r + 1]]
        ok = some[r] and len(x) >= 3 and bool(np.isfinite(x).all() and np.isfinite(y).all())
        x, y = simplify_ring(x, y, tolerance) if ok else (x[:0], y[:0])
        out.append(np.stack((x, y), axis=1).ravel())
        counts.append(len(x))
    numbers = np.concatenate(out) if out else np.zeros(0)
    points = pa.ListArray.from_arrays(pa.array(np.arange(0, len(numbers) + 1, 2), pa.int32()), pa.array(numbers))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), points)


def simplified_rooms(contours: pa.Array, tolerance: float, scale: float, least: float) -> pa.Array:
    """struct<polygon,area> of contours in pixels: simplified rings in metres and their areas, rounded; null under three points or the least area."""
    rings = simplified(contours, tolerance)
    x, y, _, start, end = corners(rings)
    x, y = rounded(x / scale, 3), rounded(y / scale, 3)
    area = np.zeros(len(rings))
    for at, k in by_size(start, end, end - start >= 3):
        area[at] = areas(x[k], y[k])
    none = ~((end - start >= 3) & (area >= least))
    numbers = pa.array(np.stack((x, y), axis=1).ravel())
    points = pa.ListArray.from_arrays(pa.array(np.arange(0, len(numbers) + 1, 2), pa.int32()), numbers)
    polygons = pa.ListArray.from_arrays(rings.offsets, points)
    return pa.StructArray.from_arrays([polygons, pa.array(rounded(area, 2))], names=["polygon", "area"], mask=pa.array(none))
