"""Flat faces of any number of corners to triangles, by ear clipping."""

from __future__ import annotations

import numpy as np


def normal(p: np.ndarray) -> np.ndarray:
    """Newell's normal of a ring of points in space; twice the ring's area long."""
    return np.cross(p, np.roll(p, -1, axis=0)).sum(axis=0)


def flattened(p: np.ndarray) -> np.ndarray:
    """The ring in the plane of its two largest extents, wound against the clock."""
    n = normal(p)
    k = int(np.argmax(np.abs(n)))
    flat = np.delete(p, k, axis=1)
    # Leaving out y mirrors the plane, and so does looking from behind.
    return flat * np.array([-1.0 if (n[k] < 0) != (k == 1) else 1.0, 1.0])


def clip_ears(ring: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles of a ring in the plane, wound against the clock; two fewer than it has corners, of which flat ones have no area.

    The next ear is a corner that turns left, or not at all, and whose triangle holds no other corner, not even on a
    side, which is told with room for rounding: a cut through a corner would pinch what is left. A ring that
    crosses itself may run out of ears; then the corner that turns left the most goes, so there are as many triangles,
    but their areas don't add up to the ring's.
    """
    left = list(range(len(ring)))
    out = []
    tiny = 1e-10 * float(np.ptp(ring, axis=0).max(initial=0.0)) ** 2
    while len(left) > 3:
        p = ring[left]
        before, after = np.roll(p, 1, axis=0), np.roll(p, -1, axis=0)
        turn = (p[:, 0] - before[:, 0]) * (after[:, 1] - p[:, 1]) - (p[:, 1] - before[:, 1]) * (after[:, 0] - p[:, 0])
        at = next((int(i) for i in np.flatnonzero(turn >= -tiny) if is_ear(p, int(i), turn, tiny)), int(np.argmax(turn)))
        out.append((left[at - 1], left[at], left[(at + 1) % len(left)]))
        left.pop(at)
    return [*out, tuple(left)]


def is_ear(p: np.ndarray, i: int, turn: np.ndarray, tiny: float) -> bool:
    a, b, c = p[i - 1], p[i], p[(i + 1) % len(p)]
    if turn[i] <= tiny:  # on the line of its neighbours; it goes unless it is the tip of a spike
        return bool(np.dot(b - a, c - b) >= 0)
    side = lambda u, v: (v[0] - u[0]) * (p[:, 1] - u[1]) - (v[1] - u[1]) * (p[:, 0] - u[0])
    inside = (side(a, b) >= -tiny) & (side(b, c) >= -tiny) & (side(c, a) >= -tiny)
    inside &= ~((p == a).all(axis=1) | (p == b).all(axis=1) | (p == c).all(axis=1))
    return not inside.any()


def clip_few(x: list[float], y: list[float]) -> list[tuple[int, int, int]]:
    """clip_ears() of a ring of few corners, by plain numbers; the same steps."""
    left, out = list(range(len(x))), []
    tiny = 1e-10 * max(max(x) - min(x), max(y) - min(y)) ** 2

    def side(u: int, v: int, k: int) -> float:
        return (x[v] - x[u]) * (y[k] - y[u]) - (y[v] - y[u]) * (x[k] - x[u])

    def ear(a: int, b: int, c: int, turn: float) -> bool:
        if turn <= tiny:
            return (x[b] - x[a]) * (x[c] - x[b]) + (y[b] - y[a]) * (y[c] - y[b]) >= 0
        own = {(x[k], y[k]) for k in (a, b, c)}
        return not any(side(a, b, k) >= -tiny and side(b, c, k) >= -tiny and side(c, a, k) >= -tiny and (x[k], y[k]) not in own for k in left)

    while len(left) > 3:
        n = len(left)
        corner = [(left[i - 1], left[i], left[(i + 1) % n]) for i in range(n)]
        turns = [(x[b] - x[a]) * (y[c] - y[b]) - (y[b] - y[a]) * (x[c] - x[b]) for a, b, c in corner]
        at = next((i for i in range(n) if turns[i] >= -tiny and ear(*corner[i], turns[i])), None)
        at = turns.index(max(turns)) if at is None else at
        out.append(corner[at])
        left.pop(at)
    return [*out, tuple(left)]


#: Rings of up to so many corners are cut by plain numbers, larger ones by arrays.
FEW = 16


def owned_triangles(points: np.ndarray, corners: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 3) corners of the triangles of faces, and the owner of each, in order of owners; face i has
    corners[starts[i]:starts[i + 1]], places in points.

    Convex faces of four corners, which walls consist of, are cut together; all others one by one.
    """
    sizes = np.diff(starts)
    quad = np.flatnonzero(sizes == 4)
    four = corners[starts[:-1][quad][:, None] + np.arange(4)]
    p = points[four]
    side = np.roll(p, -1, axis=1) - p
    up = np.cross(p[:, 2] - p[:, 0], p[:, 3] - p[:, 1])
    convex = (np.einsum("nkx,nx->nk", np.cross(np.roll(side, 1, axis=1), side), up) >= 0).all(axis=1)
    out = [four[convex][:, [0, 1, 2]], four[convex][:, [0, 2, 3]]]
    whose = [owner[quad[convex]]] * 2
    for i in [*quad[~convex], *np.flatnonzero((sizes != 4) & (sizes >= 3))]:
        face = corners[starts[i] : starts[i + 1]]
        cut = [(0, 1, 2)]
        if len(face) > 3:
            flat = flattened(points[face])
            cut = clip_few(*flat.T.tolist()) if len(face) <= FEW else clip_ears(flat)
        out.append(face[np.array(cut, np.int64)])
        whose.append(np.full(len(cut), owner[i]))
    tri, whose = np.concatenate(out), np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    return tri[order], whose[order]


def triangles(points: np.ndarray, corners: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(n, 3) corners of the triangles of faces of one owner."""
    return owned_triangles(points, np.asarray(corners, np.int64), np.asarray(starts, np.int64), np.zeros(len(starts) - 1, np.int64))[0]
