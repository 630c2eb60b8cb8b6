"""The sweep over a wall's holes, and the surface of what is left, for whole Arrow batches of walls."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .walls import BOX_FACES

#: Walls of up to so many holes are swept together with others of as many; of more, each by itself.
TOGETHER = 8
#: Numbers that are looked at together; bounds the memory.
CELLS = 1 << 19


def left_of(lo, hi, there, t_lo, t_hi, t_there):
    """What spans t, in order, leave of the spans lo to hi: (lo, hi, mask) with a last axis one longer than t's."""
    shape = np.broadcast_shapes(lo.shape, t_lo.shape[:-1] + (1,))
    at, hi, there = (np.broadcast_to(v, shape) for v in (lo, hi, there))
    out = []
    for q in range(t_lo.shape[-1]):
        a, b, on = t_lo[..., q : q + 1], t_hi[..., q : q + 1], t_there[..., q : q + 1]
        out.append((at, np.minimum(a, hi), there & on & (a > at) & (at < hi)))
        at = np.where(on, np.maximum(at, b), at)
    out.append((at, hi, there & (at < hi)))
    return tuple(np.stack([np.broadcast_to(o[k], shape) for o in out], axis=-1) for k in range(3))


def sweep_equal(length, u0, u1, z0, z1, top):
    """(along, back, front, face) of walls (a row each) of the same number of holes; see sweep()."""
    k, h = u0.shape
    us = np.sort(np.concatenate((np.zeros((k, 1)), length[:, None], u0, u1), axis=1), axis=1)
    us[:, 1:][us[:, 1:] == us[:, :-1]] = np.inf
    us = np.sort(us, axis=1)
    a, b = us[:, :-1], us[:, 1:]
    order = np.lexsort((z1, z0)) if h else np.zeros((k, 0), np.int64)
    u0, u1, z0, z1 = (np.take_along_axis(v, order, axis=1)[:, None, :] for v in (u0, u1, z0, z1))
    over = (u0 <= a[:, :, None]) & (u1 >= b[:, :, None])
    whole = np.isfinite(b)[:, :, None]
    lo, hi, there = (v[:, :, 0, :] for v in left_of(np.zeros((1, 1, 1)), np.full((1, 1, 1), top), whole, np.broadcast_to(z0, over.shape), np.broadcast_to(z1, over.shape), over))
    with np.errstate(invalid="ignore"):  # borders that aren't there are unbounded
        face = (np.where(there, hi - lo, 0.0).sum(axis=2) * np.where(whole[:, :, 0], b - a, 0.0)).sum(axis=1)
    r, s, q = np.nonzero(there)
    along = (r, a[r, s], b[r, s], lo[r, s, q], hi[r, s, q])
    wider = lambda v, first: np.concatenate((np.zeros_like(v[:, :1]), v) if first else (v, np.zeros_like(v[:, :1])), axis=1)
    before, after = ([wider(v, first) for v in (lo, hi, there)] for first in (True, False))
    across = []
    for one, other in ((after, before), (before, after)):
        got = left_of(*[v[..., None] for v in one], *[v[:, :, None, :] for v in other])
        lo_, hi_, on = (v[:, :, :, 0, :] for v in got)
        r, s, p, q = np.nonzero(on)
        across.append((r, us[r, s], lo_[r, s, p, q], hi_[r, s, p, q]))
    return along, *across, face


def gaps(lo: float, hi: float, taken: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out = []
    for a, b in taken:
        if a > lo and lo < hi:
            out.append((lo, min(a, hi)))
        lo = max(lo, b)
    return [*out, (lo, hi)] if lo < hi else out


def sweep_one(length, u0, u1, z0, z1, top):
    """sweep_equal() of one wall with many holes; only holes over a slab are looked at there."""
    us = np.unique(np.concatenate(([0.0, length], u0, u1)))
    us = us[np.isfinite(us)]
    slabs = []
    for a, b in zip(us[:-1], us[1:], strict=True):
        over = (u0 <= a) & (u1 >= b)
        slabs.append(gaps(0.0, top, sorted(zip(z0[over].tolist(), z1[over].tolist(), strict=True))))
    along = [(a, b, *x) for a, b, spans in zip(us[:-1], us[1:], slabs, strict=True) for x in spans]
    back, front = [], []
    for i, u in enumerate(us):
        before, after = slabs[i - 1] if i else [], slabs[i] if i < len(slabs) else []
        back += [(u, *g) for x in after for g in gaps(*x, before)]
        front += [(u, *g) for x in before for g in gaps(*x, after)]
    columns = lambda rows, n: (np.zeros(len(rows), np.int64), *np.array(rows, np.float64).reshape(-1, n).T)
    return columns(along, 4), columns(back, 3), columns(front, 3), np.array([sum((d - c) * (b - a) for a, b, c, d in along)])


def sweep(length, holes, start, end, top, together: int = TOGETHER):
    """What the holes start to end of each wall leave of its face: spans between two borders as (wall, from, to, low,
    high), those that end at a border and have nothing beyond it as (wall, border, low, high), on either side, and the
    area of the face."""
    size = end - start
    parts, face = [[], [], []], np.zeros(len(length))
    for h in np.unique(size):
        same = np.flatnonzero(size == h)
        step = max(1, CELLS // int((2 * h + 2) * (h + 1) * (h + 2))) if h <= together else 1
        for k in range(0, len(same), step):
            at = same[k : k + step]
            own = [v[start[at, None] + np.arange(h)] for v in holes]
            *got, area = sweep_equal(length[at], *own, top) if h <= together else sweep_one(length[at[0]], *[v[0] for v in own], top)
            face[at] = area
            for part, g in zip(parts, got, strict=True):
                part.append((at[g[0]], *g[1:]))
    wide = (5, 4, 4)
    return *[[np.concatenate([p[c] for p in part]) if part else np.zeros(0, np.int64 if c == 0 else float) for c in range(n)] for part, n in zip(parts, wide, strict=True)], face


def quads(along, back, front):
    """(wall, u, side, z) of the surface's squares, four corners each, seen from outside against the clock; by wall."""
    r, a, b, lo, hi = along
    faces = [
        (r, (a, a, b, b), (1, 1, 1, 1), (lo, hi, hi, lo)),
        (r, (a, b, b, a), (-1, -1, -1, -1), (lo, lo, hi, hi)),
        (r, (a, b, b, a), (-1, -1, 1, 1), (hi, hi, hi, hi)),
        (r, (a, a, b, b), (-1, 1, 1, -1), (lo, lo, lo, lo)),
        (back[0], (back[1],) * 4, (-1, -1, 1, 1), (back[2], back[3], back[3], back[2])),
        (front[0], (front[1],) * 4, (-1, 1, 1, -1), (front[2], front[2], front[3], front[3])),
    ]
    wall = np.concatenate([f[0] for f in faces])
    u, z = (np.concatenate([np.stack(f[k], axis=1) for f in faces]) for k in (1, 3))
    side = np.concatenate([np.broadcast_to(np.array(f[2], np.float64), (len(f[0]), 4)) for f in faces])
    order = np.argsort(wall, kind="stable")
    return wall[order], u[order], side[order], z[order]


def lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def cut_meshes(sx, sy, ex, ey, thickness, dx, dy, length, n_cuts, holes: pa.Array, top: float) -> pa.Array:
    """struct<face_area,vertices,faces> of walls less their holes. A wall without cuts is a box of eight vertices, any other has four to each square."""
    sx, sy, ex, ey, thickness, dx, dy, length = (np.asarray(c.to_numpy(zero_copy_only=False), np.float64) for c in (sx, sy, ex, ey, thickness, dx, dy, length))
    cut = np.asarray(n_cuts.to_numpy(zero_copy_only=False)) > 0
    at = np.asarray(holes.offsets).astype(np.int64)
    start, end = at[:-1], np.where(np.asarray(holes.is_valid()), at[1:], at[:-1])
    rect = [np.asarray(holes.values.field(k).to_numpy(zero_copy_only=False), np.float64) for k in ("u0", "u1", "z0", "z1")]
    along, back, front, face = sweep(length, rect, start, end, top)
    along, back, front = ([c[cut[p[0]]] for c in p] for p in (along, back, front))
    wall, u, side, z = quads(along, back, front)
    half, px, py = thickness / 2.0, -dy, dx
    squares = np.bincount(wall, minlength=len(cut))
    n_v, n_f = np.where(cut, 4 * squares, 8), np.where(cut, squares, len(BOX_FACES))
    v_at, f_at = np.concatenate(([0], np.cumsum(n_v))), np.concatenate(([0], np.cumsum(n_f)))
    xyz, corners = [np.zeros(v_at[-1]) for _ in range(3)], np.zeros((f_at[-1], 4), np.int32)
    own = np.arange(len(wall)) - (np.cumsum(squares) - squares)[wall]  # a square's place among its wall's
    w = wall[:, None]
    to = v_at[w] + own[:, None] * 4 + np.arange(4)
    xyz[0][to], xyz[1][to], xyz[2][to] = sx[w] + dx[w] * u + px[w] * half[w] * side, sy[w] + dy[w] * u + py[w] * half[w] * side, z
    corners[f_at[wall] + own] = own[:, None] * 4 + np.arange(4)
    r = np.flatnonzero(~cut)
    for k, (x, y, s) in enumerate([(sx, sy, -1.0), (sx, sy, 1.0), (ex, ey, 1.0), (ex, ey, -1.0)] * 2):
        xyz[0][v_at[r] + k], xyz[1][v_at[r] + k] = x[r] + px[r] * half[r] * s, y[r] + py[r] * half[r] * s
        xyz[2][v_at[r] + k] = top if k > 3 else 0.0
    for k, ring in enumerate(BOX_FACES):
        corners[f_at[r] + k] = ring
    points = pa.StructArray.from_arrays([pa.array(v) for v in xyz], names=["x", "y", "z"])
    faces = lists(np.arange(0, 4 * len(corners) + 1, 4), pa.array(corners.ravel()))
    return pa.StructArray.from_arrays([pa.array(face), lists(v_at, points), lists(f_at, faces)], names=["face_area", "vertices", "faces"])


def fans(vertices: pa.Array, faces: pa.Array):
    """Triangles of all faces, from each one's first corner: face of each, wall of each face, and corners a, b, c as (n, 3)."""
    v_at, f_at = (np.asarray(x.offsets).astype(np.int64) for x in (vertices, faces))
    rings = faces.values
    c_at, corner = np.asarray(rings.offsets).astype(np.int64), np.asarray(rings.values.to_numpy(zero_copy_only=False)).astype(np.int64)
    lo, hi = f_at[0], f_at[-1]
    wall = np.repeat(np.arange(len(faces)), np.diff(f_at))
    first, n = c_at[lo:hi], np.maximum(np.diff(c_at)[lo:hi] - 2, 0)
    face = np.repeat(np.arange(hi - lo), n)
    k = np.arange(n.sum()) - (np.cumsum(n) - n)[face] + 1
    points = np.stack([np.asarray(vertices.values.field(c).to_numpy(zero_copy_only=False), np.float64) for c in "xyz"], axis=1)
    base = v_at[:-1][wall][face]
    return face, wall, *[points[base + corner[first[face] + j]] for j in (0, k, k + 1)]


def mesh_numbers(vertices: pa.Array, faces: pa.Array, skin: bool) -> pa.Array:
    """Volume inside closed meshes, or the area of their faces."""
    face, wall, a, b, c = fans(vertices, faces)
    if skin:
        q = np.cross(b - a, c - a)
        total = np.stack([np.bincount(face, q[:, i], len(wall)) for i in range(3)], axis=1)
        got = np.bincount(wall, np.sqrt((total * total).sum(axis=1)) / 2.0, len(faces))
    else:
        got = np.bincount(wall[face], (a * np.cross(b, c)).sum(axis=1), len(faces)) / 6.0
    none = ~(np.asarray(vertices.is_valid()) & np.asarray(faces.is_valid()))
    return pa.array(got, pa.float64(), mask=none)
