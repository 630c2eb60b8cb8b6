"""The walk over pairs of wall ends for plans of any size: only pairs that come close are looked at."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa


class Cells:
    """Ends by the square cell they stand in; ends nearer than a cell's side stand in the same cell or in neighbours.

    An end without a number, or an unbounded one, is near none.
    """

    def __init__(self, points: list[list[float]], side: float):
        self.side, self.at = side, defaultdict(set)
        for i, p in enumerate(points):
            if self.known(p):
                self.at[self.cell(p)].add(i)

    @staticmethod
    def known(p: list[float | None]) -> bool:
        return all(x is not None and math.isfinite(x) for x in p)

    def cell(self, p: list[float]) -> tuple[int, int]:
        return int(p[0] // self.side), int(p[1] // self.side)

    def move(self, i: int, before: list[float], after: list[float]) -> None:
        if (a := self.cell(before)) != (b := self.cell(after)):
            self.at[a].discard(i)
            self.at[b].add(i)

    def near(self, p: list[float]) -> Iterator[int]:
        if not self.known(p):
            return
        x, y = self.cell(p)
        for i in (x - 1, x, x + 1):
            for j in (y - 1, y, y + 1):
                yield from self.at.get((i, j), ())


def snap_points(points: list[list[float]], threshold: float) -> list[list[float]]:
    """Ends after the walk over all pairs of ends of two walls, end 2i and 2i + 1 of wall i, in order of (wall, other wall, end, other end).

    A pair nearer than the threshold, but apart, goes to its middle, rounded; later pairs see that. The queue holds, in
    the walk's order, the pairs that are near; when an end moves, the pairs it comes near to and that are still ahead
    join them, so the work follows the number of ends and moves, not of pairs.
    """
    pts = [list(p) for p in points]
    cells = Cells(pts, threshold)

    def place(p: int, q: int) -> tuple[int, int, int, int]:
        p, q = min(p, q), max(p, q)
        return p >> 1, q >> 1, p & 1, q & 1

    def apart(p: int, q: int) -> bool:
        dx, dy = pts[p][0] - pts[q][0], pts[p][1] - pts[q][1]
        return 0 < math.sqrt(dx * dx + dy * dy) < threshold

    ahead = {place(p, q) for p in range(len(pts)) for q in cells.near(pts[p]) if p >> 1 != q >> 1 and apart(p, q)}
    queue = sorted(ahead)
    while queue:
        now = heapq.heappop(queue)
        ahead.discard(now)
        p, q = 2 * now[0] + now[2], 2 * now[1] + now[3]
        if not apart(p, q):
            continue
        middle = [round((pts[p][k] + pts[q][k]) / 2, 3) for k in (0, 1)]
        for e in (p, q):
            cells.move(e, pts[e], middle)
            pts[e] = list(middle)
        for e in (p, q):
            for other in cells.near(middle):
                pair = place(e, other)
                if e >> 1 != other >> 1 and pair > now and pair not in ahead and apart(e, other):
                    ahead.add(pair)
                    heapq.heappush(queue, pair)
    return pts


def snap_lists(plans: pa.Array, threshold: float) -> pa.Array:
    """Four numbers a wall of each plan, as they stand after the walk; null stays null."""
    out = []
    for row in plans.to_pylist():
        pts = None if row is None else snap_points([list(p) for p in zip(row[::2], row[1::2], strict=True)], threshold)
        out.append(None if pts is None else [x for p in pts for x in p])
    return pa.array(out, pa.list_(pa.float64()))
