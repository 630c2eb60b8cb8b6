"""Column expressions of plane geometry. Those given as SQL text run unchanged in DuckDB."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .rings import list_faults, ring_faults


def round_exact(c: Column, digits: int) -> Column:
    """The decimal of so many digits nearest to the exact binary value of c; of two as near, the even one.

    A product with a power of ten is rounded itself. Only where it seems to end in exactly one half can that decide, and
    there the product's error, which two halves of c give without loss, says on which side the true one lies.
    """
    k = float(10**digits)
    a = F.abs(c)
    p = a * k
    whole = F.floor(p).cast("double")
    part = p - whole
    upper = a * 134217729.0 - (a * 134217729.0 - a)  # the upper 26 bits of a
    error = (upper * k - p) + (a - upper) * k
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (whole % 2.0 == 1.0))))
    out = F.when(p < 4503599627370496.0, (whole + F.when(up, 1.0).otherwise(0.0)) / k).otherwise(a)  # beyond 2**52 all are whole
    return F.when(c < 0, -out).otherwise(out)


def round3(c: Column) -> Column:
    """Millimetres of metres, as Python's round(x, 3)."""
    return round_exact(c, 3)


def length_sql(sx: str = "sx", sy: str = "sy", ex: str = "ex", ey: str = "ey") -> str:
    return f"sqrt(({ex} - {sx}) * ({ex} - {sx}) + ({ey} - {sy}) * ({ey} - {sy}))"


def segment_distance_sql(x: str, y: str, sx: str = "sx", sy: str = "sy", ex: str = "ex", ey: str = "ey") -> str:
    """Distance of a point to a segment; to its start where the squared length is under 1e-10."""
    dx, dy = f"({ex} - {sx})", f"({ey} - {sy})"
    sq = f"({dx} * {dx} + {dy} * {dy})"
    t = f"greatest(0e0, least(1e0, (({x} - {sx}) * {dx} + ({y} - {sy}) * {dy}) / nullif({sq}, 0e0)))"
    px, py = f"({x} - ({sx} + {t} * {dx}))", f"({y} - ({sy} + {t} * {dy}))"
    return f"case when {sq} < 1e-10 then {length_sql(sx, sy, x, y)} else sqrt({px} * {px} + {py} * {py}) end"


def segment_distance(x: Column, y: Column, sx: Column, sy: Column, ex: Column, ey: Column) -> Column:
    """segment_distance_sql() of columns, for use within arrays."""
    dx, dy = ex - sx, ey - sy
    sq = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - sx) * dx + (y - sy) * dy) / F.nullif(sq, F.lit(0.0))))
    px, py = x - (sx + t * dx), y - (sy + t * dy)
    return F.when(sq < 1e-10, F.sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy))).otherwise(F.sqrt(px * px + py * py))


def direction(sx, sy, ex, ey, least: float = 1e-6) -> tuple[Column, Column, Column]:
    """Unit vector and length; ((1, 0), 0) for what is shorter than least."""
    dx, dy = ex - sx, ey - sy
    n = F.sqrt(dx * dx + dy * dy)
    short = n < least
    safe = F.when(~short, n)
    return F.when(short, 1.0).otherwise(dx / safe), F.when(short, 0.0).otherwise(dy / safe), F.when(short, 0.0).otherwise(n)


def perpendicular(dx: Column, dy: Column) -> tuple[Column, Column]:
    return -dy, dx


def polygon_area(p: Column) -> Column:
    """Shoelace area of an open ring of points (arrays of two); 0 under three points; winding doesn't matter.

    Taken from the first point, so that a ring far from the origin loses no digits: a rectangle has just width times height.
    """
    n = F.size(p)
    at = lambda i, k: F.get(F.get(p, i), F.lit(k)) - F.get(F.get(p, F.lit(0)), F.lit(k))
    nxt = lambda i: (i + 1) % n
    total = F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0.0), lambda s, i: s + at(i, 0) * at(nxt(i), 1) - at(nxt(i), 0) * at(i, 1))
    return F.when(F.coalesce(n, F.lit(0)) < 3, 0.0).otherwise(F.abs(total) / 2.0)


def vertex_mean(p: Column) -> tuple[Column, Column]:
    """Mean of the vertices, which isn't the centroid of the area."""
    mean = lambda k: F.when(F.size(p) > 0, F.aggregate(p, F.lit(0.0), lambda s, v: s + F.get(v, F.lit(k))) / F.size(p))
    return mean(0), mean(1)


def ring_fault(p: Column) -> Column:
    """What is wrong with an open ring of points (arrays of two), the first that holds, or null: few points (under
    three), bad point (a missing or unbounded number), no area (all on one line), repeated point, crossing (sides that
    meet elsewhere than at a common corner). Turns of less than 1e-9 square metres count as none.

    Called deterministic, it would go down with every filter on it and be computed again, with all that p is made of.
    """

    @F.arrow_udf("string")
    def faults(rings: pa.Array) -> pa.Array:
        return ring_faults(rings)

    return faults.asNondeterministic()(p)


def ring_list_faults(lists: Column) -> Column:
    """ring_fault() of each of a row's rings, for use with arrays, as there is none within a lambda."""

    @F.arrow_udf("array<string>")
    def faults(rings: pa.Array) -> pa.Array:
        return list_faults(rings)

    return faults.asNondeterministic()(lists)
