"""Geometry of positions: distances, boxes, shapes. All are Column expressions; nothing leaves the JVM.

Three conventions of angle are kept apart: degrees without wrap (``polar_*``), radians with wrap (``box_*``), and a coarse
constant for pi (``typed_distance``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi
#: Fixed value: the constant that distances of typed nodes use for pi.
COARSE_PI = 3.14159


def _c(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def polar_distance(t1, r1, a1, t2, r2, a2) -> Column:
    """Distance in a cylinder, angles in degrees: law of cosines across the disc, then along time."""
    t1, r1, a1, t2, r2, a2 = map(_c, (t1, r1, a1, t2, r2, a2))
    across = r1 * r1 + r2 * r2 - 2.0 * r1 * r2 * F.cos(F.radians(a1 - a2))
    return F.sqrt(F.greatest(F.lit(0.0), across) + (t1 - t2) * (t1 - t2))


def _arc(a: Column, b: Column, turn: float) -> Column:
    apart = F.abs(a - b)
    return F.least(apart, F.lit(turn) - apart)


def arc_distance(t1, r1, a1, t2, r2, a2) -> Column:
    """Distance with the angle scaled by the smaller radius (radians)."""
    t1, r1, a1, t2, r2, a2 = map(_c, (t1, r1, a1, t2, r2, a2))
    along = F.least(r1, r2) * _arc(a1, a2, TWO_PI)
    return F.sqrt((t1 - t2) ** 2 + (r1 - r2) ** 2 + along**2)


def typed_distance(t1, r1, a1, t2, r2, a2) -> Column:
    """Distance with the angle scaled by the mean radius and the coarse pi."""
    t1, r1, a1, t2, r2, a2 = map(_c, (t1, r1, a1, t2, r2, a2))
    along = (r1 + r2) / 2.0 * _arc(a1, a2, 2 * COARSE_PI)
    return F.sqrt((t1 - t2) ** 2 + (r1 - r2) ** 2 + along**2)


def chord_distance(t1, r1, a1, t2, r2, a2, w_t: float = 1.0, w_r: float = 1.0, w_a: float = 1.0) -> Column:
    """Weighted metric w_t dt^2 + w_r dr^2 + w_a r1 r2 (1 - cos da), angles in radians."""
    t1, r1, a1, t2, r2, a2 = map(_c, (t1, r1, a1, t2, r2, a2))
    return F.sqrt(F.greatest(F.lit(0.0), w_t * (t1 - t2) ** 2 + w_r * (r1 - r2) ** 2 + w_a * r1 * r2 * (1.0 - F.cos(a1 - a2))))


def padded_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of arrays; the shorter one counts as filled up with zeros."""
    squares = F.zip_with(a, b, lambda x, y: F.pow(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)), F.lit(2.0)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def metric_distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    """Distance on the dimensions that both arrays have: euclidean, manhattan or chebyshev."""
    n = F.least(F.size(a), F.size(b))
    apart = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.abs(x - y))
    if metric == "euclidean":
        return F.sqrt(F.aggregate(apart, F.lit(0.0), lambda s, x: s + x * x))
    if metric == "manhattan":
        return F.aggregate(apart, F.lit(0.0), lambda s, x: s + x)
    if metric == "chebyshev":
        return F.aggregate(apart, F.lit(0.0), lambda s, x: F.greatest(s, x))
    raise ValueError(f"unknown metric {metric!r}")


def hybrid_distance(spatial: Column, days: Column) -> Column:
    """Space and time together, in whichever the two rows have both; null if neither."""
    return F.when(spatial.isNotNull() & days.isNotNull(), F.sqrt(spatial**2 + days**2)).otherwise(F.coalesce(spatial, days))


def to_cartesian(r, theta) -> tuple[Column, Column]:
    r, theta = _c(r), _c(theta)
    return r * F.cos(theta), r * F.sin(theta)


def from_cartesian(x, y) -> tuple[Column, Column]:
    """(radius, angle in [0, 2 pi))."""
    x, y = _c(x), _c(y)
    angle = F.atan2(y, x)
    return F.sqrt(x * x + y * y), F.when(angle < 0, angle + TWO_PI).otherwise(angle)


def to_local(r, theta, r0, theta0) -> tuple[Column, Column]:
    """Polar coordinates as seen from a centre."""
    x, y = to_cartesian(r, theta)
    x0, y0 = to_cartesian(r0, theta0)
    return from_cartesian(x - x0, y - y0)


def to_global(r, theta, r0, theta0) -> tuple[Column, Column]:
    """The reverse of ``to_local``."""
    x, y = to_cartesian(r, theta)
    x0, y0 = to_cartesian(r0, theta0)
    return from_cartesian(x + x0, y + y0)


@dataclass(frozen=True)
class Box:
    """A box over time, radius and angle in radians; ``theta_lo > theta_hi`` wraps, a span of a full turn is no bound."""

    t_lo: float
    t_hi: float
    r_lo: float
    r_hi: float
    theta_lo: float
    theta_hi: float

    def full_turn(self) -> bool:
        return self.theta_hi - self.theta_lo >= TWO_PI

    def contains(self, t, r, theta) -> Column:
        """Plain comparisons, so that they reach the Parquet scan."""
        t, r = _c(t), _c(r)
        return t.between(self.t_lo, self.t_hi) & r.between(self.r_lo, self.r_hi) & self.contains_angle(theta)

    def contains_angle(self, theta) -> Column:
        theta = _c(theta)
        if self.full_turn():
            return F.lit(True)
        if self.theta_lo <= self.theta_hi:
            return theta.between(self.theta_lo, self.theta_hi)
        return (theta >= self.theta_lo) | (theta <= self.theta_hi)


BOX_FIELDS = ("t_lo", "t_hi", "r_lo", "r_hi", "theta_lo", "theta_hi")


def _f(box: Column, name: str) -> Column:
    return box.getField(name)


def box_column(**fields) -> Column:
    """A struct with the six bounds."""
    return F.struct(*[_c(fields[name]).cast("double").alias(name) for name in BOX_FIELDS])


def box_intersects(a: Column, b: Column) -> Column:
    """Whether two box structs meet; angles wrap."""
    lo_a, hi_a, lo_b, hi_b = _f(a, "theta_lo"), _f(a, "theta_hi"), _f(b, "theta_lo"), _f(b, "theta_hi")
    wrap_a, wrap_b = lo_a > hi_a, lo_b > hi_b
    angle = F.when(wrap_a & wrap_b, True).when(wrap_a, (hi_b >= lo_a) | (lo_b <= hi_a)).when(wrap_b, (hi_a >= lo_b) | (lo_a <= hi_b)).otherwise((lo_a <= hi_b) & (lo_b <= hi_a))
    return (_f(a, "t_lo") <= _f(b, "t_hi")) & (_f(b, "t_lo") <= _f(a, "t_hi")) & (_f(a, "r_lo") <= _f(b, "r_hi")) & (_f(b, "r_lo") <= _f(a, "r_hi")) & angle


def _span(box: Column) -> Column:
    lo, hi = _f(box, "theta_lo"), _f(box, "theta_hi")
    return F.when(lo <= hi, hi - lo).otherwise(TWO_PI - (lo - hi))


def box_volume(box: Column) -> Column:
    return (_f(box, "t_hi") - _f(box, "t_lo")) * (_f(box, "r_hi") ** 2 - _f(box, "r_lo") ** 2) * _span(box) / 2.0


def box_margin(box: Column) -> Column:
    """Sum of the sides: time, radius, and the arc at the mean radius, twice each."""
    arc = (_f(box, "r_hi") + _f(box, "r_lo")) / 2.0 * _span(box)
    return 2.0 * ((_f(box, "t_hi") - _f(box, "t_lo")) + (_f(box, "r_hi") - _f(box, "r_lo")) + arc)


def _turn(x: Column) -> Column:
    return x - F.floor(x / TWO_PI) * TWO_PI


def box_enlarge(box: Column, t, r, theta) -> Column:
    """The box with a point in it; the angle grows on the side where that takes less."""
    t, r, theta = map(_c, (t, r, theta))
    lo, hi = _f(box, "theta_lo"), _f(box, "theta_hi")
    inside = F.when(lo <= hi, theta.between(lo, hi)).otherwise((theta >= lo) | (theta <= hi))
    down, up = _turn(lo - theta), _turn(theta - hi)
    to_low = F.when(lo <= hi, down <= up).otherwise(up > down)
    return F.struct(
        F.least(_f(box, "t_lo"), t).alias("t_lo"),
        F.greatest(_f(box, "t_hi"), t).alias("t_hi"),
        F.least(_f(box, "r_lo"), r).alias("r_lo"),
        F.greatest(_f(box, "r_hi"), r).alias("r_hi"),
        F.when(~inside & to_low, theta).otherwise(lo).alias("theta_lo"),
        F.when(~inside & ~to_low, theta).otherwise(hi).alias("theta_hi"),
    )


def box_merge(a: Column, b: Column) -> Column:
    """The smallest box around two; where together they leave no gap of angle it is a full turn."""
    lo_a, hi_a, lo_b, hi_b = _f(a, "theta_lo"), _f(a, "theta_hi"), _f(b, "theta_lo"), _f(b, "theta_hi")
    # seen from the start of one arc, the other starts at s and ends at s + its span
    span_a, span_b = _span(a), _span(b)
    s_b, s_a = _turn(lo_b - lo_a), _turn(lo_a - lo_b)
    end_from_a, end_from_b = F.greatest(span_a, s_b + span_b), F.greatest(span_b, s_a + span_a)
    from_a = end_from_a <= end_from_b
    full = F.least(end_from_a, end_from_b) >= TWO_PI
    end = F.when(from_a, F.when(s_b + span_b > span_a, hi_b).otherwise(hi_a)).otherwise(F.when(s_a + span_a > span_b, hi_a).otherwise(hi_b))
    return F.struct(
        F.least(_f(a, "t_lo"), _f(b, "t_lo")).alias("t_lo"),
        F.greatest(_f(a, "t_hi"), _f(b, "t_hi")).alias("t_hi"),
        F.least(_f(a, "r_lo"), _f(b, "r_lo")).alias("r_lo"),
        F.greatest(_f(a, "r_hi"), _f(b, "r_hi")).alias("r_hi"),
        F.when(full, 0.0).when(from_a, lo_a).otherwise(lo_b).alias("theta_lo"),
        F.when(full, TWO_PI).otherwise(end).alias("theta_hi"),
    )


def box_min_distance(box: Box, t, r, theta, weights: Sequence[float] = (1.0, 1.0, 1.0)) -> Column:
    """A lower bound of the distance from a point to anything in the box."""
    t, r, theta = map(_c, (t, r, theta))
    zero = F.lit(0.0)
    dt = F.greatest(zero, box.t_lo - t, t - box.t_hi) * weights[0]
    dr = F.greatest(zero, box.r_lo - r, r - box.r_hi) * weights[1]
    below, above = _turn(F.lit(box.theta_lo) - theta), _turn(theta - F.lit(box.theta_hi))
    da = F.when(box.contains_angle(theta), zero).otherwise(F.least(below, above)) * weights[2]
    return F.sqrt(dt**2 + dr**2 + da**2)


def in_box(dims: Column, lower: Sequence[float], upper: Sequence[float]) -> Column:
    """Box of any number of dimensions; a row's missing ones count as zero."""
    if len(lower) != len(upper):
        raise ValueError("bounds differ in length")
    parts = [F.coalesce(F.get(dims, F.lit(i)), F.lit(0.0)).between(float(lo), float(hi)) for i, (lo, hi) in enumerate(zip(lower, upper, strict=True))]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def in_circle(x, y, cx: float, cy: float, radius: float) -> Column:
    """Within a circle; the square around it comes first, as plain comparisons that reach the scan."""
    x, y = _c(x), _c(y)
    square = x.between(cx - radius, cx + radius) & y.between(cy - radius, cy + radius)
    return square & ((x - cx) ** 2 + (y - cy) ** 2 <= radius * radius)


def in_polygon(x, y, corners: Sequence[tuple[float, float]]) -> Column:
    """Parity of the edges to the right; an edge counts where y is above its lower and not above its upper end."""
    x, y = _c(x), _c(y)
    if len(corners) < 3:
        return F.lit(False)
    crossed = []
    for (x1, y1), (x2, y2) in zip(corners, [*corners[1:], corners[0]], strict=True):
        if y1 == y2:
            continue
        at = (y - y1) * (x2 - x1) / (y2 - y1) + x1
        right = x <= max(x1, x2)
        right = right if x1 == x2 else right & (x <= at)
        crossed.append(((y > min(y1, y2)) & (y <= max(y1, y2)) & right).cast("int"))
    xs, ys = zip(*corners, strict=True)
    around = (x <= max(xs)) & y.between(min(ys), max(ys))
    return around & (reduce(lambda a, b: a + b, crossed, F.lit(0)) % 2 == 1)


def segment_distance(x, y, start: tuple[float, float], end: tuple[float, float]) -> Column:
    x, y = _c(x), _c(y)
    dx, dy = end[0] - start[0], end[1] - start[1]
    length = dx * dx + dy * dy
    if length == 0:
        return F.sqrt((x - start[0]) ** 2 + (y - start[1]) ** 2)
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - start[0]) * dx + (y - start[1]) * dy) / length))
    return F.sqrt((x - (start[0] + at * dx)) ** 2 + (y - (start[1] + at * dy)) ** 2)


def near_path(x, y, points: Sequence[tuple[float, float]], radius: float) -> Column:
    """Within ``radius`` of a line of segments; a single point has none, so nothing is near it."""
    if len(points) < 2:
        return F.lit(False)
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    around = _c(x).between(min(xs) - radius, max(xs) + radius) & _c(y).between(min(ys) - radius, max(ys) + radius)
    apart = [segment_distance(x, y, a, b) for a, b in zip(points, points[1:], strict=False)]
    return around & ((F.least(*apart) if len(apart) > 1 else apart[0]) <= radius)


def in_shape(x, y, shape: dict) -> Column:
    """A polygon ``{"polygon": [...]}``, circle ``{"center", "radius"}`` or rectangle ``{"min", "max"}``."""
    if "polygon" in shape:
        return in_polygon(x, y, shape["polygon"])
    if "center" in shape:
        return in_circle(x, y, *shape["center"], shape["radius"])
    if "min" in shape:
        (x1, y1), (x2, y2) = shape["min"], shape["max"]
        return _c(x).between(x1, x2) & _c(y).between(y1, y2)
    raise ValueError(f"unknown shape {sorted(shape)}")
