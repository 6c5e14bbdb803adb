"""Plane geometry as column expressions.

A point is an array of two numbers, a polyline an array of points, a line a pair of
points given as two columns.  Every function takes and returns columns and stays in
generated JVM code or higher-order functions.  Nulls in give null out; rounding to
whole pixels is half to even.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value worked out once a row; an expression used twice would be worked out twice,
    inside a lambda once an element."""
    return F.get(F.transform(F.array(value), body), 0)


def field(key: str | int) -> Callable[[Column], Column]:
    """A lambda that picks a struct's field or an array's element; lambdas in a loop must not carry defaults,
    which would count as further arguments."""
    return lambda value: value[key]


def _x(p: Column) -> Column:
    return F.get(p, 0).cast("double")


def _y(p: Column) -> Column:
    return F.get(p, 1).cast("double")


def point(x: Column, y: Column) -> Column:
    return F.array(x.cast("double"), y.cast("double"))


def whole(v: Column) -> Column:
    """To the nearest integer, halves to even."""
    return F.rint(v).cast("int")


def first(line: Column) -> Column:
    return F.get(line, 0)


def last(line: Column) -> Column:
    return F.element_at(line, -1)


# -- distances and lengths


def distance(p: Column, q: Column) -> Column:
    return F.sqrt(F.pow(_x(p) - _x(q), 2) + F.pow(_y(p) - _y(q), 2))


def signed_offset(p: Column, a: Column, b: Column) -> Column:
    """Signed distance of p from the infinite line a-b; the distance to a where both are one point."""
    dx, dy = _x(b) - _x(a), _y(b) - _y(a)
    length = F.sqrt(dx * dx + dy * dy)
    return F.when(length == 0, distance(p, a)).otherwise((dx * (_y(p) - _y(a)) - dy * (_x(p) - _x(a))) / length)


def distance_to_line(p: Column, a: Column, b: Column) -> Column:
    return F.abs(signed_offset(p, a, b))


def distance_between_lines(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Smallest of the four end-to-line distances of a-b and c-d."""
    return F.least(distance_to_line(a, c, d), distance_to_line(b, c, d), distance_to_line(c, a, b), distance_to_line(d, a, b))


def nearest_on_segment(p: Column, a: Column, b: Column) -> Column:
    """The point of the segment a-b nearest to p."""
    dx, dy = _x(b) - _x(a), _y(b) - _y(a)
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((_x(p) - _x(a)) * dx + (_y(p) - _y(a)) * dy) / square)))
    return point(_x(a) + t * dx, _y(a) + t * dy)


def distance_to_segment(p: Column, a: Column, b: Column) -> Column:
    return distance(p, nearest_on_segment(p, a, b))


def pairs(line: Column) -> Column:
    """Adjacent pairs of a polyline as structs (a, b)."""

    def of(l: Column) -> Column:
        n = F.greatest(F.size(l) - 1, F.lit(0))
        return F.zip_with(F.slice(l, F.lit(1), n), F.slice(l, F.lit(2), n), lambda a, b: F.struct(a.cast("array<double>").alias("a"), b.cast("array<double>").alias("b")))

    return let(line, of)


def nearest_on_polyline(p: Column, line: Column) -> Column:
    """Struct (distance, segment, point) of the nearest place; the first segment wins ties."""
    found = F.transform(pairs(line), lambda s, i: F.struct(distance_to_segment(p, s["a"], s["b"]).alias("distance"), i.alias("segment"), nearest_on_segment(p, s["a"], s["b"]).alias("point")))
    return F.array_min(found)


def polyline_length(line: Column) -> Column:
    return F.aggregate(pairs(line), F.lit(0.0), lambda acc, s: acc + distance(s["a"], s["b"]))


def along_segment(a: Column, b: Column, at: Column) -> Column:
    """The point ``at`` units from a towards b; a where the segment has no length."""
    d = distance(a, b)
    t = F.when(d == 0, F.lit(0.0)).otherwise(at / d)
    return point(_x(a) + t * (_x(b) - _x(a)), _y(a) + t * (_y(b) - _y(a)))


def resample(line: Column, segments: int) -> Column:
    """``segments`` + 1 points at equal arc length, both ends included."""

    def walk(l: Column) -> Column:
        steps = F.transform(pairs(l), lambda s: distance(s["a"], s["b"]))
        return F.aggregate(steps, F.array(F.lit(0.0)), lambda acc, d: F.array_append(acc, F.element_at(acc, -1) + d))

    def at(l: Column, walked: Column, goal: Column) -> Column:
        seat = F.greatest(F.lit(1), F.least(F.size(F.filter(walked, lambda w: w <= goal)), F.size(l) - 1))
        return let(seat, lambda i: _between(F.element_at(l, i), F.element_at(l, i + 1), F.element_at(walked, i), F.element_at(walked, i + 1), goal))

    def points(l: Column, walked: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(segments)), lambda k: let(F.element_at(walked, -1) * k / segments, lambda goal: at(l, walked, goal)))

    return let(line, lambda l: let(walk(l), lambda walked: points(l, walked)))


def _between(a: Column, b: Column, start: Column, end: Column, goal: Column) -> Column:
    t = F.when(end > start, F.least(goal - start, end - start) / (end - start)).otherwise(0.0)
    return point(_x(a) + t * (_x(b) - _x(a)), _y(a) + t * (_y(b) - _y(a)))


# -- angles


def angle(p: Column, q: Column) -> Column:
    """Direction from p to q in (-pi, pi]."""
    return F.atan2(_y(q) - _y(p), _x(q) - _x(p))


def turn(v: Column) -> Column:
    """An angle brought into (-pi, pi]."""
    w = F.pmod(v, F.lit(TWO_PI))
    return F.when(w > math.pi, w - TWO_PI).otherwise(w)


def angle_gap(a: Column, b: Column) -> Column:
    """Circular difference in [0, pi]."""
    d = F.abs(F.pmod(a, F.lit(TWO_PI)) - F.pmod(b, F.lit(TWO_PI)))
    return F.least(d, TWO_PI - d)


def angle_at(h: Column, i: Column, j: Column) -> Column:
    """Angle swept from i->h to i->j in (0, 2 pi]; null where two of the points are one."""
    ax, ay, bx, by = _x(h) - _x(i), _y(h) - _y(i), _x(j) - _x(i), _y(j) - _y(i)
    a = F.atan2(ax * by - ay * bx, ax * bx + ay * by)
    same = (distance(h, i) == 0) | (distance(i, j) == 0) | (distance(h, j) == 0)
    return F.when(~same, TWO_PI - F.when(a < 0, a + TWO_PI).otherwise(a))


def mean_angle(angles: Column, weights: Column | None = None) -> Column:
    """(Weighted) circular mean of an array of angles, in (-pi, pi]."""
    w = F.transform(angles, lambda _: F.lit(1.0)) if weights is None else weights
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))
    both = F.zip_with(angles, w, lambda a, v: F.struct((v * F.sin(a)).alias("s"), (v * F.cos(a)).alias("c")))
    add = lambda acc, v: F.struct((acc["s"] + v["s"]).alias("s"), (acc["c"] + v["c"]).alias("c"))
    return F.aggregate(both, zero, add, lambda acc: F.atan2(acc["s"], acc["c"]))


def mean_angle_positive(angles: Column) -> Column:
    return let(mean_angle(angles), lambda m: F.when(m < 0, m + TWO_PI).otherwise(m))


def angle_spread(angles: Column, weights: Column | None = None) -> Column:
    """Population deviation of the wrapped differences to the circular mean."""
    w = F.transform(angles, lambda _: F.lit(1.0)) if weights is None else weights

    def wrapped(a: Column, m: Column) -> Column:
        return F.transform(a, lambda x: F.atan2(F.sin(x - m), F.cos(x - m)))

    return let(angles, lambda a: let(w, lambda v: let(let(mean_angle(a, v), lambda m: wrapped(a, m)), lambda off: _weighted_spread(off, v))))


def _weighted_spread(values: Column, weights: Column) -> Column:
    zero = F.struct(*[F.lit(0.0).alias(c) for c in "wab"])
    rows = F.zip_with(values, weights, lambda x, w: F.struct(w.alias("w"), (w * x).alias("a"), (w * x * x).alias("b")))
    add = lambda acc, v: F.struct(*[(acc[c] + v[c]).alias(c) for c in "wab"])
    return F.aggregate(rows, zero, add, lambda t: F.sqrt(F.greatest(F.lit(0.0), t["b"] / t["w"] - F.pow(t["a"] / t["w"], 2))))


def trend(line: Column) -> Column:
    """Direction from the first to the last point, in [0, 2 pi)."""
    return F.pmod(angle(first(line), last(line)), F.lit(TWO_PI))


# -- constructions and moves


def crossing(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Where the infinite lines a-b and c-d meet, in whole numbers; null for parallels."""
    x1, y1, x2, y2, x3, y3, x4, y4 = _x(a), _y(a), _x(b), _y(b), _x(c), _y(c), _x(d), _y(d)
    det = (x1 - x2) * (y3 - y4) - (y1 - y2) * (x3 - x4)
    p, q = x1 * y2 - y1 * x2, x3 * y4 - y3 * x4
    return F.when(det != 0, F.array(whole(((x3 - x4) * p - (x1 - x2) * q) / det), whole(((y3 - y4) * p - (y1 - y2) * q) / det)))


def ray_end(a: Column, p: Column, length: Column) -> Column:
    return F.array(whole(_x(p) + length * F.cos(a)), whole(_y(p) + length * F.sin(a)))


def rotated_point(p: Column, around: Column, a: Column) -> Column:
    dx, dy = _x(p) - _x(around), _y(p) - _y(around)
    return F.array(whole(dx * F.cos(a) - dy * F.sin(a) + _x(around)), whole(dx * F.sin(a) + dy * F.cos(a) + _y(around)))


def rotated(line: Column, around: Column, a: Column) -> Column:
    return F.transform(line, lambda p: rotated_point(p, around, a))


def moved(line: Column, by: Column) -> Column:
    return F.transform(line, lambda p: point(_x(p) + _x(by), _y(p) + _y(by)))


def mirrored(line: Column) -> Column:
    return F.transform(line, lambda p: point(_x(p), -_y(p)))


def stretched(line: Column, factor: Column) -> Column:
    """x multiplied, y unchanged."""
    return F.transform(line, lambda p: point(_x(p) * factor, _y(p)))


def minus(p: Column, q: Column) -> Column:
    return point(_x(p) - _x(q), _y(p) - _y(q))


def midpoint(p: Column, q: Column) -> Column:
    return point((_x(p) + _x(q)) / 2, (_y(p) + _y(q)) / 2)


def mean_point(line: Column) -> Column:
    n = F.size(line)
    return point(_total(line, _x) / n, _total(line, _y) / n)


def _total(line: Column, f) -> Column:
    return F.aggregate(line, F.lit(0.0), lambda acc, p: acc + f(p))


def middle_vertex(line: Column, p: Column, q: Column) -> Column:
    """The vertex whose larger distance to p and q is smallest; the last one wins ties."""
    found = F.transform(line, lambda v, i: F.struct(F.greatest(distance(v, p), distance(v, q)).alias("d"), (-i).alias("i"), v.alias("v")))
    return F.array_min(found)["v"]


def bounds(line: Column) -> Column:
    """Struct (min_x, min_y, max_x, max_y)."""
    xs, ys = F.transform(line, _x), F.transform(line, _y)
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def common_bounds(one: Column, two: Column) -> Column:
    """The overlap of two polylines' boxes."""
    a, b = bounds(one), bounds(two)
    return F.struct(*[F.greatest(a[c], b[c]).alias(c) for c in ("min_x", "min_y")], *[F.least(a[c], b[c]).alias(c) for c in ("max_x", "max_y")])


def centroid(ring: Column) -> Column:
    """Area centroid of a closed outline in whole numbers; null where it has no area."""
    closed = pairs(F.concat(ring, F.slice(ring, 1, 1)))
    cross = lambda s: _x(s["a"]) * _y(s["b"]) - _x(s["b"]) * _y(s["a"])
    zero = F.struct(*[F.lit(0.0).alias(c) for c in "axy"])
    add = lambda t, s: F.struct((t["a"] + cross(s)).alias("a"), (t["x"] + (_x(s["a"]) + _x(s["b"])) * cross(s)).alias("x"), (t["y"] + (_y(s["a"]) + _y(s["b"])) * cross(s)).alias("y"))
    return F.aggregate(closed, zero, add, lambda t: F.when(t["a"] != 0, F.array(whole(t["x"] / (3 * t["a"])), whole(t["y"] / (3 * t["a"])))))


def inside(p: Column, ring: Column) -> Column:
    """Whether a point lies in a closed outline or on it, by counting crossings."""
    closed = pairs(F.concat(ring, F.slice(ring, 1, 1)))
    on = F.exists(closed, lambda s: distance_to_segment(p, s["a"], s["b"]) < 1e-9)
    hits = F.filter(
        closed,
        lambda s: ((_y(s["a"]) > _y(p)) != (_y(s["b"]) > _y(p))) & (_x(p) < (_x(s["b"]) - _x(s["a"])) * (_y(p) - _y(s["a"])) / (_y(s["b"]) - _y(s["a"])) + _x(s["a"])),
    )
    return on | (F.size(hits) % 2 == 1)


# -- shape measures


def offsets(line: Column) -> Column:
    """Signed distances of all points from the chord."""

    def of(l: Column) -> Column:
        ends = F.struct(first(l).alias("a"), last(l).alias("b"))
        return let(ends, lambda e: F.transform(l, lambda p: signed_offset(p, e["a"], e["b"])))

    return let(line, of)


def mean(values: Column) -> Column:
    return let(values, lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x) / F.size(v))


def spread(values: Column) -> Column:
    """Population standard deviation of an array."""
    return let(values, lambda v: let(mean(v), lambda m: F.sqrt(mean(F.transform(v, lambda x: F.pow(x - m, 2))))))


def offset_spread(line: Column) -> Column:
    """Deviation of the unsigned distances to the chord: how far a side is from a straight one."""
    return spread(F.transform(offsets(line), F.abs))


def mean_offset(line: Column) -> Column:
    return mean(F.transform(offsets(line), F.abs))


def straightness_weights(line: Column) -> Column:
    """Weight of each point: straight runs of long segments weigh most.

    (1 - bend / 60 degrees) to the sixth, the bend from a segment to the one after next; two
    1-2-1 smoothings; times the mean length of the adjacent segments.
    """

    def raw(dirs: Column) -> Column:
        m = F.size(dirs)
        bend = lambda a, i: angle_gap(F.get(dirs, F.least(i + 2, m - 1)), a)
        return F.array_append(F.transform(dirs, lambda a, i: F.when(i == m - 1, F.lit(1.0)).otherwise(F.pow(F.greatest(F.lit(0.0), 1 - bend(a, i) / (math.pi / 3)), 6))), F.lit(1.0))

    def smooth(v: Column) -> Column:
        return F.transform(v, lambda a, i: F.when((i == 0) | (i == F.size(v) - 1), a).otherwise(0.25 * F.get(v, i - 1) + 0.5 * a + 0.25 * F.get(v, i + 1)))

    def reach(lens: Column) -> Column:
        ext = F.concat(F.slice(lens, 1, 1), lens, F.slice(lens, -1, 1))
        return let(ext, lambda e: F.zip_with(F.slice(e, F.lit(1), F.size(e) - 1), F.slice(e, F.lit(2), F.size(e) - 1), lambda a, b: (a + b) / 2))

    def weights(s: Column) -> Column:
        dirs = F.transform(s, lambda p: angle(p["a"], p["b"]))
        lens = F.transform(s, lambda p: distance(p["a"], p["b"]))
        bent = let(let(let(dirs, raw), smooth), smooth)
        return F.zip_with(bent, let(lens, reach), lambda a, b: a * b)

    return let(line, lambda l: F.when(F.size(l) < 3, F.transform(l, lambda _: F.lit(1.0))).otherwise(let(pairs(l), weights)))


def colinearity(line: Column, weights: Column) -> Column:
    """Struct (mean, spread) of segment directions, weighted by straightness and length."""

    def of(s: Column, w: Column) -> Column:
        dirs = F.transform(s, lambda p: angle(p["a"], p["b"]))
        ws = F.transform(s, lambda p, i: (F.get(w, i) + F.get(w, i + 1)) / 2 * distance(p["a"], p["b"]))
        return let(dirs, lambda d: let(ws, lambda v: F.struct(mean_angle(d, v).alias("mean"), angle_spread(d, v).alias("spread"))))

    return let(pairs(line), lambda s: let(weights, lambda w: of(s, w)))


def curve_score(line: Column, gap: int = 4) -> Column:
    """How much a run of points looks like a smooth curve, 0 to 1; null below 16 points."""

    def score(at: Column, m: Column) -> Column:
        half = F.floor(F.size(at) / 2)
        parts = F.transform(at, lambda a, i: F.struct((1 - F.abs(i - half) / half).alias("w"), angle_gap(a, m).alias("g")))
        zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("g"))
        add = lambda acc, v: F.struct((acc["w"] + v["w"]).alias("w"), (acc["g"] + v["w"] * v["g"]).alias("g"))
        return F.aggregate(parts, zero, add, lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 3 * (0.4 - t["g"] / t["w"]))))

    def of(l: Column) -> Column:
        at = F.transform(F.sequence(F.lit(gap), F.size(l) - gap - 1), lambda i: angle_at(F.get(l, i - gap), F.get(l, i), F.get(l, i + gap)))
        return F.when(F.size(l) >= 16, let(at, lambda a: let(mean_angle(a), lambda m: score(a, m))))

    return let(line, of)


def squared_difference(one: Column, two: Column) -> Column:
    """Sum of squared differences of two arrays over the length of the first."""
    total = F.aggregate(F.zip_with(one, two, lambda a, b: F.pow(a.cast("double") - b.cast("double"), 2)), F.lit(0.0), lambda acc, v: acc + v)
    return total / F.size(one)


# -- lists


def cyclic_slice(a: Column, i: Column, j: Column, step: int = 1) -> Column:
    """Elements i to j inclusive, wrapping where j lies before i; the step starts anew after the wrap."""
    n = F.size(a)
    lo, hi = F.pmod(i, n), F.pmod(j, n)
    every = lambda c: F.filter(c, lambda _, k: k % step == 0)
    return F.when(lo <= hi, every(F.slice(a, lo + 1, hi - lo + 1))).otherwise(F.concat(every(F.slice(a, lo + 1, n - lo)), every(F.slice(a, F.lit(1), hi + 1))))


def rotated_list(a: Column, i: Column) -> Column:
    n = F.size(a)
    k = F.pmod(i, n)
    return F.when(n == 0, a).otherwise(F.concat(F.slice(a, k + 1, n - k), F.slice(a, F.lit(1), k)))


def smallest_rotation(a: Column, n: int = 4) -> Column:
    """The lexicographically smallest cyclic rotation of a list of ``n``."""
    return let(a, lambda l: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: rotated_list(l, k))))


def contains_cyclic(a: Column, part: Column) -> Column:
    """Whether ``part`` occurs in the list, element by element, wrapping round its end."""
    n, m = F.size(a), F.size(part)
    twice = F.concat(a, a)
    return (m <= n) & ((m == 0) | F.exists(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.slice(twice, i, m) == part))
