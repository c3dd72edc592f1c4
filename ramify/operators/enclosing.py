"""Smallest circle around the circles of every family.

The smallest circle is held by at most three of a family's circles. Families of few
circles are solved whole. Of a larger one, Spark keeps the circles that reach farthest in
some directions; the smallest circle around those is a lower bound, and in rounds the
circle that stands out most joins them, until none does. A round is one aggregation with
partial maxima, so a family of any size is never in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramify.store import materialize

FEW = 64  # circles that are solved whole
DIRECTIONS = 16
SLACK = 1e-10  # of the radius
_CIRCLE = "struct<x:double,y:double,r:double>"


def _held_by(held: list[tuple[float, float, float]]) -> Iterator[tuple[float, float, float]]:
    """Circles that touch one, two or three circles from outside."""
    x, y, r = held[0]
    if len(held) == 1:
        yield x, y, r
    elif len(held) == 2:
        u, v, s = held[1]
        apart = math.hypot(u - x, v - y)
        if apart > 0:
            radius = (apart + r + s) / 2
            yield x + (u - x) * (radius - r) / apart, y + (v - y) * (radius - r) / apart, radius
    else:
        # With the first in the origin, the differences of the three equations are linear
        # in the centre and the radius R: centre = base + slope * R.
        (a, b, s), (c, d, t) = ((u - x, v - y, w) for u, v, w in held[1:])
        det = a * d - b * c
        if abs(det) < 1e-14 * (abs(a * d) + abs(b * c)) or det == 0:
            return
        p, q = (a * a + b * b - s * s + r * r) / 2, (c * c + d * d - t * t + r * r) / 2
        base = (p * d - q * b) / det, (a * q - c * p) / det
        slope = ((s - r) * d - (t - r) * b) / det, (a * (t - r) - c * (s - r)) / det
        k2 = slope[0] ** 2 + slope[1] ** 2 - 1
        k1 = base[0] * slope[0] + base[1] * slope[1] + r
        k0 = base[0] ** 2 + base[1] ** 2 - r * r
        if abs(k2) < 1e-14:
            roots = [-k0 / (2 * k1)] if k1 else []
        else:
            inner = k1 * k1 - k2 * k0
            roots = [(-k1 + sign * math.sqrt(inner)) / k2 for sign in (1, -1)] if inner >= 0 else []
        for radius in roots:
            if radius >= max(r, s, t) * (1 - SLACK):
                yield x + base[0] + slope[0] * radius, y + base[1] + slope[1] * radius, radius


def smallest_circle(x: np.ndarray, y: np.ndarray, r: np.ndarray) -> tuple[float, float, float]:
    """Centre and radius of the smallest circle around circles.

    From the largest on, the circle that stands out most joins the at most three that
    hold the circle so far, and of those four the ones that hold the new circle stay.
    """
    first = int(np.argmax(r))
    held, best = [first], (float(x[first]), float(y[first]), float(r[first]))
    while True:
        out = np.hypot(x - best[0], y - best[1]) + r - best[2]
        worst = int(np.argmax(out))
        if out[worst] <= SLACK * best[2] or worst in held:
            return best
        some = [*held, worst]
        circles = {i: (float(x[i]), float(y[i]), float(r[i])) for i in some}
        found = None
        for size in (1, 2, 3):
            for chosen in combinations(some, size):
                for c in _held_by([circles[i] for i in chosen]):
                    inside = all(math.hypot(u - c[0], v - c[1]) + w <= c[2] * (1 + SLACK) for u, v, w in circles.values())
                    if inside and (found is None or c[2] < found[0][2]):
                        found = c, list(chosen)
        if found is None or found[0][2] <= best[2]:
            return best[0], best[1], best[2] + float(out[worst])  # no progress within double precision
        best, held = found


def _solved(cores: DataFrame) -> DataFrame:
    """(family, core, cx, cy, radius) from (family, core)."""
    kind = cores.schema["family"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            core = batch.column(1)
            x, y, r = (np.asarray(core.values.field(i)) for i in range(3))
            ends = np.asarray(core.offsets)
            found = [smallest_circle(x[a:b], y[a:b], r[a:b]) for a, b in zip(ends, ends[1:])]
            columns = [pa.array([f[i] for f in found], pa.float64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=["family", "core", "cx", "cy", "radius"])

    return cores.select("family", "core").mapInArrow(work, f"family {kind}, core array<{_CIRCLE}>, cx double, cy double, radius double")


def enclosing_circles(circles: DataFrame) -> DataFrame:
    """(family, cx, cy, radius): the smallest circle around ``circles(family, x, y, r)``.

    Circles may repeat and overlap; a radius may be 0. Rows with a null family, place or
    radius take no part; an empty table gives no rows. Exact within 1e-9 of the radius.
    """
    circles = circles.select("family", "x", "y", "r").dropna()
    circle = F.struct("x", "y", "r")
    sizes, seen = materialize(circles.groupBy("family").agg(F.count(F.lit(1)).alias("_n")), "family-sizes", {"most": F.max("_n")})
    known = circles.join(sizes, "family")
    few = known.filter(F.col("_n") <= FEW).groupBy("family").agg(F.collect_list(circle).alias("core"))
    turns = [2 * math.pi * i / DIRECTIONS for i in range(DIRECTIONS)]
    reach = [F.col("x") * math.cos(t) + F.col("y") * math.sin(t) + F.col("r") for t in turns]
    many = known.filter(F.col("_n") > FEW).groupBy("family").agg(F.array(*[F.max_by(circle, e) for e in reach]).alias("core"))
    done = [_solved(few).drop("core")]
    left, step = int((seen["most"] or 0) > FEW), 0
    if left:
        open_ = materialize(_solved(many), "enclosed-0")
    while left:
        step += 1
        out = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) + F.col("r") - F.col("radius")
        worst = (
            circles.join(open_.drop("core"), "family")
            .groupBy("family")
            .agg(F.max(out).alias("_out"), F.max_by(circle, out).alias("_worst"))
        )
        judged = materialize(open_.join(worst, "family"), f"judged-{step}")
        # A circle that is in the core already stands out by rounding alone.
        settled = (F.col("_out") <= 10 * SLACK * F.col("radius")) | F.array_contains("core", F.col("_worst"))
        done.append(judged.filter(settled).select("family", "cx", "cy", "radius"))
        grown = judged.filter(~settled).select("family", F.array_append("core", F.col("_worst")).alias("core"))
        open_, seen = materialize(_solved(grown), f"enclosed-{step}", {"left": F.count(F.lit(1))})
        left = seen["left"]
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    return whole
