"""Circles of one family in concentric rings: closed-form expressions.

Circles go by size class (a quarter of a doubling of the radius), largest class
inside. A class of n circles of radius at most q fills rings around what lies inside
it. A ring whose centre line is d = q * (u + 2j + 1) from the middle, u a whole
number, takes 3 * (u + 2j + 1) circles: sin(pi / k) >= q / d for that k, so they do not
touch. The rings before ring j hold 3j(u + j), which gives the ring and the slot of the
m-th circle without looking at any other. Around an empty middle the first ring is the
middle itself, and the rings are the hexagonal numbers; up to five circles stand in one
ring about an empty middle. Slots that a class leaves in its last ring go to the next,
smaller class. The same rule holds for families of any size.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLASSES_PER_DOUBLING = 4
_EPS = 1e-9


def size_class(r: Column) -> Column:
    """Class number of a radius; circles without a radius are the last class."""
    return F.when(r > 0, F.floor(F.log2(r) * _CLASSES_PER_DOUBLING + _EPS)).otherwise(F.lit(-100_000)).cast("bigint")


def _rings(u: Column, n: Column) -> Column:
    """Number of rings that n circles need around a middle of u radii."""
    full = F.ceil((F.sqrt(u * u + 4.0 * n / 3.0) - u) / 2 - _EPS)
    # Around nothing: one circle in the middle, then 6, 12, ...
    hexagonal = F.ceil((F.sqrt(12.0 * n - 3.0) - 3.0) / 6 - _EPS) + 1
    return F.when(u > 0, full).otherwise(hexagonal).cast("double")


def stack_classes(classes: Column) -> Column:
    """Classes of a family, ARRAY<STRUCT<class, n, q>> from the largest: (whole, placed).

    A class first takes the slots that its predecessor left in the outermost ring, then
    rings of its own. ``placed`` says how: ``spare`` circles at distance ``s_away`` in
    slots ``s_used`` and on of ``s_room``; the other ``rest`` around ``u`` radii ``q``;
    ``few`` for up to five circles about an empty middle. ``whole`` is the radius of the
    family.
    """
    fields = "class:bigint,spare:double,s_away:double,s_room:double,s_used:double,rest:double,q:double,u:double,few:boolean"
    zero = F.lit(0.0)
    start = F.struct(
        zero.alias("whole"), zero.alias("away"), zero.alias("room"), zero.alias("used"),
        F.array().cast(f"array<struct<{fields}>>").alias("placed"),
    )

    def add(acc: Column, c: Column) -> Column:
        n, q = c["n"].cast("double"), c["q"]
        spare = F.least(n, acc["room"] - acc["used"])
        rest = n - spare
        u = F.when(q > 0, F.ceil(acc["whole"] / q - _EPS)).otherwise(zero).cast("double")
        few = (acc["whole"] == 0) & (rest > 1) & (rest <= 5)
        last = _rings(u, rest) - 1
        away = F.when(few, q / F.sin(F.lit(3.141592653589793) / rest)).when(u > 0, q * (u + 2 * last + 1)).otherwise(2 * q * last)
        room = F.when(few, rest).when(u > 0, 3 * (u + 2 * last + 1)).otherwise(F.greatest(6 * last, F.lit(1.0)))
        before = F.when(few | (last == 0), zero).when(u > 0, 3 * last * (u + last)).otherwise(1 + 3 * last * (last - 1))
        placed = F.struct(
            c["class"].alias("class"), spare.alias("spare"), acc["away"].alias("s_away"), acc["room"].alias("s_room"),
            acc["used"].alias("s_used"), rest.alias("rest"), q.alias("q"), u.alias("u"), few.alias("few"),
        )
        more = rest > 0
        return F.struct(
            F.when(more, F.greatest(acc["whole"], away + q)).otherwise(acc["whole"]).alias("whole"),
            F.when(more, away).otherwise(acc["away"]).alias("away"),
            F.when(more, room).otherwise(acc["room"]).alias("room"),
            F.when(more, rest - before).otherwise(acc["used"] + spare).alias("used"),
            F.array_append(acc["placed"], placed).alias("placed"),
        )

    return F.aggregate(classes, start, add)


def place(m: Column, c: Column) -> tuple[Column, Column]:
    """Offsets (dx, dy) of circle ``m`` (from 0) of the placed class ``c``."""
    m = m.cast("double")
    shared = m < c["spare"]
    i, n, q, u = F.greatest(m - c["spare"], F.lit(0.0)), c["rest"], c["q"], c["u"]
    around = F.floor((F.sqrt(u * u + 4.0 * i / 3.0) - u) / 2 + _EPS).cast("double")
    # Hexagonal: ring 0 is the middle, ring j holds 6j and is preceded by 1 + 3j(j - 1).
    hexagonal = F.when(i < 1, 0.0).otherwise(F.floor((F.sqrt(F.greatest(12.0 * i - 3.0, F.lit(0.0))) + 3.0) / 6 + _EPS).cast("double"))
    ring = F.when(u > 0, around).otherwise(hexagonal)
    slot = F.when(u > 0, i - 3 * ring * (u + ring)).otherwise(F.when(i < 1, 0.0).otherwise(i - 1 - 3 * ring * (ring - 1)))
    room = F.when(u > 0, 3 * (u + 2 * ring + 1)).otherwise(F.greatest(6 * ring, F.lit(1.0)))
    own = F.when(c["few"], q / F.sin(F.lit(3.141592653589793) / n)).when(u > 0, q * (u + 2 * ring + 1)).otherwise(2 * q * ring)
    away = F.when(shared, c["s_away"]).otherwise(own)
    part = F.when(shared, (c["s_used"] + m) / c["s_room"]).when(c["few"], i / n).otherwise(slot / room)
    turn = part * 6.283185307179586
    return away * F.cos(turn), away * F.sin(turn)
