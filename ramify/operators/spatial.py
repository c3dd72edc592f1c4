"""Point-in-circle, viewport culling and labels over a laid-out node table.

Circles and points or viewports meet in an equi-join on grid cells. A circle
belongs to the zoom level whose cells are at least as wide as the circle, so it
touches at most four cells whatever its size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramify.functions import geometry as G
from ramify.operators.ranking import grouped_running, top_k
from ramify.store import materialize, transient

_MAX_ZOOM = 40


def zoom_of(r: Column, size: float) -> Column:
    """Zoom level whose cell, size / 2^z, is between one and two diameters."""
    z = F.floor(F.log2(F.lit(size) / (2 * r)))
    return F.when(r > 0, F.least(z, F.lit(_MAX_ZOOM))).otherwise(F.lit(_MAX_ZOOM)).cast("int")


def _cell(v: Column, z: Column, size: float) -> Column:
    return F.floor(v * F.pow(F.lit(2.0), z) / size).cast("bigint")


def circle_zooms(circles: DataFrame, size: float) -> list[int]:
    """Zoom levels in use: at most one value per possible level."""
    return sorted(r["z"] for r in circles.select(zoom_of(F.col("r"), size).alias("z")).distinct().collect())


def _circle_cells(circles: DataFrame, size: float) -> DataFrame:
    """One row per touched cell of the circle's own zoom level."""
    return cells_touched(circles.withColumn("_z", zoom_of(F.col("r"), size)), size)


def cells_touched(circles: DataFrame, size: float) -> DataFrame:
    """One row per cell of zoom level ``_z`` that a circle touches: (_cx, _cy)."""
    z = F.col("_z")
    xs = F.sequence(_cell(F.col("x") - F.col("r"), z, size), _cell(F.col("x") + F.col("r"), z, size))
    ys = F.sequence(_cell(F.col("y") - F.col("r"), z, size), _cell(F.col("y") + F.col("r"), z, size))
    return circles.withColumn("_cx", F.explode(xs)).withColumn("_cy", F.explode(ys))


def _with_current(labelled: DataFrame, df: DataFrame) -> DataFrame:
    """Preorder range (_lo, _hi) of ``current_id``; no current node means all."""
    bounds = labelled.select(F.col("id").alias("current_id"), F.col("pre").alias("_lo"), F.col("pre_end").alias("_hi"))
    if "current_id" not in df.columns:
        df = df.withColumn("current_id", F.lit(None).cast("bigint"))
    return df.join(bounds, "current_id", "left")


def _inside(pre: Column) -> Column:
    return F.col("current_id").isNull() | pre.between(F.col("_lo"), F.col("_hi"))


def pick(
    laid_out: DataFrame,
    points: DataFrame,
    size: float = 4000.0,
    min_px: float = G.MIN_PX,
    pick_min_px: float = G.PICK_MIN_PX,
    distance: float = 1.0,
) -> DataFrame:
    """Deepest node under each point: (point_id, id, name, level).

    ``points(point_id, wx, wy, cam_x, cam_y, k, w, h[, current_id])`` in world
    coordinates. A node counts when it is in the view radius, at least
    max(min_px, pick_min_px) wide on screen and in the current subtree. Equal
    depth: first in preorder. A point over nothing has no row.
    """
    zooms = circle_zooms(laid_out, size)
    circles = _circle_cells(laid_out.select("id", "name", "level", "pre", "x", "y", "r"), size)
    z = F.col("_z")
    located = (
        _with_current(laid_out, points)
        .withColumn("_z", F.explode(F.array(*[F.lit(v) for v in zooms])))
        .withColumn("_cx", _cell(F.col("wx"), z, size))
        .withColumn("_cy", _cell(F.col("wy"), z, size))
    )
    cam = G.camera()
    x, y, r = F.col("x"), F.col("y"), F.col("r")
    hits = located.join(circles, ["_z", "_cx", "_cy"]).filter(
        G.in_circle(F.col("wx"), F.col("wy"), x, y, r)
        & (r * F.col("k") >= max(min_px, pick_min_px))
        & G.in_view_radius(x, y, r, cam, distance)
        & _inside(F.col("pre"))
    )
    best = F.max_by(F.struct("id", "name", "level"), F.struct(F.col("level"), -F.col("pre")))
    return hits.groupBy("point_id").agg(best.alias("n")).select("point_id", "n.id", "n.name", "n.level")


def revalidate_hover(
    laid_out: DataFrame,
    hovers: DataFrame,
    min_px: float = G.MIN_PX,
    pick_min_px: float = G.PICK_MIN_PX,
    distance: float = 1.0,
) -> DataFrame:
    """Is the node of each (hover_id, id, point and camera) still under the point?"""
    node = laid_out.select("id", "x", "y", "r", "pre")
    cam = G.camera()
    x, y, r = F.col("x"), F.col("y"), F.col("r")
    valid = (
        _inside(F.col("pre"))
        & (r * F.col("k") >= max(min_px, pick_min_px))
        & G.in_view_radius(x, y, r, cam, distance)
        & G.in_circle(F.col("wx"), F.col("wy"), x, y, r)
    )
    return (
        _with_current(laid_out, hovers)
        .join(node, "id", "left")
        .withColumn("valid", F.coalesce(valid, F.lit(False)))
        .select(*hovers.columns, "valid")
    )


def _viewport_cells(viewports: DataFrame, zooms: list[int], size: float, pad_px: float, min_px: float) -> DataFrame:
    """Cells whose circles may meet a viewport.

    Circles are keyed by the cell of their centre here; a circle is at most one
    cell wide, so the rectangle grows by half a cell. Zoom levels whose circles
    are too small on screen are left out, which bounds the cells per viewport
    by its size in pixels.
    """
    x0, x1, y0, y1 = G.view_rectangle(G.camera(), pad_px)
    z = F.col("_z")
    cell = F.lit(size) / F.pow(F.lit(2.0), z)
    levels = viewports.withColumn("_z", F.explode(F.array(*[F.lit(v) for v in zooms]))).filter(
        cell / 2 * F.col("k") * 1.000001 >= min_px
    )
    half = cell / 2 * 1.000001
    xs = F.sequence(_cell(x0 - half, z, size), _cell(x1 + half, z, size))
    ys = F.sequence(_cell(y0 - half, z, size), _cell(y1 + half, z, size))
    return levels.withColumn("_cx", F.explode(xs)).withColumn("_cy", F.explode(ys))


def cull_viewports(
    laid_out: DataFrame,
    viewports: DataFrame,
    size: float = 4000.0,
    min_px: float = G.MIN_PX,
    pad_px: float = G.PAD_PX,
    strict: bool = False,
) -> DataFrame:
    """Visible nodes per viewport: (viewport columns, node columns, sr).

    A node is visible when its circle meets the padded viewport and is at least
    ``min_px`` wide on screen, below the current node. Children lie inside
    their parents, so a failing node's subtree fails by itself; ``strict``
    checks the ancestors for layouts where that does not hold.
    """
    circles = laid_out.withColumn("_z", zoom_of(F.col("r"), size))
    zooms = circle_zooms(laid_out, size)
    circles = circles.withColumn("_cx", _cell(F.col("x"), F.col("_z"), size)).withColumn(
        "_cy", _cell(F.col("y"), F.col("_z"), size)
    )
    asked = _viewport_cells(_with_current(laid_out, viewports), zooms, size, pad_px, min_px)
    cam = G.camera()
    # The cells of the viewports are many more than their table suggests: no
    # broadcast on the strength of its size.
    seen = asked.hint("merge").join(circles, ["_z", "_cx", "_cy"]).filter(
        (F.col("r") * F.col("k") >= min_px)
        & G.in_viewport(F.col("x"), F.col("y"), F.col("r"), cam, pad_px)
        & _inside(F.col("pre"))
    )
    seen = seen.withColumn("sr", F.col("r") * F.col("k")).drop("_z", "_cx", "_cy", "_lo", "_hi")
    if not strict:
        return seen
    start = seen.withColumn("_from", F.coalesce(F.array_position("path_ids", F.col("current_id")), F.lit(1)))
    above = start.select(
        "viewport_id", "id", (F.col("level") + 2 - F.col("_from")).alias("_need"),
        F.explode(F.expr("slice(path_ids, cast(_from as int), size(path_ids))")).alias("_anc"),
    )
    ok = seen.select("viewport_id", F.col("id").alias("_anc"))
    whole = (
        above.join(ok, ["viewport_id", "_anc"])
        .groupBy("viewport_id", "id")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_need").alias("_need"))
        .filter("_n = _need")
        .select("viewport_id", "id")
    )
    return seen.join(whole, ["viewport_id", "id"], "left_semi")


def node_budget(visible: DataFrame, budget: int | None = None) -> DataFrame:
    """``drawn``: number of each node of a viewport, in preorder; with ``budget`` only the first so many."""
    if budget is None:
        return grouped_running(visible, ["viewport_id"], ["pre"], "drawn")
    return top_k(visible, ["viewport_id"], ["pre"], budget, "drawn", "id")


def label_space(laid_out: DataFrame) -> DataFrame:
    """``space``: height above the highest child in world units; a leaf has its diameter."""
    top = laid_out.groupBy(F.col("parent_id").alias("id")).agg(F.min(F.col("y") - F.col("r")).alias("_top"))
    bottom = F.col("y") + F.col("r")
    return (
        laid_out.join(top.filter("id is not null"), "id", "left")
        .withColumn(
            "space",
            F.when(F.col("_top").isNull(), 2 * F.col("r")).otherwise(
                F.least(F.col("_top"), bottom) - (F.col("y") - F.col("r"))
            ),
        )
        .drop("_top")
    )


def label_candidates(
    visible: DataFrame,
    min_px: float = 22.0,
    font_min: float = 10.0,
    font_max: float = 18.0,
    divisor: float = 3.0,
    least_font: float = 12.0,
    max_labels: int | None = None,
    char_width: float = 0.6,
    pad: float = 2.0,
) -> DataFrame:
    """Labels to try per viewport, largest font first, with their rectangles.

    ``visible`` needs ``space`` (see ``label_space``). ``turn`` numbers all of them; with
    ``max_labels`` only the first so many, scaled by the zoom, are returned. Text width
    is estimated per character.
    """
    cam = G.camera()
    sx, sy = G.world_to_screen(F.col("x"), F.col("y"), cam)
    font = F.least(F.lit(font_max), F.greatest(F.lit(font_min), F.col("sr") / divisor))
    room = F.col("space") * F.col("k")
    tried = (
        visible.filter(F.col("sr") > min_px)
        .withColumn("font", font)
        .filter((F.col("font") >= least_font) & (room >= F.col("font") + 4))
        .withColumn("sx", sx)
        .withColumn("ty", sy - F.col("sr") + room / 2)
        .withColumn("_half", F.length("name") * F.col("font") * (char_width / 2) + pad)
        .withColumn("x1", F.col("sx") - F.col("_half"))
        .withColumn("x2", F.col("sx") + F.col("_half"))
        .withColumn("y1", F.col("ty") - F.col("font") / 2 - pad)
        .withColumn("y2", F.col("ty") + F.col("font") / 2 + pad)
    )
    order = [F.col("font").desc(), "pre"]
    if max_labels is None:
        return grouped_running(tried, ["viewport_id"], order, "turn").drop("_half")
    cap = F.floor(max_labels * F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.col("k"))))
    return top_k(tried, ["viewport_id"], order, cap, "turn", "id").drop("_half")


def place_labels(candidates: DataFrame) -> DataFrame:
    """Labels kept when each, in turn, must not touch one kept before it.

    Rounds over grid cells, for all viewports together: a label that is the first in turn
    of all that are left in each of its cells is kept; what touches it goes. Kept labels
    do not touch, so that only a bounded number of them meet in a cell, and a label meets
    only kept ones. The cells are half as wide and high as the average label.
    """
    cols = ["id", "turn", "x1", "y1", "x2", "y2"]
    one = ["viewport_id", "turn"]
    mean = candidates.agg(F.avg(F.col("x2") - F.col("x1")).alias("w"), F.avg(F.col("y2") - F.col("y1")).alias("h")).first()
    if mean["w"] is None:
        return candidates.select("viewport_id", *cols)

    def steps(low: str, high: str, size: float) -> Column:
        size = F.lit(max(size / 2, 1.0))
        return F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size))

    cells = F.flatten(F.transform(steps("x1", "x2", mean["w"]), lambda i: F.transform(steps("y1", "y2", mean["h"]), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    touch = (F.col("x2") >= F.col("_x1")) & (F.col("x1") <= F.col("_x2")) & (F.col("y2") >= F.col("_y1")) & (F.col("y1") <= F.col("_y2"))
    kept = []
    with transient(candidates.sparkSession):
        left = materialize(candidates.select("viewport_id", *cols), "labels-left")
        count = True
        while count:
            spread_out = left.withColumn("_cell", F.explode(cells))
            firsts = spread_out.groupBy("viewport_id", "_cell").agg(F.min("turn").alias("_first"))
            waiting = spread_out.join(firsts, ["viewport_id", "_cell"]).filter("_first < turn").select(*one).distinct()
            kept.append(materialize(left.join(waiting, one, "left_anti"), "labels-kept", keep=True))
            here = kept[-1].select("viewport_id", F.explode(cells).alias("_cell"), *[F.col(c).alias(f"_{c}") for c in cols[2:]])
            gone = spread_out.join(here, ["viewport_id", "_cell"]).filter(touch).select(*one).distinct()
            left, seen = materialize(left.join(gone, one, "left_anti"), "labels-left", {"left": F.count(F.lit(1))})
            count = seen["left"]
    return reduce(DataFrame.unionByName, kept)
