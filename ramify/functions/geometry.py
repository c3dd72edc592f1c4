"""Circle, viewport and colour expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default thresholds in pixels.
MIN_PX = 10.0
PAD_PX = 100.0
PICK_MIN_PX = 4.0
LOD_SKIP, LOD_SIMPLE, LOD_MEDIUM, LOD_DETAIL = 1.0, 2.0, 4.0, 8.0
FIT_RADIUS = 0.4


def round_half_up(value: Column, digits: int = 2) -> Column:
    """Round to ``digits`` decimals with halves toward plus infinity."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def world_to_screen(x: Column, y: Column, cam: dict[str, Column]) -> tuple[Column, Column]:
    return (
        cam["w"] / 2 + (x - cam["x"]) * cam["k"],
        cam["h"] / 2 + (y - cam["y"]) * cam["k"],
    )


def screen_to_world(px: Column, py: Column, cam: dict[str, Column]) -> tuple[Column, Column]:
    return (
        cam["x"] + (px - cam["w"] / 2) / cam["k"],
        cam["y"] + (py - cam["h"] / 2) / cam["k"],
    )


def camera(prefix: str = "") -> dict[str, Column]:
    """Columns cam_x, cam_y, k, w, h of a viewport table."""
    return {
        "x": F.col(f"{prefix}cam_x"),
        "y": F.col(f"{prefix}cam_y"),
        "k": F.col(f"{prefix}k"),
        "w": F.col(f"{prefix}w"),
        "h": F.col(f"{prefix}h"),
    }


def view_rectangle(cam: dict[str, Column], pad_px: float = PAD_PX) -> tuple[Column, Column, Column, Column]:
    """(min x, max x, min y, max y) of a padded viewport in world units."""
    half_w = cam["w"] / (2 * cam["k"]) + pad_px / cam["k"]
    half_h = cam["h"] / (2 * cam["k"]) + pad_px / cam["k"]
    return cam["x"] - half_w, cam["x"] + half_w, cam["y"] - half_h, cam["y"] + half_h


def in_viewport(x: Column, y: Column, r: Column, cam: dict[str, Column], pad_px: float = PAD_PX) -> Column:
    """The circle meets the padded viewport: box test, then nearest point."""
    x0, x1, y0, y1 = view_rectangle(cam, pad_px)
    box = (x + r >= x0) & (x - r <= x1) & (y + r >= y0) & (y - r <= y1)
    dx = x - F.greatest(x0, F.least(x, x1))
    dy = y - F.greatest(y0, F.least(y, y1))
    return box & (dx * dx + dy * dy <= r * r)


def view_radius(cam: dict[str, Column], distance: float = 1.0) -> Column:
    return F.sqrt(cam["w"] * cam["w"] + cam["h"] * cam["h"]) * 0.5 / cam["k"] * distance


def in_view_radius(x: Column, y: Column, r: Column, cam: dict[str, Column], distance: float = 1.0) -> Column:
    """The centre is no farther from the camera than view radius + r."""
    dx, dy, reach = x - cam["x"], y - cam["y"], view_radius(cam, distance) + r
    return dx * dx + dy * dy <= reach * reach


def in_circle(px: Column, py: Column, x: Column, y: Column, r: Column) -> Column:
    dx, dy = px - x, py - y
    return dx * dx + dy * dy <= r * r


def lod_class(
    sr: Column,
    min_px: float = MIN_PX,
    skip: float = LOD_SKIP,
    simple: float = LOD_SIMPLE,
    medium: float = LOD_MEDIUM,
    detail: float = LOD_DETAIL,
) -> Column:
    """Drawing detail by screen radius; below ``min_px`` the subtree is pruned."""
    return (
        F.when(sr < min_px, "pruned")
        .when(sr < skip, "skip")
        .when((sr < simple) & (sr < medium) & (sr < detail), "simple")
        .when(sr < detail, "medium")
        .otherwise("detail")
    )


def depth_culled(sr: Column, depth: Column, min_px: float = MIN_PX, base: float = 8.0, falloff: float = 0.7) -> Column:
    """Below the current node: too small for its depth and beyond the depth reach."""
    return (
        (depth > 0)
        & (sr < min_px * (1 + depth * 0.5))
        & (depth > base * F.pow(F.lit(falloff), depth))
    )


def stroke_width(lod: Column, sr: Column) -> Column:
    """Outline width: scaled for detail, 1 for medium, none below."""
    scaled = 1.5 * F.sqrt(F.greatest(sr / 40, F.lit(0.25)))
    return F.when(lod == "detail", F.greatest(F.lit(1.0), F.least(F.lit(3.0), scaled))).when(lod == "medium", F.lit(1.0))


def fit_zoom(r: Column, w: Column, h: Column, diameter: float | None = None) -> Column:
    """Zoom that makes radius ``r`` 40 % of the smaller side; null for r <= 0.

    Without a radius the whole layout (``diameter``) is fitted, if given.
    """
    side = F.least(w, h)
    whole = side / F.lit(diameter) if diameter else F.lit(None).cast("double")
    return F.when(r.isNull(), whole).when(r > 0, side * FIT_RADIUS / F.nullif(r, F.lit(0.0)))


# --- colours --------------------------------------------------------------------

# The ten-colour palette.
TABLEAU10 = [
    "rgb(31, 118, 180)",
    "rgb(255, 126, 14)",
    "rgb(214, 39, 39)",
    "rgb(44, 160, 44)",
    "rgb(23, 189, 207)",
    "rgb(189, 189, 34)",
    "rgb(147, 103, 189)",
    "rgb(227, 119, 195)",
    "rgb(140, 86, 75)",
    "rgb(127, 127, 127)",
]

# Light to dark blue, 38 entries.
BLUE_GRADIENT = [
    "rgb(184, 211, 238)", "rgb(178, 204, 232)", "rgb(172, 197, 226)", "rgb(166, 190, 220)",
    "rgb(160, 183, 214)", "rgb(154, 176, 208)", "rgb(148, 169, 202)", "rgb(142, 162, 196)",
    "rgb(136, 155, 190)", "rgb(130, 148, 184)", "rgb(124, 141, 178)", "rgb(118, 134, 172)",
    "rgb(112, 127, 166)", "rgb(106, 120, 160)", "rgb(100, 113, 154)", "rgb(94, 106, 148)",
    "rgb(88, 99, 142)", "rgb(82, 92, 136)", "rgb(76, 85, 130)", "rgb(70, 78, 124)",
    "rgb(64, 71, 118)", "rgb(58, 64, 112)", "rgb(52, 57, 106)", "rgb(46, 50, 100)",
    "rgb(40, 43, 94)", "rgb(34, 36, 88)", "rgb(28, 29, 82)", "rgb(22, 22, 76)",
    "rgb(16, 15, 70)", "rgb(10, 8, 64)", "rgb(4, 1, 58)", "rgb(0, 0, 55)",
    "rgb(0, 0, 52)", "rgb(0, 0, 50)", "rgb(0, 0, 48)", "rgb(0, 0, 47)",
    "rgb(0, 0, 46)", "rgb(0, 0, 45)",
]

# Alternating dark and light blue, 37 entries.
BLUE_ZIGZAG = [
    "rgb(50, 80, 140)", "rgb(150, 200, 255)", "rgb(45, 72, 128)", "rgb(143, 191, 247)",
    "rgb(40, 65, 117)", "rgb(136, 182, 238)", "rgb(36, 58, 106)", "rgb(129, 173, 230)",
    "rgb(32, 52, 96)", "rgb(122, 164, 221)", "rgb(28, 46, 87)", "rgb(115, 155, 213)",
    "rgb(25, 41, 78)", "rgb(108, 146, 204)", "rgb(22, 36, 70)", "rgb(101, 137, 196)",
    "rgb(19, 32, 63)", "rgb(94, 128, 187)", "rgb(17, 28, 56)", "rgb(87, 119, 179)",
    "rgb(15, 25, 50)", "rgb(80, 110, 170)", "rgb(13, 22, 45)", "rgb(73, 101, 162)",
    "rgb(11, 19, 40)", "rgb(66, 92, 153)", "rgb(9, 16, 36)", "rgb(59, 83, 145)",
    "rgb(8, 14, 32)", "rgb(52, 74, 136)", "rgb(6, 12, 28)", "rgb(45, 65, 128)",
    "rgb(5, 10, 25)", "rgb(38, 56, 119)", "rgb(4, 8, 22)", "rgb(31, 47, 111)",
    "rgb(2, 5, 18)",
]

PALETTES = {"tableau10": TABLEAU10, "blueGradient": BLUE_GRADIENT, "blueZigzag": BLUE_ZIGZAG}


def level_color(level: Column, palette: str = "blueGradient") -> Column:
    """Palette entry ``level mod size``; a null level takes the first."""
    colours = PALETTES[palette]
    return F.element_at(
        F.array(*[F.lit(c) for c in colours]), F.pmod(F.coalesce(level, F.lit(0)), F.lit(len(colours))).cast("int") + 1
    )
