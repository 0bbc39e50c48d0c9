"""Column expressions on boxes: four doubles x0, y0, x1, y1, origin top left.

A box is a namedtuple of columns, so every function composes with the others
and stays inside generated code.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column


def box(prefix: str = "") -> Box:
    return Box(*[F.col(prefix + c) for c in ("x0", "y0", "x1", "y1")])


def lit_box(x0: float, y0: float, x1: float, y1: float) -> Box:
    return Box(*[F.lit(float(v)) for v in (x0, y0, x1, y1)])


def width(b: Box) -> Column:
    return b.x1 - b.x0


def height(b: Box) -> Column:
    return b.y1 - b.y0


def area(b: Box) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, width(b)) * F.greatest(zero, height(b))


def center(b: Box) -> tuple[Column, Column]:
    return (b.x0 + b.x1) / 2, (b.y0 + b.y1) / 2


def expand(b: Box, by: float) -> Box:
    return Box(b.x0 - by, b.y0 - by, b.x1 + by, b.y1 + by)


def shared(a: Box, b: Box) -> Box:
    """The common part; inverted or empty where the boxes don't meet."""
    return Box(F.greatest(a.x0, b.x0), F.greatest(a.y0, b.y0), F.least(a.x1, b.x1), F.least(a.y1, b.y1))


def meets(a: Box, b: Box) -> Column:
    """Boxes that only touch do not meet."""
    s = shared(a, b)
    return (s.x1 > s.x0) & (s.y1 > s.y0)


def intersection(a: Box, b: Box) -> Box:
    ok = meets(a, b)
    return Box(*[F.when(ok, c) for c in shared(a, b)])


def shared_area(a: Box, b: Box) -> Column:
    return F.when(meets(a, b), area(shared(a, b))).otherwise(F.lit(0.0))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def overlap_ratio(a: Box, b: Box) -> Column:
    """Common area over a's own area."""
    return _ratio(shared_area(a, b), area(a))


def iou(a: Box, b: Box) -> Column:
    common = shared_area(a, b)
    return _ratio(common, area(a) + area(b) - common)


def contains_center(outer: Box, inner: Box) -> Column:
    cx, cy = center(inner)
    return (cx >= outer.x0) & (cx <= outer.x1) & (cy >= outer.y0) & (cy <= outer.y1)


def axis_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def flip_y(left: Column, bottom: Column, right: Column, top: Column, page_height: Column, ox: Column, oy: Column) -> Box:
    """Bottom-left coordinates to top-left ones, relative to the page's origin; edges
    may come in either order."""
    head = oy + page_height
    return Box(F.least(left, right) - ox, head - F.greatest(bottom, top), F.greatest(left, right) - ox, head - F.least(bottom, top))


def unflip_y(b: Box, page_height: Column) -> tuple[Column, Column, Column, Column]:
    """left, bottom, right, top."""
    return b.x0, page_height - b.y1, b.x1, page_height - b.y0


def rotate(b: Box, rotation: Column, w: Column, h: Column) -> Box:
    """Into the frame a reader sees; anything but a right angle changes nothing."""
    r = F.pmod(rotation, F.lit(360))
    pick = lambda same, q, half, three: F.when(r == 90, q).when(r == 180, half).when(r == 270, three).otherwise(same)
    return Box(
        pick(b.x0, h - b.y1, w - b.x1, b.y0),
        pick(b.y0, b.x0, h - b.y1, w - b.x1),
        pick(b.x1, h - b.y0, w - b.x0, b.y1),
        pick(b.y1, b.x1, h - b.y0, w - b.x0),
    )


def unrotate(b: Box, rotation: Column, w: Column, h: Column) -> Box:
    """The inverse of rotate; w and h are those of the unrotated page."""
    r = F.pmod(rotation, F.lit(360))
    pick = lambda same, q, half, three: F.when(r == 90, q).when(r == 180, half).when(r == 270, three).otherwise(same)
    return Box(
        pick(b.x0, b.y0, w - b.x1, w - b.y1),
        pick(b.y0, h - b.x1, h - b.y1, b.x0),
        pick(b.x1, b.y1, w - b.x0, w - b.y0),
        pick(b.y1, h - b.x0, h - b.y0, b.x1),
    )


def clamp(b: Box, page: Box) -> Box:
    """Cut to the page; callers drop boxes left without area."""
    inside = lambda v, lo, hi: F.least(F.greatest(v, lo), hi)
    return Box(inside(b.x0, page.x0, page.x1), inside(b.y0, page.y0, page.y1), inside(b.x1, page.x0, page.x1), inside(b.y1, page.y0, page.y1))


def raster_to_page(b: Box, w_px: Column, h_px: Column, page: Box) -> Box:
    """Pixels of a raster of the page to page points."""
    sx, sy = width(page) / w_px, height(page) / h_px
    return clamp(Box(page.x0 + b.x0 * sx, page.y0 + b.y0 * sy, page.x0 + b.x1 * sx, page.y0 + b.y1 * sy), page)


def polygon_box(points: Column) -> Column:
    """array<struct<x,y>> to a box struct, null unless four finite points span an area."""
    xs, ys = F.transform(points, lambda p: p.x), F.transform(points, lambda p: p.y)
    fine = F.forall(points, lambda p: p.x.isNotNull() & p.y.isNotNull() & ~F.isnan(p.x) & ~F.isnan(p.y) & (F.abs(p.x) < float("inf")) & (F.abs(p.y) < float("inf")))
    wide = (F.array_max(xs) > F.array_min(xs)) & (F.array_max(ys) > F.array_min(ys))
    ok = (F.size(points) >= 4) & fine & wide
    return F.when(ok, F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")))


def finite(value: Column) -> Column:
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), value)


def safe_scale(w: Column, h: Column, requested: float, max_pixels: float, max_bytes: float) -> Column:
    """The greatest scale up to the one requested within pixel and byte limits (3 bytes a pixel)."""
    limit = F.least(F.lit(float(max_pixels)), F.lit(float(max_bytes) / 3))
    return F.when((w <= 0) | (h <= 0), F.lit(float(requested))).otherwise(F.least(F.lit(float(requested)), F.sqrt(limit / (w * h))))


def scaled_dim(d: Column, scale: Column) -> Column:
    """A raster's side at a scale: half-even, and at least one more pixel when enlarged."""
    r = F.bround(d * scale).cast("long")
    return F.when(scale > 1, F.greatest(d + 1, r)).otherwise(F.greatest(F.lit(1).cast("long"), r))


def page_box(x0: Column, y0: Column, x1: Column, y1: Column, ox: Column, oy: Column, w: Column, h: Column) -> Box:
    """A page's box relative to its origin; the given size where a side is missing or not positive."""
    ok = x0.isNotNull() & y0.isNotNull() & x1.isNotNull() & y1.isNotNull() & (x1 > x0) & (y1 > y0)
    return Box(*[F.when(ok, a).otherwise(b) for a, b in ((x0 - ox, F.lit(0.0)), (y0 - oy, F.lit(0.0)), (x1 - ox, w), (y1 - oy, h))])
