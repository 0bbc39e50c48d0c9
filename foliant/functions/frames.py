"""Frames of rotated rasters and tokens, spaces between tokens, marks and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G
from .geometry import Box

# Characters that take no space before or after them, list bullets,
# and the punctuation that is a ghost when it stands alone on a small line.
NO_SPACE_BEFORE = r"^[,.:;!?%)\]}]"
NO_SPACE_AFTER = r"[(\[{]$"
BULLETS = "•◦▪‣·●○■–—-*"
GHOSTS = [",", ".", "’", "`", ":", ";"]
#: Share of a page's height that is its top band.
TOP_BAND = 0.22
#: Longest text of a title-like line.
TITLE_CHARS = 180


def shift(b: Box, dx: Column, dy: Column) -> Box:
    return Box(b.x0 + dx, b.y0 + dy, b.x1 + dx, b.y1 + dy)


def turned_sides(rotation: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """Width and height of a page as a reader sees it."""
    side = F.pmod(rotation, F.lit(360)).isin(90, 270)
    return F.when(side, h).otherwise(w), F.when(side, w).otherwise(h)


def affine_back(b: Box, inverse: tuple[float, float, float, float, float, float]) -> Box:
    """Bounds of the four corners under the inverse matrix (a, b, c, d, e, f), by rows."""
    p, q, r, s, t, u = (F.lit(float(v)) for v in inverse)
    corners = [(x, y) for x in (b.x0, b.x1) for y in (b.y0, b.y1)]
    xs, ys = [p * x + q * y + r for x, y in corners], [s * x + t * y + u for x, y in corners]
    return Box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def variant_to_region(b: Box, inverse: tuple[float, float, float, float, float, float], w_px: Column, h_px: Column, region: Box) -> Box:
    """A box of a scaled and turned crop to page points: back by the inverse matrix, cut
    to the crop, then in proportion into the region the crop was made of."""
    raster = Box(F.lit(0.0), F.lit(0.0), w_px, h_px)
    return G.raster_to_page(G.clamp(affine_back(b, inverse), raster), w_px, h_px, region)


def upright(b: Box, token_rotation: Column, page_rotation: Column, page: Box) -> Box:
    """A token's box in the frame its text stands upright in: the page is turned as it is
    shown, then the token's own turn is taken back."""
    w, h = G.width(page), G.height(page)
    shown = G.rotate(shift(b, -page.x0, -page.y0), page_rotation, w, h)
    return G.unrotate(shown, token_rotation, *turned_sides(page_rotation, w, h))


def gap(before: Box, after: Box, token_rotation: Column, page_rotation: Column, page: Box) -> Box:
    """Page box of the space between two upright boxes; a point's width where they overlap."""
    w, h = G.width(page), G.height(page)
    middle = (before.x1 + after.x0) / 2
    lapped = after.x0 < before.x1
    flat = Box(
        F.when(lapped, middle).otherwise(before.x1), F.least(before.y0, after.y0),
        F.when(lapped, middle).otherwise(after.x0), F.greatest(before.y1, after.y1),
    )
    shown = G.rotate(flat, token_rotation, *turned_sides(page_rotation, w, h))
    return shift(G.unrotate(shown, page_rotation, w, h), page.x0, page.y0)


def crop_bounds(b: Box, w_px: Column, h_px: Column) -> Box:
    """Whole pixels within the raster, edges in order."""
    inside = lambda v, top: F.greatest(F.lit(0), F.least(v.cast("int"), top.cast("int")))
    x0, x1, y0, y1 = inside(b.x0, w_px), inside(b.x1, w_px), inside(b.y0, h_px), inside(b.y1, h_px)
    return Box(F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))


def needs_space(before: Column, after: Column, a: Box, b: Box) -> Column:
    """Whether a space goes between two tokens of a line, upright boxes a and b.

    Apart: unless punctuation or a currency sign holds them together. Overlapping: only
    between letters or digits that overlap little, if one side is short or has a space.
    Null texts are empty."""
    l, r = F.rtrim(F.coalesce(before, F.lit(""))), F.ltrim(F.coalesce(after, F.lit("")))
    empty = (l == "") | (r == "")
    held = r.rlike(NO_SPACE_BEFORE) | l.rlike(NO_SPACE_AFTER) | (l.rlike(r"^[Rr]\$$") & r.rlike(r"^\p{Nd}"))
    spaced = l.contains(" ") | r.contains(" ")
    line = F.greatest(G.height(a), G.height(b), F.lit(1.0))
    little = a.x1 - b.x0 <= line * F.when(spaced, 0.75).otherwise(0.45)
    lapped = l.rlike(r"[\p{L}\p{N}]$") & r.rlike(r"^[\p{L}\p{N}]") & little & (spaced | (F.length(l) <= 2) | (F.length(r) <= 2))
    return F.when(b.x0 >= a.x1, empty | ~held).otherwise(~empty & lapped)


def bullet(t: Column) -> Column:
    """A list marker that stands alone: a bullet, or a number or letter with . or )."""
    s = F.trim(F.coalesce(t, F.lit("")))
    return ((F.length(s) == 1) & F.lit(BULLETS).contains(s)) | s.rlike(r"^(?:\p{Nd}+|[A-Za-z])[.)]$")


def visible_glyph(t: Column, b: Box, mode: Column) -> Column:
    """A glyph that can be seen: some text, no line end, no negative side, not painted as invisible (mode 3)."""
    some = t.isNotNull() & ~t.isin("", "\r", "\n")
    return some & (G.width(b) >= 0) & (G.height(b) >= 0) & (F.coalesce(mode, F.lit(0)) != 3)


def inline_mark(t: Column) -> Column:
    """Space, or text that opens with a combining mark or punctuation."""
    return F.coalesce(t.rlike(r"^(?:\s+$|[\p{M}\p{P}])"), F.lit(False))


def ghost_punctuation(t: Column, b: Box) -> Column:
    """One small mark alone on a line: it is marked, never dropped."""
    return F.coalesce(F.trim(t).isin(*GHOSTS) & (G.width(b) <= F.greatest(F.lit(10.0), G.height(b) * 1.8)), F.lit(False))


def in_top_band(line: Box, page: Box, rotation: Column) -> Column:
    """A line starts in the top band of the page as a reader sees it."""
    r = F.pmod(rotation, F.lit(360))
    dx, dy = G.width(page) * TOP_BAND, G.height(page) * TOP_BAND
    return (
        F.when(r == 90, line.x0 <= page.x0 + dx)
        .when(r == 180, line.y1 >= page.y1 - dy)
        .when(r == 270, line.x1 >= page.x1 - dx)
        .otherwise(line.y0 <= page.y0 + dy)
    )


def title_like(t: Column, in_title: Column, line: Box, page: Box, rotation: Column) -> Column:
    s = F.trim(F.coalesce(t, F.lit("")))
    return (s != "") & (F.length(s) <= TITLE_CHARS) & (in_title | in_top_band(line, page, rotation))


def turned_flag(value: Column) -> Column:
    """The half turn a recogniser reports: 1, or a label that says 180."""
    number = value.try_cast("int")
    return F.when(number == 1, 180).when(number.isNotNull(), 0).when(value.contains("180"), 180).otherwise(0)


def half_turn(rotation: Column, text: Column, confidence: Column) -> Column:
    """Aggregate: 180 if three fifths of the usable tokens say so, else 0."""
    usable = (F.coalesce(text, F.lit("")) != "") & (confidence.isNull() | (confidence >= 0.5))
    return F.when(F.count_if(usable & (rotation == 180)) >= 0.6 * F.greatest(F.count_if(usable), F.lit(1)), 180).otherwise(0)


def blank_raster(low: Column, high: Column) -> Column:
    """A raster whose grey values span so little and so near white that it shows nothing; null extremes: not blank."""
    return F.coalesce((low >= 250) & (high - low <= 3), F.lit(False))
