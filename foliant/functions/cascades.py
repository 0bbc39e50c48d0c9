"""Decision cascades over aggregates: page complexity, regions, line roles, headings,
recogniser quality. Thresholds are those of the surveyed rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G

#: reason -> penalty of the native text score
PENALTIES = {
    "garbled_unicode": 0.45, "duplicate_text_layer": 0.25, "sparse_text": 0.20, "no_text": 0.70, "scanned": 0.80,
    "invisible_text": 0.35, "vector_text": 0.20, "annotation_text": 0.15,
}
VISUAL = ["no_text", "scanned", "sparse_text", "garbled_unicode", "invisible_text", "vector_text", "annotation_text", "embedded_images"]
LAYOUT = ["table_likely", "multi_column_likely", "rotated_text", "embedded_images"]


def flags(rules: dict[str, Column]) -> Column:
    """The names of the conditions that hold, in order; an unknown one does not hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))


def scanned(length: Column, images: Column, largest: Column, ink: Column) -> Column:
    return ((length <= 30) & (largest >= 0.75)) | ((length == 0) & (images >= 0.40)) | ((length == 0) & (F.coalesce(ink, F.lit(0.0)) >= 0.02))


def grid_lines(horizontal: Column, vertical: Column) -> Column:
    """Thin long paths, counted only if there are two or more along both axes."""
    return F.when((horizontal >= 2) & (vertical >= 2), horizontal + vertical).otherwise(F.lit(0))


def is_horizontal_rule(b: G.Box, page: G.Box) -> Column:
    return (G.height(b) <= 4) & (G.width(b) >= G.width(page) * 0.20)


def is_vertical_rule(b: G.Box, page: G.Box) -> Column:
    return (G.width(b) <= 4) & (G.height(b) >= G.height(page) * 0.12)


def two_columns(n: Column, left: Column, right: Column, left_end: Column, right_start: Column, width: Column, grid: Column) -> Column:
    """Two halves of a fifth or more of at least 120 characters, with a wide gutter."""
    halves = (left >= n * 0.20) & (right >= n * 0.20)
    return F.coalesce((width > 0) & (n >= 120) & (grid < 4) & halves & (right_start - left_end > width * 0.06), F.lit(False))


def page_reasons(p: dict[str, Column]) -> Column:
    """Reason flags of a page from its aggregates; see plans.evidence for their names."""
    n = p["useful"]
    return flags({
        "no_text": n == 0,
        "scanned": scanned(n, p["image_coverage"], p["largest_image"], p["ink"]),
        "sparse_text": (n < 80) & (p["image_coverage"] >= 0.05),
        "garbled_unicode": (p["replacement"] > 0.01) | (p["private_use"] > 0.10) | (p["control"] > 0.02) | (p["unmapped"] > 0.05),
        "duplicate_text_layer": p["duplicates"] > 0.10,
        "invisible_text": (p["invisible_lines"] >= 2) & (p["invisible_lines"] / F.greatest(p["lines"], F.lit(1)) >= 0.35),
        "vector_text": (p["paths"] > 0) & (p["path_coverage"] >= 0.20) & (n < 120) & (p["text_coverage"] < 0.02),
        "annotation_text": (p["annotations"] > 0) & (n < 80),
        "rotated_text": p["rotated"],
        "multi_column_likely": p["two_columns"],
        "table_likely": (p["grid"] >= 4) & (n >= 20),
        "embedded_images": p["image_coverage"] >= 0.05,
    })


def _any(reasons: Column, names: list[str]) -> Column:
    return F.arrays_overlap(reasons, F.array(*map(F.lit, names)))


def native_text_score(reasons: Column, useful: Column, coverage: Column, duplicates: Column, unmapped: Column) -> Column:
    score = 1.0 - F.when(useful == 0, 0.80).when(coverage < 0.002, 0.10).otherwise(0.0)
    for name, penalty in PENALTIES.items():
        score = score - F.when(F.array_contains(reasons, name), penalty).otherwise(0.0)
    score = score - F.least(F.lit(0.20), duplicates * 0.5) - F.least(F.lit(0.20), unmapped * 0.5)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def strategy(reasons: Column, ink: Column) -> Column:
    blank = F.coalesce(ink < 0.002, F.lit(False))
    return (
        F.when(_any(reasons, ["no_text", "scanned"]) & ~blank, "ocr_candidate").when(_any(reasons, VISUAL + LAYOUT), "hybrid_candidate").otherwise("native")
    )


def region_decision(
    kind: Column, text: Column, area: Column, page_area: Column, coverage: Column, ink: Column, unmapped: Column, reasons: Column, score: Column
) -> Column:
    """struct(decision, confidence, reason) of one region: the first rule that matches.

    ``text`` is trimmed; a null ``ink`` was not measured and counts as visible."""
    has = text != ""
    visible = ink.isNull() | (ink >= 0.008)
    out = lambda d, c, r: F.struct(F.lit(d).alias("decision"), c.cast("double").alias("confidence"), F.lit(r).alias("reason"))
    figure, grid = kind == "figure", kind == "table"
    damaged = _any(reasons, ["garbled_unicode", "duplicate_text_layer"])
    kept = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score + F.when(has, 0.10).otherwise(0.0)))
    return (
        F.when((figure | grid) & (area / F.greatest(page_area, F.lit(1.0)) >= 0.60) & (F.length(text) < 40) & visible, out("escalate_page_ocr", F.lit(0.90), "large_visual_region"))
        .when(figure & visible & ~has, out("ocr_region", F.lit(0.82), "visual_figure_may_contain_text"))
        .when(figure & visible, out("merge_ocr", F.lit(0.72), "visual_figure_may_contain_text"))
        .when(grid & visible & (~has | (coverage < 0.008)), out("ocr_region", F.lit(0.84), "visual_table_text_sparse"))
        .when(~has & visible & ~kind.isin("header", "footer"), out("ocr_region", F.lit(0.78), "native_text_missing"))
        .when(has & ~visible, out("keep_native", F.least(F.lit(0.55), score), "native_text_not_visible"))
        .when(unmapped, out("merge_ocr", F.lit(0.64), "unicode_mapping_failed"))
        .when(has & damaged, out("merge_ocr", F.lit(0.68), "page_text_layer_damaged"))
        .when(has, out("keep_native", kept, "native_region_has_text"))
        .otherwise(out("keep_native", kept, "no_visible_recovery_signal"))
    )


def promotes_page(regions: Column, bad: Column, area: Column, bad_area: Column, escalated: Column, full_page: Column) -> Column:
    """Whether a page is read as a whole: asked for, or 60% of its regions and of
    their area are bad."""
    ratios = (bad / F.greatest(regions, F.lit(1)) >= 0.60) & (F.least(F.lit(1.0), bad_area / F.greatest(area, F.lit(1.0))) >= 0.60)
    return full_page | escalated | ratios


# --- roles of lines and regions ---


def decorative_reasons(size: Column, angle: Column, b: G.Box, page: G.Box, typical: Column, light_share: Column, opaque_share: Column) -> Column:
    """Signals of a stamp or watermark; none in the top 12% of the page, and none
    unless independent ones meet. Shares are null where no colour is known."""
    turn = F.pmod(F.coalesce(angle, F.lit(0.0)), F.lit(3.141592653589793))
    rotated = F.least(turn, 3.141592653589793 - turn) > 0.20
    large = F.coalesce(size >= F.greatest(F.lit(24.0), typical * 2.5), F.lit(False))
    broad = (G.width(b) >= G.width(page) * 0.45) & (G.height(b) >= typical * 1.8)
    light = F.coalesce(light_share >= 0.70, F.lit(False))
    translucent = F.coalesce(1 - opaque_share >= 0.70, F.lit(False))
    meets = (rotated & (broad | light | translucent)) | (light & broad & (large | translucent)) | (large & light)
    below = b.y0 > page.y0 + G.height(page) * 0.12
    found = flags({"rotated": rotated, "light_luminance": light, "low_opacity": translucent, "large_font": large, "broad_span": broad})
    return F.when(meets & below, found).otherwise(F.array().cast("array<string>"))


def heading_style(size: Column, bold: Column, typical: Column) -> Column:
    """0 to 3 points for size and weight; a null size gives none."""
    ratio = F.coalesce(size / F.greatest(typical, F.lit(1.0)), F.lit(0.0))
    point = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return point(ratio >= 1.35) + point(bold) + point(ratio >= 1.70)


CAPTION = r"(?U)^(?:figura|fig\.?|gráfico|grafico|imagem|quadro|fonte|nota)\b"
NOTE = r"(?U)^(?:(?:nota|fonte|\*|†|‡|\d+[.)])\b|observação|observacao)"


def line_role(text: Column, folded: Column, b: G.Box, page: G.Box, typical: Column, size: Column, bold: Column, decorative: Column) -> Column:
    """footnote, decorative, caption, title, marginalia or null: the first that fits.
    ``text`` has single spaces; ``folded`` is its case-folded form."""
    # shares of the page as hundredths: 750 * 0.68 lies above 510
    w, h = G.width(page), G.height(page)
    (cx, _), (px, _) = G.center(b), G.center(page)
    own, n = G.height(b), F.length(text)
    footnote = (b.y0 >= page.y0 + h * 68 / 100) & (own <= typical * 1.30) & folded.rlike(NOTE)
    caption = folded.rlike(CAPTION) & (b.y0 > page.y0 + h * 12 / 100) & (n <= 220)
    style = heading_style(size, bold, typical)
    top, centred = b.y0 <= page.y0 + h * 18 / 100, F.abs(cx - px) <= w * 16 / 100
    tall = own >= F.greatest(F.lit(12.0), typical * F.when(top, 1.35).otherwise(1.55))
    sentence = text.rlike(r"[.;:]$") & (n > 45)
    title = text.rlike(r"[\p{L}\p{N}]") & (n <= 140) & (top | centred | (style >= 2)) & (tall | (style >= 2)) & ~sentence
    edge = (b.x0 <= page.x0 + w * 6 / 100) | (b.x1 >= page.x1 - w * 6 / 100)
    margin = (G.width(b) < w * 28 / 100) & edge & (own > F.greatest(F.lit(24.0), G.width(b) * 1.35)) & (F.length(F.trim(text)) <= 80)
    return (
        F.when(footnote, "footnote").when(F.size(decorative) >= 2, "decorative").when(caption, "caption").when(title, "title").when(margin, "marginalia")
    )


LIST_LINE = r"^(?:[•◦▪‣·●○■–—*-]\s+|(?:\d+|[a-zA-Z])[.)]\s+|(?:i{1,3}|iv|vi{0,3}|ix)[.)]\s+)"
REGION_CAPTION = r"(?iU)^(?:figura|figure|fig\.?|tabela|table|tab\.?|quadro|gráfico|graph|chart)\b"


def is_list_line(text: Column) -> Column:
    return F.trim(text).rlike(LIST_LINE)


def is_caption(text: Column, lines: Column) -> Column:
    t = F.trim(text)
    return (lines >= 1) & (lines <= 3) & (F.length(t) <= 200) & t.rlike(REGION_CAPTION)


def reclassify(kind: Column, lines: Column, text: Column, list_ratio: Column, height_ratio: Column, b: G.Box, page_height: Column) -> Column:
    """A region's kind after recognition. Tables and figures and regions without
    recognised lines keep theirs; a null ratio of heights is no evidence."""
    k = F.when(kind == "unknown", "text").otherwise(kind)
    new = (
        F.when(is_caption(text, lines), "caption").when(list_ratio >= 0.5, "list").when(F.coalesce(height_ratio >= 1.3, F.lit(False)), "title")
        .when((page_height > 0) & (b.y0 / page_height < 0.10), "header").when((page_height > 0) & (b.y1 / page_height > 0.90), "footer").otherwise("text")
    )
    return F.when(kind.isin("table", "figure") | (lines == 0), kind).when(k == "text", new).otherwise(k)


NUMBERED = r"^(?:\d+(?:\.\d+)*|[A-Z](?:\.\d+)*)[.)]?\s+"
ACCEPTED = 1.0


def heading_score(text: Column, size: Column, bold: Column, body: Column, p75: Column, tallest: Column, b: G.Box, page: G.Box) -> Column:
    """Additive evidence that a region is a heading; sizes of the body may be null."""
    (cx, _), (px, _) = G.center(b), G.center(page)
    add = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0)
    big = F.coalesce(F.least(F.lit(2.2), F.greatest(F.lit(0.0), (size / body - 1) * 2)), F.lit(0.0))
    score = 0.5 + F.when(body > 0, big).otherwise(0.0) + add(size >= p75, 0.35) + add(bold, 0.45)
    score = score + F.coalesce(F.least(F.lit(0.35), tallest / F.greatest(G.height(b), F.lit(1.0))), F.lit(0.0))
    score = score + add(F.abs(cx - px) <= G.width(page) * 0.16, 0.25) + add(b.y0 <= page.y0 + G.height(page) * 0.20, 0.15)
    foot = (b.y1 >= page.y1 - G.height(page) * 0.15) & ~F.coalesce(bold, F.lit(False)) & ~F.coalesce((body > 0) & (size > body * 1.20), F.lit(False))
    score = score - add(foot, 0.45) + add(F.length(text) <= 90, 0.15) + add(text.rlike(NUMBERED), 0.15)
    first = F.substring(text, 1, 1)
    score = score + add(first.rlike(r"\p{Lu}") & text.rlike(r"\p{Ll}"), 0.05)
    score = score - add((F.length(text) <= 40) & (score < 2.0), 0.25)
    return F.when(text.rlike(r"[\p{L}\p{N}]"), F.greatest(F.lit(0.0), score)).otherwise(0.0)


def heading_accepted(score: Column, text: Column, size: Column, bold: Column, body: Column, p75: Column, threshold: float = ACCEPTED) -> Column:
    signal = (size >= body * 1.15) | F.coalesce(size >= p75 * 1.10, F.lit(False)) | F.coalesce(bold, F.lit(False)) | text.rlike(NUMBERED)
    return (score >= threshold) & (body.isNull() | (body <= 0) | signal)


# --- recogniser quality ---

# The default quality thresholds.
THRESHOLDS = {
    "strong_mean": 0.90, "strong_quartile": 0.78, "max_low": 0.12, "severe_mean": 0.70, "severe_low": 0.35, "printable": 0.90, "low": 0.70, "orientation": 0.75,
}


def quality_reasons(m: dict[str, Column], t: dict[str, float] = THRESHOLDS) -> Column:
    some = m["tokens"] > 0
    return flags({
        "no_tokens": ~some,
        "low_weighted_confidence": m["weighted"] < t["severe_mean"],
        "weak_lower_quartile": m["quartile"] < t["strong_quartile"],
        "low_confidence_characters": m["low_ratio"] > t["max_low"],
        "severely_low_confidence_characters": m["low_ratio"] >= t["severe_low"],
        "low_printable_ratio": m["printable"] < t["printable"],
        "suspicious_tokens": m["suspicious"] > 0.20,
        "control_characters": m["control"] > 0.10,
        "orientation_ratio_below_threshold": some & (m["oriented"] < t["orientation"]),
        "low_recognition_yield": m["yield"] < 0.65,
        "orientation_incoherent": m["incoherent"],
    })


def quality_score(m: dict[str, Column], sufficient: Column) -> Column:
    good = F.least(F.lit(1.0), m["weighted"] + 0.04 * m["printable"] + 0.02 * m["oriented"])
    return F.when(sufficient, good).otherwise(F.greatest(F.lit(0.0), m["weighted"] - 0.12 * m["suspicious"] - 0.08 * m["low_ratio"]))


def candidate_score(m: dict[str, Column]) -> Column:
    """How well a candidate reading stands, from its statistics; see plans.evidence."""
    return (
        m["mean"] + F.least(F.lit(0.08), F.log1p(m["chars"]) * 0.012) + m["horizontal"] * 0.02 + m["quartile"] * 0.05 + m["lexical"] * 0.03
        - m["low"] * 0.15 - m["bad_chars"] * 0.30 - m["duplicates"] * 0.10 - m["invalid"] * 0.40 - m["insertions"] * 0.08
    )


def replaces_upright(tokens: Column, chars: Column, mean: Column, low: Column, score: Column, best: Column) -> Column:
    """Whether a rotated reading may replace the upright one."""
    return (score > best) & (tokens >= 3) & (chars >= 8) & (mean >= 0.40) & (low <= 0.75)


def candidate_family(label: Column) -> Column:
    v = F.lower(label)
    return F.when(v.contains("dbnet"), "dbnet").when(v.contains("direct"), "direct_recognition").when(v.contains("wordbeam") | v.contains("beamsearch"), "craft_beam").otherwise("craft_greedy")


def page_status(failed: Column, outcome: Column, partial: Column, content: Column, added: Column) -> Column:
    """struct(content, stability) of a page: the first rule that matches."""
    out = lambda a, b: F.struct(F.lit(a).alias("content"), F.lit(b).alias("stability"))
    return (
        F.when(failed | F.coalesce(outcome.isin("failed", "runtime_error"), F.lit(False)), out("invalid", "failed")).when(partial, out("degraded", "degraded"))
        .when((outcome == "recovered") & content, out("ok", "recovered")).when(outcome.isin("degraded", "partial"), out("degraded", "degraded"))
        .when(~content & (added == 0), out("empty", "unknown")).otherwise(out("ok", "clean"))
    )


def document_status(status: Column, failed: Column, degraded: Column) -> Column:
    return F.when((status == "failure") | (failed > 0), "invalid").when((degraded > 0) | (status == "partial_success"), "partial").otherwise("valid")


def lexical_plausibility(text: Column) -> tuple[Column, Column]:
    """(plausible, neutral) of one token: mostly letters, two at least and hardly
    garbled; tokens with digits and no letters, and blank ones, are neutral."""
    s = F.trim(text)
    letters, digits = F.regexp_count(s, F.lit(r"\p{L}")), F.regexp_count(s, F.lit(r"\p{Nd}"))
    neutral = (s == "") | ((digits > 0) & (letters == 0))
    garbled = F.regexp_count(s, F.lit("�")) > 1
    return ~neutral & ~garbled & (letters >= 2) & (letters / F.greatest(F.length(s), F.lit(1)) >= 0.5), neutral
