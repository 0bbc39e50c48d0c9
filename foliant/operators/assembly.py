"""Assembly of documents: repeated furniture, the ledger of lines, headers of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F



def furniture(lines: DataFrame) -> DataFrame:
    """doc_id, key, pages: headers and footers that are furniture.

    ``lines`` has doc_id, page, line_index, role, signature, cy, edge (distance from
    the nearer edge) and height of the page, size, font and weight. A signature must
    stand on two pages or more, near the edge, at one height, in one style; unknown
    styles agree with any. Of a page the first line counts; partial aggregates meet, so
    a footer on every page of a corpus is one row per task before the shuffle."""
    keyed = lines.where("signature IS NOT NULL").withColumn("key", F.concat("role", F.lit(":"), "signature"))
    first = keyed.groupBy("doc_id", "key", "page").agg(F.min_by(F.struct("cy", "edge", "height", "size", "font", "weight"), "line_index").alias("x"))
    h = F.greatest(F.col("x.height"), F.lit(1.0))
    size = F.when(F.col("x.size") > 0, F.col("x.size"))
    found = first.groupBy("doc_id", "key").agg(
        F.count(F.lit(1)).alias("pages"), F.max(F.col("x.edge") / h).alias("far"), (F.max(F.col("x.cy") / h) - F.min(F.col("x.cy") / h)).alias("spread"),
        (F.max(size) / F.greatest(F.min(size), F.lit(0.01))).alias("ratio"), F.countDistinct(F.lower("x.font")).alias("fonts"), (F.max("x.weight") - F.min("x.weight")).alias("weights"))
    stable = (F.col("far") <= 0.08) & (F.col("spread") <= 0.035) & (F.coalesce("ratio", F.lit(1.0)) <= 1.35) & (F.col("fonts") <= 1) & (F.coalesce("weights", F.lit(0)) <= 200)
    return found.where((F.col("pages") >= 2) & stable).select("doc_id", "key", "pages")


def suppressed_blocks(blocks: DataFrame, lines: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, block_id, role of the blocks all of whose lines are furniture of one role."""
    keyed = lines.withColumn("key", F.concat("role", F.lit(":"), "signature"))
    hits = keyed.join(known.select("doc_id", "key", F.lit(True).alias("_hit")), ["doc_id", "key"], "left")
    met = blocks.select("doc_id", "block_id", F.explode("line_ids").alias("line_id")).join(hits.select("doc_id", "line_id", "role", "_hit"), ["doc_id", "line_id"], "left")
    g = met.groupBy("doc_id", "block_id").agg(F.bool_and(F.coalesce("_hit", F.lit(False))).alias("all"), F.countDistinct("role").alias("roles"), F.min("role").alias("role"))
    return g.where(F.col("all") & (F.col("roles") == 1)).select("doc_id", "block_id", "role")


def edge_bands(lines: DataFrame, keys: list[str], page_height: Column) -> DataFrame:
    """Lines with ``band``: header, footer or null, by the distance to the page's edges:
    6% of its height, between 24 and 48 points."""
    near = F.greatest(F.lit(24.0), F.least(F.lit(48.0), page_height * 0.06))
    band = F.when(F.col("y0") <= near, "header").when(F.col("y1") >= page_height - near, "footer")
    return lines.select(*keys, "y0", "y1", band.alias("band"))


#: Who owns a line that several blocks claim: the greater wins, then the earlier block.
PRIORITY = {"table": 300, "list": 250, "title": 200, "paragraph": 100}


def accepted_lines(lines: DataFrame, page: list[str]) -> DataFrame:
    """Distinct line ids of each page without those that another line has merged."""
    merged = lines.select(*page, "line_id", F.explode("merged_ids").alias("_m")).where("_m <> line_id").select(*page, F.col("_m").alias("line_id")).distinct()
    first = lines.groupBy(*page, "line_id").agg(F.min("line_order").alias("line_order"))
    return first.join(merged, [*page, "line_id"], "left_anti")


def ledger(lines: DataFrame, claims: DataFrame, page: list[str]) -> DataFrame:
    """page, line_id, line_order, disposition, block_id: every accepted line once.

    ``claims`` has page, line_id, block_id, block_order, kind and suppressed (the reason
    or null). A line with several claims goes to the one of the highest priority, then
    to the first block; a line without any is unaccounted and needs a fallback."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in PRIORITY.items() for x in p]), F.col("kind")), F.lit(50))
    w = W.partitionBy(*page, "line_id").orderBy(rank.desc(), "block_order", "block_id")
    won = claims.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    d = F.when(F.col("block_id").isNull(), "unaccounted").when(F.col("suppressed").isNotNull(), F.concat(F.lit("suppressed_"), "suppressed")).when(F.col("kind") == "table", "table_owned").when(F.col("kind") == "figure", "figure_owned").otherwise("rendered")
    return accepted_lines(lines, page).join(won, [*page, "line_id"], "left").select(*page, "line_id", "line_order", d.alias("disposition"), "block_id")


def header_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, has_header: the first row is one if at least 60% of its cells are mostly
    bold, or its median size is 1.15 times that of the rows below.

    ``cells`` has row, text, bold_tokens, tokens and sizes (array). Tables of one row
    and those without text in or below the first row have none."""
    shown = F.trim("text") != ""
    head, below = shown & (F.col("row") == 0), shown & (F.col("row") > 0)
    bold = (F.col("tokens") > 0) & (F.col("bold_tokens") >= F.greatest(F.lit(1), F.floor(F.col("tokens") / 2)))
    g = cells.groupBy(*keys).agg(F.countDistinct("row").alias("rows"), F.count_if(head).alias("n"), F.count_if(below).alias("m"), F.count_if(head & bold).alias("b"))
    sized = cells.where(shown).select(*keys, (F.col("row") == 0).alias("_h"), F.explode("sizes").alias("_s")).groupBy(*keys).agg(
        F.median(F.when(F.col("_h"), F.col("_s"))).alias("hs"), F.median(F.when(~F.col("_h"), F.col("_s"))).alias("bs"))
    j = g.join(sized, keys, "left")
    has = (F.col("b") / F.col("n") >= 0.6) | F.coalesce(F.col("hs") >= F.col("bs") * 1.15, F.lit(False))
    return j.select(*keys, F.coalesce((F.col("rows") >= 2) & (F.col("n") > 0) & (F.col("m") > 0) & has, F.lit(False)).alias("has_header"))


TRACK_RULES = {"recurrence": 0.58, "consistency": 0.58, "prose": 0.40, "code": 0.60}


def text_tracks(rows: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Whether runs of lines are tables without rules.

    ``rows`` has keys, row, text, code (whether it is source code); ``cells`` keys, row,
    col, columns (number of tracks) and text. Statistics, reasons and confidence."""
    per_row = cells.groupBy(*keys, "row", "columns").agg(F.countDistinct("col").alias("_filled"))
    shape = per_row.groupBy(*keys).agg(F.max("columns").alias("column_count"), F.sum("_filled").alias("_filled"), F.sum(F.abs(F.col("_filled") - F.col("columns")) / F.greatest("columns", F.lit(1))).alias("_off"))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    c = cells.groupBy(*keys).agg(
        F.avg(F.when(F.col("col") > 0, F.col("text").rlike(r"\p{Nd}").cast("double"))).alias("numeric"), F.avg(((words >= 5) | (F.length("text") >= 48)).cast("double")).alias("_long"))
    r = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), F.avg(F.rtrim("text").rlike(r"[.!?;]\z").cast("double")).alias("_sentence"), F.avg(F.col("code").cast("double")).alias("code_score"))
    j = r.join(shape, keys).join(c, keys)
    recurrence = F.col("_filled") / (F.col("row_count") * F.greatest("column_count", F.lit(1)))
    consistency = 1 - F.col("_off") / F.col("row_count")
    j = j.withColumns({"track_recurrence": recurrence, "row_consistency": consistency, "numeric_cell_ratio": F.coalesce("numeric", F.lit(0.0)), "prose_score": F.least(F.lit(1.0), F.col("_sentence") * 0.6 + F.col("_long") * 0.8)})
    t = TRACK_RULES
    reasons = F.array_compact(F.array(
        F.when(F.col("row_count") < 3, "fewer_than_three_rows"), F.when(F.col("column_count") < 2, "fewer_than_two_tracks"), F.when(F.col("track_recurrence") < t["recurrence"], "x_tracks_not_recurrent"),
        F.when(F.col("row_consistency") < t["consistency"], "row_shape_inconsistent"), F.when(F.col("prose_score") >= t["prose"], "continuous_prose_signal"), F.when(F.col("code_score") >= t["code"], "code_layout_signal")))
    confidence = (
        0.34 * F.col("track_recurrence") + 0.30 * F.col("row_consistency") + 0.18 * F.least(F.lit(1.0), F.col("row_count") / 5) + 0.10 * F.least(F.lit(1.0), F.col("column_count") / 4)
        + 0.08 * F.col("numeric_cell_ratio") - 0.25 * F.col("prose_score") - 0.30 * F.col("code_score")
    )
    return j.select(
        *keys, "row_count", "column_count", "track_recurrence", "row_consistency", "numeric_cell_ratio", "prose_score", "code_score", reasons.alias("reject_reasons"), (F.size(reasons) == 0).alias("accepted"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("confidence"))


def shared_orientation(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rotation: the one rotation all recognised lines of a page share if it is
    not zero and the page has no native lines, else null."""
    g = lines.groupBy(*keys).agg(F.countDistinct("rotation").alias("_n"), F.min("rotation").alias("_r"), F.bool_or("native").alias("_native"))
    return g.select(*keys, F.when((F.col("_n") == 1) & (F.col("_r") != 0) & ~F.col("_native"), F.col("_r")).alias("rotation"))
