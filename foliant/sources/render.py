"""Sinks: documents as Markdown, HTML tables, text and JSON. Every step is an
expression or an ordered aggregate, so documents are rendered where they lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXTS = ("paragraph", "heading", "list", "table")


def escape(t: Column, context: str = "paragraph") -> Column:
    """Markdown marks escaped where literal text could change the structure, line
    by line. A mark that only counts at the start of a line (#, -, +, the end of
    a number) is escaped throughout a line that starts with it."""
    if context not in CONTEXTS:
        raise ValueError(f"unknown context {context!r}")
    always = r"\\`*_\[\]<>!" + ("|" if context == "table" else "")
    prefix = lambda c, chars: F.regexp_replace(c, f"([{chars}])", r"\\$1")

    def line(x: Column) -> Column:
        lead = F.regexp_extract(x, r"(?U)^\s*", 0)
        body = F.substring(x, F.length(lead) + 1, F.length(x))
        out = prefix(body, always)
        if context in ("heading", "paragraph", "list"):
            out = F.when(body.startswith("#"), prefix(out, "#")).otherwise(out)
        if context in ("paragraph", "list"):
            number = F.regexp_extract(body, r"(?U)^\d\S*([.)])(?:\s|$)", 1)
            long = F.length(body) > 1
            out = (
                F.when(body.startswith("- "), prefix(out, r"\-")).when(body.startswith("+ "), prefix(out, "+"))
                .when(long & (number == "."), prefix(out, ".")).when(long & (number == ")"), prefix(out, ")")).otherwise(out)
            )
        return F.concat(lead, out)

    return F.array_join(F.transform(F.split(t, "\n"), line), "\n")


def escape_html(t: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def _breaks(t: Column) -> Column:
    return F.replace(F.replace(t, F.lit("\r\n"), F.lit("<br>")), F.lit("\n"), F.lit("<br>"))


def render_tables(tables: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, table_id, md.

    ``tables`` has row_count, column_count and header_rows (array); ``cells`` row,
    col, rowspan, colspan and text. A table whose only header is its first row
    and that has no spans is a pipe table, any other HTML. Tables without cells
    or columns, and pipe tables without any text, have an empty md."""
    at = [*keys, "table_id"]
    c = cells.select(*at, "row", "col", "rowspan", "colspan", "text")
    facts = c.groupBy(*at).agg(F.max("row").alias("_last"), F.bool_or((F.col("rowspan") > 1) | (F.col("colspan") > 1)).alias("_spans"))
    t = tables.select(*at, "row_count", "column_count", "header_rows").join(facts, at, "left")
    plain = ~F.col("_spans") & (F.col("header_rows") == F.array(F.lit(0)))
    t = t.withColumns({"_rows": F.greatest("row_count", F.col("_last") + 1), "_plain": plain})
    shape = t.select(*at, "_rows", "_plain", "column_count", "header_rows")
    inside = c.join(shape, at).where((F.col("row") >= 0) & (F.col("row") < F.col("_rows")))

    # of cells at one place the last in the order of their texts stays
    grid = inside.where(F.col("_plain") & (F.col("col") >= 0) & (F.col("col") < F.col("column_count")))
    grid = grid.groupBy(*at, "row", "col").agg(F.max(_breaks(escape(F.col("text"), "table"))).alias("v"))
    rows = grid.groupBy(*at, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "v"))).alias("m"))
    full = shape.where("_plain AND column_count > 0").withColumn("row", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1)))
    line = F.transform(F.sequence(F.lit(0), F.col("column_count") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("")))
    bar = lambda parts: F.concat(F.lit("| "), F.array_join(parts, " | "), F.lit(" |"))
    rule = bar(F.array_repeat(F.lit("---"), F.col("column_count")))
    lined = full.join(rows, [*at, "row"], "left").withColumn("_line", F.when(F.col("row") == 0, F.concat(bar(line), F.lit("\n"), rule)).otherwise(bar(line)))
    pipe = lined.groupBy(*at).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "_line"))), lambda x: x["_line"]), "\n").alias("md"),
        F.bool_or(F.exists(line, lambda v: v != "")).alias("_any"))
    pipe = pipe.select(*at, F.when(F.col("_any"), F.col("md")).otherwise("").alias("md"))

    html = inside.where("NOT _plain")
    tag = F.when(F.array_contains("header_rows", F.col("row")), "th").otherwise("td")
    span = lambda name: F.when(F.col(name) > 1, F.concat(F.lit(f' {name}="'), F.col(name).cast("string"), F.lit('"'))).otherwise("")
    cell = F.concat(F.lit("<"), tag, span("rowspan"), span("colspan"), F.lit(">"), F.replace(escape_html(F.col("text")), F.lit("\n"), F.lit("<br>")), F.lit("</"), tag, F.lit(">"))
    rows = html.withColumn("_cell", cell).groupBy(*at, "row").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "_cell"))), lambda x: x["_cell"]), "\n    ").alias("_cells"))
    full = shape.where("NOT _plain AND column_count > 0").withColumn("row", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1)))
    lined = full.join(rows, [*at, "row"], "left").withColumn("_line", F.concat(F.lit("  <tr>\n    "), F.coalesce("_cells", F.lit("")), F.lit("\n  </tr>")))
    spanned = lined.groupBy(*at).agg(
        F.concat(F.lit("<table>\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "_line"))), lambda x: x["_line"]), "\n"), F.lit("\n</table>")).alias("md"))
    done = pipe.unionByName(spanned)
    return tables.select(*at).join(done, at, "left").withColumn("md", F.coalesce("md", F.lit("")))


def block_markdown(preserve_furniture: Column, table_md: Column) -> Column:
    """A content block's Markdown, empty where it shows nothing. Blocks have kind,
    text, heading_level, line_ids, list_items (level, marker, text) and suppressed."""
    k, t = F.col("kind"), F.coalesce("text", F.lit(""))
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(F.nullif("heading_level", F.lit(0)), F.lit(1))))
    item = lambda x: F.concat(F.repeat(F.lit("  "), F.greatest(F.lit(0), x.level)), x.marker, F.lit(" "), escape(x.text, "list"))
    furniture = k.isin("header", "footer")
    return (
        F.when(F.coalesce("suppressed", F.lit(False)), "")
        .when(furniture & ~preserve_furniture & (F.coalesce(F.size("line_ids"), F.lit(0)) <= 0), "")
        .when(furniture, escape(t))
        .when((k == "title") & (t == ""), "")
        .when(k == "title", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), escape(t, "heading")))
        .when((k == "list") & (F.size("list_items") > 0), F.array_join(F.transform("list_items", item), "\n"))
        .when(k == "table", F.coalesce(table_md, F.lit("")))
        .otherwise(escape(t))
    )


def render_markdown(
    pages: DataFrame, blocks: DataFrame, tables: DataFrame, cells: DataFrame, regions: DataFrame | None = None, diagnostic: bool = False
) -> DataFrame:
    """doc_id, markdown.

    ``pages`` has doc_id, page_index and preserve_furniture. Blocks come in the
    order of order_index, two line ends apart. A page without blocks shows its
    ``regions`` (region_index, kind, heading_level, lines), then its tables. In
    the diagnostic form every page opens with its heading."""
    key = ["doc_id", "page_index"]
    md = render_tables(tables, cells, key)
    own = blocks.join(pages, key).join(md.select(*key, "table_id", "md"), [*key, "table_id"], "left")
    parts = own.select(*key, F.col("order_index").alias("n"), block_markdown(F.col("preserve_furniture"), F.col("md")).alias("part"))
    bare = pages.join(blocks.select(*key).distinct(), key, "left_anti").select(*key)
    if regions is not None:
        lines = F.filter(F.transform("lines", lambda x: F.rtrim(x)), lambda x: F.trim(x) != "")
        title = (F.col("kind") == "title") & F.col("heading_level").isNotNull()
        body = F.when(title, F.concat(F.repeat(F.lit("#"), F.coalesce("heading_level", F.lit(1))), F.lit(" "), escape(F.array_join(F.transform(lines, lambda x: F.trim(x)), " "), "heading")))
        body = F.when(F.size(lines) == 0, "").otherwise(F.coalesce(body, F.when(F.col("kind") == "table", F.trim(F.array_join(lines, "\n"))).otherwise(escape(F.trim(F.array_join(lines, "\n"))))))
        parts = parts.unionByName(regions.join(bare, key, "left_semi").select(*key, F.col("region_index").alias("n"), body.alias("part")))
    ranked = md.join(bare, key, "left_semi").select(*key, (F.lit(1 << 30) + F.dense_rank().over(_by(key, "table_id"))).cast("int").alias("n"), F.col("md").alias("part"))
    parts = parts.unionByName(ranked).where("part <> ''")
    joined = lambda order, part: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, part))), lambda x: x[part]), "\n\n")
    page = pages.select(*key).join(parts.groupBy(*key).agg(joined("n", "part").alias("body")), key, "left")
    if diagnostic:
        head = F.concat(F.lit("## Página "), (F.col("page_index") + 1).cast("string"))
        page = page.withColumn("body", F.concat_ws("\n\n", head, "body"))
    page = page.withColumn("body", F.coalesce("body", F.lit("")))
    return page.groupBy("doc_id").agg(F.regexp_replace(joined("page_index", "body"), r"(?U)^\s+|\s+$", "").alias("markdown"))


def _by(keys: list[str], *order: str):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(*order)


def text_view(documents: DataFrame, view: str = "reading") -> DataFrame:
    """doc_id, text of the raw or the reading view."""
    if view not in ("raw", "reading"):
        raise ValueError(f"unknown view {view!r}")
    return documents.select("doc_id", F.col(f"{view}_text").alias("text"))


def to_json(value: Column, sets: dict[str, Column] | None = None) -> Column:
    """JSON of a struct with nulls kept; named sets are added as sorted arrays."""
    for name, c in (sets or {}).items():
        value = value.withField(name, F.array_sort(F.array_distinct(c)))
    return F.to_json(value, {"ignoreNullFields": "false"})


def page_report(pages: DataFrame) -> DataFrame:
    """doc_id, report: a line a page with its strategy, counts, reasons and status."""
    line = F.format_string(
        "page %d: %s, %d chars, %d regions, %d tables%s%s",
        F.col("page_index") + 1, F.coalesce("strategy", F.lit("unknown")), F.coalesce("char_count", F.lit(0)), F.coalesce("region_count", F.lit(0)), F.coalesce("table_count", F.lit(0)),
        F.when(F.size("reasons") > 0, F.concat(F.lit(" ["), F.array_join(F.array_sort("reasons"), ", "), F.lit("]"))).otherwise(""),
        F.when(F.col("status") == "success", "").otherwise(F.concat(F.lit(" "), F.coalesce(F.upper("status"), F.lit("UNKNOWN")))))
    return pages.select("doc_id", "page_index", line.alias("line")).groupBy("doc_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_index", "line"))), lambda x: x.line), "\n").alias("report"))
