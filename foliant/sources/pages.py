"""Markdown documents and manifests as one row per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: A page heading; the strict form has a bar after the number.
HEADING = r"##\s+P[áa]gina\s+0*(\d+)"
STRICT = HEADING + r"\s*\|"


def strip(t: Column) -> Column:
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def split_pages(df: DataFrame, keys: list[str], text: str = "text", heading: str = HEADING) -> DataFrame:
    """keys, page, body: one row per page number of each document.

    A page runs from its heading to the next one. Of repeated numbers the last
    wins. Text before the first heading and null texts give no page."""
    parts = F.split(F.col(text), rf"(?imu)(?=^{heading})")
    rows = df.select(*keys, F.posexplode(parts).alias("_pos", "_part"))
    number = F.regexp_extract("_part", rf"(?iu)^{heading}", 1)
    rows = rows.where(number != "").select(*keys, number.cast("int").alias("page"), "_pos", "_part")
    return rows.groupBy(*keys, "page").agg(strip(F.max_by("_part", "_pos")).alias("body"))


def page_body(section: Column) -> Column:
    """A section without its heading line."""
    return strip(F.regexp_replace(section, r"(?iu)^##\s+P[áa]gina\s+[^\n]*\n?", ""))


def reference_pages(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Pages with a strict heading as plain reading text."""
    pages = split_pages(df, keys, text, STRICT)
    return pages.select(*keys, "page", T.strip_markdown(F.col("body")).alias("body"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """page, expected_markdown of JSON manifests. A missing text is empty; an
    explicit null, like a null page number, gives no row; of repeated pages of
    one file the last stays."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    entries = F.from_json(F.get_json_object("value", "$.pages"), "array<map<string,string>>")
    rows = whole.select("file", F.posexplode(entries).alias("pos", "e"))
    page = F.try_element_at("e", F.lit("page")).try_cast("int")
    given = F.map_contains_key("e", F.lit("expected_markdown"))
    body = F.when(~given, F.lit("")).otherwise(F.try_element_at("e", F.lit("expected_markdown")))
    rows = rows.select("file", page.alias("page"), "pos", body.alias("body")).where("page IS NOT NULL AND body IS NOT NULL")
    return rows.groupBy("file", "page").agg(F.max_by("body", "pos").alias("expected_markdown")).select("page", "expected_markdown")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; lines that can't be decoded, such as a last one half
    written, are passed over."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def select_pages(pages: DataFrame, wanted: list[int] | None, column: str = "page") -> DataFrame:
    """Only the wanted pages, as a filter that reaches the scan."""
    return pages if wanted is None else pages.where(F.col(column).isin([int(p) for p in wanted]))
