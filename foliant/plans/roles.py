"""Roles of lines and regions, sources of authority, error classes, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cascades as C
from ..functions import geometry as G
from ..functions import text as T
from .base import table
from .evidence import PAGE, PAGES, evidence
from .registry import query

#: A line's text opens with a mark of its role, its style follows from its number.
LINES = f"""{PAGES}, l AS (SELECT pg, bid, x0, y0, x1, y1, CASE bid % 6 WHEN 0 THEN 'Fonte ' WHEN 1 THEN '3) ' WHEN 2 THEN 'Figura ' WHEN 3 THEN '• ' ELSE '' END || text AS text,
  CAST(8 + bid % 20 AS DOUBLE) AS size, bid % 4 = 0 AS bold, CASE bid % 10 WHEN 0 THEN 0.5 ELSE 0 END AS angle, CASE bid % 3 WHEN 0 THEN 0.9 ELSE 0.1 END AS light FROM e)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("bid")
    mark = F.when(n % 6 == 0, "Fonte ").when(n % 6 == 1, "3) ").when(n % 6 == 2, "Figura ").when(n % 6 == 3, "• ").otherwise("")
    return evidence(spark, sf_dir).select(
        "pg", "bid", "x0", "y0", "x1", "y1", F.concat(mark, F.col("text")).alias("text"), (8 + n % 20).cast("double").alias("size"), (n % 4 == 0).alias("bold"),
        F.when(n % 10 == 0, 0.5).otherwise(0.0).alias("angle"), F.when(n % 3 == 0, 0.9).otherwise(0.1).alias("light"))


@query(
    "p12_p13_line_roles",
    f"""WITH {LINES}, f AS (SELECT *, angle > 0.2 AS rot, size >= 25 AS large, x1 - x0 >= 247.5 AND y1 - y0 >= 18 AS broad, light >= 0.7 AS li, CAST(size >= 13.5 AS INTEGER) + CAST(bold AS INTEGER) + CAST(size >= 17 AS INTEGER) AS style FROM l),
    r AS (SELECT *, CASE WHEN y0 > 90 AND ((rot AND (broad OR li)) OR (li AND broad AND large) OR (large AND li)) THEN CAST(rot AS INTEGER) + CAST(li AS INTEGER) + CAST(large AS INTEGER) + CAST(broad AS INTEGER) ELSE 0 END AS deco FROM f)
    SELECT pg, bid, CASE WHEN y0 >= 510 AND y1 - y0 <= 13 AND regexp_matches(lower(text), '^(?:(?:nota|fonte)\\b|\\d+[.)]\\b)') THEN 'footnote' WHEN deco >= 2 THEN 'decorative' WHEN regexp_matches(lower(text), '^(?:figura|fonte)\\b') AND y0 > 90 THEN 'caption'
      WHEN regexp_matches(text, '[\\p{{L}}\\p{{N}}]') AND (y0 <= 135 OR abs((x0 + x1) / 2 - 275) <= 88 OR style >= 2) AND (y1 - y0 >= greatest(12, 10 * CASE WHEN y0 <= 135 THEN 1.35 ELSE 1.55 END) OR style >= 2) THEN 'title'
      WHEN x1 - x0 < 154 AND (x0 <= 33 OR x1 >= 517) AND y1 - y0 > greatest(24, (x1 - x0) * 1.35) THEN 'marginalia' END AS role, deco FROM r""",
)
def line_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, page, typical = G.box(), G.lit_box(*PAGE), F.lit(10.0)
    d = C.decorative_reasons(F.col("size"), F.col("angle"), b, page, typical, F.col("light"), F.lit(1.0))
    r = lines(spark, sf_dir).withColumn("d", d)
    role = C.line_role(F.col("text"), T.casefold("text"), b, page, typical, F.col("size"), F.col("bold"), F.col("d"))
    return r.select("pg", "bid", role.alias("role"), F.size("d").alias("deco"))


@query(
    "p14_f14_reclassify",
    f"""WITH {LINES}, r AS (SELECT *, CASE bid % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'table' WHEN 2 THEN 'text' ELSE 'title' END AS kind, bid % 5 AS lines, 1 + (bid % 5) / 10.0 AS ratio, CAST(regexp_matches(text, '^(?:[•*-]\\s+|(?:\\d+|[a-zA-Z])[.)]\\s+)') AS INTEGER) AS li FROM l)
    SELECT pg, bid, CASE WHEN kind = 'table' OR lines = 0 THEN kind WHEN kind = 'title' THEN kind WHEN lines <= 3 AND regexp_matches(lower(text), '^(?:figura|figure|fig)\\b') THEN 'caption' WHEN li >= 0.5 THEN 'list' WHEN ratio >= 1.3 THEN 'title'
      WHEN y0 / 750 < 0.1 THEN 'header' WHEN y1 / 750 > 0.9 THEN 'footer' ELSE 'text' END AS kind FROM r""",
)
def reclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("bid")
    kind = F.when(n % 4 == 0, "unknown").when(n % 4 == 1, "table").when(n % 4 == 2, "text").otherwise("title")
    k = C.reclassify(kind, n % 5, F.col("text"), C.is_list_line(F.col("text")).cast("double"), 1 + (n % 5) / 10, G.box(), F.lit(750.0))
    return lines(spark, sf_dir).select("pg", "bid", k.alias("kind"))


@query(
    "p15_heading_scores",
    f"""WITH {LINES}, s AS (SELECT *, 0.5 + least(2.2, greatest(0, (size / 10 - 1) * 2)) + CASE WHEN size >= 14 THEN 0.35 ELSE 0 END + CASE WHEN bold THEN 0.45 ELSE 0 END + least(0.35, (y1 - y0) / greatest(y1 - y0, 1)) + CASE WHEN abs((x0 + x1) / 2 - 275) <= 88 THEN 0.25 ELSE 0 END
      + CASE WHEN y0 <= 150 THEN 0.15 ELSE 0 END - CASE WHEN y1 >= 637.5 AND NOT bold AND size <= 12 THEN 0.45 ELSE 0 END + 0.15 + CASE WHEN regexp_matches(text, '^(?:\\d+(?:\\.\\d+)*|[A-Z](?:\\.\\d+)*)[.)]?\\s+') THEN 0.15 ELSE 0 END
      + CASE WHEN regexp_matches(text, '^\\p{{Lu}}') AND regexp_matches(text, '\\p{{Ll}}') THEN 0.05 ELSE 0 END AS raw FROM l),
    t AS (SELECT *, greatest(0, raw - CASE WHEN raw < 2 THEN 0.25 ELSE 0 END) AS score FROM s)
    SELECT pg, bid, round(score, 6) AS score, score >= 1 AND (size >= 11.5 OR size >= 15.4 OR bold OR regexp_matches(text, '^(?:\\d+(?:\\.\\d+)*|[A-Z](?:\\.\\d+)*)[.)]?\\s+')) AS accepted FROM t""",
)
def heading_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, t, size, bold, body, p75 = G.box(), F.col("text"), F.col("size"), F.col("bold"), F.lit(10.0), F.lit(14.0)
    score = C.heading_score(t, size, bold, body, p75, G.height(b), b, G.lit_box(*PAGE))
    r = lines(spark, sf_dir).withColumn("score", score)
    return r.select("pg", "bid", F.round("score", 6).alias("score"), C.heading_accepted(F.col("score"), t, size, bold, body, p75).alias("accepted"))


def ocr_is_primary(requested: Column, native_lines: Column, ocr_lines: Column, native_chars: Column, mode: Column) -> Column:
    """Whether recognition replaces the native text of a page: it was asked for and
    gave lines, and it was forced or the native layer has under 20 characters."""
    return requested & (ocr_lines > 0) & ((mode == "ocr") | (native_lines == 0) | (native_chars < 20))


def is_raster_primary(images: Column, largest: Column, native: Column) -> Column:
    return (images >= 0.75) & (largest >= 0.75) & (native <= 200)


def keep_tokens(text: Column, confidence: Column, goal: Column, least: Column) -> Column:
    """Whether a token serves a goal; a null confidence always suffices."""
    t = F.trim(text)
    sure = (t != "") & (confidence.isNull() | (confidence >= least))
    fits = F.when(goal == "numeric", t.rlike(r"\p{Nd}|%")).when(goal == "textual", (F.length(t) >= 2) & t.rlike(r"\p{L}")).otherwise(True)
    return sure & fits


def renderable(rows: Column, columns: Column, texts: Column) -> Column:
    """Whether a table shows anything: it has rows and columns and a text that is not blank."""
    return (rows > 0) & (columns > 0) & F.coalesce(F.exists(texts, lambda t: F.trim(t) != ""), F.lit(False))


def hides_decoration(role: Column) -> Column:
    """A watermark is only hidden if it stands at an unusual angle and is faint or large.
    ``role`` is decorative_watermark: and its reasons, or any other role."""
    reasons = F.split(F.regexp_extract(role, r"^decorative_watermark:(.*)$", 1), ",")
    faint = F.arrays_overlap(reasons, F.array(F.lit("low_opacity"), F.lit("large_font")))
    return F.coalesce(F.array_contains(reasons, "unusual_angle") & faint, F.lit(False))


@query(
    "p18_shown_tables",
    """WITH c AS (SELECT l_orderkey AS pg, max(l_linenumber) AS rows, bool_or(l_returnflag = 'R') AS shows, min(l_suppkey % 5) AS k FROM lineitem GROUP BY l_orderkey)
    SELECT pg, shows AND k > 0 AS shown, k IN (2, 3) AS hidden FROM c""",
)
def shown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with something to show, and watermarks that may be hidden."""
    text = F.when(F.col("l_returnflag") == "R", "x").otherwise("  ")
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pg")).agg(F.max("l_linenumber").alias("rows"), F.collect_set(text).alias("texts"), F.min(F.col("l_suppkey") % 5).cast("int").alias("k"))
    roles = [None, "decorative_watermark:unusual_angle", "decorative_watermark:unusual_angle,low_opacity", "decorative_watermark:large_font,unusual_angle", "stamp:unusual_angle,low_opacity"]
    role = F.get(F.array(*[F.lit(r).cast("string") for r in roles]), F.col("k"))
    return c.select("pg", renderable(F.col("rows"), F.col("k"), F.col("texts")).alias("shown"), hides_decoration(role).alias("hidden"))


# What messages of exhausted resources say.
EXHAUSTED = ["not enough memory", "out of memory", "memory allocation failed", "std::bad_alloc", "bad allocation", "error code is 12", "errno 12", "cuda out of memory"]


def exhausted(chain: Column) -> Column:
    """Whether any error of a chain (array of type, errno, message) tells of exhausted
    resources."""
    words = "|".join(w.replace(".", r"\.") for w in EXHAUSTED)
    return F.exists(chain, lambda e: (e.type == "MemoryError") | ((e.type == "OSError") & (F.coalesce(e.errno, F.lit(0)) == 12)) | F.lower(e.type).contains("resourceexhausted") | F.lower(e.message).rlike(words))


@query(
    "p11_p17_p20_predicates",
    """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 3 AS m FROM orders)
    SELECT k, c % 4 <> 0 AND k % 5 > 0 AND (m = 0 OR k % 2 = 0 OR c % 40 < 20) AS ocr_primary, (c % 100) / 100.0 >= 0.75 AND (k % 100) / 100.0 >= 0.75 AND c % 400 <= 200 AS raster_primary,
      (c % 10) / 10.0 >= 0.5 AND CASE m WHEN 0 THEN k % 2 = 0 WHEN 1 THEN k % 2 = 1 ELSE TRUE END AS kept, k % 7 = 0 OR k % 11 = 0 AS exhausted FROM o""",
)
def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authority of sources, goals of tokens, and errors that end a run."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    mode = F.when(k % 3 == 0, "ocr").otherwise("hybrid")
    primary = ocr_is_primary(c % 4 != 0, k % 2, k % 5, c % 40, mode)
    token, goal = F.when(k % 2 == 0, " 12 % ").otherwise("ab"), F.when(k % 3 == 0, "numeric").when(k % 3 == 1, "textual").otherwise("any")
    error = lambda kind, errno, message: F.struct(F.lit(kind).alias("type"), F.lit(errno).cast("int").alias("errno"), message.alias("message"))
    chain = F.array(error("ValueError", None, F.lit("bad page")), error("RuntimeError", None, F.when(k % 7 == 0, "CUDA Out Of Memory, tried").otherwise("no")), F.when(k % 11 == 0, error("OSError", 12, F.lit(""))).otherwise(error("OSError", 2, F.lit(""))))
    return table(spark, sf_dir, "orders").select(
        k.alias("k"), primary.alias("ocr_primary"), is_raster_primary((c % 100) / 100, (k % 100) / 100, c % 400).alias("raster_primary"), keep_tokens(token, (c % 10) / 10, goal, F.lit(0.5)).alias("kept"), exhausted(chain).alias("exhausted"))


# Thresholds by family of recognisers.
FAMILIES = {
    "paddle": C.THRESHOLDS,
    "easyocr": C.THRESHOLDS | {"strong_mean": 0.82, "strong_quartile": 0.65, "max_low": 0.20, "severe_mean": 0.55, "severe_low": 0.45, "low": 0.60},
}
NEUTRAL = C.THRESHOLDS | {"strong_mean": 0.0, "strong_quartile": 0.0, "max_low": 1.0, "severe_mean": 0.0, "severe_low": 1.0, "low": 0.0}


def thresholds(engine: Column) -> Column:
    """struct of thresholds of a recogniser; those of confidence are neutral for families without calibration."""
    pick = lambda name: F.when(engine == "paddle", FAMILIES["paddle"][name]).when(engine == "easyocr", FAMILIES["easyocr"][name]).otherwise(NEUTRAL[name])
    return F.struct(*[pick(n).alias(n) for n in C.THRESHOLDS])


@query(
    "p29_p25_thresholds",
    """WITH c AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'paddle' WHEN 1 THEN 'easyocr' ELSE 'other' END AS engine, 1 - l_discount * 3 AS mean, l_tax AS low, CAST(l_quantity AS BIGINT) AS chars FROM lineitem)
    SELECT l_orderkey, l_linenumber, engine, mean >= CASE engine WHEN 'paddle' THEN 0.9 WHEN 'easyocr' THEN 0.82 ELSE 0 END AS strong, mean > 0.8 AND l_linenumber >= 3 AND chars >= 8 AND low <= 0.75 AS replaces FROM c""",
)
def by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(n % 3 == 0, "paddle").when(n % 3 == 1, "easyocr").otherwise("other").alias("engine"), (1 - F.col("l_discount") * 3).alias("mean"), F.col("l_tax").alias("low"), F.col("l_quantity").cast("long").alias("chars"))
    m = F.col("mean")
    return c.select("l_orderkey", "l_linenumber", "engine", (m >= thresholds(F.col("engine")).strong_mean).alias("strong"), C.replaces_upright(n, F.col("chars"), m, F.col("low"), m, F.lit(0.8)).alias("replaces"))


# What a Portuguese recogniser's dictionary must hold.
REQUIRED = list("áàâãçéêíóôõúÁÀÂÃÇÉÊÍÓÔÕÚ")


@query(
    "p28_required_characters",
    """SELECT lang, count(*) AS docs, CAST(24 - len(list_filter(['á','à','â','ã','ç','é','ê','í','ó','ô','õ','ú','Á','À','Â','Ã','Ç','É','Ê','Í','Ó','Ô','Õ','Ú'], lambda c: bool_or_c(c))) AS INTEGER) AS missing FROM documents GROUP BY lang""".replace(
        "CAST(24 - len(list_filter(['á','à','â','ã','ç','é','ê','í','ó','ô','õ','ú','Á','À','Â','Ã','Ç','É','Ê','Í','Ó','Ô','Õ','Ú'], lambda c: bool_or_c(c))) AS INTEGER)",
        "CAST(24 - (" + " + ".join(f"CAST(coalesce(bool_or(contains(nfc_normalize(text), '{c}')), FALSE) AS INTEGER)" for c in REQUIRED) + ") AS INTEGER)"),
)
def required_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the characters a dictionary must have no text of a language has."""
    d = table(spark, sf_dir, "documents").select("lang", T.nfc("text").alias("t"))
    has = [F.coalesce(F.bool_or(F.col("t").contains(c)), F.lit(False)).cast("int") for c in REQUIRED]
    found = has[0]
    for h in has[1:]:
        found = found + h
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), (len(REQUIRED) - found).alias("missing"))
