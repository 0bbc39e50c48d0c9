"""Furniture, ledgers and tables of synthetic documents: eight pages are a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assembly as A
from .base import table
from .evidence import PAGES, evidence
from .registry import query

EDGE = f"""{PAGES}, l AS (SELECT pg // 8 AS doc_id, pg % 8 AS page, bid, 'line:' || bid AS line_id, CASE WHEN bid % 2 = 0 THEN 'header' ELSE 'footer' END AS role, 'title ' || (bid % 6) AS signature,
   CASE WHEN bid % 2 = 0 THEN 20 + bid % 3 ELSE 735 - bid % 3 END + CASE WHEN bid % 6 = 4 THEN pg % 8 * 10 ELSE 0 END AS cy, 10 + CASE WHEN bid % 6 = 3 THEN pg % 8 ELSE 0 END AS size, CASE WHEN bid % 6 = 5 AND pg % 2 = 0 THEN 'Serif' ELSE 'sans' END AS font FROM e)"""
FOUND = """f AS (SELECT doc_id, role || ':' || signature AS key, page, min_by(cy, bid) AS cy, min_by(size, bid) AS size, min_by(font, bid) AS font FROM l GROUP BY ALL),
 k AS (SELECT doc_id, key, count(*) AS pages FROM f GROUP BY ALL HAVING count(*) >= 2 AND max(least(cy - 5, 750 - cy - 5) / 750.0) <= 0.08 AND max(cy / 750.0) - min(cy / 750.0) <= 0.035 AND max(size) / CAST(min(size) AS DOUBLE) <= 1.35 AND count(DISTINCT lower(font)) <= 1)"""


def edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, page = F.col("bid"), F.col("pg") % 8
    cy = F.when(n % 2 == 0, 20 + n % 3).otherwise(735 - n % 3) + F.when(n % 6 == 4, page * 10).otherwise(0)
    return evidence(spark, sf_dir).select(
        F.expr("pg div 8").alias("doc_id"), page.alias("page"), n.alias("line_index"), F.concat(F.lit("line:"), n.cast("string")).alias("line_id"), F.when(n % 2 == 0, "header").otherwise("footer").alias("role"),
        F.concat(F.lit("title "), (n % 6).cast("string")).alias("signature"), cy.cast("double").alias("cy"), F.least(cy - 5, 745 - cy).cast("double").alias("edge"), F.lit(750.0).alias("height"),
        (10 + F.when(n % 6 == 3, page).otherwise(0)).cast("double").alias("size"), F.when((n % 6 == 5) & (F.col("pg") % 2 == 0), "Serif").otherwise("sans").alias("font"), F.lit(None).cast("int").alias("weight"))


@query("d18_furniture", f"WITH {EDGE}, {FOUND} SELECT doc_id, key, pages FROM k")
def furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.furniture(edge_lines(spark, sf_dir))


@query(
    "d19_suppressed_blocks",
    f"""WITH {EDGE}, {FOUND}, bl AS (SELECT doc_id, bid // 3 AS block_id, role, role || ':' || signature AS key FROM l), h AS (SELECT bl.doc_id, block_id, role, k.key IS NOT NULL AS hit FROM bl LEFT JOIN k USING (doc_id, key))
    SELECT doc_id, block_id, min(role) AS role FROM h GROUP BY doc_id, block_id HAVING bool_and(hit) AND count(DISTINCT role) = 1""",
)
def suppressed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that are nothing but furniture of one role."""
    # line ids repeat where two orders number alike: rows are made distinct by id first
    lines = edge_lines(spark, sf_dir)
    blocks = lines.groupBy("doc_id", F.expr("line_index div 3").alias("block_id")).agg(F.collect_set("line_id").alias("line_ids"))
    return A.suppressed_blocks(blocks, lines, A.furniture(lines))


@query(
    "d14_edge_bands",
    f"WITH {PAGES} SELECT pg, count(*) FILTER (WHERE y0 <= 45) AS headers, count(*) FILTER (WHERE y0 > 45 AND y1 >= 705) AS footers FROM e GROUP BY pg",
)
def edge_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = A.edge_bands(evidence(spark, sf_dir), ["pg"], F.lit(750.0))
    return b.groupBy("pg").agg(F.count_if(F.col("band") == "header").alias("headers"), F.count_if(F.col("band") == "footer").alias("footers"))


@query(
    "a24_j27_k07_ledger",
    """WITH l AS (SELECT l_orderkey AS pg, l_linenumber AS n FROM lineitem GROUP BY ALL), m AS (SELECT pg, n + 1 AS n FROM l WHERE n % 3 = 0), a AS (SELECT pg, n FROM l WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.pg = l.pg AND m.n = l.n)),
    c AS (SELECT pg, n, 1 AS ord, 'paragraph' AS kind, 100 AS p FROM l WHERE n % 5 <> 0 UNION ALL SELECT pg, n, 2, 'table', 300 FROM l WHERE n % 2 = 0 AND pg % 4 = 0 UNION ALL SELECT pg, n, 3, 'footer', 50 FROM l WHERE n = 1),
    w AS (SELECT *, row_number() OVER (PARTITION BY pg, n ORDER BY p DESC, ord) AS r FROM c),
    d AS (SELECT a.pg, CASE WHEN w.n IS NULL THEN 'unaccounted' WHEN kind = 'footer' THEN 'suppressed_repeated' WHEN kind = 'table' THEN 'table_owned' ELSE 'rendered' END AS disposition FROM a LEFT JOIN w ON w.pg = a.pg AND w.n = a.n AND w.r = 1)
    SELECT pg, disposition, count(*) AS lines FROM d GROUP BY ALL""",
)
def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every accepted line of every page has one disposition."""
    n = F.col("l_linenumber")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pg"), "l_linenumber").distinct()
    name = lambda c: c.cast("string")
    lines = li.select("pg", name(n).alias("line_id"), n.alias("line_order"), F.when(n % 3 == 0, F.array(name(n), name(n + 1))).otherwise(F.array().cast("array<string>")).alias("merged_ids"))
    claim = lambda cond, order, kind, why: li.where(cond).select("pg", name(n).alias("line_id"), F.lit(f"b{order}").alias("block_id"), F.lit(order).alias("block_order"), F.lit(kind).alias("kind"), F.lit(why).cast("string").alias("suppressed"))
    claims = claim(n % 5 != 0, 1, "paragraph", None).unionByName(claim((n % 2 == 0) & (F.col("pg") % 4 == 0), 2, "table", None)).unionByName(claim(n == 1, 3, "footer", "repeated"))
    return A.ledger(lines, claims, ["pg"]).groupBy("pg", "disposition").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "a30_header_rows",
    """WITH c AS (SELECT l_orderkey AS pg, l_linenumber - 1 AS r, l_suppkey % 4 AS bold, 9 + CASE WHEN l_linenumber = 1 THEN l_orderkey % 3 ELSE 0 END AS size FROM lineitem),
    g AS (SELECT pg, count(DISTINCT r) AS rows, count(*) FILTER (WHERE r = 0) AS n, count(*) FILTER (WHERE r > 0) AS m, count(*) FILTER (WHERE r = 0 AND bold >= 1) AS b, median(size) FILTER (WHERE r = 0) AS hs, median(size) FILTER (WHERE r > 0) AS bs FROM c GROUP BY pg)
    SELECT pg, coalesce(rows >= 2 AND n > 0 AND m > 0 AND (b >= 0.6 * n OR hs >= bs * 1.15), FALSE) AS has_header FROM g""",
)
def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    cells = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pg"), (n - 1).alias("row"), F.lit("x").alias("text"), (F.col("l_suppkey") % 4).alias("bold_tokens"), F.lit(2).alias("tokens"),
        F.array((9 + F.when(n == 1, F.col("l_orderkey") % 3).otherwise(0)).cast("double")).alias("sizes"))
    return A.header_rows(cells, ["pg"])


@query(
    "a28_text_tracks",
    """WITH r AS (SELECT conv_id, turn AS row, text FROM conversations WHERE text IS NOT NULL), w AS (SELECT conv_id, row, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws, text FROM r),
    x AS (SELECT conv_id, row, unnest(ws[1:4]) AS text, generate_subscripts(ws[1:4], 1) - 1 AS col FROM w),
    p AS (SELECT conv_id, row, count(DISTINCT col) AS filled FROM x GROUP BY ALL), s AS (SELECT conv_id, sum(filled) AS filled, sum(abs(filled - 4) / 4.0) AS off FROM p GROUP BY conv_id),
    c AS (SELECT conv_id, coalesce(avg(CASE WHEN regexp_matches(text, '\\p{Nd}') THEN 1.0 ELSE 0.0 END) FILTER (WHERE col > 0), 0) AS numeric_, avg(CASE WHEN length(text) >= 48 THEN 1.0 ELSE 0.0 END) AS long_ FROM x GROUP BY conv_id),
    g AS (SELECT conv_id, count(*) AS n, avg(CASE WHEN regexp_matches(rtrim(text), '[.!?;]$') THEN 1.0 ELSE 0.0 END) AS sentence FROM r GROUP BY conv_id),
    j AS (SELECT g.conv_id, n, filled / (n * 4.0) AS rec, 1 - off / n AS con, numeric_, least(1, sentence * 0.6 + long_ * 0.8) AS prose FROM g JOIN s USING (conv_id) JOIN c USING (conv_id))
    SELECT conv_id, n AS row_count, round(rec, 6) AS track_recurrence, round(con, 6) AS row_consistency, round(prose, 6) AS prose_score, n >= 3 AND rec >= 0.58 AND con >= 0.58 AND prose < 0.40 AS accepted,
      round(greatest(0, least(1, 0.34 * rec + 0.30 * con + 0.18 * least(1, n / 5.0) + 0.10 + 0.08 * numeric_ - 0.25 * prose)), 6) AS confidence FROM j""",
)
def text_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as runs of lines whose first four words are cells."""
    r = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", F.col("turn").alias("row"), "text", F.lit(False).alias("code"))
    ws = F.slice(F.filter(F.split("text", " "), lambda w: w != ""), 1, 4)
    cells = r.select("conv_id", "row", F.posexplode(ws).alias("col", "text"), F.lit(4).alias("columns"))
    t = A.text_tracks(r, cells, ["conv_id"])
    # as SQL rounds doubles: the nearest whole of the product, not of the shortest decimal
    six = lambda c: (F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c)
    return t.select("conv_id", "row_count", six("track_recurrence"), six("row_consistency"), six("prose_score"), "accepted", six("confidence"))


@query(
    "k19_shared_orientation",
    "SELECT l_orderkey AS pg, CASE WHEN count(DISTINCT l_suppkey % 2) = 1 AND min(l_suppkey % 2) = 1 AND NOT bool_or(l_partkey % 9 = 0) THEN 90 END AS rotation FROM lineitem GROUP BY l_orderkey",
)
def shared_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pg"), F.when(F.col("l_suppkey") % 2 == 1, 90).otherwise(0).alias("rotation"), (F.col("l_partkey") % 9 == 0).alias("native"))
    return A.shared_orientation(li, ["pg"])


@query("f26_similarity_keys", "SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) > 0 AS has_key FROM documents WHERE text IS NOT NULL")
def similarity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", (F.length(T.compact(T.nfkc_casefold("text"))) > 0).alias("has_key"))
