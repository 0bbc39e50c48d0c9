"""Pages of Markdown, recogniser output, files and sinks over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import integrity, pages, recogniser, render
from .base import BOXES, boxes, table
from .registry import query
from .text import docs

#: Every document dressed up as a Markdown report: pages of three lines, two of five
#: numbers come twice, and lines are headings, quotes, table rows or emphasis in turn.
DRESSED = r"""l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
 d AS (SELECT doc_id, i, CASE i % 6 WHEN 0 THEN '## Heading ' || line WHEN 1 THEN '> ' || line WHEN 2 THEN '| ' || replace(line, ' ', ' | ') || ' |' WHEN 3 THEN '**' || line || '**' WHEN 4 THEN '|---|:-:|' ELSE '<!-- ' || line || ' -->' END AS line FROM l),
 p AS (SELECT doc_id, i // 3 AS pos, 1 + (i // 3) % 3 AS page, string_agg(line, chr(10) ORDER BY i) AS part FROM d GROUP BY ALL)"""
LAST = "q AS (SELECT doc_id, page, max_by(part, pos) AS part FROM p GROUP BY ALL)"
TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def dressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("i")
    lines = docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    line = (
        F.when(i % 6 == 0, F.concat(F.lit("## Heading "), "line")).when(i % 6 == 1, F.concat(F.lit("> "), "line"))
        .when(i % 6 == 2, F.concat(F.lit("| "), F.replace("line", F.lit(" "), F.lit(" | ")), F.lit(" |")))
        .when(i % 6 == 3, F.concat(F.lit("**"), "line", F.lit("**"))).when(i % 6 == 4, "|---|:-:|").otherwise(F.concat(F.lit("<!-- "), "line", F.lit(" -->")))
    )
    head = F.when(i % 3 == 0, F.format_string("## PáGINA %03d | t\n", 1 + F.floor(i / 3) % 3)).otherwise("")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x.line)
    return lines.withColumn("line", F.concat(head, line)).groupBy("doc_id").agg(F.array_join(ordered, "\n").alias("text"))


@query("o07_o10_page_sections", f"WITH {DRESSED}, {LAST} SELECT doc_id, CAST(page AS INTEGER) AS page, md5({TRIM.format('part')}) AS digest FROM q")
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of every report, the last of repeated numbers, without their headings."""
    return pages.split_pages(dressed(spark, sf_dir), ["doc_id"]).select("doc_id", "page", F.md5(pages.page_body(F.col("body"))).alias("digest"))


STRIPPED = r"""list_filter(list_transform(list_filter(string_split(part, chr(10)), lambda x: NOT starts_with(trim(x), '<!--')), lambda x:
  list_reduce(['', CASE WHEN contains(regexp_replace(regexp_replace(x, '^#{1,6}\s+', ''), '^> ', ''), '|')
    THEN array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(x, '^#{1,6}\s+', ''), '^> ', ''), '|'), lambda c: trim(c)), lambda c: c <> '' AND NOT regexp_matches(c, '^[-:]+$')), '  ')
    ELSE ' ' || regexp_replace(regexp_replace(x, '^#{1,6}\s+', ''), '^> ', '') END], lambda a, b: b)), lambda x: x <> '')"""
EMPHASIS = r"regexp_replace(regexp_replace(regexp_replace({0}, '\*{{1,2}}([^*]+)\*{{1,2}}', '\1', 'g'), '_{{1,2}}([^_]+)_{{1,2}}', '\1', 'g'), '`([^`]+)`', '\1', 'g')"


@query(
    "o08_f04_f05_reference_pages",
    f"""WITH {DRESSED}, {LAST}, s AS (SELECT doc_id, page, {STRIPPED} AS ls FROM q)
    SELECT doc_id, CAST(page AS INTEGER) AS page, md5({TRIM.format("nfc_normalize('Página ' || lpad(CAST(page AS VARCHAR), 3, '0') || '  t' || chr(10) || array_to_string(list_transform(ls, lambda x: trim(regexp_replace(" + EMPHASIS.format('x') + r", '\s+', ' ', 'g'))), chr(10)))")}) AS digest FROM s""".replace("  t'", " t'").replace("'Página '", "'PáGINA '"),
)
def reference_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a strict heading as reading text without Markdown."""
    p = pages.reference_pages(dressed(spark, sf_dir), ["doc_id"])
    return p.select("doc_id", "page", F.md5(T.nfc("body")).alias("digest"))


@query(
    "o06_selected_pages",
    "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (1, 5, 8)",
)
def selected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested pages alone; the filter reaches the scan."""
    return pages.select_pages(docs(spark, sf_dir), [1, 5, 8], "doc_id").select("doc_id", "n_chars")


@query(
    "o12_recogniser_words",
    """WITH r AS (SELECT l_orderkey AS page, l_linenumber AS n, CASE WHEN l_linenumber = 4 THEN '4' ELSE '5' END AS level, CAST(l_discount * 1000 AS BIGINT) AS c, l_quantity AS w, l_comment AS text FROM lineitem_c)
    SELECT page, n, trim(text) AS text, CAST(c AS DOUBLE) AS confidence, CAST(n * 10 + 2 AS DOUBLE) AS x0, CAST(n * 10 + 2 + w - 5 AS DOUBLE) AS x1 FROM r
    WHERE level = '5' AND trim(text) <> '' AND c BETWEEN 30 AND 100 AND w > 5""".replace("l_comment", "l_shipmode || ' '").replace("lineitem_c", "lineitem").replace("l_shipmode", "l_returnflag"),
)
def recogniser_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a recogniser's table of texts: numbers may be missing or no numbers."""
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), n.alias("n"), F.when(n == 4, "4").otherwise("5").alias("level"), (F.col("l_discount") * 1000).cast("long").cast("string").alias("conf"),
        (n * 10).cast("string").alias("left"), F.lit("7").alias("top"), (F.col("l_quantity") - 5).cast("string").alias("width"), F.lit(" 9 ").alias("height"), F.concat("l_returnflag", F.lit(" ")).alias("text"))
    return recogniser.tsv_words(rows, least=30, dx=2).select("page", "n", "text", "confidence", "x0", "x1")


@query(
    "o14_tuple_tokens",
    f"""WITH {BOXES} SELECT pg, CAST(count(*) AS BIGINT) AS tokens, CAST(sum(bid) AS BIGINT) AS ids, round(sum(least(1, CASE WHEN bid % 5 = 0 THEN 1 WHEN bid % 7 = 0 THEN 0 ELSE conf * 20 END)), 6) AS sure
    FROM b WHERE bid % 3 <> 0 GROUP BY pg""",
)
def tuple_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of raw outlines: bad outlines go, scores are clamped."""
    n = F.col("bid")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0 = F.when(n % 3 == 0, F.lit(float("nan"))).otherwise(F.col("x0"))
    outline = F.array(point(x0, F.col("y0")), point(F.col("x1"), F.col("y0")), point(F.col("x1"), F.col("y1")), point(F.col("x0"), F.col("y1")))
    raw = F.struct(outline.alias("points"), n.cast("string").alias("text"), F.when(n % 7 == 0, F.lit(float("nan"))).otherwise(F.col("conf") * 20).alias("score"), (n % 5 != 0).alias("scored"))
    t = boxes(spark, sf_dir).groupBy("pg").agg(F.collect_list(raw).alias("raw")).select("pg", F.inline(recogniser.tuple_tokens(F.col("raw"), 1.0, 2.0)))
    return t.groupBy("pg").agg(F.count(F.lit(1)).alias("tokens"), F.sum(F.col("text").cast("long")).alias("ids"), F.round(F.sum("confidence"), 6).alias("sure"))


@query(
    "o13_a38_payload_records",
    """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 4 = 3 THEN 0 ELSE 2 END AS INTEGER) AS recognition_count, CASE WHEN o_orderkey % 4 <> 3 THEN 2 / 4.0 ELSE 0.0 END AS recognition_yield,
      CASE WHEN o_orderkey % 4 <> 3 THEN (0.5 + 0.25) / 2 END AS mean_score, CAST(CASE o_orderkey % 4 WHEN 0 THEN 180 ELSE 0 END AS INTEGER) AS rotation FROM orders""",
)
def payload_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of payloads of several forms: columns in an object, the same under
    another key, lists of tuples, and text that is no JSON."""
    k = F.col("o_orderkey")
    name = lambda s: F.concat(F.lit(s), k.cast("string"))
    newer = F.concat(F.lit('{"res": {"rec_texts": ["'), name("a"), F.lit('", "b", "lost"], "rec_scores": [0.5, 0.25], "rec_polys": [[[1, 2], [3, 4]], [1, 2, 3, 4]], "textline_orientation_angles": [1, 1]}}'))
    older = F.concat(F.lit('[[[[[0, 0], [4, 0], [4, 2], [0, 2]], ["'), name("a"), F.lit('", 0.5]], [[[0, 0], [1, 1]], ["b", 0.25]], ["bad"]]]'))
    plain = F.concat(F.lit('{"texts": ["'), name("a"), F.lit('", "b"], "scores": [0.5, 0.25], "boxes": [[1, 2, 3, 4], [5, 6, 7, 8]]}'))
    payload = F.when(k % 4 == 0, newer).when(k % 4 == 1, older).when(k % 4 == 2, plain).otherwise("{broken")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", recogniser.records(payload).alias("r"))
    m = recogniser.yield_metrics(F.col("r"), F.lit(4))
    return rows.select("o_orderkey", m.recognition_count.alias("recognition_count"), m.recognition_yield.alias("recognition_yield"), m.mean_score.alias("mean_score"), recogniser.dominant_rotation(F.col("r")).alias("rotation"))


BASE = r"regexp_replace(b, '([\\`*_\[\]<>!])', '\\\1', 'g')"
ESCAPED = rf"""e AS (SELECT doc_id, i, regexp_extract(line, '^\s*', 0) AS lead, substr(line, length(regexp_extract(line, '^\s*', 0)) + 1) AS b FROM x),
 f AS (SELECT doc_id, i, lead || CASE WHEN b LIKE '- %' THEN replace(v, '-', '\-') WHEN b LIKE '+ %' THEN replace(v, '+', '\+')
   WHEN regexp_extract(b, '^[0-9]\S*([.)])(?:\s|$)', 1) = '.' AND length(b) > 1 THEN replace(v, '.', '\.') WHEN regexp_extract(b, '^[0-9]\S*([.)])(?:\s|$)', 1) = ')' AND length(b) > 1 THEN replace(v, ')', '\)') ELSE v END AS line
   FROM (SELECT *, CASE WHEN b LIKE '#%' THEN replace({BASE}, '#', '\#') ELSE {BASE} END AS v FROM e))"""


@query(
    "f32_escape",
    rf"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
    x AS (SELECT doc_id, i, CASE i % 4 WHEN 0 THEN '- ' WHEN 1 THEN '  # ' WHEN 2 THEN '12. ' ELSE '' END || line AS line FROM l), {ESCAPED},
    h AS (SELECT doc_id, md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS html_digest FROM documents)
    SELECT f.doc_id, md5(string_agg(f.line, chr(10) ORDER BY i)) AS paragraph_digest, any_value(html_digest) AS html_digest FROM f JOIN h USING (doc_id) GROUP BY f.doc_id""",
)
def escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = lambda n: (n + 1) % 4
    lines = F.transform(F.split("text", "\n"), lambda x, n: F.concat(F.when(i(n) == 0, "- ").when(i(n) == 1, "  # ").when(i(n) == 2, "12. ").otherwise(""), x))
    d = docs(spark, sf_dir).where("text IS NOT NULL")
    return d.select("doc_id", F.md5(render.escape(F.array_join(lines, "\n"))).alias("paragraph_digest"), F.md5(render.escape_html(F.col("text"))).alias("html_digest"))


@query(
    "o17_markdown_blocks",
    f"""WITH {BOXES}, k AS (SELECT pg // 4 AS doc_id, CAST(pg % 4 AS INTEGER) AS page_index, bid, kind, status FROM b),
    m AS (SELECT *, CASE WHEN status = 'O' AND bid % 5 = 0 THEN '' WHEN kind = 'N' THEN '## block\\_' || bid WHEN kind = 'R' THEN '  * item ' || bid || chr(10) || '  * \\# two' ELSE '3\\) text ' || bid END AS part FROM k),
    p AS (SELECT doc_id, page_index, string_agg(part, chr(10) || chr(10) ORDER BY bid) FILTER (WHERE part <> '') AS body FROM m GROUP BY ALL)
    SELECT doc_id, md5(string_agg('## Página ' || (page_index + 1) || CASE WHEN body IS NULL THEN '' ELSE chr(10) || chr(10) || body END, chr(10) || chr(10) ORDER BY page_index)) AS digest FROM p GROUP BY doc_id""",
)
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as diagnostic Markdown from their content blocks."""
    b = boxes(spark, sf_dir).withColumns({"doc_id": F.expr("pg div 4"), "page_index": (F.col("pg") % 4).cast("int")})
    kind = F.when(F.col("kind") == "N", "title").when(F.col("kind") == "R", "list").otherwise("paragraph")
    n = F.col("bid").cast("string")
    text = F.when(F.col("kind") == "N", F.concat(F.lit("block_"), n)).otherwise(F.concat(F.lit("3) text "), n))
    items = F.array(*[F.struct(F.lit(1).alias("level"), F.lit("*").alias("marker"), t.alias("text")) for t in (F.concat(F.lit("item "), n), F.lit("# two"))])
    blocks = b.select(
        "doc_id", "page_index", F.col("bid").alias("order_index"), kind.alias("kind"), text.alias("text"), F.lit(2).alias("heading_level"), F.array(n).alias("line_ids"),
        F.when(kind == "list", items).alias("list_items"), ((F.col("status") == "O") & (F.col("bid") % 5 == 0)).alias("suppressed"), F.lit(None).cast("string").alias("table_id"))
    pages_ = b.select("doc_id", "page_index", F.lit(True).alias("preserve_furniture")).distinct()
    none = spark.createDataFrame([], "doc_id long, page_index int, table_id string, row_count int, column_count int, header_rows array<int>")
    cells = spark.createDataFrame([], "doc_id long, page_index int, table_id string, row int, col int, rowspan int, colspan int, text string")
    return render.render_markdown(pages_, blocks, none, cells, diagnostic=True).select("doc_id", F.md5("markdown").alias("digest"))


@query(
    "o18_pipe_tables",
    """WITH c AS (SELECT l_orderkey AS pg, l_linenumber - 1 AS r, unnest([0, 1, 2]) AS col, l_returnflag || '|' AS a, CAST(l_partkey AS VARCHAR) AS b FROM lineitem),
    v AS (SELECT pg, r, max(CASE col WHEN 0 THEN a WHEN 1 THEN b END) FILTER (WHERE col = 0) AS v0, max(b) FILTER (WHERE col = 1) AS v1 FROM c GROUP BY ALL),
    n AS (SELECT pg, max(r) AS last FROM v GROUP BY pg), g AS (SELECT pg, unnest(range(0, last + 1)) AS r FROM n),
    l AS (SELECT g.pg, g.r, '| ' || replace(coalesce(v0, ''), '|', '\\|') || ' | ' || coalesce(v1, '') || ' |  |' || CASE WHEN g.r = 0 THEN chr(10) || '| --- | --- | --- |' ELSE '' END AS line FROM g LEFT JOIN v USING (pg, r))
    SELECT pg, md5(string_agg(line, chr(10) ORDER BY r)) AS digest FROM l GROUP BY pg""",
)
def pipe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's lines as a pipe table of three columns, the last one empty."""
    li = table(spark, sf_dir, "lineitem")
    row = (F.col("l_linenumber") - 1).cast("int")
    both = F.explode(F.array(F.struct(F.lit(0).alias("col"), F.concat("l_returnflag", F.lit("|")).alias("text")), F.struct(F.lit(1).alias("col"), F.col("l_partkey").cast("string").alias("text")))).alias("c")
    cells = li.select(F.col("l_orderkey").alias("pg"), F.lit("t").alias("table_id"), row.alias("row"), both).select("pg", "table_id", "row", "c.col", F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), "c.text")
    tables = cells.groupBy("pg", "table_id").agg((F.max("row") + 1).alias("row_count")).withColumns({"column_count": F.lit(3), "header_rows": F.array(F.lit(0))})
    return render.render_tables(tables, cells, ["pg"]).select("pg", F.md5("md").alias("digest"))


@query("o15_o16_document_json", "SELECT source, count(*) AS n, list_sort(list_distinct(list(lang) FILTER (WHERE lang IS NOT NULL))) AS langs FROM documents GROUP BY source")
def document_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of a document's fields with its sets sorted, read back."""
    langs = docs(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.collect_set("lang").alias("langs"))
    j = langs.select("source", render.to_json(F.struct("n"), {"langs": F.col("langs")}).alias("j"))
    return j.select("source", F.from_json("j", "n long, langs array<string>").alias("v")).select("source", "v.n", "v.langs")


@query(
    "o23_tree_hash",
    """WITH f AS (SELECT source, CAST(doc_id AS VARCHAR) AS name, octet_length(encode(text)) AS length, sha256(text) AS sha FROM documents WHERE text IS NOT NULL)
    SELECT source, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes, sha256(string_agg(name || chr(0) || sha, chr(10) ORDER BY name || chr(0) || sha)) AS tree FROM f GROUP BY source""",
)
def tree_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash per source over its documents' names and hashes."""
    f = docs(spark, sf_dir).where("text IS NOT NULL").select("source", F.col("doc_id").cast("string").alias("name"), F.octet_length("text").alias("length"), F.sha2("text", 256).alias("sha256"))
    return integrity.tree_hash(f, ["source"])


@query(
    "o24_lock_check",
    """WITH a AS (SELECT o_orderkey AS lock_id, o_orderkey % 9 AS f FROM orders)
    SELECT lock_id, CASE f WHEN 0 THEN 'schema_version' WHEN 1 THEN 'corpus_id' WHEN 2 THEN 'artifacts' WHEN 3 THEN 'unsafe_path' WHEN 4 THEN 'missing' WHEN 5 THEN 'size' WHEN 6 THEN 'sha256' END AS error FROM a""",
)
def lock_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failing check of every lock; each seventh part of them fails in another way."""
    k = F.col("o_orderkey")
    f = k % 9
    a = lambda path, size, sha: F.struct(path.alias("path"), size.cast("long").alias("size_bytes"), sha.alias("sha256"))
    name = F.concat(F.lit("f"), k.cast("string"))
    sha = F.sha2(name, 256)
    good = a(name, F.length(name), sha)
    bad = F.when(f == 3, a(F.concat(F.lit("../"), name), F.length(name), sha)).when(f == 4, a(F.lit("none"), F.length(name), sha)).when(f == 5, a(name, F.length(name) + 1, sha)).when(f == 6, a(name, F.length(name), F.lit("0"))).otherwise(good)
    key = F.when(f == 2, "other").otherwise("reference")
    o = table(spark, sf_dir, "orders")
    locks = o.select(
        k.alias("lock_id"), F.when(f == 0, "2.0").otherwise("1.0").alias("schema_version"), F.when(f == 1, "x").otherwise("corpus").alias("corpus_id"),
        F.map_from_arrays(F.array(F.lit("pdf"), key), F.array(good, bad)).alias("artifacts"))
    files = o.select(name.alias("path"), F.length(name).cast("long").alias("length"), sha.alias("sha256"))
    return integrity.verify_lock(locks, files, "1.0", "corpus", ["pdf", "reference"])


@query(
    "o25_protocol_id",
    """SELECT DISTINCT lang, sha256('{"comparison_kind":"deployment_profile","corpus_policy":"identical-pdf-reference-and-manifest-hashes","language":"' || lang || '","mode":"balanced","page_selection_policy":"identical-explicit-pages-or-all-pages","protocol":"ocr-deployment-profile-v1","quality_policy":"adaptive"}') AS id FROM documents WHERE lang IS NOT NULL""",
)
def protocol_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).where("lang IS NOT NULL").select("lang").distinct()
    return d.select("lang", integrity.protocol_id(F.col("lang"), F.lit("balanced"), F.lit("adaptive")).alias("id"))
