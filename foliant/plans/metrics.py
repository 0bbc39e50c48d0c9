"""The quality-metric suite: page counters, micro and macro averages, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import text as T
from ..operators import multiset as M
from ..operators import spatial as S
from .base import table
from .registry import query
from .text import docs, whole_pairs

#: Runs: the reference pages of a source, and a reading that lacks some of them.
RUN = """ref AS (SELECT source, doc_id AS page, lang, text AS body FROM documents),
 hyp AS (SELECT source, doc_id AS page, replace(text, 'th', 'd') AS body FROM documents WHERE doc_id % 17 <> 0)"""


def ref_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("source", F.col("doc_id").alias("page"), "lang", F.col("text").alias("body"))


def hyp_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).where("doc_id % 17 <> 0")
    return d.select("source", F.col("doc_id").alias("page"), F.replace("text", F.lit("th"), F.lit("d")).alias("body"))


@query("quality_by_language", None)
def quality_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-averaged character and word error rates and duplicate-line rate of a
    garbled reading, per language: counters per page, then sums."""
    d = docs(spark, sf_dir).select("lang", F.col("text"), T.squeeze_lines(T.nfc(F.col("text"))).alias("ref"))
    d = d.withColumn("hyp", F.replace("ref", F.lit("th"), F.lit("d")))
    words = F.size(F.split(F.trim("ref"), r"\s+"))
    counters = d.select(
        "lang", D.char_distance("hyp", "ref").alias("ce"), F.length("ref").alias("cl"),
        D.word_distance("hyp", "ref").alias("we"), words.alias("wl"), T.duplicate_line_ratio(F.col("text")).alias("dup"))
    out = counters.groupBy("lang").agg(*[F.sum(c).alias(c) for c in ("ce", "cl", "we", "wl")], F.avg("dup").alias("duplicate_lines"), F.count(F.lit(1)).alias("pages"))
    return out.select("lang", "pages", M.ratio(F.col("ce"), F.col("cl")).alias("cer"), M.ratio(F.col("we"), F.col("wl")).alias("wer"), "duplicate_lines")


@query("a03_micro_error", None)
def micro_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits over characters of whole texts; a missing page counts all of its
    characters as edits."""
    p = whole_pairs(spark, sf_dir)
    missing = F.col("doc_id") % 17 == 0
    e = D.char_distance(F.when(missing, "").otherwise(F.col("hyp")), F.col("ref"))
    p = p.select("lang", missing.alias("gone"), e.alias("e"), F.length("ref").alias("n"))
    g = p.groupBy("lang").agg(F.sum("e").alias("edits"), F.sum("n").alias("chars"), F.count_if("gone").alias("missing"))
    return g.withColumn("cer", F.col("edits") / F.col("chars"))


NUMBERS = "regexp_extract_all({0}, '[0-9]+(?:[.,][0-9]+)*')"


@query(
    "a04_a06_multiset_f1",
    """WITH w AS (SELECT source, unnest(string_split(text, ' ')) AS v FROM documents),
    h AS (SELECT source, unnest(string_split(replace(text, 'th', 'd'), ' ')) AS v FROM documents WHERE doc_id % 17 <> 0),
    r1 AS (SELECT source, v, count(*) AS nr FROM w GROUP BY ALL), h1 AS (SELECT source, v, count(*) AS nh FROM h GROUP BY ALL),
    j AS (SELECT source, coalesce(nr, 0) AS nr, coalesce(nh, 0) AS nh FROM r1 FULL JOIN h1 USING (source, v)),
    c AS (SELECT source, CAST(sum(least(nr, nh)) AS BIGINT) AS tp, CAST(sum(greatest(nh - nr, 0)) AS BIGINT) AS fp, CAST(sum(greatest(nr - nh, 0)) AS BIGINT) AS fn FROM j GROUP BY source)
    SELECT source, tp, fp, fn, round(tp / CAST(tp + fp AS DOUBLE), 4) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 4) AS recall, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 4) AS f1 FROM c""",
)
def multiset_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset intersection of words between two runs."""
    word = lambda d: d.select("source", F.explode(F.split("body", " ")).alias("v"))
    c = M.overlap(word(hyp_pages(spark, sf_dir)), word(ref_pages(spark, sf_dir)), ["source"], "v")
    return c.select("*", *[x.alias(n) for n, x in M.prf(F.col("tp"), F.col("fp"), F.col("fn")).items()])


MD = """md AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
 m AS (SELECT doc_id, i, CASE i % 5 WHEN 1 THEN repeat('#', 1 + CAST(i % 3 AS INTEGER)) || ' ' || line WHEN 2 THEN '- ' || line WHEN 3 THEN '' ELSE line END AS line FROM md WHERE length(line) > 0)"""


def markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dressed up as Markdown, a line a row."""
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).where("length(line) > 0")
    i = F.col("i") + 1
    dressed = (
        F.when(i % 5 == 1, F.concat(F.repeat(F.lit("#"), (1 + i % 3).cast("int")), F.lit(" "), "line"))
        .when(i % 5 == 2, F.concat(F.lit("- "), "line")).when(i % 5 == 3, "").otherwise(F.col("line"))
    )
    return lines.select("doc_id", i.cast("long").alias("i"), dressed.alias("line"))


@query(
    "p21_headings",
    rf"""WITH {MD} SELECT doc_id, i, CAST(length(regexp_extract(line, '^(#+)\s', 1)) AS INTEGER) AS level, md5(trim(regexp_extract(line, '^#+\s+(.*)$', 1))) AS title FROM m
    WHERE regexp_matches(line, '^#+\s')""",
)
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = markdown_lines(spark, sf_dir).where(F.col("line").rlike(r"^#+\s"))
    return m.select("doc_id", "i", F.length(F.regexp_extract("line", r"^(#+)\s", 1)).alias("level"), F.md5(F.trim(F.regexp_extract("line", r"^#+\s+(.*)$", 1))).alias("title"))


BLOCKS = rf"""WITH {MD}, k AS (SELECT *, CASE WHEN trim(line) = '' THEN NULL WHEN regexp_matches(line, '^#{{1,6}}\s') THEN 'h' || length(regexp_extract(line, '^(#+)', 1))
      WHEN regexp_matches(line, '^\s*\|') THEN 'table' WHEN regexp_matches(line, '^\s*(?:[-*+]|\d+[.)])\s') THEN 'list' ELSE 'para' END AS kind FROM m),
    s AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM k),
    b AS (SELECT *, kind IS NOT NULL AND (before IS NULL OR before <> kind OR kind LIKE 'h_') AS starts FROM s)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their block type (null: blank) and whether they open a block."""
    line = F.col("line")
    kind = (
        F.when(F.trim(line) == "", F.lit(None)).when(line.rlike(r"^#{1,6}\s"), F.concat(F.lit("h"), F.length(F.regexp_extract(line, "^(#+)", 1)).cast("string")))
        .when(line.rlike(r"^\s*\|"), "table").when(line.rlike(r"^\s*(?:[-*+]|\d+[.)])\s"), "list").otherwise("para")
    )
    m = markdown_lines(spark, sf_dir).withColumn("kind", kind)
    before = F.lag("kind").over(W.partitionBy("doc_id").orderBy("i"))
    starts = F.col("kind").isNotNull() & (before.isNull() | (before != F.col("kind")) | F.col("kind").startswith("h"))
    return m.withColumn("starts", starts)


@query("p22_block_sequence", BLOCKS + " SELECT doc_id, string_agg(kind, ' ' ORDER BY i) FILTER (WHERE starts) AS blocks FROM b GROUP BY doc_id HAVING bool_or(starts)")
def block_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir).where("starts")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("i", "kind"))), lambda x: x.kind)
    return b.groupBy("doc_id").agg(F.array_join(ordered, " ").alias("blocks"))


@query(
    "a11_mean_median_worst",
    """WITH s AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT lang, avg(n_chars) AS mean, max(n_chars) FILTER (WHERE rn = n // 2 + 1) AS upper_median, max(n_chars) AS worst FROM s GROUP BY lang""",
)
def mean_median_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median from counts per value, so that no list of a group is built."""
    counts = docs(spark, sf_dir).groupBy("lang", "n_chars").agg(F.count(F.lit(1)).alias("k"))
    w = W.partitionBy("lang")
    run = counts.withColumns({"upto": F.sum("k").over(w.orderBy("n_chars").rowsBetween(W.unboundedPreceding, 0)), "n": F.sum("k").over(w)})
    return run.groupBy("lang").agg(
        (F.sum(F.col("n_chars") * F.col("k")) / F.sum("k")).alias("mean"),
        F.min(F.when(F.col("upto") >= F.floor(F.col("n") / 2) + 1, F.col("n_chars"))).alias("upper_median"), F.max("n_chars").alias("worst"))


@query(
    "a12_strategy_counts",
    """SELECT source, count(*) AS docs, count(*) FILTER (WHERE n_chars >= 2000) AS native, count(*) FILTER (WHERE n_chars < 200) AS ocr,
      string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY doc_id) FILTER (WHERE n_chars < 200) AS ocr_docs FROM documents GROUP BY source""",
)
def strategy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.sort_array(F.collect_list(F.when(F.col("n_chars") < 200, F.col("doc_id"))))
    listed = F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")
    return docs(spark, sf_dir).groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.count_if(F.col("n_chars") >= 2000).alias("native"), F.count_if(F.col("n_chars") < 200).alias("ocr"),
        F.nullif(listed, F.lit("")).alias("ocr_docs"))


@query(
    "a13_percentiles",
    """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99
    FROM events GROUP BY GROUPING SETS ((event_type), ())""",
)
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact interpolated percentiles, by type and over all."""
    e = table(spark, sf_dir, "events")
    p = lambda q: F.round(F.percentile("value", q), 6)
    return e.rollup("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


@query(
    "a14_rounded_index_percentile",
    """WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, max(value) FILTER (WHERE rn = CAST(round_even((n - 1) * 0.75, 0) AS BIGINT) + 1) AS p75 FROM s GROUP BY user_id""",
)
def rounded_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("user_id")
    e = table(spark, sf_dir, "events").select("user_id", "value", F.row_number().over(w.orderBy("value")).alias("rn"), F.count(F.lit(1)).over(w).alias("n"))
    return e.groupBy("user_id").agg(F.max(F.when(F.col("rn") == F.bround((F.col("n") - 1) * 0.75) + 1, F.col("value"))).alias("p75"))


@query(
    "a15_by_condition",
    """WITH l AS (SELECT d.source, d.n_chars, unnest(list_filter(['quality' || l.quality, CASE WHEN l.toxic = 1 THEN 'toxic' END, d.lang], lambda x: x IS NOT NULL)) AS label
      FROM documents d JOIN labels l USING (doc_id))
    SELECT label, count(*) AS n, avg(n_chars) AS mean_chars FROM l GROUP BY label""",
)
def by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document counts under each of its labels."""
    j = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    labels = F.array_compact(F.array(F.concat(F.lit("quality"), F.col("quality").cast("string")), F.when(F.col("toxic") == 1, "toxic"), F.col("lang")))
    return j.select("n_chars", F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean_chars"))


@query(
    "a16_best_engines",
    """WITH m AS (SELECT lang AS engine, avg(n_chars) AS chars, CAST(count(*) AS DOUBLE) AS docs, avg(len(string_split(text, chr(10)))) AS lines FROM documents GROUP BY lang),
    u AS (UNPIVOT m ON chars, docs, lines INTO NAME metric VALUE value),
    b AS (SELECT *, CASE WHEN metric = 'lines' THEN min(value) OVER (PARTITION BY metric) ELSE max(value) OVER (PARTITION BY metric) END AS best FROM u)
    SELECT engine, metric, value, abs(value - best) <= 0.000001 AS is_best FROM b""",
)
def best_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unpivoted metrics, each with its own direction, the best flagged within a tolerance."""
    m = docs(spark, sf_dir).groupBy(F.col("lang").alias("engine")).agg(
        F.avg("n_chars").alias("chars"), F.count(F.lit(1)).cast("double").alias("docs"), F.avg(F.size(F.split("text", "\n"))).alias("lines"))
    u = m.unpivot("engine", ["chars", "docs", "lines"], "metric", "value")
    w = W.partitionBy("metric")
    best = F.when(F.col("metric") == "lines", F.min("value").over(w)).otherwise(F.max("value").over(w))
    return u.withColumn("is_best", F.abs(F.col("value") - best) <= 1e-6)


@query("a17_worst_pages", None)
def worst_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty pages of the highest character error rate over whole texts."""
    p = whole_pairs(spark, sf_dir).select("doc_id", (D.char_distance("hyp", "ref") / F.greatest(F.length("ref"), F.lit(1))).alias("cer"))
    return p.orderBy(F.col("cer").desc(), "doc_id").limit(20)


@query(
    "a18_event_summary",
    """SELECT event_type, user_id % 10 AS page, count(*) AS calls, round(sum(value), 6) AS seconds, max(value) AS peak,
      arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY ALL""",
)
def event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 10).alias("page")).agg(
        F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 6).alias("seconds"), F.max("value").alias("peak"),
        F.min_by("value", at).alias("first_value"), F.max_by("value", at).alias("last_value"))


@query(
    "a18_slowest_calls",
    "SELECT event_id, event_type, value FROM events ORDER BY value DESC, event_id LIMIT 30",
)
def slowest_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report lists thirty calls."""
    return table(spark, sf_dir, "events").select("event_id", "event_type", "value").orderBy(F.desc("value"), "event_id").limit(30)


@query(
    "a19_rates_by_mode",
    """WITH c AS (SELECT l.quality, l.toxic, count(*) AS n FROM labels l GROUP BY ALL)
    SELECT quality, CAST(sum(n) AS BIGINT) AS pages, CAST(sum(CASE WHEN toxic = 1 THEN n ELSE 0 END) AS DOUBLE) / nullif(sum(n), 0) AS toxic_rate
    FROM c GROUP BY GROUPING SETS ((quality), ())""",
)
def rates_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals for all and for each mode, as grouping sets."""
    g = table(spark, sf_dir, "labels").rollup("quality").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("toxic") == 1).alias("t"))
    return g.select("quality", "pages", F.try_divide("t", "pages").alias("toxic_rate"))


@query(
    "a25_document_rollup",
    """SELECT conv_id, count(*) AS pages, CASE WHEN bool_and(length(text) < 40) THEN 'failure' WHEN bool_or(length(text) < 40) THEN 'partial' ELSE 'success' END AS status,
      md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id""",
)
def document_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.length("text") < 40
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x.text), "\n")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("pages"), F.when(F.bool_and(bad), "failure").when(F.bool_or(bad), "partial").otherwise("success").alias("status"), F.md5(joined).alias("digest"))


@query(
    "a31_pareto_frontier",
    """WITH c AS (SELECT vec_id % 25 AS page, vec_id, CAST(embedding[1] AS DOUBLE) AS quality, CAST(embedding[2] AS DOUBLE) AS coverage FROM embeddings)
    SELECT page, vec_id FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.page = a.page AND b.quality >= a.quality - 0.02 AND b.coverage >= a.coverage - 0.03
      AND (b.quality > a.quality + 0.02 OR b.coverage > a.coverage + 0.03))""",
)
def pareto_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates no other candidate of the page materially dominates."""
    c = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 25).alias("page"), "vec_id", F.col("embedding")[0].cast("double").alias("q"), F.col("embedding")[1].cast("double").alias("c"))
    return frontier(c, "page", "q", "c", 0.02, 0.03).select("page", "vec_id")


def frontier(df: DataFrame, page: str, q: str, c: str, dq: float, dc: float) -> DataFrame:
    """Rows that no row of their page dominates: one that is better by over a tolerance
    in one measure and not worse by more than the other's. Two sorted passes with a
    running maximum per page, so rows are never paired."""
    best = lambda of, by, d: F.expr(f"max(`{of}`) OVER (PARTITION BY `{page}` ORDER BY `{by}` DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CAST({d!r} AS DOUBLE) PRECEDING)")
    seen = df.withColumns({"_c": best(c, q, dq), "_q": best(q, c, dc)})
    free = F.coalesce(F.col("_c") < F.col(c) - dc, F.lit(True)) & F.coalesce(F.col("_q") < F.col(q) - dq, F.lit(True))
    return seen.where(free).drop("_c", "_q")


@query(
    "a33_manifest_rollup",
    """WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    w AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS rn, n - 1 AS n FROM s WHERE page > 1)
    SELECT s.user_id, max(s.value) FILTER (WHERE page = 1) AS first_page, (SELECT max(value) FROM w WHERE w.user_id = s.user_id AND w.n > 1 AND rn = CAST(floor(0.95 * (w.n - 1)) AS BIGINT) + 1) AS warm_p95
    FROM s GROUP BY s.user_id""",
)
def manifest_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-page latency and the 95th percentile (floor index) of the warm pages."""
    e = table(spark, sf_dir, "events").withColumn("page", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    warm = F.sort_array(F.collect_list(F.when(F.col("page") > 1, F.col("value"))))
    g = e.groupBy("user_id").agg(F.max(F.when(F.col("page") == 1, F.col("value"))).alias("first_page"), warm.alias("w"))
    p95 = F.when(F.size("w") > 1, F.try_element_at("w", F.floor(0.95 * (F.size("w") - 1)).cast("int") + 1))
    return g.select("user_id", "first_page", p95.alias("warm_p95"))


@query(
    "a40_counter_deltas",
    """SELECT event_id, value - lag(value, 1, 0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events""",
)
def counter_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", (F.col("value") - F.lag("value", 1, 0.0).over(w)).alias("delta"))


@query(
    "j21_selected_bodies",
    f"""WITH {RUN} SELECT r.source, md5(string_agg(coalesce(h.body, ''), chr(10) ORDER BY r.page)) AS hyp_digest, md5(string_agg(r.body, chr(10) ORDER BY r.page)) AS ref_digest
    FROM ref r LEFT JOIN hyp h ON h.page = r.page GROUP BY r.source""",
)
def selected_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages in order, missing ones empty."""
    r = ref_pages(spark, sf_dir)
    h = hyp_pages(spark, sf_dir).select("page", F.col("body").alias("hyp"))
    j = r.join(h, "page", "left").withColumn("hyp", F.coalesce("hyp", F.lit("")))
    rows = F.sort_array(F.collect_list(F.struct("page", "hyp", "body")))
    g = j.groupBy("source").agg(rows.alias("rows"))
    both = lambda f: F.md5(F.array_join(F.transform("rows", f), "\n"))
    return g.select("source", both(lambda x: x.hyp).alias("hyp_digest"), both(lambda x: x.body).alias("ref_digest"))


@query(
    "j22_comparability",
    """WITH r AS (SELECT source, CAST(count(DISTINCT lang) AS VARCHAR) AS langs, CAST(min(n_chars) AS VARCHAR) AS shortest, max(lang) AS last_lang FROM documents GROUP BY source),
    f AS (SELECT * FROM r WHERE source = 'src0'),
    u AS (SELECT r.source, unnest(['langs', 'shortest', 'last_lang']) AS field, unnest([r.langs, r.shortest, r.last_lang]) AS mine, unnest([f.langs, f.shortest, f.last_lang]) AS first FROM r, f)
    SELECT source, field, mine, first FROM u WHERE mine IS DISTINCT FROM first""",
)
def comparability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per input in which a run differs from the first run."""
    fields = ["langs", "shortest", "last_lang"]
    r = docs(spark, sf_dir).groupBy("source").agg(F.countDistinct("lang").cast("string").alias("langs"), F.min("n_chars").cast("string").alias("shortest"), F.max("lang").alias("last_lang"))
    u = r.unpivot("source", fields, "field", "mine")
    first = u.where("source = 'src0'").select("field", F.col("mine").alias("first"))
    return u.join(F.broadcast(first), "field").where(~F.col("mine").eqNullSafe(F.col("first"))).select("source", "field", "mine", "first")


@query(
    "j23_side_by_side",
    f"""WITH {RUN} SELECT coalesce(r.page, h.page) AS page, CASE WHEN h.page IS NULL THEN 'not_run' WHEN r.page IS NULL THEN 'extra' ELSE 'both' END AS state, length(h.body) AS hyp_chars
    FROM (SELECT * FROM ref WHERE page % 5 <> 0) r FULL JOIN hyp h ON r.page = h.page""",
)
def side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ref_pages(spark, sf_dir).where("page % 5 <> 0").select("page", F.lit(True).alias("r"))
    h = hyp_pages(spark, sf_dir).select("page", F.lit(True).alias("h"), F.length("body").cast("long").alias("hyp_chars"))
    state = F.when(F.col("h").isNull(), "not_run").when(F.col("r").isNull(), "extra").otherwise("both")
    return r.join(h, "page", "full").select("page", state.alias("state"), "hyp_chars")


@query(
    "k14_page_sets",
    f"""WITH {RUN}, a AS (SELECT page FROM ref WHERE page % 5 <> 0), s AS (
      SELECT page, 'selected' AS kind FROM (SELECT page FROM a INTERSECT SELECT page FROM hyp) UNION ALL
      SELECT page, 'missing' FROM (SELECT page FROM a EXCEPT SELECT page FROM hyp) UNION ALL SELECT page, 'extra' FROM (SELECT page FROM hyp EXCEPT SELECT page FROM a))
    SELECT kind, count(*) AS n, min(page) AS first FROM s GROUP BY kind""",
)
def page_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ref_pages(spark, sf_dir).where("page % 5 <> 0").select("page")
    h = hyp_pages(spark, sf_dir).select("page")
    sets = {"selected": a.intersect(h), "missing": a.subtract(h), "extra": h.subtract(a)}
    parts = [d.withColumn("kind", F.lit(k)) for k, d in sets.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("first"))
