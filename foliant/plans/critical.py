"""Critical data: format scores, label types, typed values, rewrite guard, multisets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import critical as C
from ..functions import distance as D
from ..functions import text as T
from ..operators import multiset as M
from .base import table
from .registry import query
from .text import CPF1, CPF2, DIGIT, docs

CNPJ_WEIGHTS = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
CNPJ1 = " + ".join(f"{DIGIT.format(i + 1)} * {w}" for i, w in enumerate(CNPJ_WEIGHTS))
CNPJ2 = " + ".join(f"{DIGIT.format(i + 1)} * {w}" for i, w in enumerate([6, *CNPJ_WEIGHTS]))
#: Readings of nine kinds, right and wrong ones of each, made from the numbers of orders.
READINGS = """r AS (SELECT o_orderkey, lpad(CAST((o_orderkey * 7919 + o_custkey * 104729) % 100000000000 AS VARCHAR), 11, '0') AS e,
    lpad(CAST((o_orderkey * 15485863 + o_custkey) % 100000000000000 AS VARCHAR), 14, '0') AS f, CAST(o_custkey AS VARCHAR) AS c, o_orderkey % 40 AS dd, o_custkey % 14 AS mm FROM orders),
 t AS (SELECT o_orderkey, CASE o_orderkey % 9
    WHEN 0 THEN substr(e, 1, 3) || '.' || substr(e, 4, 3) || '.' || substr(e, 7, 3) || '-' || substr(e, 10, 2)
    WHEN 1 THEN substr(f, 1, 2) || '.' || substr(f, 3, 3) || '.' || substr(f, 6, 3) || '/' || substr(f, 9, 4) || '-' || substr(f, 13, 2)
    WHEN 2 THEN 'R$ ' || c || ',' || substr(e, 1, 2 + CAST(o_orderkey % 2 AS INTEGER))
    WHEN 3 THEN CAST(dd AS VARCHAR) || '/' || CAST(mm AS VARCHAR) || '/20' || substr(e, 10, 2)
    WHEN 4 THEN substr(e, 9, 3) || ',' || substr(e, 1, 1) || ' %'
    WHEN 5 THEN ' ' || CAST(mm AS VARCHAR) || ':' || substr(e, 10, 2)
    WHEN 6 THEN substr(e, 1, 5) || '-' || substr(e, 6, 3)
    WHEN 7 THEN substr(f, 1, 7) || '-' || substr(f, 8, 2) || '.2024.8.' || substr(e, 1, 2) || '.' || substr(e, 3, 4)
    ELSE 'NF-' || c END AS s FROM r)"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders_of_readings")
    return spark.sql(f"WITH {READINGS.replace('VARCHAR', 'STRING').replace('FROM orders)', 'FROM orders_of_readings)')} SELECT * FROM t")


KINDS = ["cpf", "cnpj", "currency", "date", "percentage", "numeric", "time", "cep", "process_number", "invoice_number"]
SCORES = rf"""
 g AS (SELECT *, trim(s) AS b, regexp_replace(s, '[^0-9]', '', 'g') AS d, regexp_extract(s, '\d{{1,2}}[/\-\.]\d{{1,2}}[/\-\.]\d{{4}}', 0) AS met,
   try_cast(trim(replace(regexp_replace(regexp_extract(s, '\d+[,.]?\d*\s*%', 0), '[% ]', '', 'g'), ',', '.')) AS DOUBLE) AS share FROM t),
 v AS (SELECT *, CASE WHEN length(d) = 11 THEN len(list_distinct(string_split(d, ''))) > 1 AND {DIGIT.format(10)} = CASE WHEN ({CPF1}) % 11 < 2 THEN 0 ELSE 11 - ({CPF1}) % 11 END
      AND {DIGIT.format(11)} = CASE WHEN ({CPF2}) % 11 < 2 THEN 0 ELSE 11 - ({CPF2}) % 11 END END AS cpf_ok,
   CASE WHEN length(d) = 14 THEN len(list_distinct(string_split(d, ''))) > 1 AND {DIGIT.format(13)} = CASE WHEN ({CNPJ1}) % 11 < 2 THEN 0 ELSE 11 - ({CNPJ1}) % 11 END
      AND {DIGIT.format(14)} = CASE WHEN ({CNPJ2}) % 11 < 2 THEN 0 ELSE 11 - ({CNPJ2}) % 11 END END AS cnpj_ok FROM g)
 SELECT o_orderkey, s,
   CAST(CASE WHEN length(d) <> 11 THEN 0 WHEN NOT regexp_matches(s, '\d{{3}}\.?\d{{3}}\.?\d{{3}}-?\d{{2}}') THEN 0.3 WHEN cpf_ok THEN 1 ELSE 0.6 END AS DOUBLE) AS cpf,
   CAST(CASE WHEN length(d) <> 14 THEN 0 WHEN NOT regexp_matches(s, '\d{{2}}\.?\d{{3}}\.?\d{{3}}/?\.?\d{{4}}-?\d{{2}}') THEN 0.3 WHEN cnpj_ok THEN 1 ELSE 0.6 END AS DOUBLE) AS cnpj,
   CAST(CASE WHEN regexp_matches(s, 'R\$\s*(?:\d{{1,3}}(?:\.\d{{3}})+|\d+),\d{{2}}(?:\D|$)') THEN 1 WHEN regexp_full_match(b, '(?:R\$\s*)?(?:\d{{1,3}}(?:\.\d{{3}})+|\d+),\d{{2}}') THEN 0.85
      WHEN contains(s, 'R$') THEN 0.5 ELSE 0 END AS DOUBLE) AS currency,
   CAST(CASE WHEN met = '' THEN 0 WHEN try_strptime(met, ['%d/%m/%Y', '%d-%m-%Y', '%d.%m.%Y']) IS NOT NULL THEN 1 ELSE 0.4 END AS DOUBLE) AS date,
   CAST(CASE WHEN NOT regexp_matches(s, '\d+[,.]?\d*\s*%') THEN 0 WHEN share BETWEEN 0 AND 100 THEN 1 ELSE 0.4 END AS DOUBLE) AS percentage,
   CAST(CASE WHEN NOT regexp_matches(s, '\d[\d.]*,\d+|\d{{4,}}') THEN 0 WHEN regexp_full_match(s, '[\d.,/\-% ]*') THEN 1 ELSE 0.4 END AS DOUBLE) AS numeric,
   CAST(CASE WHEN regexp_full_match(b, '(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d)?') THEN 1 ELSE 0 END AS DOUBLE) AS time,
   CAST(CASE WHEN length(d) = 8 AND regexp_full_match(b, '\d{{5}}-?\d{{3}}') THEN 1 ELSE 0 END AS DOUBLE) AS cep,
   CAST(CASE WHEN regexp_full_match(b, '\d{{7}}-\d{{2}}\.\d{{4}}\.\d\.\d{{2}}\.\d{{4}}') THEN 1 WHEN length(d) = 20 THEN 0.35 ELSE 0 END AS DOUBLE) AS process_number,
   CAST(CASE WHEN regexp_full_match(b, '\d{{1,15}}') THEN 1 WHEN regexp_full_match(b, '(?i)[A-Z0-9][A-Z0-9./-]{{1,19}}') THEN 0.65 ELSE 0 END AS DOUBLE) AS invoice_number
 FROM v"""


@query("f22_format_scores", f"WITH {READINGS}, {SCORES}")
def f22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).select("o_orderkey", "s", *[C.format_score(F.col("s"), F.lit(k)).alias(k) for k in KINDS])


@query(
    "k08_ranked_by_format",
    f"WITH {READINGS}, x AS ({f'WITH {SCORES.strip()}'}), k AS (SELECT o_orderkey // 9 AS cell, o_orderkey, cpf AS score, row_number() OVER (PARTITION BY o_orderkey // 9 ORDER BY cpf DESC, o_orderkey) AS place FROM x) SELECT * FROM k",
)
def k08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a cell by their score as one type; equal ones keep their order."""
    from pyspark.sql import Window as W

    r = readings(spark, sf_dir).withColumn("score", C.format_score(F.col("s"), F.lit("cpf"))).withColumn("cell", F.expr("o_orderkey div 9"))
    return r.select("cell", "o_orderkey", "score", F.row_number().over(W.partitionBy("cell").orderBy(F.col("score").desc(), "o_orderkey")).alias("place"))


LABEL_ROWS = ", ".join(f"({i}, '{n}', '{k}')" for i, (k, n) in enumerate((k, n) for k, ns in C.LABELS.items() for n in ns))


@query(
    "f23_context_type",
    f"""WITH known(i, name, kind) AS (VALUES {LABEL_ROWS}), first AS (SELECT name, min_by(kind, i) AS kind FROM known GROUP BY name),
    l AS (SELECT o_orderkey, (SELECT count(*) FROM known) AS n FROM orders),
    x AS (SELECT o_orderkey, unnest([0, 1, 2]) AS pos, o_orderkey % (n + 7) AS a, (o_orderkey * 31) % (n + 20) AS b, (o_orderkey * 17) % n AS c FROM l),
    y AS (SELECT o_orderkey, pos, k.name FROM x JOIN known k ON k.i = CASE pos WHEN 0 THEN a WHEN 1 THEN b ELSE c END)
    SELECT o.o_orderkey, min_by(f.kind, y.pos) AS kind FROM orders o LEFT JOIN y USING (o_orderkey) LEFT JOIN first f ON f.name = y.name GROUP BY o.o_orderkey""",
)
def f23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of the first known label near a value; labels come in capitals with
    a colon, and some are known to none."""
    names = [n for ns in C.LABELS.values() for n in ns]
    k, n = F.col("o_orderkey"), len(names)
    pick = lambda i: F.concat(F.lit(" "), F.upper(F.coalesce(F.get(F.array(*map(F.lit, names)), i.cast("int")), F.lit("nenhum"))), F.lit(": "))
    labels = [C.normalize_label(pick(i)) for i in (k % (n + 7), (k * 31) % (n + 20), (k * 17) % n)]
    return table(spark, sf_dir, "orders").select("o_orderkey", C.context_type(F.array(*labels)).alias("kind"))


@query("f24_critical_values", None)
def f24(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("CPF 123.456.789-09 em 01/02/2024, processo 0001234-56.2024.8.26.0100 "), "text")
    return docs(spark, sf_dir).select("doc_id", F.array_join(C.critical_values(t), " ").alias("found"))


@query(
    "f25_signed_amounts",
    r"""WITH m AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '-' ELSE '+' END AS sign, CAST(round(o_totalprice, 2) AS DECIMAL(20,2)) AS money, o_custkey % 100 AS share, o_custkey % 10 AS tenth FROM orders)
    SELECT o_orderkey, 'money:' || sign || ':' || CAST(money AS VARCHAR) || ' percentage:-:' || CAST(share AS VARCHAR) || CASE WHEN tenth = 0 THEN '' ELSE '.' || tenth END AS amounts FROM m""",
)
def f25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in thousands groups with and without a sign; what only looks like
    one (letters before R$, three decimals, a word after %) is passed over."""
    money = F.format_string("%,.2f", F.round("o_totalprice", 2))
    money = F.translate(money, ",.", ".,")
    sign = F.element_at(F.array(F.lit("- "), F.lit("+"), F.lit("")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    share = F.concat(F.lit("-"), (F.col("o_custkey") % 100).cast("string"), F.lit(","), (F.col("o_custkey") % 10).cast("string"), F.lit("0 %"))
    t = F.concat(F.lit("r$ "), sign, money, F.lit(" e "), share, F.lit("; xR$ 1,00 R$ 1,234 7%a 1234%"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(C.signed_values(t), " ").alias("amounts"))


@query("e06_rewrite_guard", None)
def e06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a garbled reading of each whole document may replace it."""
    old = F.col("text")
    new = F.when(F.col("doc_id") % 3 == 0, F.substring(old, F.lit(1), (F.length(old) * 0.55).cast("int"))).otherwise(F.replace(old, F.lit("th"), F.lit("d")))
    key = lambda c: F.regexp_replace(T.nfkc_casefold(c), r"(?U)\s", "")
    d = docs(spark, sf_dir).select("doc_id", old.alias("old"), new.alias("new"))
    return d.select("doc_id", C.conserves(F.col("old"), F.col("new"), D.sequence_ratio(key("old"), key("new"))).alias("conserves"))


def _value(pattern: str, t: str) -> str:
    return f"regexp_extract_all({t}, '{pattern}')"


TYPED = {
    k: " UNION ALL ".join(f"SELECT source, unnest({_value(p, 'body')}) AS v FROM {{side}}" for p in ps) for k, ps in C.COUNTED.items()
}
A06_SQL = """WITH ref AS (SELECT source, text AS body FROM documents), hyp AS (SELECT source, replace(text, '1', '7') AS body FROM documents WHERE doc_id % 17 <> 0), """ + ", ".join(
    f"r_{k} AS (SELECT source, v, count(*) AS nr FROM ({q.replace('{side}', 'ref')}) GROUP BY ALL), h_{k} AS (SELECT source, v, count(*) AS nh FROM ({q.replace('{side}', 'hyp')}) GROUP BY ALL), "
    f"c_{k} AS (SELECT source, '{k}' AS kind, sum(least(coalesce(nr, 0), coalesce(nh, 0))) AS tp, sum(coalesce(nh, 0)) AS n_hyp, sum(coalesce(nr, 0)) AS n_ref FROM r_{k} FULL JOIN h_{k} USING (source, v) GROUP BY source)"
    for k, q in TYPED.items()
) + ", a AS (" + " UNION ALL ".join(f"SELECT * FROM c_{k}" for k in TYPED) + """),
 k AS (SELECT DISTINCT source, kind FROM documents, (SELECT unnest(['numeric', 'date', 'currency', 'identifier']) AS kind)),
 p AS (SELECT k.source, k.kind, coalesce(tp, 0) AS tp, coalesce(n_hyp, 0) AS n_hyp, coalesce(n_ref, 0) AS n_ref FROM k LEFT JOIN a ON a.source IS NOT DISTINCT FROM k.source AND a.kind = k.kind),
 q AS (SELECT *, CASE WHEN n_ref = 0 AND kind <> 'identifier' THEN 1.0 WHEN n_hyp > 0 THEN round(tp / CAST(n_hyp AS DOUBLE), 4) WHEN n_ref = 0 THEN 1.0 ELSE 0.0 END AS precision,
   CASE WHEN n_ref = 0 THEN 1.0 ELSE round(tp / CAST(n_ref AS DOUBLE), 4) END AS recall FROM p)
 SELECT source, kind, CAST(tp AS BIGINT) AS tp, CAST(n_hyp AS BIGINT) AS n_hyp, CAST(n_ref AS BIGINT) AS n_ref, CAST(precision AS DOUBLE) AS precision, CAST(recall AS DOUBLE) AS recall,
   CASE WHEN n_ref = 0 AND kind <> 'identifier' THEN 1.0 WHEN precision + recall > 0 THEN round(2 * precision * recall / (precision + recall), 4) ELSE 0.0 END AS f1 FROM q"""


@query("a05_a06_critical_data", A06_SQL)
def critical_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, dates, amounts and identifiers of two runs as multisets, per source.

    An empty reference is perfect by convention; of identifiers only its recall is."""
    d = docs(spark, sf_dir)
    ref = d.select("source", F.col("text").alias("body"))
    hyp = d.where("doc_id % 17 <> 0").select("source", F.replace("text", F.lit("1"), F.lit("7")).alias("body"))

    def values(side: DataFrame) -> DataFrame:
        typed = F.array(*[F.struct(F.lit(k).alias("kind"), C.counted_values(F.col("body"), k).alias("vs")) for k in C.COUNTED])
        one = side.select("source", F.explode(typed).alias("t")).select("source", "t.kind", F.explode("t.vs").alias("v"))
        return one

    counts = M.overlap(values(hyp), values(ref), ["source", "kind"], "v")
    kinds = F.explode(F.array(*map(F.lit, C.COUNTED)))
    every = d.select("source").distinct().select("source", kinds.alias("kind"))
    at = every.join(counts.withColumnsRenamed({"source": "s", "kind": "k"}), F.col("source").eqNullSafe(F.col("s")) & (F.col("kind") == F.col("k")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    at = at.select("source", "kind", zero(F.col("tp")).alias("tp"), (zero(F.col("tp")) + zero(F.col("fp"))).alias("n_hyp"), (zero(F.col("tp")) + zero(F.col("fn"))).alias("n_ref"))
    return at.select("*", *[c.alias(n) for n, c in M.match_rates(F.col("tp"), F.col("n_hyp"), F.col("n_ref"), F.col("kind") != "identifier").items()])


def allowlist(kind: Column) -> Column:
    return C.allowed_characters(kind)


F28_WORDS = 12


@query("f28_cell_recovery", None)
def f28(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell texts that lost their spaces and case come back from the words of the
    page: the shortest run of at most twelve words that is equal once both are
    compact. Cells are runs of words of each document, the page is the whole text."""
    d = docs(spark, sf_dir).select("doc_id", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("w"))
    n = F.size("w")
    places = F.explode(F.sequence(F.lit(0), n - 1, F.lit(40)))
    cells = d.where(n > 0).select("doc_id", "w", places.alias("at")).select(
        "doc_id", "at", F.lower(F.array_join(F.slice("w", F.col("at") + 1, F.lit(3)), "")).alias("cell"))
    return recover_cells(cells, d.select("doc_id", "w"), "doc_id", "cell", "w").select("doc_id", "at", "cell", "recovered")


WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def compact(t: str) -> str:
    return WHITE.sub("", t.casefold())


def runs_of_cells(words: list[str], cells: list[str]) -> list[tuple[str, str, int, int]]:
    """cell, run, number of words and start of the first shortest run that is equal to a
    cell once both are compact. Runs end where they have more marks than any cell."""
    by: dict[str, list[str]] = {}
    for c in cells:
        if len(short := compact(c)) >= 2:
            by.setdefault(short, []).append(c)
    most, best = max(map(len, by), default=0), {}
    forms = [(compact(w or ""), len((w or "").replace(" ", ""))) for w in words]
    for start in range(len(words) if by else 0):
        run, marks = "", 0
        for n, (form, k) in enumerate(forms[start : start + F28_WORDS], 1):
            run, marks = run + form, marks + k
            if marks > most:
                break
            if run in by and (n, start) < best.get(run, (n + 1,)):
                best[run] = n, start
    return [(c, " ".join(w for w in words[at : at + n] if w is not None), n, at) for run, (n, at) in best.items() for c in by[run]]


@F.pandas_udf(ArrayType(StructType([StructField("cell", StringType()), StructField("run", StringType()), StructField("n", IntegerType()), StructField("at", IntegerType())])))
def found_runs(words: pd.Series, cells: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("cell", "run", "n", "at"), r, strict=True)) for r in runs_of_cells(list(w), list(c))] for w, c in zip(words, cells, strict=True)], dtype=object)


def recover_cells(cells: DataFrame, pages: DataFrame, key: str, cell: str, words: str) -> DataFrame:
    """``cells`` with ``recovered``: see f28. The cells of a page meet its words as
    arrays, so no run is a row; of one length the first run on the page wins.
    Cells of under two characters and those without a match stay as they are."""
    wanted = cells.groupBy(key).agg(F.collect_set(cell).alias("_cells"))
    found = pages.where(F.col(words).isNotNull()).join(wanted, key).select(key, F.inline(found_runs(F.col(words), F.col("_cells"))))
    best = found.groupBy(key, F.col("cell").alias("_cell")).agg(F.min_by("run", F.struct("n", "at")).alias("_found")).withColumnRenamed(key, "_key")
    met = cells.join(best, (F.col(key) == F.col("_key")) & (F.col(cell) == F.col("_cell")), "left")
    return met.withColumn("recovered", F.coalesce("_found", F.col(cell))).drop("_found", "_key", "_cell")


@query("f17_f19_token_predicates", None)
def token_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are source code, and tokens no reader would have typed."""
    w = docs(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("row")).distinct()
    t = F.element_at(F.split("row", " "), 1)
    return w.select("row", T.looks_like_code(T.casefold("row")).alias("code"), T.suspicious(t, F.lit(3000.0), F.lit(0.5)).alias("suspicious"))
