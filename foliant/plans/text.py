"""Text: normal forms, markup removal, words, signatures, critical data, distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import critical as C
from ..functions import distance as D
from ..functions import text as T
from .base import table
from .registry import query


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(
    "f01_normalize_text",
    r"""SELECT doc_id, regexp_replace(nfc_normalize(regexp_replace(text, '\r\n?', chr(10), 'g')), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]', '', 'g') AS text FROM documents""",
)
def f01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.normalize_text(F.col("text")).alias("text"))


@query(
    "f02_reading_text",
    r"""SELECT doc_id, md5(replace(nfc_normalize(text), 'ft', 'st')) AS digest FROM documents""",
)
def f02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ligatures come back as letters: the input has every fi glued, and a long s
    with t (U+FB05), which reads st, for every ft."""
    glued = F.replace(F.replace(F.col("text"), F.lit("fi"), F.lit("ﬁ")), F.lit("ft"), F.lit("ﬅ"))
    return docs(spark, sf_dir).select("doc_id", F.md5(T.normalize_reading_text(glued)).alias("digest"))


@query(
    "f03_squeeze_lines",
    r"""SELECT doc_id, md5(trim(array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), chr(10)), ' ' || chr(10) || chr(9))) AS digest FROM documents""",
)
def f03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(T.squeeze_lines(T.nfc(F.col("text")))).alias("digest"))


WORDS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+(?:[-''][\p{L}\p{N}_]+)*')"


@query("f07_words", f"SELECT doc_id, CAST(len({WORDS}) AS INTEGER) AS n, md5(array_to_string({WORDS}, ' ')) AS digest FROM documents")
def f07(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = T.words(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(w).alias("n"), F.md5(F.array_join(w, " ")).alias("digest"))


@query("f08_accented_words", None)
def f08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.size(T.accented_words(F.col("text"))).alias("accented"))


@query(
    "f09_duplicate_lines",
    """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(lower(text), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents)
    SELECT doc_id, CASE WHEN len(ls) > 0 THEN CAST(len(ls) - len(list_distinct(ls)) AS DOUBLE) / len(ls) ELSE 0 END AS ratio FROM l""",
)
def f09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.duplicate_line_ratio(F.col("text")).alias("ratio"))


@query(
    "f10_signature",
    r"""WITH s AS (SELECT doc_id, lower(split_part(text, chr(10), 1)) || ' página ' || doc_id || CASE doc_id % 3 WHEN 0 THEN ' de 90' WHEN 1 THEN ' / 90' ELSE ' |' END AS t FROM documents),
    r AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\b(?:página|pagina|page)\s+\d+\s+(?:de|of)\s+\d+\b', '<page-number>', 'g'), '\b(?:página|pagina|page)\s+\d+\s*/\s*\d+\b', '<page-number>', 'g'),
      '\b(?:página|pagina|page)\s+\d+\b', '<page-number>', 'g'), '\s+', ' ', 'g'), ' -|·') AS s FROM s)
    SELECT doc_id, CASE WHEN length(s) >= 3 THEN s END AS signature FROM r""",
)
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    total = F.when(k % 3 == 0, " de 90").when(k % 3 == 1, " / 90").otherwise(" |")
    t = F.concat(F.lower(F.split("text", "\n")[0]), F.lit(" página "), k.cast("string"), total)
    return docs(spark, sf_dir).select("doc_id", T.furniture_signature(t).alias("signature"))


@query("f11_f26_keys", None)
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header keys without marks, and compatibility keys for similarity."""
    head = F.split("text", "\n")[0]
    return docs(spark, sf_dir).select("doc_id", T.nfkd_letters(head).alias("header_key"), T.compact(T.nfkc_casefold(head)).alias("similarity_key"))


@query(
    "f12_value_types",
    r"""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents),
    t AS (SELECT doc_id, CASE WHEN trim(w) = '' THEN 'empty' WHEN regexp_matches(w, '\p{Nd}') AND len(regexp_extract_all(w, '\p{L}')) <= 3 THEN 'numeric'
      WHEN regexp_matches(w, '\p{Nd}') THEN 'mixed' ELSE 'text' END AS kind FROM w)
    SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t GROUP BY kind""",
)
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", " ")).alias("w"))
    return w.groupBy(T.value_type(F.col("w")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


MARKER = r"^\s*([•◦▪‣*-]|\d{1,3}[.)]|[A-Za-z][.)]|[ivxlcdmIVXLCDM]{1,6}[.)])\s+(\S.*)$"


@query(
    "f13_f14_list_lines",
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    m AS (SELECT doc_id, CASE i % 3 WHEN 0 THEN i || '. ' || line WHEN 1 THEN '• ' || line ELSE line END AS line FROM l)
    SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, '{MARKER}')) / CAST(count(*) AS DOUBLE) AS list_ratio, count(DISTINCT regexp_extract(line, '{MARKER}', 1)) AS markers FROM m GROUP BY doc_id""",
)
def f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("i", F.col("i") + 1)
    line = F.when(F.col("i") % 3 == 0, F.concat(F.col("i").cast("string"), F.lit(". "), "line")).when(F.col("i") % 3 == 1, F.concat(F.lit("• "), "line")).otherwise(F.col("line"))
    marker, _ = T.list_marker(F.col("line"))
    return lines.withColumn("line", line).groupBy("doc_id").agg(F.avg((marker != "").cast("double")).alias("list_ratio"), F.countDistinct(marker).alias("markers"))


@query(
    "f15_d10_dehyphenate",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    h AS (SELECT doc_id, i, regexp_replace(line, '\W+$', '') || '-' AS line, lower(lead(line) OVER (PARTITION BY doc_id ORDER BY i)) AS next FROM l)
    SELECT doc_id, i, regexp_matches(line, '\p{L}-$') AND regexp_matches(next, '^\p{Ll}') AND NOT regexp_matches(regexp_extract(line, '(\S+)-$', 1), '\d') AS joins
    FROM h WHERE next IS NOT NULL""",
)
def f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("i", (F.col("i") + 1).cast("long"))
    lines = lines.withColumn("next", F.lower(F.lead("line").over(W.partitionBy("doc_id").orderBy("i")))).where("next IS NOT NULL")
    return lines.select("doc_id", "i", T.is_hyphen_break(F.concat(F.regexp_replace("line", r"\W+$", ""), F.lit("-")), F.col("next")).alias("joins"))


@query(
    "f18_odd_characters",
    r"""SELECT doc_id, length(regexp_replace(t, '[^�]', '', 'g')) / CAST(greatest(length(t), 1) AS DOUBLE) AS replacement,
      CAST(0 AS DOUBLE) AS private_use, CAST(0 AS DOUBLE) AS control
    FROM (SELECT doc_id, replace(text, 'q', '�') AS t FROM documents)""",
)
def f18(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", F.replace("text", F.lit("q"), F.lit("�")).alias("t"))
    return d.select("doc_id", *[c.alias(n) for n, c in T.odd_character_ratios(F.col("t")).items()])


DIGIT = "CAST(substr(d, {0}, 1) AS INTEGER)"
CPF1 = " + ".join(f"{DIGIT.format(i + 1)} * {10 - i}" for i in range(9))
CPF2 = " + ".join(f"{DIGIT.format(i + 1)} * {11 - i}" for i in range(10))


@query(
    "f21_check_digits",
    f"""WITH t AS (SELECT o_orderkey, lpad(CAST((o_orderkey * 7919 + o_custkey * 104729) % 100000000000 AS VARCHAR), 11, '0') AS d FROM orders),
    m AS (SELECT *, ({CPF1}) % 11 AS a, ({CPF2}) % 11 AS b FROM t)
    SELECT o_orderkey, d AS digits, len(list_distinct(string_split(d, ''))) > 1
      AND {DIGIT.format(10)} = CASE WHEN a < 2 THEN 0 ELSE 11 - a END AND {DIGIT.format(11)} = CASE WHEN b < 2 THEN 0 ELSE 11 - b END AS valid FROM m""",
)
def f21(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.lpad(((F.col("o_orderkey") * 7919 + F.col("o_custkey") * 104729) % 100000000000).cast("string"), 11, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", d.alias("digits"), C.valid_cpf(d).alias("valid"))


@query(
    "f29_f30_words_from_lines",
    r"""WITH t AS (SELECT conv_id, turn, text, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE trim(text) <> '')
    SELECT conv_id, string_agg(CASE WHEN before IS NULL OR before = role THEN text ELSE chr(10) || text END, '' ORDER BY turn) AS text FROM t GROUP BY conv_id""",
)
def f30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows join directly after a row of the same kind, else on a new line; blanks are passed over."""
    from pyspark.sql import Window as W

    t = table(spark, sf_dir, "conversations").where(F.trim("text") != "")
    before = F.lag("role").over(W.partitionBy("conv_id").orderBy("turn"))
    part = F.when(before.isNull() | (before == F.col("role")), F.col("text")).otherwise(F.concat(F.lit("\n"), "text"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("turn", "part"))), lambda x: x.part)
    return t.withColumn("part", part).groupBy("conv_id").agg(F.array_join(ordered, "").alias("text"))


@query(
    "f31_language_alias",
    """SELECT lang, count(*) AS n FROM documents GROUP BY lang""",
)
def f31(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("lang") == "en", " ENG ").when(F.col("lang") == "de", "German").when(F.col("lang") == "fr", "fra").when(F.col("lang") == "es", "spa").otherwise(F.col("lang"))
    return docs(spark, sf_dir).groupBy(T.language_alias(name).alias("lang")).agg(F.count(F.lit(1)).alias("n"))


def whole_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference and a garbled reading of each whole document, in ASCII."""
    plain = F.regexp_replace("text", r"[^ -~]", "")
    return docs(spark, sf_dir).select("doc_id", "lang", plain.alias("ref"), F.replace(plain, F.lit("th"), F.lit("d")).alias("hyp"))


@query("e01_e07_character_error", None)
def e01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits and error rates of whole texts, over characters and over words."""
    p = whole_pairs(spark, sf_dir)
    d, w = D.char_distance("hyp", "ref"), D.word_distance("hyp", "ref")
    n = F.size(F.filter(F.split("ref", r"\s+"), lambda x: x != ""))
    return p.select("doc_id", d.alias("edits"), w.alias("word_edits"), D.error_rate(d, F.length("ref")).alias("cer"), D.error_rate(w, n).alias("wer"))


@query("e02_word_operations", None)
def e02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the reading first: deletions are its extra words, insertions missing ones."""
    return whole_pairs(spark, sf_dir).withColumn("o", D.word_ops("hyp", "ref")).select("doc_id", "o.*", D.word_distance("hyp", "ref").alias("distance"))


@query("e03_common_subsequence", None)
def e03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_pairs(spark, sf_dir).select("doc_id", D.lcs(F.split("hyp", " "), F.split("ref", " ")).alias("lcs"))


@query("e04_pairwise_similarity", None)
def e04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_pairs(spark, sf_dir).withColumn("m", D.pairwise("ref", "hyp")).select("doc_id", "m.*")
