"""Text expressions. Built-in functions wherever Spark has them; the few Unicode
operations it lacks (normal forms, case folding) are Arrow functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1C-\x1F]"


def _each(f):  # noqa: ANN001, ANN202
    """A scalar Arrow function that passes nulls through."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


nfc = F.pandas_udf(_each(lambda t: unicodedata.normalize("NFC", t)), T.StringType())
nfkc_casefold = F.pandas_udf(_each(lambda t: unicodedata.normalize("NFKC", t).casefold()), T.StringType())
casefold = F.pandas_udf(_each(str.casefold), T.StringType())


@F.pandas_udf(T.StringType())
def nfkd_letters(s: pd.Series) -> pd.Series:
    """Compatibility form without marks, letters and digits only, case folded."""

    def one(t: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c) and c.isalnum()).casefold()

    return s.map(one, na_action="ignore")


_WORD = re.compile(r"[\w]+(?:[-'][\w]+)*")


@F.pandas_udf(T.ArrayType(T.StringType()))
def accented_words(s: pd.Series) -> pd.Series:
    """Words that hold a combining mark once decomposed."""

    def one(t: str) -> list[str]:
        return [w for w in _WORD.findall(t.casefold()) if any(unicodedata.combining(c) for c in unicodedata.normalize("NFD", w))]

    return s.map(one, na_action="ignore")


def unify_lines(t: Column) -> Column:
    return F.regexp_replace(t, r"\r\n?", "\n")


def drop_controls(t: Column) -> Column:
    return F.regexp_replace(t, r"[\p{C}&&[^\n\r\t]]", "")


def normalize_text(t: Column) -> Column:
    """Line ends unified, NFC, no control characters but line ends and tabs."""
    return drop_controls(nfc(unify_lines(t)))


def expand_ligatures(t: Column) -> Column:
    for one, many in LIGATURES.items():
        t = F.replace(t, F.lit(one), F.lit(many))
    return t


def normalize_reading_text(t: Column) -> Column:
    return expand_ligatures(normalize_text(t))


def squeeze_lines(t: Column) -> Column:
    """White space inside each line to one space, lines and the whole trimmed."""
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")


def strip_page_heading(t: Column) -> Column:
    """Without a page heading at the very start."""
    return F.trim(F.regexp_replace(t, r"^(?i)##\s+p[áa]gina\s+[^\n]*\n?", ""))


def strip_markdown(t: Column) -> Column:
    """Reading text of Markdown, line by line: comments go, and with them rules of
    tables; heading and quote marks at the start, emphasis and code marks go; a
    line with bars becomes its cells two spaces apart."""

    def line(x: Column) -> Column:
        plain = F.regexp_replace(x, r"(?U)^#{1,6}\s+", "")
        plain = F.regexp_replace(plain, r"^> ", "")
        cells = F.filter(F.transform(F.split(plain, r"\|"), lambda c: F.trim(c)), lambda c: (c != "") & ~c.rlike(r"^[-:]+$"))
        row = F.when(F.size(cells) > 0, F.array_join(cells, "  "))
        plain = F.when(plain.contains("|"), row).otherwise(plain)
        for mark in (r"\*{1,2}([^*]+)\*{1,2}", r"_{1,2}([^_]+)_{1,2}", r"`([^`]+)`"):
            plain = F.regexp_replace(plain, mark, "$1")
        return plain

    lines = F.filter(F.split(t, "\n"), lambda x: ~F.trim(x).startswith("<!--"))
    done = F.filter(F.transform(lines, line), lambda x: x.isNotNull())
    return squeeze_lines(F.array_join(done, "\n"))


def words(t: Column) -> Column:
    """Unicode words, with hyphens and apostrophes inside."""
    return F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}_]+(?:[-'][\p{L}\p{N}_]+)*"), 0)


def duplicate_line_ratio(t: Column) -> Column:
    lines = F.filter(F.transform(F.split(F.lower(t), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    n = F.size(lines)
    return F.when(n > 0, (n - F.size(F.array_distinct(lines))) / n).otherwise(F.lit(0.0))


def furniture_signature(t: Column) -> Column:
    """What stays equal of a header or footer from page to page; null if under 3
    characters. Only numbers that a page label names are taken out. ``t`` is case folded."""
    label = r"(?U)\b(?:página|pagina|page)\s+\d+"
    s = F.trim(t)
    for rest in (r"\s+(?:de|of)\s+\d+\b", r"\s*/\s*\d+\b", r"\b"):
        s = F.regexp_replace(s, label + rest, "<page-number>")
    s = F.trim(F.regexp_replace(s, r"(?U)\s+", " "), F.lit(" -|·"))
    return F.when(F.length(s) >= 3, s)


def value_type(t: Column) -> Column:
    """empty, numeric (digits and at most three letters), mixed or text."""
    digits, letters = F.regexp_count(t, F.lit(r"\p{Nd}")), F.regexp_count(t, F.lit(r"\p{L}"))
    return (
        F.when(F.trim(t) == "", "empty").when((digits > 0) & (letters <= 3), "numeric").when(digits > 0, "mixed").otherwise("text")
    )


LIST_MARKER = r"^\s*([•◦▪‣*-]|\d{1,3}[.)]|[A-Za-z][.)]|[ivxlcdmIVXLCDM]{1,6}[.)])\s+(\S.*)$"


def list_marker(t: Column) -> tuple[Column, Column]:
    """Marker and body of a list line; both empty for other lines."""
    return F.regexp_extract(t, LIST_MARKER, 1), F.regexp_extract(t, LIST_MARKER, 2)


def is_hyphen_break(before: Column, after: Column) -> Column:
    """A word broken at the line end; codes with digits are left alone."""
    code = F.regexp_extract(before, r"(\S+)-$", 1).rlike(r"\d")
    return before.rlike(r"\p{L}-$") & after.rlike(r"^\p{Ll}") & ~code


def looks_like_code(t: Column) -> Column:
    """A row of source code: it opens with a statement or a comment, or assigns
    with at least three marks of programming. ``t`` is case folded."""
    row = F.trim(F.regexp_replace(t, r"(?U)\s+", " "))
    opens = row.rlike(r"^(?:def |for |while |if |elif |else:|return |//|# )")
    return opens | (row.contains(" = ") & (F.regexp_count(row, F.lit(r"[()\[\]{}_=/*]")) >= 3))


def odd_character_ratios(t: Column) -> dict[str, Column]:
    """Shares of replacement, private-use and other control characters."""
    n = F.greatest(F.length(t), F.lit(1))
    visible = F.greatest(F.regexp_count(t, F.lit(r"\S")), F.lit(1))
    return {
        "replacement": F.regexp_count(t, F.lit("�")) / n,
        "private_use": F.regexp_count(t, F.lit(r"\p{Co}")) / n,
        "control": F.regexp_count(t, F.lit(r"[\p{C}&&[^\s]]")) / visible,
    }


def suspicious(t: Column, box_area: Column, confidence: Column) -> Column:
    """Tokens no reader would have typed: hardly printable, controls, nothing but
    punctuation or one repeated mark, or one unsure character in a large box. A
    null confidence is none."""
    n = F.length(t)
    share = lambda p: F.regexp_count(t, F.lit(p)) / n
    alnum = F.regexp_count(t, F.lit(r"[\p{L}\p{N}]"))
    chars = F.split(t, "")
    most = F.array_max(F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c))))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence.cast("double"), F.lit(0.0))))
    return (
        (n == 0)
        | (share(r"[\p{C}\p{Z}&&[^ ]]") > 0.1)
        | (share(r"\p{C}") > 0.1)
        | ((alnum == 0) & (n >= 4) & (share(r"\p{P}") > 0.8))
        | ((alnum == 0) & (n >= 5) & (most / n > 0.82))
        | ((n == 1) & (box_area > 2500) & (sure < 0.7))
    )


def orientation_plausible(t: Column, width: Column, height: Column, rotation: Column) -> Column:
    """Whether a box is longer along the token's own direction; one character always fits."""
    turned = F.pmod(F.coalesce(rotation, F.lit(0)), F.lit(360)).isin(90, 270)
    fits = F.when(turned, height >= width * 1.15).otherwise(width >= height * 1.15)
    return (F.length(F.trim(t)) <= 1) | fits


def language_alias(t: Column) -> Column:
    """Canonical language codes of the names recognisers use."""
    table = {"pt": ("pt", "por", "pt-br", "pt_br", "portuguese", "latin"), "en": ("en", "eng", "english"), "es": ("es", "spa", "spanish"), "fr": ("fr", "fra", "french"), "de": ("de", "deu", "german")}
    key, out = F.lower(F.trim(t)), F.lit(None).cast("string")
    for code, names in table.items():
        out = F.when(key.isin(*names), code).otherwise(out)
    return F.coalesce(out, key)


def compact(t: Column) -> Column:
    return F.regexp_replace(t, r"\s+", "")
