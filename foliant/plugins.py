"""Replaceable parts: detectors, recognisers and extractors as functions over
DataFrames, found by name and loaded when first asked for.

A recogniser or detector gives a schema and a function over Arrow batches, so
that it runs where the pages are; what it declares about itself (capabilities,
identity) is stamped on its rows.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENS = "doc_id long, page_index int, text string, x0 double, y0 double, x1 double, y1 double, confidence double, level string"
REGIONS = "doc_id long, page_index int, kind string, x0 double, y0 double, x1 double, y1 double, confidence double"
CELLS = "doc_id long, page_index int, table_id string, row int, col int, rowspan int, colspan int, text string"
#: Pages a part is given at once: each may become thousands of rows.
PAGES = 32
KINDS = {"recogniser": TOKENS, "detector": REGIONS, "table_recogniser": CELLS}


@dataclass(frozen=True)
class Plugin:
    """A part of one kind: ``run`` maps pandas batches of pages to rows of the
    kind's schema; a batch that fails gives no rows and counts as failed."""

    name: str
    kind: str
    run: Callable[[pd.DataFrame], pd.DataFrame]
    version: str = "0"
    capabilities: frozenset[str] = field(default_factory=frozenset)

    def supports(self, capability: str) -> bool:
        return capability in self.capabilities

    def apply(self, pages: DataFrame) -> DataFrame:
        """Rows of the kind with ``provenance``; columns the part doesn't give are null."""
        schema = KINDS[self.kind]
        names = [c.split()[0] for c in schema.split(", ")]
        run = self.run

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for i in range(0, len(b), PAGES):
                    yield run(b.iloc[i : i + PAGES]).reindex(columns=names)

        return pages.mapInPandas(each, schema).withColumn("provenance", self.provenance())

    def provenance(self) -> Column:
        """Who made a row: name, version and what it declares, sorted."""
        return F.struct(
            F.lit(self.name).alias("name"), F.lit(self.version).alias("version"),
            F.array(*[F.lit(c) for c in sorted(self.capabilities)]).cast("array<string>").alias("capabilities"))


_entries: dict[tuple[str, str], str | Plugin] = {}


def register(plugin: Plugin) -> Plugin:
    if plugin.kind not in KINDS:
        raise ValueError(f"unknown kind {plugin.kind!r}")
    _entries[plugin.kind, plugin.name] = plugin
    return plugin


def register_lazy(kind: str, name: str, where: str) -> None:
    """``where`` is module:attribute, imported when the part is first asked for."""
    _entries[kind, name] = where


def get(kind: str, name: str) -> Plugin:
    entry = _entries.get((kind, name))
    if entry is None:
        raise KeyError(f"no {kind} {name!r}; there are {', '.join(sorted(n for k, n in _entries if k == kind)) or 'none'}")
    if isinstance(entry, str):
        module, _, attribute = entry.partition(":")
        entry = _entries[kind, name] = getattr(importlib.import_module(module), attribute)
    return entry


def names(kind: str) -> list[str]:
    return sorted(n for k, n in _entries if k == kind)


def capability_facts(kind: str, wanted: list[str]) -> dict[str, dict[str, bool]]:
    return {n: {c: get(kind, n).supports(c) for c in wanted} for n in names(kind)}


def fake_recogniser(pages: pd.DataFrame) -> pd.DataFrame:
    """Deterministic tokens for tests: the words of a page's ``text`` side by side."""
    rows = []
    for doc, page, text in zip(pages["doc_id"], pages["page_index"], pages["text"], strict=True):
        x = 0.0
        for w in (text or "").split():
            rows.append((doc, page, w, x, 0.0, x + 6.0 * len(w), 10.0, 0.9, "word"))
            x += 6.0 * len(w) + 3.0
    return pd.DataFrame(rows, columns=[c.split()[0] for c in TOKENS.split(", ")])


register(Plugin("fake", "recogniser", fake_recogniser, "1", frozenset({"words", "confidence"})))


def compare(reference: DataFrame, adapters: dict[str, Callable[[DataFrame], DataFrame]], pages: DataFrame) -> DataFrame:
    """adapter, doc_id, text, reference_text, error: every extractor over the same
    pages, each against the reference. An extractor that fails when its plan is
    made has null texts and its error, and stops no other; all are lazy, so one
    that fails in a task fails the job of its own rows."""
    parts = []
    for name, adapter in adapters.items():
        try:
            got = adapter(pages).select("doc_id", "text")
            parts.append(pages.select("doc_id").join(got, "doc_id", "left").select(F.lit(name).alias("adapter"), "doc_id", "text", F.lit(None).cast("string").alias("error")))
        except Exception as e:  # noqa: BLE001
            parts.append(pages.select(F.lit(name).alias("adapter"), "doc_id", F.lit(None).cast("string").alias("text"), F.lit(str(e)[:200]).alias("error")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.join(reference.select("doc_id", F.col("text").alias("reference_text")), "doc_id", "left")


def comparison_status(rows: DataFrame) -> DataFrame:
    """adapter, status: success if every document has a text, partial if some do, else failure."""
    n, ok = F.count(F.lit(1)), F.count_if(F.col("text").isNotNull() & F.col("error").isNull())
    return rows.groupBy("adapter").agg(F.when(ok == n, "success").when(ok > 0, "partial").otherwise("failure").alias("status"), ok.alias("documents"))
