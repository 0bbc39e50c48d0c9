"""Page evidence as tables, from dumps of one JSON object a page.

A dump holds a page's boxes, characters, images, paths and annotations. It can
be read with Spark's JSON reader or, as any recogniser or parser may plug in,
with a Python data source that is registered under a name and gives one
partition per range of pages.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
CHARACTER = f"struct<char_index:int,text:string,bbox:{BOX},angle:double,font_name:string,font_size:double,font_weight:int,text_render_mode:int,unicode_mapping_failed:boolean,hyphen:boolean>"
PAGE = (
    f"doc_id long, page_index int, bbox {BOX}, rotation int, characters array<{CHARACTER}>, "
    f"images array<struct<bbox:{BOX},width_px:int,height_px:int>>, paths array<struct<bbox:{BOX}>>, "
    f"annotations array<struct<subtype:string,contents:string,bbox:{BOX}>>, structure array<struct<tag:string,mcid:int>>"
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Dumps as rows of pages."""
    return spark.read.schema(PAGE).json(path)


def dump_pages(pages: DataFrame, path: str, wanted: list[int] | None = None) -> None:
    """Write dumps, of all pages or only of some, a JSON object a line."""
    chosen = pages if wanted is None else pages.where(F.col("page_index").isin(wanted))
    chosen.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def characters(pages: DataFrame) -> DataFrame:
    """One row per character: doc_id, page_index, its fields with a flat box."""
    rows = pages.select("doc_id", "page_index", F.inline("characters"))
    return rows.select("doc_id", "page_index", *[c for c in rows.columns[2:] if c != "bbox"], "bbox.*")


def objects(pages: DataFrame, kind: str) -> DataFrame:
    """One row per image, path or annotation, with a flat box that may be null."""
    rows = pages.select("doc_id", "page_index", F.posexplode(kind).alias("object_index", "o")).select("doc_id", "page_index", "object_index", "o.*")
    return rows.select(*[c for c in rows.columns if c != "bbox"], "bbox.*")


def counters(pages: DataFrame) -> DataFrame:
    """Per document: pages acquired, characters, objects, annotations, structure
    nodes, and the native calls they stand for (about six a character, two an
    object or annotation, one a node and five a page)."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    n = pages.select(
        "doc_id", size("characters").alias("c"), (size("images") + size("paths")).alias("o"), size("annotations").alias("a"), size("structure").alias("s"))
    total = n.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_acquisitions"), F.sum("c").alias("characters"), F.sum("o").alias("objects"), F.sum("a").alias("annotations"), F.sum("s").alias("structure_nodes"))
    calls = 6 * F.col("characters") + 2 * (F.col("objects") + F.col("annotations")) + F.col("structure_nodes") + 5 * F.col("page_acquisitions")
    return total.withColumn("native_calls_estimated", calls)


class PageRange(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        super().__init__((first, last))
        self.first, self.last = first, last


class PageSource(DataSource):
    """Base of pluggable page sources: give ``page_count`` and ``extract`` in a
    subclass, register it, and read it by its name. Options: pages_per_task and
    whatever the subclass asks for. A page that fails is a row with its error."""

    def schema(self) -> str:
        return PAGE + ", error string"

    def page_count(self) -> int:
        raise NotImplementedError

    def extract(self, page_index: int) -> tuple:
        """The fields of PAGE of one page."""
        raise NotImplementedError

    def reader(self, schema: object) -> DataSourceReader:  # noqa: ARG002
        return _PageReader(self)


class _PageReader(DataSourceReader):
    def __init__(self, source: PageSource) -> None:
        self.source = source

    def partitions(self) -> list[PageRange]:
        n, step = self.source.page_count(), int(self.source.options.get("pages_per_task", 32))
        return [PageRange(i, min(n, i + step)) for i in range(0, n, step)]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        for i in range(partition.first, partition.last):
            try:
                yield (*self.source.extract(i), None)
            except Exception as e:  # noqa: BLE001
                yield (None, i, None, None, None, None, None, None, None, str(e))
