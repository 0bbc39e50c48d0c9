"""Output of text recognisers as token rows: TSV, tuples, heterogeneous payloads."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G

TSV = "level string, page_num string, block_num string, par_num string, line_num string, word_num string, left string, top string, width string, height string, conf string, text string"


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A recogniser's TSV with every column as text."""
    return spark.read.schema(TSV).csv(path, sep="\t", header=True, enforceSchema=False)


def tsv_words(rows: DataFrame, least: float = 0.0, dx: float = 0.0, dy: float = 0.0) -> DataFrame:
    """All columns with text, confidence (0 to 100) and box of the rows that are
    words: level 5, not blank, a finite confidence of at least ``least`` and a
    finite box of positive size."""
    number = lambda c: F.trim(F.col(c)).try_cast("double")
    x, y, w, h = number("left") + dx, number("top") + dy, number("width"), number("height")
    out = rows.withColumns({"_conf": number("conf"), "_text": F.trim("text"), "x0": x, "y0": y, "x1": x + w, "y1": y + h})
    fine = (F.col("level") == "5") & (F.col("_text") != "") & F.col("_conf").between(max(0.0, least), 100.0)
    for c in ("x0", "y0", "x1", "y1"):
        fine = fine & G.finite(F.col(c)).isNotNull()
    return out.where(fine & (w > 0) & (h > 0)).withColumn("text", F.col("_text")).withColumn("confidence", F.col("_conf")).drop("_conf", "_text")


def tuple_tokens(raw: Column, dx: float = 0.0, dy: float = 0.0) -> Column:
    """array<struct<points, text, score, scored>> to token structs: blank texts and
    bad outlines go; a score that was given is clamped to [0, 1], a null one is
    0, and one that was never given is 1."""
    sure = lambda t: F.when(~t.scored, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(G.finite(t.score), F.lit(0.0)))))
    moved = lambda p: F.transform(p, lambda q: F.struct((q.x + dx).alias("x"), (q.y + dy).alias("y")))
    tokens = F.transform(raw, lambda t: F.struct(t.text.alias("text"), sure(t).alias("confidence"), G.polygon_box(moved(t.points)).alias("box")))
    return F.filter(tokens, lambda t: (F.trim(t.text) != "") & t.box.isNotNull())


def _number(v: object) -> float | None:
    try:
        return float(v)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None


def _turn(v: object) -> int:
    try:
        return 180 if int(v) == 1 else 0  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return 180 if "180" in str(v) else 0


def _outline(box: object) -> list[float] | None:
    """Corners of four numbers or of points; null if neither."""
    if not isinstance(box, list):
        return None
    if len(box) == 4 and all(isinstance(v, int | float) and not isinstance(v, bool) for v in box):
        return [float(v) for v in box]
    points = [p for p in box if isinstance(p, list) and len(p) >= 2]
    xs, ys = ([_number(p[i]) for p in points] for i in (0, 1))
    if not points or None in xs or None in ys:
        return None
    return [min(xs), min(ys), max(xs), max(ys)]


def payload_records(value: object) -> list[tuple[str, float | None, list[float] | None, int]]:
    """Records (text, score, corners, rotation) of a decoded payload: columns of
    texts, scores and boxes in an object, under ``res`` or not; or a list of
    [outline, [text, score, turn]], perhaps wrapped once more. Bad records go,
    their siblings stay."""
    found: list[tuple[str, float | None, list[float] | None, int]] = []
    waiting = [value]
    while waiting:
        v = waiting.pop(0)
        if isinstance(v, str):
            try:
                v = json.loads(v)
            except ValueError:
                continue
        if isinstance(v, dict):
            if "res" in v:
                waiting.insert(0, v["res"])
                continue
            first = lambda *names: next((v[n] for n in names if v.get(n) is not None), [])  # noqa: B023, E731
            texts, scores = first("rec_texts", "texts"), first("rec_scores", "scores")
            boxes, turns = first("rec_boxes", "rec_polys", "boxes", "polys"), first("textline_orientation_angles", "orientation_angles", "angles")
            if not all(isinstance(c, list) for c in (texts, scores, boxes, turns)):
                continue
            for i, t in enumerate(texts[: len(boxes)]):
                found.append((str(t), _number(scores[i]) if i < len(scores) else None, _outline(boxes[i]), _turn(turns[i]) if i < len(turns) else 0))
        elif isinstance(v, list):
            inner = []
            for item in v:
                if isinstance(item, list) and len(item) >= 2 and isinstance(item[1], list) and item[1] and not isinstance(item[1][0], list | dict):
                    text, *rest = item[1]
                    found.append((str(text), _number(rest[0]) if rest else None, _outline(item[0]), _turn(rest[1]) if len(rest) > 1 else 0))
                elif isinstance(item, dict) or (isinstance(item, list) and len(v) == 1):
                    inner.append(item)
            waiting[:0] = inner
    return found


RECORDS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("corners", T.ArrayType(T.DoubleType())), T.StructField("rotation", T.IntegerType())]))


@F.pandas_udf(RECORDS)
def records(payloads: pd.Series) -> pd.Series:
    """Records of JSON payloads; what is no JSON has none."""

    def one(p: str | None) -> list[dict]:
        return [dict(zip(("text", "score", "corners", "rotation"), r, strict=True)) for r in payload_records(p)] if p else []

    return payloads.map(one)


def dominant_rotation(recs: Column) -> Column:
    """180 if at least 60% of the records with a text and no score under 0.5 are
    upside down, else 0."""
    usable = F.filter(recs, lambda r: (r.text != "") & (r.score.isNull() | (r.score >= 0.5)))
    down = F.size(F.filter(usable, lambda r: r.rotation == 180))
    return F.when((F.size(usable) > 0) & (down >= 0.6 * F.size(usable)), 180).otherwise(0)


def yield_metrics(recs: Column, detections: Column) -> Column:
    """Counts of detections and of records with a text, their ratio and the mean
    of the finite scores; nulls where nothing was counted."""
    texts = F.size(F.filter(recs, lambda r: F.trim(r.text) != ""))
    scores = F.filter(F.transform(recs, lambda r: r.score), lambda s: s.isNotNull() & ~F.isnan(s))
    total = F.aggregate(scores, F.lit(0.0), lambda a, s: a + s)
    return F.struct(
        detections.alias("detection_count"), texts.alias("recognition_count"),
        F.when(detections > 0, texts / detections).alias("recognition_yield"),
        F.when(F.size(scores) > 0, total / F.size(scores)).alias("mean_score"))


def finite(v: float | None) -> bool:
    return v is not None and math.isfinite(v)
