"""Files read and written: manifests, tables, dumps, validation, streams, plug-ins."""

from __future__ import annotations

import hashlib
import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliant import plugins
from foliant.sources import evidence, integrity, pages, recogniser, render
from foliant.streaming import events as E
from foliant.streaming import pages as P


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_manifest(spark, tmp_path):
    entries = [{"page": 1, "expected_markdown": "a"}, {"page": 2}, {"page": 3, "expected_markdown": None}, {"expected_markdown": "x"}, {"page": 1, "expected_markdown": "b"}]
    path = put(tmp_path / "m.json", json.dumps({"pages": entries}, indent=1))
    assert sorted(map(tuple, pages.read_manifest(spark, path).collect())) == [(1, "b"), (2, "")]
    assert pages.read_manifest(spark, put(tmp_path / "e.json", "{}")).count() == 0


def test_sections(spark):
    md = "intro\n## Página 001 | One\nbody\n## pagina 2\nold\n### sub\n## Página 2 |\nnew\n"
    df = spark.createDataFrame([(1, md), (2, None), (3, "none")], "k int, text string")
    got = {r.page: r.body for r in pages.split_pages(df, ["k"]).collect()}
    assert got == {1: "## Página 001 | One\nbody", 2: "## Página 2 |\nnew"}
    strict = {r.page: r.body for r in pages.reference_pages(df, ["k"]).collect()}
    assert strict == {1: "Página 001 One\nbody\npagina 2\nold\nsub", 2: "Página 2\nnew"}


def test_json_lines(spark, tmp_path):
    path = put(tmp_path / "e.jsonl", '{"event": "a", "call": 1}\n{"event": "b", "ca')
    assert [tuple(r) for r in pages.read_json_lines(spark, path, "event string, call int").collect()] == [("a", 1)]


def test_tsv(spark, tmp_path):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    rows = ["5\t1\t1\t1\t1\t1\t10\t20\t30\t8\t95.5\t Olá ", "4\t1\t1\t1\t1\t0\t10\t20\t30\t8\t-1\t", "5\t1\t1\t1\t1\t2\t1\t2\t0\t8\t90\tflat", "5\t1\t1\t1\t1\t3\t1\t2\t3\t8\tnan\tx", "5\t1\t1\t1\t1\t4\t1\t2\t3\t8\t10\tunsure"]
    path = put(tmp_path / "t.tsv", head + "\n".join(rows) + "\n")
    got = recogniser.tsv_words(recogniser.read_tsv(spark, path), least=20, dx=1.0).collect()
    assert [(r.text, r.confidence, r.x0, r.y0, r.x1, r.y1) for r in got] == [("Olá", 95.5, 11.0, 20.0, 41.0, 28.0)]


def test_payloads():
    f = recogniser.payload_records
    assert f({"res": {"rec_texts": ["a", "b"], "rec_scores": [0.5], "rec_boxes": [[1, 2, 3, 4], [[0, 0], [2, 1]]], "angles": [1]}}) == [("a", 0.5, [1.0, 2.0, 3.0, 4.0], 180), ("b", None, [0.0, 0.0, 2.0, 1.0], 0)]
    assert f([[[[0, 0], [4, 2]], ["x", 0.9, "rot180"]], "noise", [1]]) == [("x", 0.9, [0.0, 0.0, 4.0, 2.0], 180)]
    assert f([[[[[0, 0], [4, 2]], ["x", 0.9]]]]) == [("x", 0.9, [0.0, 0.0, 4.0, 2.0], 0)]
    assert f(None) == f("no json") == f({"texts": 5}) == []


def test_pdf_scan_and_hashes(spark, tmp_path):
    put(tmp_path / "d" / "a.pdf", b"%PDF-1.7\n1 0 obj <</Type /Pages /Count 2>>\n<</Type /Page>> <</Type/Page >>")
    put(tmp_path / "d" / "b.pdf", b"no pdf")
    got = {os.path.basename(r.path): (r.page_count, r.error) for r in integrity.scan_pdfs(spark, str(tmp_path / "d"), max_pages=1).collect()}
    assert got == {"a.pdf": (2, "max_pages"), "b.pdf": (None, "header")}
    assert {r.error for r in integrity.scan_pdfs(spark, str(tmp_path / "d"), max_bytes=3).collect()} == {"header", "max_file_size_bytes"}
    files = integrity.file_hashes(spark, str(tmp_path / "d")).withColumn("name", F.element_at(F.split("path", "/"), -1))
    assert {r.sha256 for r in files.collect()} >= {hashlib.sha256(b"no pdf").hexdigest()}
    row = integrity.tree_hash(files.withColumn("g", F.lit(1)), ["g"]).first()
    assert row.files == 2 and row.bytes == files.agg(F.sum("length")).first()[0]
    inv = integrity.inventory(files.withColumn("g", F.lit(1)), ["g"]).first()
    assert (inv.files, inv.has_weights, inv.has_metadata) == (2, False, False)


def test_replace_text(spark, tmp_path):
    path = str(tmp_path / "out" / "r.json")
    for text in ("one", "twö"):
        integrity.replace_text(spark, path, text)
        assert open(path).read() == text
    assert [f for f in os.listdir(tmp_path / "out") if not f.startswith(".")] == ["r.json"]


def page(doc, index, text, **more):
    box = {"x0": 0.0, "y0": 0.0, "x1": 9.0, "y1": 9.0}
    chars = [{"char_index": i, "text": c, "bbox": box} for i, c in enumerate(text)]
    return {"doc_id": doc, "page_index": index, "bbox": box, "rotation": 0, "characters": chars, "images": [], "paths": [{"bbox": None}], "annotations": [], "structure": []} | more


def test_dumps(spark, tmp_path):
    put(tmp_path / "in" / "a.json", "\n".join(json.dumps(page(1, i, t)) for i, t in enumerate(("ab", "c", ""))))
    read = evidence.read_pages(spark, str(tmp_path / "in"))
    assert [(r.page_index, r.text, r.x1) for r in evidence.characters(read).orderBy("page_index", "char_index").collect()] == [(0, "a", 9.0), (0, "b", 9.0), (1, "c", 9.0)]
    assert evidence.objects(read, "paths").where("x0 IS NULL").count() == 3 and evidence.objects(read, "images").count() == 0
    c = evidence.counters(read).first()
    assert (c.page_acquisitions, c.characters, c.objects, c.native_calls_estimated) == (3, 3, 3, 3 * 6 + 2 * 3 + 15)
    evidence.dump_pages(read, str(tmp_path / "out"), [1])
    assert evidence.read_pages(spark, str(tmp_path / "out")).select("page_index").collect()[0][0] == 1


def test_page_source(spark):
    class Fixture(evidence.PageSource):
        @classmethod
        def name(cls):
            return "fixture_pages"

        def page_count(self):
            return 5

        def extract(self, page_index):
            if page_index == 3:
                raise ValueError("torn")
            return (7, page_index, None, 0, [], [], [], [], [])

    spark.dataSource.register(Fixture)
    rows = spark.read.format("fixture_pages").option("pages_per_task", "2").load()
    assert rows.rdd.getNumPartitions() == 3
    assert {r.page_index: r.error for r in rows.collect()} == {0: None, 1: None, 2: None, 3: "torn", 4: None}


def test_render(spark):
    pages_ = spark.createDataFrame([(1, 0, True), (1, 1, True), (1, 2, False)], "doc_id long, page_index int, preserve_furniture boolean")
    blocks = spark.createDataFrame(
        [
            (1, 0, 1, "title", "A # b", 9, None, None, False, None), (1, 0, 0, "paragraph", "# x\n1. y *z*", None, None, None, False, None), (1, 0, 2, "table", None, None, None, None, False, "t"),
            (1, 0, 3, "paragraph", "gone", None, None, None, True, None), (1, 2, 0, "header", "old", None, None, None, False, None), (1, 2, 1, "list", "", None, None, [(1, "-", "- q")], False, None),
        ],
        "doc_id long, page_index int, order_index int, kind string, text string, heading_level int, line_ids array<string>, list_items array<struct<level:int,marker:string,text:string>>, suppressed boolean, table_id string",
    )
    tables = spark.createDataFrame([(1, 0, "t", 2, 2, [0]), (1, 1, "u", 1, 2, [0])], "doc_id long, page_index int, table_id string, row_count int, column_count int, header_rows array<int>")
    cells = spark.createDataFrame([(1, 0, "t", 0, 0, 1, 1, "a|b"), (1, 0, "t", 1, 1, 1, 1, "c\nd"), (1, 1, "u", 0, 0, 1, 2, "<wide>")], "doc_id long, page_index int, table_id string, row int, col int, rowspan int, colspan int, text string")
    regions = spark.createDataFrame([(1, 1, 0, "title", 2, ["Ti", " tle "])], "doc_id long, page_index int, region_index int, kind string, heading_level int, lines array<string>")
    md = render.render_markdown(pages_, blocks, tables, cells, regions).first().markdown
    assert md == (
        "\\# x\n1\\. y \\*z\\*\n\n###### A # b\n\n| a\\|b |  |\n| --- | --- |\n|  | c<br>d |\n\n"
        '## Ti tle\n\n<table>\n  <tr>\n    <th colspan="2">&lt;wide&gt;</th>\n  </tr>\n</table>\n\n  - \\- q'
    )
    with pytest.raises(ValueError):
        render.text_view(pages_, "other")
    with pytest.raises(ValueError):
        render.escape(F.lit(""), "other")


def test_page_stream(spark, tmp_path):
    good = "\n".join(json.dumps(page(1, i, "abc")) for i in range(2))
    put(tmp_path / "in" / "a.json", good + "\n{broken")
    seen = []
    q = P.extract(P.read_dumps(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), lambda *a: seen.append(a))
    q.awaitTermination(60)
    put(tmp_path / "in" / "b.json", json.dumps(page(2, 0, "z", characters=None)))
    P.extract(P.read_dumps(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), lambda *a: seen.append(a)).awaitTermination(60)
    assert seen == [(0, 3, 1), (1, 1, 1)]
    got = {r.doc_id: (r.pages, r.failed, r.characters) for r in P.page_counters(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == {1: (2, 0, 6), 2: (1, 1, 0), None: (1, 1, 0)}


def test_sample_stream(spark, tmp_path):
    lines = [{"run": "r", "ts": f"2024-01-01T00:00:0{s}Z", "rss_kib": v, "swap_kib": 0} for s, v in ((0, 5), (1, 9), (3, 7))]
    put(tmp_path / "s" / "a.jsonl", "\n".join(map(json.dumps, lines)) + '\n{"run": "r", "rs')
    for name, df, mode in (("w", E.resource_windows(E.read_samples(spark, str(tmp_path / "s"))), "complete"), ("p", E.running_peak(E.read_samples(spark, str(tmp_path / "s"))), "complete")):
        q = df.writeStream.format("memory").queryName(f"sample_{name}").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert sorted(r.rss_peak for r in spark.table("sample_w").collect()) == [7, 9]
    assert [tuple(r) for r in spark.table("sample_p").collect()] == [("r", 9, 3)]


def test_repeats_in_a_stream(spark, tmp_path):
    put(tmp_path / "s" / "a.jsonl", "\n".join(json.dumps({"ts": "2024-01-01T00:00:00Z", "event_id": i % 2}) for i in range(5)))
    s = spark.readStream.schema("ts timestamp, event_id long").json(str(tmp_path / "s"))
    E.first_of_each(s, ["event_id"]).writeStream.format("memory").queryName("once").trigger(availableNow=True).start().awaitTermination(60)
    assert spark.table("once").count() == 2


def test_plugins(spark):
    with pytest.raises(KeyError):
        plugins.get("detector", "none")
    with pytest.raises(ValueError):
        plugins.register(plugins.Plugin("x", "no kind", lambda b: b))
    plugins.register_lazy("table_recogniser", "lazy", "tests_of_nothing:plugin")
    with pytest.raises(ImportError):
        plugins.get("table_recogniser", "lazy")
    plugins.register(plugins.Plugin("whole", "detector", lambda b: pd.DataFrame({"doc_id": b.doc_id, "page_index": b.page_index, "kind": "text"})))
    pages_ = spark.createDataFrame([(1, 0, "a bc"), (2, 0, None)], "doc_id long, page_index int, text string")
    rows = plugins.get("detector", "whole").apply(pages_).collect()
    assert [(r.doc_id, r.kind, r.confidence, r.provenance.name) for r in rows] == [(1, "text", None, "whole"), (2, "text", None, "whole")]
    tokens = plugins.get("recogniser", "fake").apply(pages_).collect()
    assert [(t.text, t.x0, t.x1) for t in tokens] == [("a", 0.0, 6.0), ("bc", 9.0, 21.0)]
    assert plugins.capability_facts("recogniser", ["words", "tables"])["fake"] == {"words": True, "tables": False}
