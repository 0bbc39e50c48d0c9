"""Golden cases of critical data, token predicates and cell recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import critical as C
from foliant.functions import distance as D
from foliant.functions import text as T
from foliant.plans.critical import recover_cells


def test_format_scores(spark):
    cases = [
        ("529.982.247-25", "cpf", 1.0), ("529.982.247-26", "cpf", 0.6), ("529 982 247 25", "cpf", 0.3), ("12", "cpf", 0.0),
        ("11.222.333/0001-81", "cnpj", 1.0), ("11.222.333/0001-80", "cnpj", 0.6), ("11 222 333 0001 81", "cnpj", 0.3),
        ("R$ 1.234,56", "currency", 1.0), ("1.234,56", "currency", 0.85), ("R$ x", "currency", 0.5), ("R$ 1,234", "currency", 0.5), ("x", "currency", 0.0),
        ("31/12/2024", "date", 1.0), ("1-2-2024", "date", 1.0), ("31/02/2024", "date", 0.4), ("1/2.2024", "date", 0.4), ("x", "date", 0.0),
        ("12,5 %", "percentage", 1.0), ("120%", "percentage", 0.4), ("12", "percentage", 0.0),
        ("1.234,5", "numeric", 1.0), ("a 1234", "numeric", 0.4), ("12", "numeric", 0.0),
        (" 23:59 ", "time", 1.0), ("24:00", "time", 0.0), ("12345-678", "cep", 1.0), ("1234-5678", "cep", 0.0),
        ("0001234-56.2024.8.26.0100", "process_number", 1.0), ("00012345620248260100", "process_number", 0.35),
        ("123", "invoice_number", 1.0), ("nf-12/a", "invoice_number", 0.65), ("x", "invoice_number", 0.0), ("1", "no such type", 0.0),
    ]
    df = spark.createDataFrame(cases, "t string, kind string, want double")
    got = df.select("t", "kind", "want", C.format_score(F.col("t"), F.col("kind")).alias("score")).collect()
    assert [(r.t, r.kind) for r in got if r.score != r.want] == []


def test_labels(spark):
    cases = [(["Nome", "VENCIMENTO:"], "date"), (["CPF/CNPJ :"], "cpf"), (["Emissão"], "date"), (["R$"], "currency"), (["Processo nº"], "process_number"), (["Processos"], None), (["Alíquota ."], "percentage"), ([], None)]
    rows = [(i, want, j, label) for i, (labels, want) in enumerate(cases) for j, label in enumerate(labels or [None])]
    df = spark.createDataFrame(rows, "k int, want string, i int, l string").withColumn("l", C.normalize_label("l"))
    df = df.groupBy("k", "want").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "l"))), lambda x: x.l).alias("ls"))
    assert all(r.want == r.got for r in df.select("want", C.context_type(F.col("ls")).alias("got")).collect())


def test_signed_values(spark):
    cases = [
        ("R$ -1.234,50 e +12,50%", ["money:-:1234.50", "percentage:+:12.5"]),
        ("r$10,00 r$10,00 100%", ["money:+:10.00", "money:+:10.00", "percentage:+:100"]),
        ("xR$ 1,00 R$ 1,234 5%a 1234%", []),
        ("0,250 %", ["percentage:+:0.25"]),
    ]
    df = spark.createDataFrame(cases, "t string, want array<string>")
    assert all(r.want == r.got for r in df.select("want", C.signed_values(F.col("t")).alias("got")).collect())


def test_rewrite_guard(spark):
    cases = [
        ("CPF 123.456.789-09", "CPF 123.456.789-00", False), ("abcd", "", True), ("palavra inteira aqui mesmo", "palavra inteira aqui mesnno", True),
        ("palavra inteira aqui mesmo", "zzzzzzz qqqqqqq wwww xxxxx", False), ("palavra inteira", "pal", False), ("R$ 10,00 hoje", "R$ -10,00 hoje", False), ("curto", "longo", True),
    ]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    key = lambda c: F.regexp_replace(T.nfkc_casefold(c), r"\s", "")
    got = df.select("a", "want", C.conserves(F.col("a"), F.col("b"), D.sequence_ratio(key("a"), key("b"))).alias("got")).collect()
    assert [r.a for r in got if r.got != r.want] == []


def test_token_predicates(spark):
    rows = [("def f(x):", True), ("  # note", True), ("total = f(a)[0]", True), ("a = b", False), ("defence of the realm", False), ("else: x", True)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert all(r.want == r.got for r in df.select("want", T.looks_like_code(T.casefold("t")).alias("got")).collect())
    rows = [("", 1.0, 0.9, True), ("abc", 1.0, 0.1, False), ("....", 1.0, 0.9, True), ("--", 1.0, 0.9, False), ("=====", 1.0, 0.9, True), ("a", 3000.0, 0.5, True), ("a", 3000.0, 0.9, False), ("a\x07", 1.0, 0.9, True), ("aaaaa", 1.0, 1.0, False)]
    df = spark.createDataFrame(rows, "t string, area double, c double, want boolean")
    assert [r.t for r in df.select("t", "want", T.suspicious(F.col("t"), F.col("area"), F.col("c")).alias("got")).collect() if r.got != r.want] == []


def test_cell_recovery(spark):
    page = "Total geral: R$ 1.234,56 Total  geral de Maio".split()
    cells = [(1, "totalgeral:"), (1, "TOTALGERAL"), (1, "r$1.234,56"), (1, "x"), (1, "absent"), (2, "totalgeral")]
    out = recover_cells(spark.createDataFrame(cells, "pg int, cell string"), spark.createDataFrame([(1, page)], "pg int, w array<string>"), "pg", "cell", "w")
    got = {(r.pg, r.cell): r.recovered for r in out.collect()}
    assert got == {(1, "totalgeral:"): "Total geral:", (1, "TOTALGERAL"): "Total geral", (1, "r$1.234,56"): "R$ 1.234,56", (1, "x"): "x", (1, "absent"): "absent", (2, "totalgeral"): "totalgeral"}
