"""Golden figures."""

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import text as X
from ledgerlark.functions import values as V
from ledgerlark.operators import documents as D
from ledgerlark.operators import metrics as M
from ledgerlark.operators import verify as C

FIGURES = [
    ("1,234 crore", 1234, "crore", "unknown", None, []),
    ("1,234 cr", 1234, "crore", "unknown", None, []),
    ("56.7 lakhs", 56.7, "lakh", "unknown", None, []),
    ("12 lac", 12, "lakh", "unknown", None, []),
    ("2.4 bn", 2.4, "billion", "unknown", None, []),
    ("₹ 12,34,567", 1234567, "unit", "currency", "INR", ["no_scale_determined"]),
    ("(1,234)", -1234, "unit", "unknown", None, ["no_scale_determined"]),
    ("−5.5%", -5.5, "unit", "percent", None, []),
    ("1,2232*", 12232, "unit", "unknown", None, ["footnote_marker_stripped", "irregular_grouping", "no_scale_determined"]),
    ("increase of 500", 500, "unit", "unknown", None, ["no_scale_determined"]),
    ("5 million crore", 5, "million", "unknown", None, ["ambiguous_compound_scale"]),
    ("7 (k cr)", 7, "crore", "unknown", None, ["ambiguous_compound_scale"]),
]


@pytest.mark.parametrize("case", FIGURES)
def test_parse(spark, case):
    text, amount, scale, kind, currency, warnings = case
    r = spark.createDataFrame([(text,)], "t string").select(V.parse(F.col("t")).alias("v")).first().v
    assert (float(r.amount), r.scale, r.unit_kind, r.currency, r.warnings) == (amount, scale, kind, currency, warnings)


def test_parse_nothing(spark):
    rows = spark.createDataFrame([("n/a",), ("",), (None,)], "t string").select(V.parse(F.col("t")).alias("v")).collect()
    assert all(r.v is None for r in rows)


def test_context(spark):
    r = spark.createDataFrame([("45",)], "t string").select(V.parse(F.col("t"), F.lit("lakh"), F.lit("INR")).alias("v")).first().v
    assert (r.scale, r.currency, r.unit_kind, r.warnings) == ("lakh", "INR", "currency", ["scale_inherited_from_context"])


def test_degroup(spark):
    r = spark.createDataFrame([("1,234 and 12,34,567 and 1,2232",)], "t string").select(V.degroup(F.col("t")).alias("d")).first()
    assert r.d == "1234 and 1234567 and 1,2232"


def test_calculate(spark):
    cases = [  # operation, [(value, kind, currency)], value, error
        ("ratio", [(1, "currency", None), (0, "currency", None)], None, "division by zero"), ("percentage_change", [(-2, "currency", None), (1, "currency", None)], 1.5, None), ("percentage_change", [(0, "currency", None), (1, "currency", None)], None, "base of 0"),
        ("cagr", [(4, "currency", None), (1, "currency", None)], None, "number of years required"), ("other", [(1, "currency", None)], None, "unsupported operation"), ("sum", [(1, "currency", "INR"), (2, "unknown", None), (4, "currency", "INR")], 7.0, None),
        ("sum", [(1, "percent", None), (2, "currency", None)], None, "incompatible unit kinds"), ("sum", [(1, "currency", "INR"), (2, "currency", "USD")], None, "different currencies"), ("difference", [(1, "currency", None)] * 3, None, "exactly 2 operands required"),
        ("average", [(1, "currency", None), (2, "currency", None), (6, "currency", None)], 3.0, None), ("product", [(2, "currency", None), (3, "ratio", None)], 6.0, None), ("sum", [], None, "no operands supplied"),
    ]
    df = spark.createDataFrame([(o, x) for o, x, _, _ in cases], "o string, x array<struct<value:int,unit_kind:string,currency:string>>").select(V.calculate(F.col("o"), F.col("x").cast(f"array<{V.OPERAND}>")).alias("r"))
    got = [r.r for r in df.collect()]
    assert [(g.value, g.error) for g in got] == [(v, e) for _, _, v, e in cases]
    assert got[5].currency == "INR" and got[5].unit_kind == "currency" and got[1].unit_kind == "percent"


def test_judge(spark):
    cases = [  # amount, scale, kind, currency, gold, gold kind, gold currency -> mismatch, assumed
        ((5.0, "crore", "unknown", None, 5e7, "currency", "INR"), "none", True), ((45.0, "unit", "unknown", None, 0.45, "percent", None), "none", True), ((45.0, "unit", "percent", None, 0.45, "ratio", None), "none", False),
        ((5.0, "unit", "percent", None, 5.0, "currency", None), "unit_kind", False), ((5.0, "unit", "currency", "USD", 5.0, "currency", "INR"), "currency", False), ((-5.0, "unit", "currency", None, 5.0, "currency", None), "sign", False),
        ((5.1, "unit", "currency", None, 5.0, "currency", None), "magnitude", False), ((0.0, "unit", "currency", None, 0.0, "currency", None), "none", False), ((1.0, "unit", "currency", None, 0.0, "currency", None), "magnitude", False),
        ((None, "unit", "currency", None, 5.0, "currency", None), "missing_prediction", False), ((5.0, "unit", "currency", None, None, "currency", None), "missing_gold", False), ((5.0, "unit", "currency", "INR", 5.0, "unknown", None), "none", False),
    ]
    m = lambda c: F.col(c).cast(V.MONEY)
    df = spark.createDataFrame([c for c, _, _ in cases], "a double, s string, k string, c string, g double, gk string, gc string")
    got = [r.j for r in df.select(V.judge(m("a"), F.col("s"), F.col("k"), F.col("c"), m("g"), F.col("gk"), F.col("gc"), 0.005).alias("j")).collect()]
    assert [(g.mismatch, g.correct, g.unit_assumed) for g in got] == [(w, w == "none", u) for _, w, u in cases]
    strict = df.limit(1).select(V.judge(m("a"), F.col("s"), F.col("k"), F.col("c"), m("g"), F.col("gk"), F.col("gc"), 0.005, False).alias("j")).first().j
    assert strict.mismatch == "unit_kind"


def test_parsed_equals_parse(spark):
    rows = spark.createDataFrame([(t,) for t, *_ in FIGURES] + [("n/a",), (None,)], "t string")
    both = V.parsed(rows.withColumn("p", V.parse(F.col("t"), F.lit("lakh"), F.lit("INR"))), "v", F.col("t"), F.lit("lakh"), F.lit("INR"))
    assert both.where("not (v <=> p)").count() == 0


def test_variants(spark):
    cases = {"1234567.50": ["12,34,567.5", "1,234,567.5", "12,34,567", "1,234,567", "1234567.5", "1234567"], "12": ["12"], "-1234": ["(1,234)", "(1234)", "-1,234", "-1234", "1,234", "1234"], "abc": []}
    got = {r.t: r.v for r in spark.createDataFrame([(c,) for c in cases], "t string").select("t", V.figure_variants(F.col("t")).alias("v")).collect()}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in cases.items()} and all([len(x) for x in v] == sorted((len(x) for x in v), reverse=True) for v in got.values())


def test_units(spark):
    cases = {"Rs cr": ("currency", "crore", "INR"), "percent": ("percent", "unit", None), "times": ("ratio", "unit", None), "USD bn": ("currency", "billion", "USD"), "": ("unknown", "unit", None)}
    got = {r.t: tuple(r.u) for r in spark.createDataFrame([(c,) for c in cases], "t string").select("t", V.unit_of(F.col("t")).alias("u")).collect()}
    assert got == cases


def test_noisy_or(spark):
    df = spark.range(1).select(C.combine(F.array(F.lit(0.85), F.lit(0.045), F.lit(0.5))).alias("r"))
    assert df.first().r == pytest.approx(0.89003125)


def test_uncertain_risk(spark):
    ch = spark.createDataFrame([(1, 0, True, True, 5.0), (1, 1, False, True, None), (1, 2, False, False, None)], "k int, channel int, available boolean, applicable boolean, a double")
    ch = ch.select("k", "channel", "available", "applicable", F.col("a").cast(V.MONEY).alias("amount"), F.lit("unit").alias("scale"), F.lit("count").alias("unit_kind"), F.lit(None).cast("string").alias("currency"))
    r = C.risk(C.consistency(ch, "k"), F.lit(2)).first()
    assert (r.verdict, r.coverage, r.risk_band) == ("UNCERTAIN", 0.9, "MEDIUM")
    assert r.risk_score == pytest.approx(0.51125)


def test_undefined_metrics(spark):
    one = spark.createDataFrame([(0.5, 1), (0.5, 1)], "score double, label int")
    assert M.auroc(one).first().auroc is None
    tied = spark.createDataFrame([(0.5, 1), (0.5, 0)], "score double, label int")
    assert M.auroc(tied).first().auroc == 0.5


def test_fiscal(spark):
    r = spark.createDataFrame([("from FY 2023-24 to March 31, 2025 and 2024/25, not 2026",)], "t string").select(X.fiscal_years(F.col("t")).alias("y"), X.only_fiscal_year(F.col("t")).alias("o")).first()
    assert r.y == ["2023-24", "2024-25"] and r.o is None


LEXICON = [("trade payables", "trade payables", "currency"), ("goodwill", "goodwill", "currency"), ("total equity", "total equity", "currency"), ("current ratio", "current ratio", "ratio")]
CHUNK = "chunk_id string, part int, text string, context_scale string, context_currency string, fiscal_year string"


def chunks(spark, *rows):
    more = {c: F.lit(None).cast(t) for c, t in (("page", "int"), ("section", "string"), ("table_index", "int"), ("company", "string"))}
    return spark.createDataFrame([(f"d:p1:t0:{i}", i, t, "crore", "INR", "2023-24") for i, t in enumerate(rows)], CHUNK).withColumns({"kind": F.lit("table"), "document_id": F.lit("d"), **more}), spark.createDataFrame(LEXICON, "alias string, canonical string, unit_kind string")


def test_facts(spark):
    text = "Balance sheet\n(All figures in INR crore)\n| Particulars | Note | 2024 | 2023 |\n|---|---|---|---|\n| Trade payables | 2.14 | 3,956 | 3,865 |\n| Trade payables ageing schedule | 1 | 2 | 3 |"
    rows = D.facts(*chunks(spark, text)).collect()
    assert sorted((float(r.amount), r.scale, r.year, r.column_index, r.year_source) for r in rows) == [(3865, "crore", "2023", 3, "column_header"), (3956, "crore", "2024", 2, "column_header")]


def test_facts_years(spark):
    """A span names the year it ends in; a header with figures is none; merged cells take the years of a merged header."""
    span = "| x | 2022-23 | FY24 |\n| Goodwill | 10 | 11 |"
    data = "| As at March 31, 2024 | 88,461 |\n| Goodwill | 10 |"
    merged = "| x | As at | 2024 2023 |\n| y | March 31, 2022 | z |\n| Goodwill |  | 76  161 |"
    got = {r.chunk_id[-1]: [] for r in D.facts(*chunks(spark, span, data, merged)).collect()}
    for r in D.facts(*chunks(spark, span, data, merged)).orderBy("column_index").collect():
        got[r.chunk_id[-1]].append((float(r.amount), r.year, r.year_source))
    assert got["0"] == [(10, "2023", "column_header"), (11, "2024", "column_header")]
    assert got["1"] == [(10, "2023-24", "document_fiscal_year")]
    assert got["2"] == [(76, None, "unknown"), (161, None, "unknown")]


def test_two_panels(spark):
    text = "| Assets | Note | 2024 | 2023 | Liabilities | Note | 2024 | 2023 |\n| Goodwill |  | 14,989 | 15,270 | Total Equity |  | 9,25,788 | 8,28,881 |"
    got = sorted((r.metric, float(r.amount), r.year) for r in D.facts(*chunks(spark, text)).collect())
    assert got == [("goodwill", 14989, "2024"), ("goodwill", 15270, "2023"), ("total equity", 828881, "2023"), ("total equity", 925788, "2024")]


def test_later_parts_inherit_years(spark):
    first, second = "| x | 2024 | 2023 |\n| Goodwill | 1 | 2 |", "| Trade payables | 3 | 4 |\n| Total equity | 5 | 6 |"
    got = {(r.metric, float(r.amount), r.year, r.year_source) for r in D.facts_across(*chunks(spark, first, second)).collect()}
    assert {("trade payables", 3.0, "2024"), ("total equity", 6.0, "2023"), ("goodwill", 1.0, "2024")} <= {g[:3] for g in got}


def test_streaming_rates(spark, tmp_path):
    from ledgerlark.streaming.rates import sliding_rates

    src = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(src).schema
    (tmp_path / "in").mkdir()
    import shutil

    shutil.copy(src, tmp_path / "in" / "events.parquet")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    q = sliding_rates(stream, "ts", "event_type", "value", "1 hour", "1 hour").writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = spark.read.parquet(src).count()
    assert spark.table("rates").agg(F.sum("requests")).first()[0] == want
