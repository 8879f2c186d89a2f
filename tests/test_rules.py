"""Golden rows of tables, headings, questions, gold sets, campaigns and reads."""

import pytest
from pyspark.sql import functions as F

from ledgerlark import api
from ledgerlark.functions import tables as B
from ledgerlark.functions import text as X
from ledgerlark.operators import binding as N
from ledgerlark.operators import campaign as C
from ledgerlark.operators import dataset as DS
from ledgerlark.operators import documents as D
from ledgerlark.operators import index as I
from ledgerlark.operators import metrics as M
from ledgerlark.operators import questions as Q
from ledgerlark.operators import report as RP
from ledgerlark.operators import retrieval as R
from ledgerlark.operators import taxonomy as T
from ledgerlark.operators import verify as V


def column(spark, values, f, kind="string"):
    """f over the values, as a list."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("r"))
    return [r.r for r in df.orderBy("i").collect()]


def test_headings(spark):
    yes = ["Consolidated Balance Sheet", "2.14 Trade payables", "NOTES TO THE ACCOUNTS", "Note 3 Revenue"]
    no = ["", "The company grew in the year.", "Revenue from the", "continued)", "total", "Amounts,", "x" * 91, "A Very Long Title That Has Many More Words Than A Heading Ever Should Have"]
    assert column(spark, yes + no, B.is_heading) == [True] * len(yes) + [False] * len(no)


def test_header_years(spark):
    cells = ["2022-23", "1999-00", "2019/2020", "as at March 31, 2024", "2024 2023", "FY24", "fy2023", "Particulars"]
    assert column(spark, cells, B.header_year) == ["2023", "2000", "2020", "2024", None, "2024", "2023", None]


def test_figures_of_cells(spark):
    assert column(spark, ["1,234", "(12.50)", "45", "2.14", "2.14.1", "2.3.1 and 2.4", "x", ""], B.is_figure) == [True, True, True, False, False, False, False, False]
    assert column(spark, ["76  161", "(1,234)", "-"], B.figures) == [["76", "161"], ["(1,234)"], []]


def test_merged_headers(spark):
    rows = [[["", "As at"], ["Particulars", "March 2024"], ["Cash", "12"]], [["Cash", "12"]], [["a", "b"], ["c", "d"]], []]
    got = column(spark, rows, B.merged_header, "array<array<string>>")
    assert [(g.header, g.rows) for g in got] == [(["Particulars", "As at March 2024"], 2), (None, 0), (["a", "b"], 0), (None, 0)]


def test_pipe_tables(spark):
    r = spark.createDataFrame([([["Cash", "12"], ["Tax"]], ["x", "2024"])], "r array<array<string>>, h array<string>").select(B.pipe_table(F.col("r"), F.col("h")).alias("t"), B.pipe_table(F.col("r"), F.lit(None).cast("array<string>")).alias("u")).first()
    assert r.t == "| x | 2024 |\n|---|---|\n| Cash | 12 |\n| Tax |  |" and r.u == "| Cash | 12 |\n| Tax |  |"


def test_spillover(spark):
    numerals = F.array(F.lit("8,390"), F.lit("9,287"), F.lit("1,350"))
    texts = ["Current tax 8,390 9,287 Deferred tax 1,350", "The tax was 8,390. It was 9,287 and 1,350 before", "8,390 and 9,287", "1 2 8,390 9,287"]
    assert column(spark, texts, lambda c: B.is_spillover(c, numerals)) == [True, False, False, False]


def test_table_parts(spark):
    rows = [["Item", "FY 2024"]] + [[f"Line {i}", str(i)] for i in range(40)]
    t = spark.createDataFrame([("d", 1, 0, rows)], "document_id string, page int, table_index int, rows array<array<string>>")
    p = spark.createDataFrame([("d", 1, "Amounts in Rs. crore\nItem")], "document_id string, page int, text string")
    c = D.table_chunks(D.table_contexts(t, p).withColumn("section", F.lit("Note 1")), 300).orderBy("part").collect()
    assert len(c) > 2 and all(r.total_parts == len(c) and r.text.startswith("Note 1\n(All figures in INR crore)\n| Item | FY 2024 |\n|---|---|\n") for r in c)
    assert [x for r in c for x in r.text.split("\n")[4:]] == [f"| Line {i} | {i} |" for i in range(40)] and c[0].chunk_id == "d:p1:t0:0"


def test_paragraphs():
    assert D.split_paragraph("short", 10, 3) == ["short"]
    parts = D.split_paragraph("One two three. Four five six. Seven eight nine.", 30, 5)
    assert parts == ["One two three. Four five six.", "six. Seven eight nine."]
    assert D.split_paragraph("a" * 25, 10, 4) == ["a" * 10, "a" * 10, "a" * 10, "a" * 7, "a"]


def test_validated_files(spark):
    files = spark.createDataFrame([("a", b"%PDF-1"), ("b", b"<html>"), ("c", b"%PDF-1"), ("d", b"%PDF-1"), ("e", b"")], "path string, content binary")
    pages = spark.createDataFrame([("a", 1, "x" * 200), ("a", 2, "y"), ("c", 1, "Access Denied"), ("d", 1, "")], "path string, page int, text string")
    got = {r.path: (r.status, r.text_coverage) for r in D.validated(files, pages).collect()}
    assert got == {"a": ("valid", 0.5), "b": ("rejected", 0.0), "c": ("rejected", 0.0), "d": ("needs_ocr", 0.0), "e": ("rejected", 0.0)}


def test_search_texts(spark):
    q = ["What was the revenue from operations for the year ended March 31, 2024?", "What was the?", ""]
    assert column(spark, q, X.search_text) == ["revenue operations", "What was the?", ""]
    assert column(spark, ["How did Tata Motors Limited , and tata motors, do?"], lambda c: X.without_company(c, F.lit("Tata Motors Limited"))) == ["How did, and, do?"]
    assert column(spark, ["What was x (the sum of all)?"], X.without_gloss) == ["What was x?"]


def test_operations_in_order(spark):
    cases = {"what was the cagr of margin": "cagr", "how did the margin change": "percentage_change", "net margin": "margin", "return on equity": "ratio", "share of assets": "percentage_of", "how much more": "difference", "total of a and b": "sum", "average": "average", "total assets": "lookup", "profits decreased": "percentage_change"}
    assert column(spark, list(cases), X.operation) == list(cases.values())


def test_guesses(spark):
    assert column(spark, ["for the year ended March 31, 2024", "FY 2023-2024", "in 2022-23", "none"], X.guessed_fiscal_year) == ["2023-24", "2023-24", "2022-23", None]
    assert column(spark, ["Report of Sun Pharma Ltd. for"], X.guessed_company) == ["Report of Sun Pharma Limited"]


def test_refusals(spark):
    assert column(spark, ["try again in 350ms", "retry in 2 m", "try again in 7.5s", "no"], X.retry_delay) == [0.35, 120.0, 7.5, None]
    body = ["Quota exceeded, billing", "tokens per day (TPD): Limit 200000, Used 199170", "slow down"]
    assert column(spark, body, lambda c: X.allowance_exhausted(c, F.lit(None).cast("double"))) == [True, True, False]
    assert column(spark, body, lambda c: X.allowance_exhausted(c, F.lit(5.0))) == [False, False, False]
    assert column(spark, body, X.daily_tokens_used) == [None, 199170, None]


def test_binding_refuses_to_choose(spark):
    lex = spark.createDataFrame([("accounts payable", "trade payables"), ("goodwill", "goodwill")], "alias string, canonical string")
    blocks = spark.createDataFrame([("q", 1, "| Trade payables * | 2.14 | 3,956 |\n| Goodwill | 10 20 |\n| Goodwill impairment | 3 |", "crore", "INR", "p.1"), ("q", 2, "| Goodwill: | 11 |", "crore", "INR", "p.2"), ("r", 1, "| Goodwill | 5.00 |\n| goodwill | 5 |", None, None, "p.1")], "question string, block int, text string, scale string, currency string, citation string")
    metrics = spark.createDataFrame([("q", "accounts payable", 0), ("q", "goodwill", 1), ("q", "cash", 2), ("r", "goodwill", 0)], "question string, metric string, pos int")
    got = {(r.question, r.metric): (r.bound, r.value and float(r.value), r.note) for r in N.bind_operands(metrics, blocks, lex).collect()}
    assert got == {("q", "accounts payable"): (True, 3956e7, None), ("q", "goodwill"): (False, None, "rows_disagree"), ("q", "cash"): (False, None, "no_row"), ("r", "goodwill"): (True, 5.0, None)}
    second = {r.metric: r.value for r in N.bind_operands(metrics.where("question = 'q' and metric = 'goodwill'"), blocks.where("block = 1"), lex, 1).collect()}
    assert float(second["goodwill"]) == 20e7


def test_groups_need_page_and_anchors(spark):
    items = spark.createDataFrame([("q", 1, 3, "Trade  payables 1,234 crore"), ("q", 2, 4, "other"), ("q", 3, 5, "Revenue – 12,34,567")], "question string, rank int, page int, text string")
    spans = spark.createDataFrame([("q", "a", 3, ["trade payables", "1234"]), ("q", "a", 9, ["x"]), ("q", "b", 4, ["Revenue"]), ("q", "c", 5, ["revenue - 1234567"])], "question string, group_id string, page int, anchors array<string>")
    assert sorted((r.group_id, r["rank"]) for r in T.satisfied(items, spans).collect()) == [("a", 1), ("c", 3)]
    s = {r.k: (round(r.recall, 3), r.rr, r.all_found, round(r.precision, 3)) for r in T.group_scores(items, spans, [1, 3]).collect()}
    assert s == {1: (0.333, 1.0, False, 1.0), 3: (0.667, 1.0, False, 0.667)}
    corpus = spark.createDataFrame([("c1", 4, "our Revenue"), ("c2", 9, "y")], "chunk_id string, page int, text string")
    assert [(r.group_id, r.verdict, r.holders) for r in T.diagnosed(items, spans, corpus, 3).collect()] == [("b", "ranked_too_low", ["c1"])]


def test_oracle_is_all_or_nothing(spark):
    chunks = spark.createDataFrame([("d", 0, 1, "a b", "c0"), ("d", 1, 1, "a", "c1"), ("d", 2, 2, "z", "c2")], "document_id string, pos int, page int, text string, chunk_id string")
    spans = spark.createDataFrame([("q", "g", 0, "d", 1, ["a"]), ("q", "h", 1, "d", 2, ["z"]), ("r", "g", 0, "d", 1, ["a"]), ("r", "h", 1, "d", 2, ["missing"])], "question string, group_id string, group_pos int, document_id string, page int, anchors array<string>")
    assert sorted(map(tuple, T.oracle_blocks(spans, chunks).collect())) == [("q", "E1", "c0"), ("q", "E2", "c2")]


def test_retrieved_is_tristate(spark):
    blocks = spark.createDataFrame([("a", 1, "x y"), ("b", 1, "q"), ("c", 1, None), ("e", 1, "x")], "question string, page int, text string")
    spans = spark.createDataFrame([(q, "g", 1, ["x"]) for q in "abcd"], "question string, group_id string, page int, anchors array<string>")
    assert {r.question: r.retrieved for r in T.evidence_retrieved(blocks, spans).collect()} == {"a": True, "b": False, "c": None, "d": False, "e": None}


def test_sealed_split(spark):
    q = spark.createDataFrame([("a", "test", "validated", "1", False), ("b", "test", "pending", "1", False), ("c", "test", "validated", "1", True)], "qid string, split string, status string, answer string, ambiguous boolean")
    for more in ({}, {"allowed": True}, {"allowed": True, "reason": "x", "include_pending": True}):
        with pytest.raises(DS.SealedSplit):
            DS.split_of(q, "test", **more)
    assert [r.qid for r in DS.split_of(q, "test", allowed=True, reason="final").collect()] == ["a"]
    with pytest.raises(ValueError):
        DS.unique_qids(q.union(q))


def test_second_pass(spark):
    q = spark.createDataFrame([("a", "5", "INR", "validated", None, None), ("b", "6", "INR", "validated", None, None), ("c", "7", "INR", "pending", None, None)], "qid string, answer string, unit string, status string, evidence array<struct<page:int,anchors:array<string>>>, second_pass_agreed boolean")
    sheet = spark.createDataFrame([("a", "validated", "", ""), ("b", "validated", "8", ""), ("c", "rejected", "", ""), ("zz", "validated", "", "")], "qid string, verdict string, corrected_answer string, corrected_unit string")
    got = {r.qid: (r.answer, r.status, r.second_pass_agreed) for r in DS.imported(q, sheet, "ann", 2).collect()}
    assert got == {"a": ("5", "validated", True), "b": ("8", "validated", False), "c": ("7", "rejected", None)}
    assert [r.qid for r in DS.unknown_qids(sheet, q).collect()] == ["zz"]
    assert DS.agreement(DS.imported(q, sheet, "ann", 2)).first().agreement == 0.5


def test_pools(spark):
    configs = spark.createDataFrame([("r1", "v", "m", "p"), ("r2", "v", "m2", "p")], "run_id string, split string, natural_model string, program_model string")
    runs = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, x int")
    with pytest.raises(ValueError):
        C.pooled(runs, configs)
    assert C.pooled(runs, configs.where("run_id = 'r1'")).count() == 1
    pools = spark.createDataFrame([("r1+r2",), ("r1+r9",), ("r1",)], "run_id string")
    assert [(r.run_id, r.natural_model) for r in C.pooled_complete(pools, configs).collect()] == [("r1+r2", "m")]


def test_independence(spark):
    b = lambda *rows: spark.createDataFrame(list(rows), "role string, provider string, model string")
    n = ("natural_channel", "x", "m")
    assert [tuple(C.independence(b(n, ("program_channel", *p))).first())[0] for p in (("y", "m"), ("x", "m2"), ("x", "m"))] == [True, True, False]


def test_preflight(spark):
    chunks = spark.createDataFrame([("d1", "Acme"), ("d2", "Beta")], "document_id string, company string")
    m = I.manifest(chunks, "col", "e5", 64)
    ok = spark.createDataFrame([("Acme",)], "company string")
    assert I.preflight(m, chunks, "col", "e5", ok).first().companies == ["Acme", "Beta"]
    for bad in (("other", "e5", ok), ("col", "bge", ok), ("col", "e5", spark.createDataFrame([("Gone",)], "company string"))):
        with pytest.raises(ValueError):
            I.preflight(m, chunks, *bad)
    assert [r.c for r in I.present(chunks, "company", spark.createDataFrame([("Acme",), ("Zed",)], "c string")).collect()] == ["Acme"]


def test_index_by_partitions(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = lambda *r: spark.createDataFrame(list(r), "document_id string, company string, fiscal_year string")
    I.write(rows(("d1", "Acme", "2023-24"), ("d2", "Beta", "2023-24")), path, recreate=True)
    I.write(rows(("d3", "Acme", "2023-24")), path)
    back = spark.read.parquet(path)
    assert sorted(r.document_id for r in back.collect()) == ["d2", "d3"]
    assert I.count(back, I.matches(company="Acme", fiscal_year=["2023-24", "2024-25"], page=None)) == 1


def test_rerank_keeps_the_fused_rank(spark):
    f = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id int, doc int, rank int")
    s = spark.createDataFrame([(1, 10, 0.1), (1, 11, 0.9), (1, 12, 0.1)], "query_id int, doc int, score double")
    assert [(r.doc, r.fused_rank) for r in R.reranked(f, s, 2).orderBy("rank").collect()] == [(11, 2), (10, 1)]


def test_interval_of_auroc(spark):
    """Resamples by weights against resamples by rows."""
    import random

    r = random.Random(3)
    rows = [(i, r.random() + 0.5 * (i % 2), i % 2) for i in range(60)]
    got = M.bootstrap_auroc(spark.createDataFrame(rows, "id int, score double, label int").repartition(4), 2000).first()
    auc = lambda x: (lambda p, n: sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n)) if p and n else None)([s for _, s, y in x if y], [s for _, s, y in x if not y])
    draws = sorted(filter(None, (auc([r.choice(rows) for _ in rows]) for _ in range(600))))
    assert got.point == pytest.approx(auc(rows)) and got.low == pytest.approx(draws[15], abs=0.04) and got.high == pytest.approx(draws[584], abs=0.04)
    same = M.paired_auroc(spark.createDataFrame([(i, s, y, s, y) for i, s, y in rows], "id int, score_a double, label_a int, score_b double, label_b int"), 200).first()
    assert same.point == 0 and same.low == 0 and not same.excludes_zero and same.p_value == 1.0


def test_hypotheses_and_contrasts(spark):
    rows = [(arm, f"q{i}", i % 3 != 0, (0.9 if i % 3 == 0 else 0.1) if arm == "A" else (i % 7) / 7, ["retrieval_caused", "reasoning_caused"][i % 2], "1" if i % 5 else None, True) for arm in ("A", "B5", "G", "B") for i in range(40)]
    cases = spark.createDataFrame(rows, "arm string, qid string, correct boolean, risk_score double, stratum string, predicted string, agreed boolean").cache()
    h = {r.name: r for r in RP.hypotheses(cases, 300).collect()}
    assert h["H1"].testable and h["H1"].point > 0.3 and h["H1"].significant and not h["H4"].testable and h["H4"].significant is None
    c = {(r.name, r.family): r for r in RP.contrasts(cases, resamples=300).collect()}
    assert set(c) == {("A-B", "all"), ("A-B", "committed"), ("A-G", "all"), ("A-G", "committed")} and c["A-B", "all"].n == 40 and c["A-B", "committed"].n == 32 and not c["A-B", "all"].underpowered
    s = {r.stratum: (r.n, r.auroc) for r in RP.stratified(cases.where("arm = 'A'"), 50).collect()}
    assert s["pooled"] == (40, 1.0) and s["unknown"] == (0, None) and RP.strata_difference(cases).first().difference == 0.0
    assert RP.operating_threshold(cases, "A") == 0.9
    assert RP.melted(RP.report(cases.where("arm = 'A'"), 50)).where("metric = 'auroc' and stratum = 'pooled'").first().value == 1.0


def test_replies_and_explanations(spark):
    risk = V.risk(spark.createDataFrame([(1, "UNCERTAIN", 0.45, 0.5, 0.9, ["channel_unavailable"], 1, 2)], "k int, verdict string, score double, base_score double, coverage double, disagreements array<string>, usable int, applicable int"), F.lit(3))
    e = V.explained(risk, F.lit("5 crore"), F.lit("natural"), F.lit(3)).first()
    assert e.remedies == ["second_channel", "missing_channels"] and e.text.startswith("ANSWER: 5 crore\n  source: natural\n  risk:   0.511 (MEDIUM)") and "agreement: PARTIAL - fewer than two channels" in e.text
    line = spark.range(1).select(V.channel_line("A", F.lit(True), F.lit(True), F.lit(False), F.lit(None).cast("string"), F.lit("quota")).alias("l")).first().l
    assert line == "A: produced no figure (quota)"


def test_reads(spark):
    docs = spark.createDataFrame([(1, "d1", "s1", "f1", 7, "2023-24", 3)], "id int, document_id string, sha256 string, filename string, company_id int, fiscal_year string, page_count int")
    companies = spark.createDataFrame([(7, "Acme")], "id int, name string")
    records = spark.createDataFrame([("d1", "s1", "f1b", "Acme", "2023-24", 4), ("d2", "s2", "f2", "Beta", None, 1)], "document_id string, sha256 string, filename string, company string, fiscal_year string, page_count int")
    d, c = api.ingest_registry(docs, companies, records)
    assert sorted((r.document_id, r.filename, r.company_id) for r in d.collect()) == [("d1", "f1b", 7), ("d2", "f2", 8)] and sorted(r.name for r in c.collect()) == ["Acme", "Beta"]
    labels = api.document_labels(spark.createDataFrame([("d1",), ("d2",), ("d3",)], "document_id string"), d, c)
    assert {r.document_id: r.label for r in labels.collect()} == {"d1": "Acme 2023-24", "d2": "Beta", "d3": "d3"}
    with pytest.raises(ValueError):
        api.list_documents(docs, companies, 501)
    assert api.get_document(docs, companies, "nope").count() == 0


def test_coverage_of_sub_questions(spark):
    subs = spark.createDataFrame([(1, 0), (1, 1)], "k int, sub int")
    hits = spark.createDataFrame([(1, 0, 5), (1, 0, 6)], "k int, sub int, doc int")
    assert {r.sub: r.n for r in Q.coverage(subs, hits, "k").collect()} == {0: 2, 1: 0} and [r.sub for r in Q.uncovered(subs, hits, "k").collect()] == [1]


def test_chunks_written_and_read(spark, tmp_path):
    from ledgerlark.sources import records as S

    c = spark.createDataFrame([("d:p1:t0:0", "table", "x", "d", 1, "crore"), ("e:p1:x0", "text", "y", "e", 1, None)], "chunk_id string, kind string, text string, document_id string, page int, context_scale string")
    S.write_chunks(c, str(tmp_path / "c"))
    back = S.read_chunks(spark, str(tmp_path / "c"))
    assert sorted((r.chunk_id, r.context_scale) for r in back.collect()) == [("d:p1:t0:0", "crore"), ("e:p1:x0", None)]
    S.write_chunks(c.withColumn("context_scale", F.lit("dozen")), str(tmp_path / "b"))
    with pytest.raises(Exception, match="unknown scale"):
        S.read_chunks(spark, str(tmp_path / "b")).collect()
    blocks = spark.createDataFrame([("q", 2, "d:p1:t0:0"), ("q", 1, "e:p1:x0"), ("q", 3, "gone")], "question string, pos int, chunk_id string")
    assert S.retrieved_text(S.block_texts(blocks, back)).first().text == "y\nx"


def test_dataset_written_and_read(spark, tmp_path):
    from ledgerlark.sources import records as S

    q = spark.createDataFrame([("b", "Q2", ("5", "INR"), False), ("a", "Q1", None, True)], "qid string, question string, answer struct<text:string,unit:string>, ambiguous boolean").withColumn("validation", F.struct(F.lit("validated").alias("status")))
    head = spark.createDataFrame([("set", "1", 2)], "set_id string, version string, total int")
    S.write_dataset(q, head, str(tmp_path / "d"))
    back = S.read_dataset(spark, str(tmp_path / "d"))
    assert sorted((r.qid, r.answer, r.unit, r.status, r.ambiguous, r.awaiting) for r in back.collect()) == [("a", None, None, "validated", True, False), ("b", "5", "INR", "validated", False, False)]
    assert S.markdown(back.orderBy("qid"), "Set", ["qid", "answer"]) == "# Set\n\n| qid | answer |\n|---|---|\n| a | — |\n| b | 5 |"
    S.write_dataset(q.union(q), head, str(tmp_path / "e"))
    with pytest.raises(ValueError):
        S.read_dataset(spark, str(tmp_path / "e"))


def test_derived_candidates_need_one_basis(spark):
    facts = spark.createDataFrame([("d", "profit for the year", 1, 5), ("d", "total equity", 2, 9), ("d", "total assets", 3, 9), ("e", "goodwill", 1, 1)], "document_id string, metric string, page int, amount int")
    basis = spark.createDataFrame([("d", 1, "consolidated"), ("d", 2, "consolidated"), ("d", 3, "standalone"), ("e", 1, "-")], "document_id string, page int, basis string")
    got = Q.derived_candidates(facts, basis).collect()
    assert [(r.document_id, r.metric, r.basis, r.components) for r in got] == [("d", "return on equity", "consolidated", ["profit for the year", "total equity"])]


def test_formulations(spark):
    q = spark.createDataFrame([(1, "For Acme Limited, what was x (the sum)?", "Acme Limited")], "k int, q string, c string")
    assert {r.arm: r["query"] for r in Q.formulations(q, "k", "q", "c").collect()} == {"asis": "For Acme Limited, what was x (the sum)?", "no_company": "For, what was x (the sum)?", "no_gloss": "For Acme Limited, what was x?", "both": "For, what was x?"}


def test_bootstrap_weights_are_poisson_draws_that_cost_little():
    """Sixteen bits fix all draws but those at a step of the distribution function; shares and means are those of mean 1."""
    import math
    from itertools import pairwise

    steps = [0.0, *M._UPTO[:-1]]
    assert (M._DRAWN < 0).sum() == len({int(u * 65536) for u in M._UPTO if u < 1 - 2**-16} | {65535})
    for k, (low, high) in enumerate(pairwise(steps)):
        assert high - low == pytest.approx(math.exp(-1) / math.factorial(k), abs=1e-12)
        fixed = M._DRAWN == k
        assert fixed.sum() <= (high - low) * 65536 < fixed.sum() + 2 or k > 7
    w = M._weights(3, list(range(400)), 10000)
    assert w.shape == (400, 10000) and (w == M._weights(3, list(range(400)), 10000)).all() and w.min() == 0
    assert all((w == k).mean() == pytest.approx(math.exp(-1) / math.factorial(k), abs=1.5e-3) for k in range(6))
    assert (M._weights(3, [5], 10001)[0, :10000] == w[5]).all() and not (M._weights(4, [5], 10000) == w[5]).all()
