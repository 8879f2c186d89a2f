"""Golden rows of operators that the table queries do not reach."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import text as X
from ledgerlark.functions import values as V
from ledgerlark.operators import documents as D
from ledgerlark.operators import metrics as M
from ledgerlark.operators import projection as P
from ledgerlark.operators import questions as Q
from ledgerlark.operators import retrieval as R
from ledgerlark.operators import verify as C
from ledgerlark.operators import windows as W
from ledgerlark.sources import records as S


def test_modal_cluster(spark):
    rows = spark.createDataFrame([("q", i, v) for i, v in enumerate([100.0, 100.2, 250.0, 100.1])] + [("r", 0, None)], "k string, pos int, v double")
    got = Q.modal_fraction(rows, "k", "v").collect()
    assert [(r.k, r.samples, r.fraction, r.clusters) for r in got] == [("q", 4, 0.75, 2)]
    assert got[0].risk == pytest.approx(0.25 * 0.9 + 0.1 * (0.002 + 1 + 0.001) / 4)
    one = Q.modal_fraction(spark.createDataFrame([("q", 0, 5.0), ("q", 1, None)], "k string, pos int, v double"), "k", "v").first()
    assert one.risk is None


def test_bm25_negative_idf(spark):
    """A term in most documents gets a quarter of the mean idf."""
    import math

    docs = spark.createDataFrame([(1, "apple apple pear"), (2, "apple plum"), (3, "apple fig")], "id int, t string")
    terms = R.query_terms(spark.createDataFrame([(9, "apple")], "q int, t string"), "q", "t", 5)
    got = {r.doc: r.score for r in R.bm25_top(docs, "id", "t", terms, 10).collect()}
    raw = {"apple": math.log(0.5 / 3.5), "pear": math.log(2.5 / 1.5), "plum": math.log(2.5 / 1.5), "fig": math.log(2.5 / 1.5)}
    idf = 0.25 * sum(raw.values()) / 4
    if idf <= 0:
        assert got == {}
    else:
        assert got[1] == pytest.approx(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / (7 / 3))), abs=1e-9)


def test_copies_tie_by_id(spark):
    """Equal texts share their score whatever the order of summing; the smaller id goes first."""
    docs = spark.createDataFrame([(i, "red fox and blue dog and green bird " * (1 + i % 2)) for i in range(40)] + [(100 + i, f"other{i} words") for i in range(200)], "id long, t string").repartition(5)
    terms = R.query_terms(spark.createDataFrame([(1, "blue bird and red dog fox green")], "q long, t string"), "q", "t", None)
    got = R.bm25_top(docs, "id", "t", terms, 30).orderBy("rank").collect()
    odd, even = [i for i in range(40) if i % 2], [i for i in range(40) if i % 2 == 0]
    assert [r.doc for r in got] in ((odd + even)[:30], (even + odd)[:30])
    both = [R.fuse(x, x, 30).orderBy("rank").collect() for x in (R.bm25_top(docs, "id", "t", terms, 30),)][0]
    assert [r.doc for r in both] == [r.doc for r in got]


def test_fusion_order(spark):
    s = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, doc int, rank int")
    k = spark.createDataFrame([(1, 12, 1), (1, 11, 2)], "query_id int, doc int, rank int")
    got = R.fuse(s, k, 10).orderBy("rank").collect()
    assert [(r.doc, r.found_by) for r in got] == [(11, "both"), (10, "semantic"), (12, "keyword")]


def test_round_robin_keeps_first(spark):
    rows = spark.createDataFrame([("q", 0, 5, 1), ("q", 1, 5, 1), ("q", 1, 6, 2), ("q", 0, 7, 2)], "question string, sub int, doc int, rank int")
    assert [(r.sub, r.doc) for r in R.round_robin(rows, 3).orderBy("position").collect()] == [(0, 5), (0, 7), (1, 6)]


def test_holm_stops(spark):
    t = spark.createDataFrame([("a", 0.001), ("b", 0.03), ("c", 0.02)], "name string, p double")
    assert {r.name: r.rejected for r in M.holm(t).collect()} == {"a": True, "c": True, "b": True}
    t = spark.createDataFrame([("a", 0.03), ("b", 0.01), ("c", 0.04)], "name string, p double")
    assert {r.name: r.rejected for r in M.holm(t).collect()} == {"b": True, "a": False, "c": False}


def test_bootstrap_covers_mean(spark):
    rows = spark.range(400).select("id", (F.col("id") % 4 == 0).cast("double").alias("value"))
    r = M.bootstrap_mean(rows, 300, 7).first()
    assert r.low < 0.25 < r.high and r.high - r.low < 0.15 and r.undefined == 0


def test_conflict_of_both_agreeing(spark):
    ch = spark.createDataFrame([(1, 0, 100.0), (1, 1, 100.0), (1, 2, 400.0)], "k int, channel int, a double")
    ch = ch.select("k", "channel", F.lit(True).alias("available"), F.lit(True).alias("applicable"), F.col("a").cast(V.MONEY).alias("amount"), F.lit("unit").alias("scale"), F.lit("currency").alias("unit_kind"), F.lit("INR").alias("currency"))
    r = C.consistency(ch, "k").first()
    assert r.verdict == "DISAGREE" and r.disagreements == ["deterministic_conflict", "magnitude_mismatch"] and r.score == pytest.approx(0.005 / 0.75 * 0.35)


def test_scale_mismatch(spark):
    ch = spark.createDataFrame([(1, 0, "crore"), (1, 1, "million")], "k int, channel int, scale string")
    ch = ch.select("k", "channel", F.lit(True).alias("available"), F.lit(True).alias("applicable"), F.lit(5).cast(V.MONEY).alias("amount"), "scale", F.lit("currency").alias("unit_kind"), F.lit("INR").alias("currency"))
    assert [r.disagreement for r in C.pairs(ch, "k").collect()] == ["scale_mismatch"]


def test_provenance_order(spark):
    from ledgerlark.operators import taxonomy as T

    cases = [  # retrieved, parsed, ambiguous, faulty
        ((False, False, True, True), "definitional_ambiguity"), ((False, False, False, True), "question_understanding"), ((False, None, False, True), "retrieval"), ((None, True, False, False), "retrieval"),
        ((True, True, False, True), "extraction"), ((True, None, False, False), "undetermined"), ((True, True, False, None), "undetermined"), ((True, True, False, False), "reasoning"),
    ]
    df = spark.createDataFrame([c for c, _ in cases], "r boolean, p boolean, a boolean, f boolean").select(T.provenance(F.col("r"), F.col("p"), F.col("a"), F.col("f")).alias("x"))
    got = [r.x for r in df.collect()]
    assert [g.provenance for g in got] == [w for _, w in cases] and [g.confidence == "needs_human" for g in got] == [w == "undetermined" for _, w in cases]


def test_basis_carried_forward(spark):
    long = "The consolidated balance sheet is discussed on the pages that follow, together with what changed in the year that ended"
    texts = ["x", "Standalone Balance Sheet\nx", long, "a\n\nb\nConsolidated Statement of Cash Flows", "a\nb\nc\nstandalone balance sheet", "Consolidated and standalone financial statements", "Consolidated overview"]
    pages = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(texts)], "d string, p int, t string")
    got = D.statement_basis(pages, "d", "p", "t")
    assert [r.basis for r in got.orderBy("p").collect()] == ["-", "standalone", "standalone", "consolidated", "consolidated", "consolidated", "consolidated"]
    assert [(r.basis, r["first"], r["last"]) for r in W.runs(got, ["d"], ["p"], "basis").orderBy("first").collect()] == [("-", 1, 1), ("standalone", 2, 3), ("consolidated", 4, 7)]


def test_chunks_overlap(spark):
    text = " ".join(f"Sentence number {i} ends here." for i in range(60))
    got = D.chunks(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string"), "k", "t", 300, 60).orderBy("k", "part").collect()
    assert {r.k for r in got} == {1} and all(len(r.chunk) <= 300 for r in got) and all(f"number {i} " in " ".join(r.chunk for r in got) for i in range(60))


def test_thoughts_and_truncation(spark):
    df = spark.createDataFrame([("<think>a</think> yes", "x" * 10), ("no <think>open", None)], "t string, s string")
    none = F.lit(None).cast("string")
    got = df.select(X.without_thoughts(F.col("t")).alias("t"), X.evidence_block(F.lit("E1"), F.lit("p.3"), none, F.lit("INR"), F.lit("crore"), F.col("s"), 4).alias("s")).collect()
    assert [(r.t, r.s) for r in got] == [("yes", "[E1] p.3 | figures in INR crore\nxxxx\n... [evidence truncated]"), ("no", "[E1] p.3 | figures in INR crore\n")]
    assert spark.range(1).select(X.evidence_text(F.array().cast("array<string>")).alias("t")).first().t == X.NO_EVIDENCE


def test_upsert_and_prune(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, P.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, P.insert_missing(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert [r.k for r in P.prune(old, new, ["k"]).collect()] == [2] and [r.k for r in P.stale(old, new, ["k"]).collect()] == [1]


def test_run_records(spark, tmp_path):
    ok = {"arm": "A", "question_id": "q1", "tokens_used": 100, "natural": {"available": True, "usage": {"total_tokens": 60, "reported_total_tokens": 70}}}
    (tmp_path / "r.jsonl").write_text(json.dumps(ok) + '\n{"arm": "B", "quest')
    runs = S.read_runs(spark, str(tmp_path / "r.jsonl"))
    assert runs.count() == 1
    assert sorted((r.channel, r.tokens) for r in S.usage_rows(runs).collect()) == [("natural", 70), ("unattributed", 30)]
    grid = spark.createDataFrame([("A", "q1"), ("A", "q2")], "arm string, question_id string")
    assert [r.question_id for r in S.remaining(grid, runs).collect()] == ["q2"]


def test_registry(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "c.pdf").write_bytes(b"<html>")
    got = S.registered(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert sorted((r.bytes, r.is_pdf, len(r.document_id)) for r in got) == [(6, False, 16), (10, True, 16)]
