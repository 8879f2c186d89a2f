"""All groups at once against one group at a time; the whole report of a campaign."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import metrics as M
from ledgerlark.operators import questions as Q
from ledgerlark.operators import report as RP
from ledgerlark.operators import taxonomy as T
from ledgerlark.sources import records as RR


def cases(spark):
    r = random.Random(9)
    rows = []
    for arm in ("A", "B5", "G", "H"):
        for i in range(60):
            wrong = i % 4 == 0
            rows.append((arm, f"q{i}", not wrong, None if i == 7 else round(r.random() * 0.5 + (0.45 if wrong and arm == "A" else 0), 1), ["retrieval_caused", "reasoning_caused", "unknown", None][i % 4 if i % 8 else 0], "1", i % 3 > 0))
    return spark.createDataFrame(rows, "arm string, qid string, correct boolean, risk_score double, stratum string, predicted string, agreed boolean").repartition(5).cache()


def test_groups_at_once(spark):
    c = cases(spark)
    rows = c.where("risk_score is not null").select("arm", F.col("qid").alias("id"), F.col("risk_score").alias("score"), (~F.col("correct")).cast("int").alias("label"))
    many = M.auroc_draws_by(rows, ["arm"], 200)
    ranked = {r.arm: r for r in M.ranked_by(rows, ["arm"]).collect()}
    cuts = {r.arm: r for r in M.thresholds_by(rows, ["arm"]).collect()}
    for arm in ("A", "G"):
        own = rows.where(F.col("arm") == arm)
        assert np.allclose(many[arm,], M.auroc_draws(own, 200), equal_nan=True)
        assert ranked[arm].auroc == pytest.approx(M.auroc(own).first()[0]) and ranked[arm].average_precision == pytest.approx(M.average_precision(own).first()[0])
        one = M.select_threshold(own).first()
        assert (cuts[arm].threshold, cuts[arm].tp, cuts[arm].fp, cuts[arm].f1) == (one.score, one.tp, one.fp, pytest.approx(one.f1))
    assert M.auroc_draws_by(rows.where("1 = 0"), ["arm"], 10) == {}


def test_campaign_report(spark):
    c = cases(spark)
    call = lambda n: (True, True, None, None, None, (None, None, None, None, n, 1.0, None, None)) if n else None
    runs = spark.createDataFrame(
        [(arm, f"q{i}", "5", False, 100, float(i), call(40), call(20) if i % 2 else None, [call(10), call(0), call(5)] if arm == "B5" else None, (i % 5 == 0, True, None, False, None)) for arm in ("A", "B5") for i in range(60)],
        f"arm string, question_id string, answer string, abstained boolean, tokens_used bigint, latency_seconds double, natural {RR.CHANNEL}, program {RR.CHANNEL}, samples array<{RR.CHANNEL}>, verification struct<triggered:boolean,available:boolean,resolution:string,resolved:boolean,value:string>",
    )
    arbiter = c.select("arm", F.lit(True).alias("triggered"), F.col("agreed").alias("resolved"), "correct", F.lit(True).alias("right_available"))
    r = RP.campaign_report(c, runs=runs, arbiter=arbiter, resamples=100)
    assert set(r) == {"detection", "contingency", "errors", "efficiency", "arbitration", "hypotheses", "contrasts"}
    d = {(x.arm, x.stratum): x for x in r["detection"].collect()}
    assert len(d) == 16 and d["A", "pooled"].n == 59 and d["A", "unknown"].errors == 0 and d["A", "unknown"].auroc is None
    assert sum(x.agree_correct + x.agree_wrong + x.disagree_correct + x.disagree_wrong for x in r["contingency"].collect()) == 240
    e = {x.arm: x for x in r["efficiency"].collect()}
    assert e["B5"].tokens_by_channel == {"natural": 2400, "natural_sample": 900, "program": 600} and e["A"].unattributed_tokens == 60 * 100 - 3000 and e["A"].trigger_rate == pytest.approx(0.2) and e["A"].calls == 90 and e["B5"].p50 == 29.5
    h = {x.name: x for x in r["hypotheses"].collect()}
    assert set(h) == {"H1", "H2", "H3", "H4", "H5"} and h["H1"].verdict == "supported" and h["H5"].verdict == "described" and h["H1"].low > 0
    assert {x.arm for x in r["arbitration"].collect()} == {"A", "B5", "G", "H"}
    gold = runs.where("arm = 'A'").select("question_id", F.lit(5).cast("decimal(38,6)").alias("amount"), F.lit("unknown").alias("unit_kind"), F.lit(None).cast("string").alias("currency"), F.lit(False).alias("ambiguous"))
    a = RR.answer_records(runs.withColumn("stratum", F.lit(None).cast("string")), gold).where("arm = 'A'").collect()
    assert len(a) == 60 and all(x.prediction == 5 for x in a) and sum(x.program_executed is None for x in a) == 30
    with pytest.raises(ValueError):
        RP.operating_threshold(c, "A", validation_run="r1", reported_run="r1")


def test_longest_term_by_tree(spark):
    lexicon = spark.createDataFrame([("total", "T"), ("total assets", "TA"), ("total assets held for sale", "TS"), ("assets", "AS"), ("assets", "AZ"), ("net, of tax", "N"), ("", "none"), ("sale", "S")], "alias string, canonical string")
    texts = ["the total assets held for a sale", "Total Assets held for sale!", "subtotal assets", "nothing", None, "net, of tax and total", "total " * 50, "total assets total assets held for sale sale"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    got = {r.k: r.canonical for r in Q.longest_term(df, "k", "t", lexicon).collect()}
    assert got == {0: "TA", 1: "TS", 2: "AZ", 5: "N", 6: "T", 7: "TS"}
    assert Q.longest_term(df, "k", "t", lexicon.where("1 = 0")).count() == 0


def test_spans_by_one_automaton(spark, monkeypatch):
    r = random.Random(2)
    words = ["revenue", "1,234", "12,34,567", "1234", "tax", "net", "of", "—", "2,34"]
    texts = [(r.randrange(3), " ".join(r.choice(words) for _ in range(r.randrange(9))), f"c{i}") for i in range(60)] + [(None, "revenue tax", "n"), (1, None, "m")]
    spans = [(f"q{i}", f"g{i % 3}", r.randrange(3), [" ".join(r.choice(words) for _ in range(r.randrange(1, 3))) for _ in range(r.randrange(3))]) for i in range(25)] + [("q0", "g0", 1, [""])]
    t, s = spark.createDataFrame(texts, "page int, text string, chunk_id string").repartition(3), spark.createDataFrame(spans, "question string, group_id string, page int, anchors array<string>")
    want = {tuple(x) for x in t.join(s, "page").where(T.holds_anchors(F.coalesce("text", F.lit("")), F.col("anchors"))).select("question", "group_id", "chunk_id").collect()}
    assert {tuple(x) for x in T.spans_in(t, "page", "chunk_id", s).collect()} == want and len(want) > 20
    monkeypatch.setattr(T, "LETTERS", 50)
    assert {tuple(x) for x in T.spans_in(t, "page", "chunk_id", s).collect()} == want
    assert T.spans_in(t, "page", "chunk_id", s.where("1 = 0")).count() == 0
