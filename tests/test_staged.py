"""Answers in stages: who is asked, what counts, what is said about it."""

from ledgerlark.operators import staged as G
from ledgerlark.operators import verify as V

CH = "q string, channel int, available boolean, applicable boolean, amount decimal(38,6), scale string, unit_kind string, currency string, said string, reason string, sufficient boolean, executed boolean"


def channels(spark, rows):
    from decimal import Decimal

    return spark.createDataFrame([(q, c, v is not None, a, None if v is None else Decimal(v), "unit", "currency", "INR", None if v is None else str(v), why, ok, ran) for q, c, a, v, why, ok, ran in rows], CH)


def fixture(spark):
    rows = [
        ("agree", 0, True, 5, None, True, False), ("agree", 1, True, 5, None, None, True), ("agree", 2, False, None, "lookup", None, False),
        ("settled", 0, True, 5, None, True, False), ("settled", 1, True, 7, None, None, True), ("settled", 2, False, None, None, None, False),
        ("open", 0, True, 5, None, True, False), ("open", 1, True, -5, None, None, True), ("open", 2, True, 5, None, None, False),
        ("waiting", 0, True, 5, None, True, False), ("waiting", 1, True, 9, None, None, True),
        ("silent", 0, True, None, "declined", False, False), ("silent", 1, True, None, None, None, False),
        ("broken", 0, True, None, "no JSON object in the reply", True, False),
    ]
    replies = spark.createDataFrame(
        [
            ("agree", 1, '{"resolution": "candidate_2", "answer": "9", "unit": ""}', False),  # nobody asked
            ("settled", 1, '{"resolution": "neither", "answer": "1"}', False), ("settled", 2, '{"resolution": "candidate_1", "answer": "7", "unit": "thousand"}', True),
            ("open", 1, '{"resolution": "neither", "answer": null}', None),
        ],
        "q string, attempt int, payload string, swapped boolean",
    )
    evidence = spark.createDataFrame([(q, p, f"p. {p}") for q in ("agree", "settled", "open", "waiting", "silent") for p in (2, 1)], "q string, pos int, citation string")
    return channels(spark, rows), replies, evidence


def test_answered(spark):
    got = {r.q: r for r in G.answered(*fixture(spark), "q", 0.6).collect()}
    assert len(got) == 6
    assert {q: (r.source, None if r.answer is None else float(r.answer)) for q, r in got.items()} == {"agree": ("natural", 5), "settled": ("verification_agent", 7000), "open": ("natural", 5), "waiting": ("natural", 5), "silent": (None, None), "broken": (None, None)}
    assert {q for q, r in got.items() if r.arbiter_ran} == {"settled", "open"} and got["settled"].resolution == "supports_b" and got["open"].resolution == "supports_neither" and not got["open"].arbiter_resolved
    assert {q for q, r in got.items() if r.abstained} == {"silent"}
    assert got["broken"].risk_score == 1.0 and got["broken"].blocks == 0 and got["broken"].remedies == ["retrieve_evidence"] and not got["broken"].withheld
    assert got["open"].withheld and got["open"].risk_score > got["waiting"].risk_score - 1e-9 and not got["agree"].withheld
    assert got["agree"].citations == ["E1: p. 1", "E2: p. 2"] and got["agree"].statements == ["natural: 5", "program: 5", "deterministic: does not apply to this question (lookup)"]
    assert got["settled"].statements[-1] == "arbiter: supports_b -> 7000.000000" and got["open"].statements[-1] == "arbiter: supports_neither"
    assert got["waiting"].statements[-1] == "deterministic: not run in this configuration"
    assert got["open"].reasons[4:] == ["channels differ in kind: sign_mismatch", "the arbiter left the disagreement open"] and "arbiter_declined" in got["open"].remedies
    text = got["open"].text
    assert [text.index(t) for t in ("ANSWER: 5", "EVIDENCE\n  E1: p. 1", "WHAT EACH CHANNEL SAID\n  natural: 5", "WHY\n  evidence: ", "WHAT WOULD CHANGE IT", "CAVEATS")] == sorted(text.index(t) for t in ("ANSWER: 5", "EVIDENCE", "WHAT EACH CHANNEL SAID", "WHY", "WHAT WOULD CHANGE IT", "CAVEATS"))


def test_asked_next(spark):
    c, replies, _ = fixture(spark)
    assert [(r.q, r.candidate_1, r.candidate_2) for r in G.asked_next(c, replies, "q").collect()] == [("waiting", "5", "9")]
    assert {r.q for r in G.asked_next(c, replies.where("1 = 0"), "q").collect()} == {"settled", "open", "waiting"}
    assert G.answered(c.where("1 = 0"), *fixture(spark)[1:], "q").count() == 0


def test_without_a_score(spark):
    risks = spark.createDataFrame([(None, "UNSCORED", None, 1, 1)], "risk_score double, risk_band string, verdict string, applicable int, usable int").selectExpr("*", "cast(null as map<string,string>) as facets", "cast(null as double) as coverage", "cast(null as array<string>) as disagreements")
    from pyspark.sql import functions as F

    e = V.explained(risks, F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(1)).first()
    assert e.reasons == ["nothing here gives a risk score"] and e.remedies == ["enable_consistency"] and e.caveats == [] and e.text.startswith("ANSWER: no answer produced\n  source: none\n  risk:   not scored (UNSCORED)")
