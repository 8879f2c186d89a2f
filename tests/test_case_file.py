"""The case study's file, with and without results; one answer read with what belongs to it."""

from ledgerlark import api
from ledgerlark.operators import report as RP
from ledgerlark.sources import records as S

CASE = "company string, sector string, question_type string, correct boolean, agreed boolean, verdict string, abstained boolean, latency double, tokens bigint, provenance string, kind string, triggered boolean, resolved boolean"


def written(spark, path, cases, **more):
    S.write_case_study(RP.case_lines(RP.case_tables(cases), "Study", **more), str(path))
    return [r.value for f in sorted(path.glob("part-*")) for r in spark.read.text(str(f)).collect()]


def test_case_study_file(spark, tmp_path):
    rows = [("Acme", "steel", "lookup", True, True, "AGREE", False, float(i), 10, None, None, False, False) for i in range(16)]
    rows += [("Beta", None, "growth", False, True, "AGREE", False, 20.0, 11, "retrieval", "scale", False, False), ("Beta", None, "growth", False, False, "DISAGREE", True, None, None, None, "sign", True, False)]
    lines = written(spark, tmp_path / "a", spark.createDataFrame(rows, CASE).repartition(3), corpus="Two companies.")
    assert lines[:5] == ["# Study", "", "Two companies.", "", "**18** graded questions from 2 companies."]
    heads = [x for x in lines if x.startswith("#")]
    assert heads == ["# Study", "## Headline", "## By company", "## By type of question, the hardest first", "## Errors by provenance", "## Errors by kind", "## Arbitration"]
    for line in (
        "| Numerical accuracy | 88.9% |", "| No agreement: other figures, or none from a channel | 5.6% |", "| Other figures (verdict DISAGREE) | 1 of 18 (5.6%) |", "| **Agreed and both wrong** | 1 of 18 |", "| Latency p50 / p95 | 8.00s / 16.00s |", "| Tokens per question | 10 |",
        "The arbiter was asked for 5.6% of the questions; it settled 0 and left 1 open.",
    ):
        assert line in lines, line
    at = lines.index("## By company")
    assert lines[at + 4 : at + 7] == ["| Beta | — | 2 | 0.0% | 50.0% | 1 | **thin cell** |", "| Acme | steel | 16 | 100.0% | 0.0% | 0 |  |", ""]
    at = lines.index("## Errors by provenance")
    assert lines[at + 4 : at + 6] == ["| retrieval | 1 |", "| unknown | 1 |"]


def test_case_study_of_few_and_none(spark, tmp_path):
    few = written(spark, tmp_path / "few", spark.createDataFrame([("Acme", None, "lookup", True, True, "AGREE", False, None, None, None, None, False, False)], CASE))
    assert few[2:4] == ["**1** graded questions from 1 companies.", "> **Fewer than 15 questions: no rate here is a finding.**"] and "| Latency p50 / p95 | —s / —s |" in few
    none = written(spark, tmp_path / "none", spark.createDataFrame([], CASE), corpus="Chosen.")
    assert none[:4] == ["# Study", "", "Chosen.", ""] and none[4].startswith("No results yet") and not any(x.startswith("|") or x.startswith("##") for x in none)


def test_one_answer(spark):
    answers = spark.createDataFrame([(1, 10, 100, "A"), (2, 10, 101, "A")], "id int, experiment_id int, question_id int, arm string")
    experiments, questions = spark.createDataFrame([(10, "r")], "id int, run_id string"), spark.createDataFrame([(100, "q1", "one"), (101, "q2", "two")], "id int, qid string, text string")
    channels = spark.createDataFrame([(1, "program", True, "5", None), (1, "natural", False, None, "declined"), (2, "natural", True, "6", None)], "answer_id int, channel string, available boolean, value string, failure_reason string")
    evidence = spark.createDataFrame([(7, 100, 3, "g", "a"), (5, 100, 2, "g", "b"), (6, 101, 1, "g", "c")], "id int, question_id int, page int, group_id string, anchors string")
    verifications = spark.createDataFrame([(1, True, "supports_a", True, "5")], "answer_id int, triggered boolean, resolution string, resolved boolean, value string")
    got = api.get_answer(answers, experiments, questions, channels, evidence, verifications, 1).collect()
    assert len(got) == 1 and got[0].qid == "q1" and [c.channel for c in got[0].channels] == ["natural", "program"] and [e.id for e in got[0].evidence] == [5, 7] and got[0].verification.resolution == "supports_a"
    assert api.get_answer(answers, experiments, questions, channels, evidence, verifications, 3).count() == 0
    assert [r.id for r in api.get_evidence(evidence, questions, "q1").collect()] == [5, 7] and api.get_verification(verifications, 2).count() == 0
    other = api.get_answer(answers, experiments, questions, channels, evidence, verifications, 2).first()
    assert other.verification is None and [e.id for e in other.evidence] == [6]
