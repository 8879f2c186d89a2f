"""Positions, cuts and percentiles against sorting everything; the ingest graph against stops in between."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import dataset as D
from ledgerlark.operators import ingest as G
from ledgerlark.operators import selection as S
from ledgerlark.operators import windows as W


def rows_of(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["a", "a", "a", "a", "b", None, "c" if i == 7 else "a"]), r.choice([1.0, 2.5, 2.5, None, r.random()])) for i in range(900)]
    return rows, spark.createDataFrame(rows, "k long, g string, v double").repartition(7)


def test_cut_by_hash(spark):
    rows, df = rows_of(spark)
    share = [lambda n: F.floor(n * 0.25), lambda n: F.floor(n * 0.5), lambda n: n]
    h = lambda k: hashlib.md5(f"x{k}".encode()).hexdigest()
    for by in (["g"], []):
        want = {}
        for g in {x[1] if by else 0 for x in rows}:
            own = sorted((h(k), k) for k, y, _ in rows if not by or y == g)
            for i, (_, k) in enumerate(own):
                want[k] = sum(i >= c for c in (len(own) // 4, len(own) // 2, len(own)))
        got = S.cut_by_hash(df, by, "k", "x", share, "cut")
        assert got.columns == ["k", "g", "v", "cut"] and {x.k: x["cut"] for x in got.collect()} == want
    assert S.cut_by_hash(df.where("1 = 0"), ["g"], "k", "x", share, "cut").count() == 0
    assert W.hash_sample(df.where("1 = 0"), "k", "x", 0.2).count() == 0 and W.hash_sample(df.limit(1), "k", "x", 0.2).count() == 1


def test_percentiles(spark):
    rows, df = rows_of(spark)
    got = {x.g: x for x in S.percentiles(df, ["g"], "v", linear={"p50": 0.5, "p95": 0.95}, nearest={"p90": 0.9}).collect()}
    for g in {x[1] for x in rows}:
        v = sorted(x for _, y, x in rows if y == g and x is not None)
        if v:
            assert [got[g].p50, got[g].p95] == pytest.approx(np.quantile(v, [0.5, 0.95]).tolist())
            assert got[g].p90 == (v[int(len(v) * 0.9) - 1] if int(len(v) * 0.9) else None)
    assert S.percentiles(df.where("v is null"), ["g"], "v", linear={"p": 0.5}).count() == 0


def test_percentiles_of_many_rows(spark):
    """Enough rows that two range sorts would draw different bounds."""
    df = spark.range(40_000).select((F.col("id") % 3).cast("string").alias("g"), F.rand(5).alias("v"), F.col("id").alias("other")).repartition(6).persist()
    v = df.toPandas()
    got = {r.g: r for r in S.percentiles(df, ["g"], "v", linear={"p50": 0.5, "p95": 0.95}).collect()}
    for g, own in v.groupby("g"):
        assert [got[g].p50, got[g].p95] == pytest.approx(own.v.quantile([0.5, 0.95]).tolist())
    numbered = S.numbered(df, ["g"], ["v"], "i").toPandas()
    assert (numbered.i == numbered.groupby("g").v.rank(method="first")).all()


def test_positions_in_turn(spark):
    rows, df = rows_of(spark)
    q = df.where("g is not null").select(F.col("k").alias("qid"), F.col("g").alias("company"))
    of = {}
    for k, g, _ in rows:
        if g:
            of.setdefault(g, []).append(k)
    order = sorted((t, len(own), g, k) for g, own in of.items() for t, k in enumerate(sorted(own)))
    assert {x.qid: x.position for x in D.interleaved(q).collect()} == {k: i + 1 for i, (*_, k) in enumerate(order)}


def test_cascade_follows_every_way(spark):
    df = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    tables = {
        "experiments": df([(1,), (2,)], "id long"), "questions": df([(5,), (6,)], "id long"), "answers": df([(10, 1, 5), (11, 2, 6), (12, 2, 5), (13, None, 6)], "id long, experiment_id long, question_id long"),
        "reasoning_runs": df([(10,), (11,), (12,), (None,)], "answer_id long"), "results": df([(1,), (2,)], "experiment_id long"),
    }
    left = G.cascade(tables, "questions", df([(5,)], "id long"))
    assert [r.id for r in left["answers"].orderBy("id").collect()] == [11, 13]
    assert {r.answer_id for r in left["reasoning_runs"].collect()} == {11, None} and left["results"].count() == 2
    left = G.cascade(tables, "experiments", df([(2,), (9,)], "id long"))
    assert [r.id for r in left["answers"].orderBy("id").collect()] == [10, 13] and [r.experiment_id for r in left["results"].collect()] == [1]


CHANNEL = "struct<available:boolean,failure_reason:string,value:string,canonical:double>"
RECORD = f"arm string, question_id string, written long, answer string, abstained boolean, agreed boolean, verdict string, consistency_score double, risk_score double, latency_seconds double, error string, natural {CHANNEL}, program {CHANNEL}, verification struct<triggered:boolean,available:boolean,resolution:string,resolved:boolean,value:string>"
GRADED = "arm string, qid string, correct boolean, stratum string, label struct<provenance:string,kind:string,confidence:string,counts_as_hallucination:boolean>"


def record(arm, qid, answer, written=1, program=True):
    c = (True, None, answer, 1.0)
    return (arm, qid, written, answer, False, True, None, 0.5, None, 1.0, None, c, c if program else None, None)


def test_ingest_resumes_and_replaces_children(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    registry = spark.createDataFrame([("d1", "s1", "f", "acme", "2023", 3), ("d2", "s2", "g", "", None, 1)], "document_id string, sha256 string, filename string, company string, fiscal_year string, page_count int")
    span = "array<struct<group_id:string,any_of:array<struct<page:int,anchors:array<string>>>>>"
    dataset = spark.createDataFrame([("Q1", "q", "d1", "test", "1", "INR", "pending", [("g", [(4, ["x"])])]), ("Q2", "q", "dx", "test", None, None, "pending", None)], f"qid string, question string, document_id string, split string, answer string, unit string, status string, evidence {span}")
    facts = spark.createDataFrame([("d1", "c", "row", 0, 5), ("d9", "c", "row", 0, 5)], "document_id string, chunk_id string, row_label string, column_index int, amount int")
    graded = spark.createDataFrame([("A", "Q1", False, "agreed", ("model", None, None, None))], GRADED)
    first = spark.createDataFrame([record("A", "Q1", "old", 1), record("A", "Q1", "new", 2), record("A", "Q9", "?"), record(None, "Q1", "?"), record("B", "Q2", "z")], RECORD)
    all_ = {"registry": registry, "facts": facts, "dataset": dataset, "runs": {"r": (first, graded, {"natural_model": "m"})}, "reports": {"r": spark.createDataFrame([("A", "accuracy", "all", 0.5)], "arm string, metric string, stratum string, value double")}}
    real, seen = G.record, []

    def stops(row, where):
        seen.append(where)
        if len(seen) == 6:
            raise OSError("lost")
        real(row, where)

    with monkeypatch.context() as m:
        m.setattr(G, "record", stops)
        with pytest.raises(OSError):
            G.ingest(spark, path, **all_)
    assert G.load(spark, path, "documents").count() == 2 and G.load(spark, path, "answers").count() == 0
    done = G.ingest(spark, path, **all_)
    assert {t: n for t, (n, _) in done.items()} == {"companies": 1, "documents": 2, "facts": 1, "questions": 2, "evidence": 1, "experiments": 1, "answers": 2, "reasoning_runs": 2, "program_runs": 2, "verification_runs": 2, "hallucination_events": 1, "results": 1}
    assert not done["documents"][1] and done["answers"][1]  # what was in stays as it is
    assert not any(changed for _, changed in G.ingest(spark, path, **all_).values())
    assert {r.answer_text for r in G.load(spark, path, "answers").collect()} == {"new", "z"} and G.load(spark, path, "questions").where("document_id is null").count() == 1
    event = G.load(spark, path, "hallucination_events").first()
    assert (event.provenance, event.kind, event.label_confidence, event.counts_as_hallucination) == ("model", "unclassified", "needs_human", True)
    again = spark.createDataFrame([record("A", "Q1", "third", 1, program=False)], RECORD)
    G.ingest(spark, path, runs={"r": (again, graded.where("1 = 0"), {})})
    assert {r.answer_text for r in G.load(spark, path, "answers").collect()} == {"third", "z"}
    assert (G.load(spark, path, "program_runs").count(), G.load(spark, path, "reasoning_runs").count(), G.load(spark, path, "hallucination_events").count()) == (1, 2, 0)
