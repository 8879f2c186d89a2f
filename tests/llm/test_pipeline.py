"""The stages on the smallest tables, each against brute force on its own input."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from ledgerlark.llm import secrets

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, now, kept = docs.columns, docs, []
    for name, stage in P.STAGES[:-1]:
        before = {r.doc_id: r.text for r in now.collect()}
        now = stage(spark, now, SF).cache()
        assert now.columns == cols
        after = {r.doc_id: r.text for r in now.collect()}
        kept.append((name, before, after))
    by = {n: (b, a) for n, b, a in kept}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    b, a = by["quality"]
    good = [i for i in b if labels.get(i) == 1]
    assert sum(i in a for i in good) >= 0.97 * len(good) and sum(i in a for i in b if labels.get(i) == 0) <= 0.1 * len(b)
    b, a = by["near_copies"]
    assert set(a) == {i for i, (_, c) in brute.similar(b.items(), 5, 80).items() if i == c}
    b, a = by["repeats"]
    for i, (w, gone) in brute.repeats(b.items(), 50).items():
        assert i not in a if gone and all(gone) else brute.WORD.findall(a[i]) == [x for x, g in zip(w, gone) if not g]
    b, a = by["secrets"]
    assert set(a) == set(b) and not any(secrets.base_spans(t) for t in a.values())
    packed = P.STAGES[-1][1](spark, now, SF).collect()
    assert {r.doc_id for r in packed} == set(a)


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_awkward_rows(spark, docs, rows, tmp_path):
    """Null texts and ids, empty, blank and very long texts, repeated rows, and columns with the names that stages add."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    more = {"__bit": "b", "__first": "f", "__n": "m", "__key": "k", "__GONE": "g", "component_id": "c"}
    odd = docs.withColumns({c: F.lit(v) for c, v in more.items()})
    now = odd
    for name, stage in P.STAGES[:-1]:
        now = stage(spark, now, f"file://{tmp_path}")
        got = now.collect()
        assert now.columns == odd.columns, name
        assert all(all(r[c] == v for c, v in more.items()) and r.lang == "en" and r.n == 5 for r in got), name
        assert sum(r.doc_id is None for r in got) == 2 and {1, 4, 7} <= {r.doc_id for r in got}, name
        texts = {r.doc_id: r.text for r in got}
        assert texts[1] is None and texts[4] == ""
        if name == "quality":
            assert len(got) == len(rows)
        if name == "near_copies":
            want = brute.similar(dict((i, t) for i, t in rows if i is not None).items(), 5, 80)
            assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(i for i, (_, c) in want.items() if i == c)
    packed = P.STAGES[-1][1](spark, now, f"file://{tmp_path}").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in got}
