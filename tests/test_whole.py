"""Queries without SQL that do the whole job, against brute force over all rows of the smallest tables."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerlark.functions.text import TOKEN
from ledgerlark.operators import retrieval as R
from ledgerlark.plans import QUERIES

DATA = "/root/testdata/sf0.001"


def read(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


def brute_bm25(docs, items):
    """Item to [(score, doc)], best first."""
    words = lambda t: re.findall(TOKEN, (t or "").lower())
    tf = {i: Counter(words(t)) for i, t in docs}
    size = {i: sum(c.values()) for i, c in tf.items()}
    mean = sum(size.values()) / len(size)
    df = Counter(w for c in tf.values() for w in c)
    raw = {w: math.log((len(docs) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    out = {}
    for q, t in items:
        scores = {}
        for d, c in tf.items():
            s = sum(n * (floor if raw[w] < 0 else raw[w]) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * size[d] / mean)) for w, n in sorted(Counter(words(t)).items()) if c[w])
            if s > 0:
                scores[d] = s
        out[q] = sorted((-round(s, 9), d) for d, s in scores.items())
    return out


@pytest.fixture(scope="module")
def ranked():
    return brute_bm25([(r["doc_id"], r["text"]) for r in read("documents")], [(r["item_id"], r["text"]) for r in read("benchmark")])


@pytest.fixture(scope="module")
def gold():
    return [(b["item_id"], d["doc_id"]) for b in read("benchmark") for d in read("documents") if b["text"] in (d["text"] or "")]


def test_bm25_of_all_items(spark, ranked):
    got = {}
    for r in QUERIES["bm25_topk"](spark, DATA).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc, r.score))
    assert set(got) == {q for q, x in ranked.items() if x} and len(got) > 5
    for q, x in ranked.items():
        own = sorted(got[q])
        assert [s for _, _, s in own] == pytest.approx([-s for s, _ in x[:10]], abs=2e-6)
        full = {d: -s for s, d in x}
        assert [i for i, _, _ in own] == list(range(1, len(x[:10]) + 1)) and all(abs(full[d] - s) < 2e-6 for _, d, s in own)


ROWS = [(7, "pear fig"), (3, "pear fig"), (1, None), (4, "plum plum pear"), (5, "\xe9t\xe9 fig kiwi 1,5"), (6, "date"), (10, "lime"), (11, "lime date"), (12, "lemon")]
ASKED = [(9, "a b c d e f pear fig fig"), (2, "kiwi"), (8, "none")]


def test_bm25_top_is_bm25(spark, monkeypatch):
    """Both operators agree, blocks and k cut nothing, equal texts tie by the smaller document."""
    monkeypatch.setattr(R, "BLOCK", 2)
    docs = spark.createDataFrame(ROWS, "id long, t string").repartition(3)
    terms = R.query_terms(spark.createDataFrame(ASKED, "q long, t string"), "q", "t", None)
    want = brute_bm25(ROWS, ASKED)
    got = {}
    for r in R.bm25_top(docs, "id", "t", terms, 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc, r.score))
    assert (1, 3) in {(i, d) for i, d, _ in got[9]} and set(got) == {q for q, x in want.items() if x}
    assert all([(i + 1, d, pytest.approx(-s)) for i, (s, d) in enumerate(x[:3])] == sorted(got[q]) for q, x in want.items() if x)
    assert R.bm25_top(docs, "id", "t", terms.where("1 = 0"), 3).count() == 0


def test_filters_by_query(spark, monkeypatch):
    """Each query sees its own rows with their own statistics, as if the others were not there, also in several passes."""
    monkeypatch.setattr(R, "TERMS", 3)
    monkeypatch.setattr(R, "NUMBERS", 4)
    rows = [(i, t, "ab"[i % 2], None if i == 4 else i % 3) for i, t in ROWS]
    docs = spark.createDataFrame(rows, "id long, t string, side string, year int").repartition(3)
    asked = [(i, "pear fig date lime", s, y) for i, (s, y) in enumerate([(None, None), (["a"], None), (["a", "b"], [0]), (None, [1, 2]), (["b"], [1]), (["z"], None), (["a", None], [0, 0])])]
    a = spark.createDataFrame(asked, "query_id long, q string, side array<string>, year array<int>")
    terms = R.query_terms(a, "query_id", "q", None)
    got = {}
    for r in R.bm25_top(docs, "id", "t", terms, 9, a.select("query_id", "side", "year")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc, r.score))
    for q, text, side, year in asked:
        own = [(i, t) for i, t, s, y in rows if (side is None or s in side) and (year is None or (y is not None and y in year))]
        want = brute_bm25(own, [(q, text)])[q] if own else []
        assert sorted(got.get(q, [])) == [(i + 1, d, pytest.approx(-s)) for i, (s, d) in enumerate(want)]
    v = docs.select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"), "side", "year")
    near = R.dense_top(v, "id", "v", a.select("query_id", F.array(F.lit(1.0), F.lit(0.0)).alias("vector")), 3, a.select("query_id", "side", "year"), own_ids=False)
    for q, _, side, year in asked:
        want = sorted((i for i, _, s, y in rows if (side is None or s in side) and (year is None or (y is not None and y in year))), reverse=True)[:3]
        assert [r.doc for r in near.where(F.col("query_id") == q).orderBy("rank").collect()] == want


def test_dense_of_all_items(spark):
    v = {r["vec_id"]: np.array(r["embedding"], float) for r in read("embeddings")}
    asked = [r["item_id"] for r in read("benchmark") if r["item_id"] in v]
    ids = np.array(sorted(v))
    u = np.array([v[i] / np.linalg.norm(v[i]) for i in ids])
    got = {}
    for r in QUERIES["dense_topk"](spark, DATA).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc, r.score))
    assert set(got) == set(asked) and len(got) > 5
    for q in asked:
        s = np.round(u @ (v[q] / np.linalg.norm(v[q])), 12)
        s[ids == q] = -9
        assert [d for _, d, _ in sorted(got[q])] == ids[np.lexsort((ids, -s))[:10]].tolist()


def test_dense_top_awkward(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERIES_AT_ONCE", 1)
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0]), (7, [1.0, None]), (8, [float("nan"), 1.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "i long, v array<float>").repartition(3)
    asked = df.where("i in (1, 3, 4)").select(F.col("i").alias("query_id"), F.col("v").alias("vector"))
    got = sorted((r.query_id, r["rank"], r.doc) for r in R.dense_top(df, "i", "v", asked, 5).collect())
    assert got == [(1, 1, 2), (1, 2, 3), (3, 1, 1), (3, 2, 2)]


def test_gold_of_every_language_counts(spark, ranked, gold):
    """Each item's share of found gold documents, whatever their language."""
    rank = {(q, d): i + 1 for q, x in ranked.items() for i, (_, d) in enumerate(x)}
    of = {}
    for q, d in gold:
        of.setdefault(q, []).append(rank.get((q, d), 10**9))
    got = {(r.query_id, r.k): r.recall for r in QUERIES["retrieval_metrics_at_k"](spark, DATA).collect()}
    assert got == {(q, k): round(sum(i <= k for i in x) / len(x), 6) for q, x in of.items() for k in (1, 3, 5, 10)}
    band = Counter(next((b for b in (10, 20, 70, 300) if i <= b), 10**6) for x in of.values() for i in x)
    assert {r.upto: r.n for r in QUERIES["rank_bands"](spark, DATA).collect()} == dict(band)


def test_fusion_of_all_items(spark):
    asked = {r["item_id"] for r in read("benchmark")}
    assert {r.query_id for r in QUERIES["rrf_fusion"](spark, DATA).select("query_id").distinct().collect()} == asked
    held = {b["item_id"] for b in read("benchmark") for d in read("documents") if b["text"] in (d["text"] or "")}
    assert {r.questions for r in QUERIES["weight_sweep"](spark, DATA).collect()} == {len(held)}
    assert {r.question for r in QUERIES["planned_round_robin"](spark, DATA).select("question").distinct().collect()} == {q // 3 for q in asked}


def test_lexicon_of_all_parts(spark):
    """Every part finds its name, also names that none of the first forty parts has."""
    parts = read("part")
    brand = {}
    for r in parts:
        brand[r["p_name"].lower()] = max(brand.get(r["p_name"].lower(), ""), r["p_brand"])
    assert {r["p_name"].lower() for r in parts if r["p_partkey"] > 40} - {r["p_name"].lower() for r in parts if r["p_partkey"] <= 40}
    longest = lambda t: max((len(a), a) for a in brand if f" {a} " in f" {t} ")[1]
    want = {r["p_partkey"]: brand[longest(f"what was {r['p_name'].lower()} then")] for r in parts}
    assert {r.p_partkey: r.canonical for r in QUERIES["lexicon_terms"](spark, DATA).collect()} == want
    assert {r.p_partkey: r.metric for r in QUERIES["question_specs"](spark, DATA).collect()} == want
