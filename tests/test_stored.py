"""The stored index and the incremental collection: appends, crashes, what is read."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import incremental as N
from ledgerlark.operators import inverted as V
from ledgerlark.operators import retrieval as R
from ledgerlark.sources import shared


def corpus(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(i * 37, " ".join(r.choices(words, [1 / (k + 1) for k in range(300)], k=r.randrange(60)))) for i in range(600)]
    return spark.createDataFrame([*rows, (None, "w1 w2"), (10**12, None), (-5, "w7 w250")], "id long, t string").repartition(5)


def ranked(df):
    return sorted((r.query_id, r["rank"], r.doc, pytest.approx(r.score, abs=1e-8)) for r in df.collect())


def test_stored_index_is_bm25(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "FIRST", 2)
    docs, path = corpus(spark).where("id is not null"), str(tmp_path / "index")
    asked = spark.createDataFrame([(1, "w0 w1 w250 w250"), (2, "w299 w17"), (3, "nothing here"), (4, "w0")], "q long, t string")
    terms = R.query_terms(asked, "q", "t", None)
    want = [(r.query_id, r["rank"], r.doc, r.score) for r in R.bm25_top(docs, "id", "t", terms, 7).orderBy("query_id", "rank").collect()]
    for part in (0, 1, 2):
        V.append(docs.where(F.pmod("id", F.lit(3)) == part), "id", "t", path)
    assert ranked(V.search(spark, path, terms, 7)) == want
    V.append(docs, "id", "t", path)  # all there already
    assert shared.latest(spark, f"{path}/manifest", V.MANIFEST, "default").version == 3
    monkeypatch.setattr(V, "TERMS", 2)
    assert ranked(V.search(spark, path, terms, 7)) == want
    assert V.search(spark, path, terms.where("1 = 0"), 7).count() == 0


def test_an_unfinished_append_is_not_seen(spark, tmp_path, monkeypatch):
    docs, path = corpus(spark).where("id is not null"), str(tmp_path / "index")
    V.append(docs.where("id < 9000"), "id", "t", path)
    terms = R.query_terms(spark.createDataFrame([(1, "w3 w40")], "q long, t string"), "q", "t", None)
    before = V.search(spark, path, terms, 5).orderBy("rank").collect()
    with monkeypatch.context() as m:
        m.setattr(V, "record", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            V.append(docs, "id", "t", path)
    assert V.search(spark, path, terms, 5).orderBy("rank").collect() == before
    V.append(docs, "id", "t", path)
    assert ranked(V.search(spark, path, terms, 5)) == [(r.query_id, r["rank"], r.doc, r.score) for r in R.bm25_top(docs, "id", "t", terms, 5).orderBy("rank").collect()]
    with pytest.raises(ValueError):
        V.search(spark, path, terms, 5, "other")


def test_a_search_reads_its_terms_alone(spark, tmp_path):
    """A vocabulary of 60,000 names and a query of two: far fewer rows leave the scan than the index has."""
    r, path = random.Random(4), str(tmp_path / "index")
    docs = spark.createDataFrame([(i, " ".join(f"n{r.randrange(60_000)}" for _ in range(400))) for i in range(2000)], "id long, t string").repartition(4)
    V.append(docs, "id", "t", path)

    def scanned(df):
        """Rows that left the scan; pages whose statistics rule them out never do."""
        n = len(df.collect())
        return n, df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()

    postings = spark.read.parquet(f"{path}/segments/*/postings").select("term", "rng", "n")
    whole = scanned(postings)[1]
    found = postings.where(V._named(["n777", "n4242"]))
    assert "EqualTo(term,n777)" in found._jdf.queryExecution().toString()
    n, read = scanned(found)
    assert whole > 50_000 and 0 < n <= read < whole / 10


CHUNK = "document_id string, page int, text string, company string, fiscal_year string"


def chunks(spark, rows):
    df = spark.createDataFrame([(d, p, t, c, y) for d, c, y, texts in rows for p, t in enumerate(texts)], CHUNK)
    state = spark.createDataFrame([(d, "|".join(t), "v1", c, y) for d, c, y, t in rows], "document_id string, text string, cache_key string, company string, fiscal_year string")
    return df, state.withColumn("sha256", F.sha2("text", 256))


def live(spark, path, collection="c"):
    return sorted((r.document_id, r.page, r.text, r.company or "", r.fiscal_year or "") for r in N.read(spark, path, collection, CHUNK).collect())


def expected(rows):
    return sorted((d, p, t, c or "", y or "") for d, c, y, texts in rows for p, t in enumerate(texts))


def test_incremental_commits(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "x")
    one = [("a", "acme", "2023", ["x", "y"]), ("b", "acme", "2024", ["z"]), ("c", "bolt", "2023", ["u"]), ("d", None, None, ["n"])]
    df, state = chunks(spark, one)
    assert live(spark, path) == [] and N.outdated(state, N.documents(spark, path, "c")).count() == 4
    m = N.commit(df, state, path, "c", "model", 3)
    assert (m.version, m.point_count, m.companies, m.document_count) == (1, 5, ["acme", "bolt"], 4) and live(spark, path) == expected(one)
    assert N.commit(df, state, path, "c", "model", 3).version == 1  # nothing to do
    two = [("a", "acme", "2023", ["x", "y2", "y3"]), ("c", "bolt", "2024", ["u"]), ("e", "acme", "2023", ["new"]), ("d", None, None, ["n"])]
    df, state = chunks(spark, two)
    again = N.outdated(state, N.documents(spark, path, "c"))
    assert sorted(r.document_id for r in again.collect()) == ["a", "c", "e"]
    with monkeypatch.context() as k:  # lost between the new parts and the manifest row
        k.setattr(N, "record", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            N.commit(df, state, path, "c", "model", 3)
    assert live(spark, path) == expected(one)
    untouched = {p.path for p in N.manifest(spark, path, "c").parts if p.company is None}
    m = N.commit(df.join(again.select("document_id"), "document_id", "left_semi"), state, path, "c", "model", 3)
    assert m.version == 2 and live(spark, path) == expected(two) and untouched <= {p.path for p in m.parts}
    N.commit(df.where("1 = 0"), state.where("1 = 0"), path, "c", "model", 3)
    assert live(spark, path) == [] and N.manifest(spark, path, "other") is None
    N.commit(df, state, path, "other", "model", 3)  # collections stand side by side
    assert live(spark, path, "other") == expected(two) and live(spark, path) == []


def test_cache_of_chunks(spark, tmp_path):
    path = str(tmp_path / "cache")
    df, state = chunks(spark, [("a", "acme", "2023", ["x", "y"]), ("b", "acme", "2024", ["z"])])
    headers = state.select("document_id", "sha256", "cache_key", F.lit(2).alias("pages"), F.lit(0).alias("tables"), F.lit(0.123456).alias("scale_context_coverage"))
    N.write_cache(df.select("document_id", F.to_json(F.struct("*")).alias("value")), headers, path)
    for d in ("a", "b"):
        lines = [r.value for r in spark.read.text(f"{path}/document_id={d}").collect()]
        assert '"cache_key":"v1"' in lines[0] and '0.1235' in lines[0] and len(lines) == (3 if d == "a" else 2)
    got, again = N.cached(spark, path, state, CHUNK)
    assert sorted((r.document_id, r.text) for r in got.collect()) == [("a", "x"), ("a", "y"), ("b", "z")] and again.count() == 0
    other = state.withColumn("sha256", F.when(F.col("document_id") == "b", "changed").otherwise(F.col("sha256")))
    got, again = N.cached(spark, path, other, CHUNK)
    assert {r.document_id for r in got.collect()} == {"a"} and [r.document_id for r in again.collect()] == ["b"]
