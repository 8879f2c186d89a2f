"""Whitening, host ranks and periodic runs against the same results computed the long way."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from .brute import LOWER, WORD
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlark.llm import hosts, runs, whitening


# --- whitening ------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 3, 0.5) for i, v in rows], "vec_id long, embedding array<float>, label string, n long, whitened double").repartition(4)


def long_way(rows):
    """{dim: (ids, whitened up to signs, deviations, values, trace, n)} with a dense covariance."""
    out = {}
    for dim in {len(v) for _, v in rows if v}:
        own = [(i, v) for i, v in rows if v and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
        if not own:
            continue
        x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in own], object)
        fit = np.array(sorted({tuple(r) for r in x.tolist()}), object)
        n, s = len(fit), fit.sum(0)
        z = ((n * fit - s) / n).astype(float)
        values, axes = np.linalg.eigh(z.T @ z / n)
        values, axes = values[::-1], axes[:, ::-1]
        out[dim] = ([i for i, _ in own], ((n * x - s) / n).astype(float) @ axes, ((n * x - s) ** 2).sum(1), values, values.sum(), n)
    return out


def check_whitening(got, want, components):
    for dim, (ids, w, dev, values, trace, n) in want.items():
        k = int((values[:components] > 1e-9 * max(trace, 1e-9)).sum())
        own = sorted((r for r in got if r.vec_id in set(ids)), key=lambda r: (r.vec_id, r.component))
        assert len(own) == len(ids) * k
        assert {r.component for r in own} == set(range(1, k + 1))
        by = {(r.vec_id, r.component): r for r in own}
        for c in range(k):
            a = np.array([by[i, c + 1].whitened for i in ids])
            b = w[:, c] / np.sqrt(values[c])
            assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7
            assert abs(by[ids[0], c + 1].explained / (values[c] / trace) - 1) < 1e-9
        assert all(by[i, 1].deviation == d and by[i, 1].n == n for i, d in zip(ids, dev, strict=True))
        assert all(r.identity_error < 1e-9 for r in own)


def test_whitening_against_dense_eigenvectors(spark):
    r = np.random.default_rng(5)
    base = (r.normal(size=(160, 40)) * np.linspace(1, 3, 40)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(500 + i, base[7].tolist()) for i in range(80)]
    odd = [(900, None), (901, []), (902, [None] * 40), (903, [float("nan")] * 40), (904, [float("inf")] * 40), (905, [0.0] * 40)]
    got = whitening.whitened(vectors(spark, rows + odd), 16).collect()
    check_whitening(got, long_way(rows + odd), 16)
    assert {x.vec_id for x in got} == {i for i, _ in rows} | {905}


def test_whitening_of_few_short_and_equal_vectors(spark):
    r = np.random.default_rng(6)
    rows = [(i, r.normal(size=64).tolist()) for i in range(9)] + [(100 + i, r.normal(size=3).tolist()) for i in range(20)]
    got = whitening.whitened(vectors(spark, rows), 16).collect()
    check_whitening(got, long_way(rows), 16)
    assert whitening.whitened(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]), 16).collect() == []
    assert whitening.whitened(vectors(spark, [(1, [1.0])]).where("1 = 0"), 16).collect() == []


def test_whitening_of_repeated_ids_null_ids_and_huge_entries(spark):
    rows = [(1, [1.0, 2.0, 0.0]), (1, [1.0, 2.0, 0.0]), (None, [4.0, -2.0, 1.0]), (3, [0.5, 9.0, -7.0]), (4, [1e30, 0.0, 0.0])]
    got = whitening.whitened(vectors(spark, rows), 2).collect()
    # beside the huge entry the other directions are within rounding
    assert sorted((x.vec_id is None, x.vec_id or 0, x.component) for x in got) == [(False, 1, 1), (False, 1, 1), (False, 3, 1), (False, 4, 1), (True, 0, 1)]
    assert all(x.deviation is None and x.n == 4 for x in got if x.vec_id == 4)


# --- hosts ----------------------------------------------------------------------------------------


def page_rows():
    r = random.Random(4)
    names = [f"{a}.example.{b}" for a in ("a", "b", "www.c", "d", "e") for b in ("net", "com", "org")] + ["org", "net", "other.io", "EXAMPLE.net"]
    rows = []
    for i in range(300):
        h = r.choice(names[:3] * 12 + names)
        links = "".join(f"""<a {r.choice(['href', 'HREF', 'src'])} = {r.choice(['"', "'", ''])}{r.choice(['http:', 'https:', ''])}//{r.choice(names)}{r.choice(['/x', '?y', '#z', ''])}{r.choice(['"', "'", ' '])}>""" for _ in range(r.randrange(4)))
        rows.append((i, f"http://{h}{r.choice(['/en/', '/de/', '/fr/', '/', '', '?q=/en/', '#/fr/', '/en'])}{i if r.random() < 0.5 else ''}", f"<p>{links}<a href='/own'></p>"))
    return [*rows, rows[3], (None, rows[4][1], rows[4][2]), (901, None, "<a href='//a.example.net/'>"), (902, "no scheme", None), (903, "", ""), (904, "x://?a://b/c", "y" * 300_000), (905, "http://A.B.Org/fr/ü", rows[0][2])]


def pages_table(spark, rows):
    return spark.createDataFrame([(*x, "allow", 9, "z") for x in rows], "page_id long, url string, html string, verdict string, trust long, said string").repartition(3)


def by_hand(rows):
    import re

    rules = [("block", "example.com", "/de/"), ("allow", "example.net", "/en/"), ("allow", "org", "/fr/"), ("block", "net", "/")]
    pages, links = [], {}
    for i, url, html in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        raw = re.match("[^/?#]*", rest)[0]
        host, path = raw.translate(LOWER), re.match("[^?#]*", rest[len(raw) :])[0]
        rule = next(((v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), (None, None))
        pages.append((i, host, path, rule[1], rule[0]))
        for dst in {x.translate(LOWER) for x in re.findall(hosts._LINK, html or "", re.ASCII)}:
            if host and dst != host:
                links[host, dst] = links.get((host, dst), 0) + 1
    units, rank = 1 << 50, {}
    for good in (True, False):
        counts = {}
        for _, h, _, _, v in pages:
            counts[h] = counts.get(h, 0) + (v == ("allow" if good else "block"))
        total = sum(counts.values()) or 1
        rank[good] = [{h: m for h, c in counts.items() if (m := math.floor(c * (units / total)))}]
    ways = {good: [(a, b, n) if good else (b, a, n) for (a, b), n in links.items()] for good in (True, False)}
    out = {good: {} for good in ways}
    for good, w in ways.items():
        for a, _, n in w:
            out[good][a] = out[good].get(a, 0) + n
    while True:
        for good, w in ways.items():
            step = {}
            for a, b, n in w:
                if a in rank[good][-1]:
                    step[b] = step.get(b, 0) + math.floor(rank[good][-1][a] * (n / out[good][a]) * 0.85)
            rank[good].append({h: m for h, m in step.items() if m})
        if sum(sum(r[-1].values()) for r in rank.values()) < hosts.REST:
            break
    mass = {good: lambda h, good=good: sum(s.get(h, 0) for s in rank[good]) for good in ways}
    free = sum(v is None for *_, v in pages) or 1
    own = lambda h: math.floor(sum(v is None and x == h for _, x, _, _, v in pages) * (units / free))
    return sorted(((i, h, p, r, v or ("block" if mass[False](h) > mass[True](h) + own(h) else "allow"), mass[True](h), mass[False](h)) for i, h, p, r, v in pages), key=str)


def test_host_ranks_against_a_loop_and_sql(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hosts, "FAN", 2)
    monkeypatch.setattr(hosts, "LARGE", 10)
    rows = page_rows()
    df = pages_table(spark, rows)
    got = hosts.judged(df)
    want = by_hand(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert len({x[4] for x in want if x[3] is None}) == 2  # the graph speaks both ways
    df.write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    assert sorted(con.execute(hosts.ORACLE).fetchall(), key=str) == want


def test_hosts_of_no_pages_and_no_links(spark):
    assert hosts.judged(pages_table(spark, page_rows()).where("1 = 0")).collect() == []
    got = hosts.judged(pages_table(spark, [(1, "http://a.io/", None), (2, None, None)])).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == [(1, "a.io", "/", None, "allow"), (2, "", "", None, "allow")]


# --- runs -----------------------------------------------------------------------------------------


def smallest_period(w):
    border, k = [0] * len(w), 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = border[k - 1]
        k += w[i] == w[k]
        border[i] = k
    return len(w) - border[-1]


def runs_of(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        x = 0
        while x + q < len(w):
            y = x
            while y + q < len(w) and w[y] == w[y + q]:
                y += 1
            if y > x and y - x + q >= max(6, 4 * q) and smallest_period(w[x : y + q]) == q:
                out.append((x, y - x + q, q))
            x = max(y, x + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


piece = st.tuples(st.lists(st.integers(1, 3), min_size=1, max_size=9), st.integers(1, 9)).map(lambda x: x[0] * x[1])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(piece, max_size=5).map(lambda x: sum(x, [])), min_size=1, max_size=4), st.sampled_from([5, 100, 1 << 19]))
def test_runs_against_every_period(texts, pairs):
    before, runs.PAIRS = runs.PAIRS, pairs
    try:
        t, s, length, q = runs.runs(np.array(sum(texts, []), np.int64), np.array([len(x) for x in texts]))
    finally:
        runs.PAIRS = before
    assert [[(a, b, c) for k, a, b, c in zip(t.tolist(), s.tolist(), length.tolist(), q.tolist()) if k == i] for i in range(len(texts))] == [runs_of(x) for x in texts]


def test_common_extensions():
    r = random.Random(2)
    w = sum(([1, 2] * 40, [r.randrange(1, 4) for _ in range(200)], [3] * 100, [9]), [])
    ext = runs.Extensions(np.array(w))
    i, j = (np.array([r.randrange(len(w)) for _ in range(3000)]) for _ in range(2))
    i, j = i[i != j], j[i != j]

    def common(a, b):
        n = 0
        while max(a, b) + n < len(w) and w[a + n] == w[b + n]:
            n += 1
        return n

    assert ext.common(i, j).tolist() == [common(a, b) for a, b in zip(i.tolist(), j.tolist())]


def expected(i, text, tails):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(i).encode())
    if tails and i is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = runs_of(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join("%d,%d,%d\n" % r for r in found)), digest(" ".join(x for k, x in enumerate(w) if k not in gone)))


@pytest.mark.parametrize("tails", [True, False])
def test_runs_of_documents(spark, rows, docs, tails):
    r = random.Random(8)
    more = [(1000 + i, " ".join(r.choice("ab") for _ in range(r.randrange(400)))) for i in range(60)] + [(2000, "so it goes\u00a0 " * 900), (2001, "a b c\x0b" * 2000 + "d " * 7)]
    df = docs.union(spark.createDataFrame([(i, t, "en", 5, 7, "s", 1.5) for i, t in more], docs.schema))
    got = runs.detect(df, periodic_tails=tails).collect()
    assert sorted(map(tuple, got), key=str) == sorted((expected(i, t, tails) for i, t in rows + more), key=str)


def test_runs_keep_texts_and_take_empty_tables(docs, empty):
    assert runs.detect(empty).collect() == []
    kept = {x.doc_id: x for x in runs.detect(docs, keep_text=True).collect()}
    loop = next(x for x in kept.values() if x.collapsed == "loop")
    assert loop.runs == "0,25,1\n"
