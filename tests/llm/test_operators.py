"""The numbered operators against brute force, round trips and the libraries themselves, with awkward rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import context_tree, jaccard, packing, pieces, quality, secrets, substrings, token_orc, tokens, vectors
from ledgerlark.llm.common import components, shared_path

from . import brute


def unique(rows):
    return sorted(dict((i, t) for i, t in rows if i is not None).items())


def packed(ids):
    return np.asarray(ids, "<u4").tobytes()


# --- shared


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 560)]
    got = {x.node: x.component for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = brute.groups(600, pairs)
    assert got == {n: want[n] for a, b in pairs for n in (a, b) if a != b}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


# --- 1


def test_token_orc(spark, docs, rows):
    from tokenizers import Tokenizer

    lib, path = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json")), shared_path(spark, "t")
    token_orc.write(docs, path, tokens.vocabulary("word_bpe_49k.json"), 2)
    got = sorted((x.start, -1 if x.doc_id is None else 0, x.doc_id or 0, x.n_tokens, x.ids_crc32) for x in token_orc.starts(spark, path).collect())
    assert [(g[2]) for g in got if g[1] == 0] == sorted(i for i, _ in rows if i is not None)
    crc = {}
    for i, t in rows:
        crc.setdefault(i or 0, set()).add((len(ids := [*lib.encode(t or "", add_special_tokens=False).ids, 2]), zlib.crc32(packed(ids))))
    start = 0
    for s, _, i, n, c in got:
        assert s == start and (n, c) in crc[i]
        start += n
    assert len(token_orc.lookup(spark, path, 19).collect()) == 2


def test_token_orc_files(spark, docs, tmp_path):
    """Small stripes make several in a file (their size is looked at every 5,000 rows), with row indexes; a look-up's predicate reaches
    the scan; run lengths and compression make ids smaller than plain integers."""
    import glob

    from pyarrow import orc

    few = docs.where("text is null or length(text) < 2000")
    many = few.unionByName(few.withColumn("doc_id", F.col("doc_id") + 10_000)).crossJoin(spark.range(250)).withColumn("doc_id", F.col("doc_id") + 100_000 * F.col("id")).drop("id").repartition(1)
    path = f"file://{tmp_path}/t"
    token_orc.write(many, path, tokens.vocabulary("word_bpe_49k.json"), 2, stripe_bytes=1 << 16)
    files = [orc.ORCFile(f) for f in glob.glob(f"{tmp_path}/t/*.orc")]
    assert sum(f.nrows for f in files) == many.count() and max(f.nstripes for f in files) > 1 and all(f.row_index_stride > 0 and f.compression == "ZSTD" for f in files)
    plan = token_orc.lookup(spark, path, 19)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,19)" in plan and len(token_orc.lookup(spark, path, 19).collect()) == 2
    size = lambda d: sum(len(open(f, "rb").read()) for f in glob.glob(f"{tmp_path}/{d}/*.orc"))
    raw = sum(4 * len(r.ids) for r in token_orc.read(spark, path).select("ids").collect())
    assert size("t") < raw


@pytest.mark.parametrize("seed", range(3))
def test_tokens_equal_the_library_on_odd_texts(seed):
    from tokenizers import Tokenizer

    r = random.Random(seed)
    letters = "aAbBzZ019 \t\n\r\u00a0\u2009'\"!?.,;:-_/\\#@éÉßΣςİıñ漢字か🙂\u0301\u200d\u0000\u001f\ufeff"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(0, 60))) for _ in range(400)] + ["<|endoftext|> x", "it's we'LL", "  "]
    for name, ours in (("word_bpe_49k.json", tokens.word_bpe), ("byte_bpe_50k.json", tokens.byte_bpe)):
        path = tokens.vocabulary(name)
        lib = Tokenizer.from_file(path)
        for t in texts:
            assert ours(path, t) == packed(lib.encode(t, add_special_tokens=False).ids), (name, t)


def test_token_orc_empty(spark, empty):
    path = shared_path(spark, "t")
    token_orc.write(empty, path, tokens.vocabulary("word_bpe_49k.json"), 2)
    assert token_orc.starts(spark, path).count() == 0


# --- 2


def test_quality(spark, docs):
    r = random.Random(2)
    good = [(1000 + i, " ".join(r.choice(["river", "stone", "bridge", "cloud", "field"]) for _ in range(30))) for i in range(150)]
    bad = [(2000 + i, " ".join(r.choice(["WIN!!", "CASH!!", "CLICK!!"]) for _ in range(30))) for i in range(150)]
    d = spark.createDataFrame(good + bad + [(1, None), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (5, None), (1001, 1)], "doc_id long, quality int")
    got = {x.doc_id: x for x in quality.scored(d, quality.train(d, labels)).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sorted(held) == sorted(i for i, x in got.items() if x.held_out)
    assert all(got[i].predicted == (i < 2000) for i in held if i > 2)
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got.values())
    assert quality.accepted(docs, quality.train(d, labels)).columns == docs.columns


def test_quality_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, none)
    assert quality.scored(docs, model).count() == docs.count()
    assert quality.scored(empty, model).count() == 0


# --- 3 and 4


def vectors_table(spark, dim=16, n=400):
    r = np.random.default_rng(4)
    x = r.normal(size=(n, dim)).astype(np.float32)
    x[100:130] = x[100] + 0.02 * r.normal(size=(30, dim))
    x[200:210] = x[200]
    x[210] = 3 * x[200]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(n, None), (n + 1, [0.0] * dim), (n + 2, [float("nan")] * dim), (n + 3, [1.0, None] + [0.0] * (dim - 2)), (n + 4, []), (n + 5, [1.0, 2.0]), (n + 6, [2.0, 4.0]), (None, x[0].tolist())]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("m", F.lit(9))


def test_prefix_forest(spark):
    x, df = vectors_table(spark)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    got = {}
    for r in vectors.nearest(df, 20, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = 0
    for q in range(0, 400, 20):
        s = u @ u[q]
        s[q] = -9
        own = sorted(got[q])
        hit += len({v for _, v, _ in own} & set(np.lexsort((np.arange(len(s)), -np.round(s, 12)))[:5].tolist()))
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5] and all(abs(s[v] - c) < 1e-9 for _, v, c in own)
        assert [v for _, v, _ in own] == [v for v, _ in sorted(((v, c) for _, v, c in own), key=lambda p: (-p[1], p[0]))]
    assert hit >= 0.9 * 5 * 20
    assert [v for _, v, _ in sorted(got[200])] == [201, 202, 203, 204, 205]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_prefix_forest_recall_on_given_tables(spark, sf):
    """Against all rows, for the queries of op 3: nine tenths and more of the five nearest, from less than half of the rows."""
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = {r.vec_id: r.embedding for r in vectors.valid(df).collect()}
    ids = np.array(sorted(rows))
    u = vectors.unit(np.array([rows[i] for i in ids]))
    got = {}
    for r in vectors.nearest(df, 50, 5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = u @ u[q]
        s[q] = -9
        hit += len(got[ids[q]] & set(ids[np.lexsort((ids, -np.round(s, 12)))[:5]].tolist()))
        total += 5
    forest = vectors.Forest(u[:8192])
    read = np.mean([len(h) for h in forest.candidates(u[:20], int(np.ceil(vectors.SHARE * min(len(u), 8192))))]) / min(len(u), 8192)
    print(f"{sf}: recall {hit / total:.3f}, reads {read:.2f}")
    assert hit >= 0.9 * total and read < 0.5


def test_prefix_forest_empty(spark):
    _, df = vectors_table(spark)
    assert vectors.nearest(df.where("1 = 0"), 20, 5).count() == 0


@pytest.mark.parametrize("tile", [8192, 64])
def test_pca_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE", tile)
    x, df = vectors_table(spark)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    s = u @ u.T >= 0.95
    np.fill_diagonal(s, False)
    want = brute.groups(400, list(zip(*np.nonzero(s))))
    got = vectors.near_copies(df, 0.95).collect()
    assert len(got) == 408
    for r in got:
        if r.vec_id is not None and r.vec_id < 400:
            assert (r.n_links, r.component_id, r.kept) == (s[r.vec_id].sum(), want[r.vec_id], want[r.vec_id] == r.vec_id)
    other = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None or r.vec_id >= 400}
    assert other[405] == (1, 405, True) and other[406] == (1, 405, False) and other[400] == (0, 400, True) and other[None] == (0, None, False)
    assert vectors.near_copies(df.where("1 = 0"), 0.95).count() == 0


# --- 5


@pytest.mark.parametrize("words, pct, tile", [(3, 90, 400_000), (5, 80, 400_000), (3, 80, 200)])
def test_jaccard(spark, docs, rows, monkeypatch, words, pct, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    want = brute.similar(unique(rows), words, pct)
    got = jaccard.similar(docs, words, pct).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None for r in got if r.doc_id is None)


def test_jaccard_many_near(spark):
    """A large group whose members mostly link through others."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    made = []
    for i in range(150):
        w = list(base)
        for k in r.sample(range(150), r.randrange(1, 6)):
            w[k] = f"c{r.randrange(9)}"
        made.append((i, " ".join(w)))
    made += [(1000 + i, " ".join(base[:60] + [f"q{i}-{k}" for k in range(90)])) for i in range(60)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.similar(spark.createDataFrame(made, "doc_id long, text string"), 3, 90).collect()}
    assert got == brute.similar(made, 3, 90)


def test_jaccard_distinct(spark, docs, rows, empty):
    want = brute.similar(unique(rows), 5, 80)
    left = jaccard.distinct(docs, 5, 80)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    assert jaccard.similar(empty, 5, 80).count() == 0


# --- 6


@pytest.mark.parametrize("window", [20, 7])
def test_substrings(spark, docs, rows, window):
    want = brute.repeats(unique(rows), window)
    got = substrings.digests(docs, window).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            w, gone = want[r.doc_id]
            assert (r.n_words, r.n_removed) == (len(w), sum(gone)), r.doc_id
            assert r.kept_sha256 == hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()


def test_substrings_trimmed(spark, docs, rows, empty):
    want = brute.repeats(unique(rows), 20)
    left = substrings.trimmed(docs, 20)
    assert left.columns == docs.columns
    got = {r.doc_id: r.text for r in left.collect()}
    for i, (w, gone) in want.items():
        if any(gone) and all(gone):
            assert i not in got
        else:
            assert brute.WORD.findall(got[i] or "") == [x for x, g in zip(w, gone) if not g]
    assert substrings.digests(empty, 20).count() == 0


# --- 7


def test_pieces(spark, docs, rows, empty):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary("piece_bpe_32k.model"))
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digests(docs, tokens.vocabulary("piece_bpe_32k.model")).collect())
    want = []
    for i, t in rows:
        ids = p.encode(t or "", add_bos=True, add_eos=True)
        want.append(((i is None, i or 0), len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(p.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    assert pieces.encode(empty, tokens.vocabulary("piece_bpe_32k.model")).count() == 0


# --- 8


def test_packing(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = tokens.vocabulary("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = packing.pack(packing.cut(docs, path, 1024, 2), 1024).collect()
    ids = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows if i is not None}
    seen, where = {}, {}
    for r in got:
        assert 1 <= r.length <= 1024
        where.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id is not None:
            assert r.ids_crc32 == zlib.crc32(packed(ids[r.doc_id][r.start : r.start + r.length]))
            seen.setdefault(r.doc_id, set()).add((r.piece, r.start, r.length))
    for i, own in seen.items():
        own = sorted(own)
        assert [p for p, _, _ in own] == list(range(-(-len(ids[i]) // 1024))) and sum(n for _, _, n in own) == len(ids[i]) and all(n == 1024 for _, _, n in own[1:])
    for own in where.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end
            end += n
        assert end <= 1024
    assert len(where) <= -(-sum(r.length for r in got) // 1024) + 2
    assert packing.pack(packing.cut(empty, path, 1024, 2), 1024).count() == 0


@pytest.mark.parametrize("seed", [5, 6])
def test_packing_rounds_against_best_fit_decreasing(spark, seed):
    """Every piece once, no overlap, and within a hundredth of the sequences that best-fit decreasing opens."""
    r = random.Random(seed)
    sizes = [r.randrange(1, 101) if seed == 5 else min(100, 1 + int(r.expovariate(0.08))) for _ in range(3000)]
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(100 - s)
    pieces = spark.createDataFrame([(i, 0, 0, s, 0) for i, s in enumerate(sizes)], packing.PIECES).repartition(4)
    got = packing.pack(pieces, 100).collect()
    assert sorted((x.doc_id, x.length) for x in got) == list(enumerate(sizes))
    where = {}
    for x in got:
        where.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for own in where.values():
        assert all(o == sum(n for _, n in sorted(own)[:k]) for k, (o, _) in enumerate(sorted(own))) and sum(n for _, n in own) <= 100
    assert len(where) <= 1.01 * len(gaps) + 1


# --- 9


def test_secrets(spark, docs, rows, empty):
    import re

    kinds = [(re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 6), (re.compile("AKIA[A-Z0-9]+"), 20), (re.compile("[0-9a-f]+"), 24)]
    net = secrets.train(docs)
    got = {r.doc_id: r for r in secrets.find(docs, net).collect()}
    for i, t in unique(rows):
        found = sorted((m.start(), k, m.end()) for k, (p, n) in enumerate(kinds) for m in p.finditer(t or "") if len(m[1] if k == 0 else m[0]) >= n)
        text = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in found)
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == x for _, k, _ in found) for x in range(3)]
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(text.split(",")) <= set(got[i].spans.split(","))
    assert secrets.find(empty, secrets.train(empty)).count() == 0
    assert secrets.masked(docs, net).columns == docs.columns
    assert "hunter2" not in "".join(r.text or "" for r in secrets.masked(docs, net).collect())


def test_network_finds_planted_keys_that_patterns_miss(spark):
    """Trained on assignments alone; keys without a keyword, and numbers, names and words that are none."""
    r = random.Random(16)
    pick = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    word = lambda: pick("etaoinshrdlu", r.randrange(3, 11))
    prose = lambda n: " ".join(word() for _ in range(n))
    other = [lambda: pick("0123456789", 16), lambda: ".".join(str(r.randrange(256)) for _ in range(4)), lambda: word() + "_" + word() + "_" + word(), lambda: word().capitalize() + word().capitalize(), lambda: pick("ETAOIN", 22)]
    docs = [(i, f'{prose(20)} {r.choice(["token", "api_key", "secret"])} = "{pick("0123456789abcdef", 40)}" {prose(10)} {r.choice(other)()} {prose(9)} {r.choice(other)()}') for i in range(300)]
    net = secrets.train(spark.createDataFrame(docs, "doc_id long, text string"))
    keys = [f"{prose(12)} {pick('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789', 36)} {prose(12)}" for _ in range(200)]
    plain = [f"{prose(12)} {f()} {prose(12)}" for f in other for _ in range(60)]
    hit = lambda t: any(k == 3 for _, k, _ in secrets.spans(t, net)[1])
    assert all(not secrets.base_spans(t) for t in keys)
    recall, wrong = sum(map(hit, keys)) / len(keys), sum(map(hit, plain)) / len(plain)
    print(f"recall {recall:.3f}, false alarms {wrong:.3f}")
    assert recall >= 0.9 and wrong <= 0.05


def test_network_tells_keys_from_words():
    r = random.Random(6)
    key = lambda: "".join(r.choice("abcdef0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(r.randrange(20, 36)))
    word = lambda: "".join(r.choice("etaoinshr") for _ in range(14)) + str(r.randrange(10))
    text = [(f"some words {k()} and more", y) for y, k in ((1.0, key), (0.0, word)) for _ in range(300)]
    x = np.array([np.frombuffer(secrets.window(t, 11, t.index(" ", 11)), np.uint8) for t, _ in text])
    y = np.array([z for _, z in text])
    net = secrets.Network().fit(x[::2], y[::2], 0.95)
    flagged = net.probability(x[1::2]) >= net.threshold
    assert flagged[y[1::2] == 1].mean() > 0.9 and flagged[y[1::2] == 0].mean() < 0.05


# --- 10


def brute_tree(train, texts, depth, split=0, longest=1):
    """log10 probabilities by the trees of all contexts in dicts: shares of depths 2 and deeper from the whole tree, of 0 and 1 from the tree cut at 2,
    of frequent contexts up to `longest` bytes from the tree cut just below them."""
    import math

    def steps(t):
        d = b"\n" * depth + t.translate(brute.LOWER).encode() + b"\0"
        return [(d[k - depth : k][::-1], d[k]) for k in range(depth, len(d))]

    n = {}
    for t in train:
        for c, y in steps(t):
            for j in range(8):
                for k in range(depth + 1):
                    n.setdefault((k, c[:k], j, y >> (8 - j)), [0, 0])[y >> (7 - j) & 1] += 1
    kt = lambda z, o: math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)
    kids = {}
    for k, c, j, p in n:
        if k:
            kids.setdefault((k - 1, c[:-1], j, p), []).append((k, c, j, p))

    def weight(node, deepest):
        own = kt(*n[node])
        if node[0] == deepest:
            return own, 1.0
        below = sum(weight(x, deepest)[0] for x in kids[node])
        both = max(own, below) + math.log1p(math.exp(-abs(own - below)))
        return both - math.log(2), math.exp(own - both)

    known = {}
    total_bytes = sum(n[0, b"", 0, 0])

    def above(k, c):
        """Whether a context and all shorter ones from two bytes on hold more than 1 / split of all bytes."""
        return 2 <= k <= longest and sum(n.get((k, c, 0, 0), (0, 0))) * split > total_bytes and (k == 2 or above(k - 1, c[:-1]))

    def share(node):
        if node not in known:
            cut = 2 if node[0] < 2 else node[0] + 1 if split and above(node[0], node[1]) else depth
            known[node] = weight(node, cut)[1] if node in n else 0.5
        return known[node]

    out = []
    for t in texts:
        total = 0.0
        for c, y in steps(t):
            for j in range(8):
                p = None
                for k in range(depth, -1, -1):
                    node = (k, c[:k], j, y >> (8 - j))
                    z, o = n.get(node, (0, 0))
                    own = (o + 0.5) / (z + o + 1)
                    p = own if p is None else share(node) * own + (1 - share(node)) * p
                total += math.log10(p if y >> (7 - j) & 1 else 1 - p)
        out.append(total)
    return out


@pytest.mark.parametrize("row, split", [(1 << 20, 4096), (30, 20)])
def test_context_tree_against_all_contexts(spark, monkeypatch, row, split):
    """Also where most trees, or only frequent ones, are cut at three to five bytes."""
    monkeypatch.setattr(context_tree, "ROW", row)
    monkeypatch.setattr(context_tree, "TREES", row)
    monkeypatch.setattr(context_tree, "SPLIT", split)
    monkeypatch.setattr(context_tree, "SAMPLE", 1)
    r = random.Random(17)
    texts = ["", "a", "Ünï ab", *["".join(r.choice(["the ", "cat ", "sat ", "on ", "Mat. ", "x"]) for _ in range(r.randrange(1, 12))) for _ in range(25)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.score for x in context_tree.score(df).collect()}
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    for i, want in enumerate(brute_tree(train, texts, context_tree.DEPTH, split, context_tree.LONGEST)):
        assert got[i] == pytest.approx(want, abs=0.3 * (len(texts[i].encode()) + 1) / context_tree.UNIT)


def test_context_tree_beats_words_on_unseen_texts(spark):
    """Bits a byte of held-out documents, and what a second copy in training tells."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()
    got = {x.doc_id: x for x in context_tree.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    size = {x.doc_id: len((x.text or "").encode()) + 1 for x in rows}
    held = [x for x in got.values() if x.held_out]
    bits = lambda c: -sum(getattr(x, c) for x in held) / np.log10(2) / sum(size[x.doc_id] for x in held)
    print(f"trees {bits('score'):.3f}, words {bits('base_score'):.3f} bits a byte")
    assert bits("score") < bits("base_score")


def test_scores(spark, docs, rows, empty):
    import math
    from collections import Counter

    got = context_tree.score(docs).collect()
    assert len(got) == len(rows)
    words = lambda t: brute.WORD.findall((t or "").translate(brute.LOWER)) + [None]
    c = Counter(w for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1 for w in words(t))
    n, v = sum(c.values()), len(c)
    want = {i: (len(w := words(t)), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for i, t in unique(rows)}
    for r in got:
        assert r.train_tokens == n and r.score < 0
        if r.doc_id is not None:
            assert (r.n_tokens, r.n_known) == want[r.doc_id][:2] and r.base_score == pytest.approx(want[r.doc_id][2], rel=1e-9)
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
    assert context_tree.score(empty).count() == 0


def test_word_ids_of_every_code_point():
    """Known code points by our way, word by word and between letters; unknown ones, which go to the library, in texts of their own."""
    import unicodedata

    path = tokens.vocabulary("word_bpe_49k.json")
    assigned = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    private = [chr(c) for c in (0xE000, 0xF8FF, 0xF0000, 0x10FFFD)]
    unknown = [chr(c) for c in (0x378, 0x558, 0x1C89, 0xA7CB, 0x105C0, 0xE0FFF, 0x10FFFF)]
    chars = assigned + private
    texts = [" ".join(f"a{c}b" for c in chars[i : i + 500]) for i in range(0, len(chars), 500)] + [" ".join(f"{c} {c}{c}" for c in chars[i : i + 500]) for i in range(0, len(chars), 500)] + [f"a{c}b {c}" for c in unknown] + unknown
    assert [tokens.word_bpe(path, t) for t in texts] == tokens.whole(path, texts)
