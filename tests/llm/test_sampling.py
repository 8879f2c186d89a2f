"""Bounded samples and windows leave nothing of the whole job out."""

import random

import numpy as np

from ledgerlark.llm import quality, secrets


def mixed(n_good, n_bad):
    """Texts of two labels that share most of their words, so that scores are seldom sure."""
    r = random.Random(11)
    common = [f"c{i}" for i in range(40)]

    def text(own):
        return " ".join(r.choice(own) if r.random() < 0.08 else r.choice(common) for _ in range(12))

    rows = [(i, text(["river", "stone"]), 1) for i in range(n_good)] + [(10_000 + i, text(["cash", "click"]), 0) for i in range(n_bad)]
    return [(i, t) for i, t, _ in rows], [(i, y) for i, _, y in rows]


def test_scores_keep_the_shares_of_labels(spark):
    """With 900 good to 150 bad rows and a sample of 120 each, the mean score is the good ones' share, not a half."""
    docs, labels = mixed(900, 150)
    d, known = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")
    mean = lambda sample: (lambda x: sum(r.score for r in x) / len(x))(quality.scored(d, quality.train(d, known, sample=sample)).where("held_out").collect())
    whole, cut = mean(quality.SAMPLE), mean(120)
    assert abs(whole - 900 / 1050) < 0.06 and abs(cut - 900 / 1050) < 0.06


def test_accepted_keeps_all_if_nothing_was_taught(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.accepted(docs, quality.train(docs, none)).count() == docs.count()


def test_windows_cover_a_candidate():
    for n in (10, 39, 40, 41, 59, 60, 61, 200, 205):
        text = "x " + "".join(chr(97 + i % 26) for i in range(n)) + " tail"
        inside = [w[secrets.BEFORE : secrets.BEFORE + secrets.INSIDE].rstrip(b"\0").decode() for w in secrets.windows(text, 2, 2 + n)]
        assert len(inside) == 1 + max(0, -(-(n - 40) // 20))
        assert all(any(text[2 + i : 2 + i + min(20, n)] in w for w in inside) for i in range(n - min(20, n) + 1))


def test_a_key_far_inside_a_path_is_found():
    """Paths with a key at their end, after more characters than the window has, against paths without."""
    r = random.Random(12)
    key = lambda: "".join(r.choice("abcdef0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(36))
    words = lambda n: "/".join("".join(r.choice("etaoinshr") for _ in range(6)) for _ in range(n))
    rows = [(f"see {words(3)} {k} now", y) for y, k in [(1.0, key()) for _ in range(300)] + [(0.0, words(5) + str(r.randrange(10))) for _ in range(300)]]
    x = np.array([np.frombuffer(secrets.window(t, 25, t.rindex(" ")), np.uint8) for t, _ in rows])
    net = secrets.Network().fit(x, np.array([y for _, y in rows]), 0.95)
    hit = lambda t: any(k == 3 for _, k, _ in secrets.spans(t, net)[1])
    deep = [f"see {words(9)}/v1/{key()} now" for _ in range(50)]
    assert sum(map(hit, deep)) >= 45
    assert sum(hit(f"see {words(12)}/v1 now") for _ in range(50)) <= 10


def test_the_threshold_keeps_the_recall():
    """Labels that cannot be told apart leave probabilities below a half; the recall still holds."""
    r = np.random.default_rng(13)
    x = r.integers(97, 123, (1000, secrets.WIDTH)).astype(np.uint8)
    y = (r.random(1000) < 0.3).astype(float)
    net = secrets.Network().fit(x, y, 0.95)
    held = np.random.default_rng(2).permutation(1000)[:200]
    assert (net.probability(x[held])[y[held] == 1] >= net.threshold).mean() >= 0.95


def test_nothing_is_added_without_training():
    assert secrets.spans("see abcdef0123456789 now", secrets.Network())[1] == []
