"""The classifier's parts against plain forms: the solver, the log-count ratios, whole scores, held-out figures on the given tables."""

import random
from collections import Counter

import numpy as np
import pytest

from ledgerlark.llm import quality

SF = "/root/testdata/sf0.01"


def _objective(w, bias, dense, y, most):
    return 0.5 * (w @ w + bias * bias) + np.sum(most * np.maximum(0, 1 - y * (dense @ w + bias)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_descent_reaches_the_optimum_of_a_plain_solver(seed):
    r = np.random.default_rng(seed)
    n, slots = 40, 15
    y = np.where(r.random(n) < 0.3, 1.0, -1.0)
    y[:2] = 1, -1
    rows = [np.sort(r.choice(slots, r.integers(1, 6), replace=False)).astype(np.int32) for _ in range(n)]
    values = quality.scaled(rows, r.normal(size=slots))
    dense = np.zeros((n, slots))
    for i, (at, v) in enumerate(zip(rows, values, strict=True)):
        dense[i, at] = v
    most = np.where(y > 0, n / (2 * (y > 0).sum()), n / (2 * (y < 0).sum()))
    # the same dual by projected gradient, all coordinates at once
    q = (dense @ dense.T + 1) * np.outer(y, y)
    alpha, step = np.zeros(n), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(40_000):
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, most)
    w, bias = dense.T @ (alpha * y), float(alpha @ y)
    best = _objective(w, bias, dense, y, most)
    assert best == pytest.approx(alpha.sum() - 0.5 * alpha @ q @ alpha, rel=1e-3)  # no gap: it is the optimum
    got = quality.descend(rows, values, y, slots, passes=3_000)
    assert np.allclose(got[0], w, atol=2e-3) and got[1] == pytest.approx(bias, abs=2e-3)
    assert best - 1e-6 <= _objective(*quality.descend(rows, values, y, slots), dense, y, most) <= 1.1 * best


def test_ratios_are_those_of_counted_indicators(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdef") for _ in range(3))
    text = {i: " ".join(word() for _ in range(r.randrange(1, 40))) for i in range(120)}
    label = {i: int(r.random() < 0.4) for i in range(0, 120, 2)}
    d = spark.createDataFrame(list(text.items()), "doc_id long, text string").repartition(4)
    model = quality.train(d, spark.createDataFrame(list(label.items()), "doc_id long, quality int").repartition(3))
    count = [Counter(), Counter()]
    for i, y in label.items():
        if quality.fold(i, 4) != 2:
            count[y].update(quality.features(text[i]).tolist())
    total = [sum(c.values()) + quality.SLOTS for c in count]
    seen = set(count[0]) | set(count[1])
    want = {s: np.log((count[1][s] + 1) / total[1] / ((count[0][s] + 1) / total[0])) for s in seen}
    assert set(np.flatnonzero(model.scale).tolist()) <= seen
    assert max(abs(model.scale[s] - v) for s, v in want.items()) < 1e-5


def test_scores_of_odd_rows(spark):
    good, bad = [(i, f"clear words about rivers and hills number {i}") for i in range(40)], [(i, "click click buy buy now now " * 3 + str(i)) for i in range(40, 80)]
    long = "clear words about rivers and hills " * 260_000  # beyond an Arrow batch
    odd = [(100, None), (101, ""), (102, " \n"), (103, long), (104, good[0][1]), (104, good[0][1]), (None, good[0][1])]
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad], "doc_id long, quality int")
    d = spark.createDataFrame(good + bad + odd, "doc_id long, text string")
    model = quality.train(d, labels)
    got = quality.scored(d, model).collect()
    assert len(got) == 87
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x.score)
    assert by[100] == by[101] == [model.score("")] and 0 < by[102][0] < 1
    assert by[103] == [model.score(long)] and by[104][0] == by[104][1] == by[None][0] == by[0][0]
    assert all(x.predicted == int(x.score >= 0.7) for x in got) and [x.held_out for x in got if x.doc_id is None] == [False]


def test_held_out_figures_on_the_given_tables(spark):
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality is not null").collect()}
    got = [(x.score, y[x.doc_id], x.predicted) for x in quality.op2_quality_nbsvm(spark, SF).where("held_out").collect() if x.doc_id in y]
    one, none = [s for s, k, _ in got if k], [s for s, k, _ in got if not k]
    auroc = np.mean([(a > b) + 0.5 * (a == b) for a in one for b in none])
    assert len(got) > 50 and auroc > 0.98 and np.mean([k == p for _, k, p in got]) > 0.93
