"""What op9 learns from: all rows, counted against plain Python."""

import random

import numpy as np

from ledgerlark.llm import secrets


def test_training_sees_every_finding_and_candidate(spark):
    """More findings than the sample of before had, each in its own context, in several parts."""
    r = random.Random(31)
    pick = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    texts = [f"{pick('etaoin', 9)} token = {pick('0123456789abcdef', 30)} {pick('etaoin', 9)} {pick('0123456789', 12)} {pick('etaoin', 9)}" for _ in range(1700)]
    seen = secrets.labelled(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    want = set()
    for t in texts:
        base = secrets.base_spans(t)
        want |= {(secrets.window(t, *secrets.secret_part(t, *b)), 1.0) for b in base} | {(secrets.window(t, *c), 0.0) for c in secrets.candidates(t) if not secrets.Reach(base).touches(*c)}
    assert sum(y == 1 for _, y in want) > 1500 and sum(y == 0 for _, y in want) > 1500
    got = set()
    rows = secrets.parts(seen, 500).collect()
    for x in rows:
        w, y, kind = np.frombuffer(x.windows, np.uint8).reshape(-1, secrets.WIDTH), np.frombuffer(x.labels), np.frombuffer(x.kinds, np.int8)
        got |= {(a.tobytes(), b) for a, b in zip(w[kind == 0], y[kind == 0], strict=True)}
        assert x.n == (~np.frombuffer(x.held, bool)).sum()
    assert len(rows) > 1 and got == want


def test_training_in_parts_finds_planted_keys(spark):
    """Parts of a few hundred rows, averaged: twice the same weights, and keys without a keyword are told from words."""
    r = random.Random(32)
    pick = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    prose = lambda n: " ".join(pick("etaoinshrdlu", r.randrange(3, 11)) for _ in range(n))
    docs = [(i, f'{prose(8)} secret = "{pick("0123456789abcdef", 40)}" {prose(5)} {pick("0123456789", 16)} {prose(5)} {pick("ETAOIN", 22)}') for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    net, again = secrets.train(df, size=400), secrets.train(df.repartition(5), size=400)
    assert all((net.w[k] == again.w[k]).all() for k in net.w) and net.threshold == again.threshold
    hit = lambda t: any(k == 3 for _, k, _ in secrets.spans(t, net)[1])
    assert sum(hit(f"{prose(9)} {pick('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789', 36)} {prose(9)}") for _ in range(100)) >= 90
    assert sum(hit(f"{prose(9)} {pick('0123456789', 16)} {prose(9)}") for _ in range(100)) <= 5
