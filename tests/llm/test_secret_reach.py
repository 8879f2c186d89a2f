"""Findings that touch or hold a span, against a look at every finding; a long text full of keys."""

import random
import time

from ledgerlark.llm import secrets


def test_reach_is_a_look_at_every_finding():
    r = random.Random(8)
    for _ in range(400):
        base = sorted((a, r.randrange(3), a + r.randrange(1, 9)) for a in (r.randrange(40) for _ in range(r.randrange(7))))
        reach = secrets.Reach(base)
        for s in range(42):
            for e in (s + 1, s + 3, s + 12):
                assert reach.touches(s, e) == any(a < e and s < b for a, _, b in base)
                assert reach.covers(s, e) == any(a <= s and e <= b for a, _, b in base)


def test_a_long_text_of_keys():
    r = random.Random(9)
    text = " ".join("token=" + "".join(r.choice("0123456789abcdef") for _ in range(32)) for _ in range(30_000))
    start = time.time()
    reach, base = secrets.Reach(secrets.base_spans(text)), secrets.base_spans(text)
    found = secrets.candidates(text)
    assert len(base) >= 30_000 and all(reach.touches(*c) for c in found) and all(reach.covers(a, e) for a, _, e in base)
    assert time.time() - start < 30
