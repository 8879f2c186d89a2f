"""The same results, the long way."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def groups(n, linked):
    """The smallest index reachable from each of n items."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def similar(rows, k, pct):
    """{doc_id: (n, component)} of rows (doc_id, text) with different ids."""
    rows = sorted((i, t) for i, t in rows if i is not None)
    sets = [shingles(t, k) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= pct * len(sets[a] | sets[b])]
    at = groups(len(rows), links)
    return {i: (len(s), rows[g][0]) for (i, _), s, g in zip(rows, sets, at)}


def repeats(rows, window):
    """{doc_id: (words, covered flags)}."""
    seen, out = set(), {}
    for i, t in sorted((i, t) for i, t in rows if i is not None):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if key in seen:
                gone[p : p + window] = [True] * window
            seen.add(key)
        out[i] = (w, gone)
    return out
