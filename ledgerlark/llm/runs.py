"""Periodic runs of words, and texts without their repeats (op 13).

A run is a stretch of consecutive words with smallest period q and at least max(6, 4 * q) words that no neighbour extends.
Texts are taken in slices; the words of a slice are numbered and stand behind each other in one array, a separator of its
own behind each text.  Suffixes at the positions of a difference cover are sorted, and no others; two positions reach a pair of sorted ones
within 31 words, which are compared, and the rest of their common extension is a range minimum over neighbours' common prefixes.

A run of period q holds a multiple x of 3 * q, counted from the text's start, with x + q in it; so one pair of words for each
point of that grid, n ln n / 3 of them for n words, finds all runs.  Most pairs differ in one of the first words.

Null or empty text: no words.  A null doc_id has no number and its text is taken as it is.  Rows that repeat a doc_id are documents of their own.  Texts
are read whole, whatever their length: a longer one is a slice by itself, its grid taken in parts.  An empty table gives no rows; other columns
are ignored.  No row depends on another, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import WORD, map_texts, table, texts

#: Every distance modulo COVER is a difference of two of these: a perfect difference set.
COVER, IN_COVER = 31, np.array([1, 5, 11, 24, 25, 27])
#: Words of a text that a run needs, repeats of its period, and pairs of the grid looked at at once.
LEAST, TIMES, PAIRS = 6, 4, 1 << 19

_SLOT = np.full(COVER, -1)
_SLOT[IN_COVER] = np.arange(len(IN_COVER))
#: How far two positions, by their remainders, have to go until both are in the cover.
_TO_COVER = np.array([[next(d for d in range(COVER) if _SLOT[(i + d) % COVER] >= 0 and _SLOT[(j + d) % COVER] >= 0) for j in range(COVER)] for i in range(COVER)])


class Extensions:
    """Longest common extensions of positions of an array of positive numbers whose every text ends in a number of its own."""

    def __init__(self, w: np.ndarray):
        n, k = len(w), len(IN_COVER)
        self.w = np.r_[w, np.zeros(2 * COVER, w.dtype)].astype(np.uint32)
        at = (np.arange(-(-n // COVER))[:, None] * COVER + IN_COVER).ravel()
        at = at[at < n]
        block = self.w[at[:, None] + np.arange(COVER)]
        order = np.argsort(np.ascontiguousarray(block.astype(">u4")).view(f"V{4 * COVER}").ravel(), kind="stable")
        new = np.r_[True, (block[order[1:]] != block[order[:-1]]).any(1)]
        name = np.empty(len(at), np.int64)
        name[order] = np.cumsum(new) - 1
        names = [name]
        while len(at) and names[-1].max() < len(at) - 1:  # twice as many words each time
            name, step = names[-1], k << (len(names) - 1)
            pair = name * (len(at) + 1)
            pair[:-step] += name[step:] + 1
            names.append(np.unique(pair, return_inverse=True)[1])
        self.rank = names[-1]
        order = np.argsort(self.rank)
        a, b, equal = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, len(at) - 1), np.int32)
        for t in range(len(names) - 2, -1, -1):
            same = names[t][a] == names[t][b]
            a[same] += k << t
            b[same] += k << t
            equal[same] += COVER << t
        differ = block[a] != block[b]
        self.least = [equal + differ.argmax(1).astype(np.int32)]
        while 2 << (len(self.least) - 1) <= len(equal):
            low, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(low[:-half], low[half:]))

    def _sampled(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of different positions in the cover."""
        k = len(IN_COVER)
        a, b = (self.rank[x // COVER * k + _SLOT[x % COVER]] for x in (i, j))
        a, b = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((b - a).astype(float))[1] - 1
        out = np.empty(len(a), np.int64)
        for t in np.unique(level):
            some = level == t
            out[some] = np.minimum(self.least[t][a[some]], self.least[t][b[some] - (1 << t)])
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are the same; i and j differ."""
        w, out, left = self.w, _TO_COVER[i % COVER, j % COVER].astype(np.int64), np.arange(len(i))
        to = out.copy()
        for k in range(COVER):
            left = left[to[left] > k]
            if not len(left):
                break
            same = w[i[left] + k] == w[j[left] + k]
            out[left[~same]] = k
            to[left[~same]] = -1
            left = left[same]
        on = np.flatnonzero(to >= 0)
        if len(on):
            out[on] += self._sampled(i[on] + out[on], j[on] + out[on])
        return out


def grid(start: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, position, period), about PAIRS at a time: for each text of n words and each period its multiples of three periods."""
    most = n // TIMES
    text = np.repeat(np.arange(len(n)), most)
    q = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    points = (n[text] - q - 1) // (3 * q) + 1
    ends = np.cumsum(points)
    cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(PAIRS, ends[-1] if len(ends) else 0, PAIRS)), len(q)])
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        c = points[s:e]
        t, p = np.repeat(text[s:e], c), np.repeat(q[s:e], c)
        k = np.arange(len(p)) - np.repeat(np.cumsum(c) - c, c)
        yield t, start[t] + 3 * p * k, p


def runs(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs of texts of n words each, by text, start and period; words: a positive number each."""
    size, many = np.asarray(n, np.int64), len(n)
    own = np.repeat(np.arange(many), size)
    start = np.cumsum(size + 1) - size - 1
    w = np.empty(len(words) + many, np.int64)
    w[np.arange(len(words)) + own] = words
    w[start + size] = (words.max() if len(words) else 0) + 1 + np.arange(many)
    none = np.zeros(0, np.int64)
    found, ext, last = [], None, len(w) - 1
    for t, x, q in grid(start, np.where(size >= LEAST, size, 0)):
        same = lambda a, b: w[np.clip(a, 0, last)] == w[np.minimum(b, last)]
        use = np.flatnonzero(w[x] == w[x + q])
        t, x, q = t[use], x[use], q[use]
        # of 3 * q equal pairs about x, half or more stand on one side of it
        use = np.flatnonzero((same(x + q, x + 2 * q) & same(x + 1, x + 1 + q)) | (same(x - q, x) & same(x - 1, x - 1 + q)))
        t, x, q = t[use], x[use], q[use]
        if not len(x):
            continue
        ext = ext or Extensions(w)
        ahead, before = ext.common(x, x + q), np.minimum(x - start[t], 3 * q)
        use = np.flatnonzero(ahead + before >= 3 * q)
        t, x, q, ahead, most = t[use], x[use], q[use], ahead[use], before[use]
        low, high = np.zeros(len(x), np.int64), most + 1  # the words before x that go on equal: at least low, fewer than high
        while (open_ := np.flatnonzero(high - low > 1)).size:
            mid = (low[open_] + high[open_]) // 2
            y = x[open_] - mid
            good = ext.common(y, y + q[open_]) >= mid
            low[open_[good]] = mid[good]
            high[open_[~good]] = mid[~good]
        length = low + ahead + q
        use = np.flatnonzero((low < 3 * q) & (length >= np.maximum(LEAST, TIMES * q)))  # farther back: an earlier point finds it
        found.append((t[use], x[use] - low[use] - start[t[use]], length[use], q[use]))
    if not found:
        return none, none, none, none
    t, s, length, q = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((q, length, s, t))  # a stretch once, with its smallest period
    t, s, length, q = t[order], s[order], length[order], q[order]
    first = np.flatnonzero(np.r_[True, (np.diff(t) != 0) | (np.diff(s) != 0) | (np.diff(length) != 0)]) if len(t) else none
    t, s, length, q = t[first], s[first], length[first], q[first]
    order = np.lexsort((q, s, t))
    return t[order], s[order], length[order], q[order]


def periodic(n: int, h: int) -> np.ndarray | None:
    """The places of the words of a text whose number is h, where the contract makes its tail periodic."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def strongest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> int:
    """The run with the greatest length / period, exactly; ties: the smallest start, then period."""
    near = length / period
    near = np.flatnonzero(near >= near.max() * (1 - 1e-12))
    return int(min(near, key=lambda k: (-Fraction(int(length[k]), int(period[k])), start[k], period[k])))


def collapsed(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run has behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return edge.cumsum()[:n] == 0


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def detect(docs: DataFrame, periodic_tails: bool = False, keep_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_runs, the strongest run, digests of all runs and of the text without repeats.

    periodic_tails: read the texts as the check's contract makes them.  keep_text: also the runs and the text itself."""

    def work(ids: list, text: list[str]) -> dict:
        own = [WORD.findall(t) for t in text]
        if periodic_tails:
            for k, i in enumerate(ids):
                at = None if i is None else periodic(len(own[k]), zlib.crc32(str(i).encode()))
                if at is not None:
                    own[k] = [own[k][x] for x in at.tolist()]
        n = [len(x) for x in own]
        numbers = pa.array([w for x in own for w in x], pa.large_string()).dictionary_encode().indices.to_numpy().astype(np.int64) + 1
        t, s, length, q = runs(numbers, np.array(n, np.int64))
        edge = np.searchsorted(t, np.arange(len(ids) + 1))
        out: dict[str, list] = {c: [] for c in ("start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed")}
        for k, words in enumerate(own):
            at = slice(edge[k], edge[k + 1])
            a, m, p = s[at], length[at], q[at]
            best = (None,) * 4
            if len(a):
                b = strongest(a, m, p)
                best = (int(a[b]), int(m[b]), int(p[b]), 1000 * int(m[b]) // int(p[b]))
                words = [words[i] for i in np.flatnonzero(collapsed(len(words), a, m, p)).tolist()]
            said, kept = "".join(f"{x},{y},{z}\n" for x, y, z in zip(a.tolist(), m.tolist(), p.tolist(), strict=True)), " ".join(words)
            for c, v in zip(out, (*best, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(), said, kept), strict=True):
                out[c].append(v)
        return {"doc_id": ids, "n_runs": np.diff(edge), **out}

    return map_texts(texts(docs), work, SCHEMA + ", runs string, collapsed string" * keep_text)


def op13_cover_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"), periodic_tails=True)
