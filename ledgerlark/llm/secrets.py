"""Secrets: fixed patterns, and a character convolutional network over candidates in context (op 9).

The patterns' findings always stay.  Candidates are all runs of key-like characters with a digit, with a capital
behind a small letter, or of 20 characters and more; the network reads each with the text around it, those of the
patterns' findings too, and adds a span for each that scores above a threshold and no finding covers.  A candidate
longer than the window is read in overlapping windows and has the largest of their probabilities.

It is trained on all labelled findings, each window once: the secrets that the patterns find, the same
with other secrets of equal length and in other places of the corpus, against all other candidates of the corpus and the
same places filled with words and numbers.  They are dealt to parts of about PART by hash; each task passes over its parts, and the
weights are averaged after each epoch.  Platt's calibration and the threshold, the largest that keeps the required recall,
are made on all findings held out from training, by counts of their logits to 1 / CELLS.  Without findings nothing is added.

Null or empty text: no spans.  Places count code points, ends are exclusive.  Texts of any length are read whole.
Repeated rows are each returned; null ids stay; an empty table gives no rows; other columns are ignored by find()
and kept by masked().  Row by row, no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, grouped, lean, map_texts, saved, table, texts

KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A run of key-like characters; which of them are candidates says key_like.
_RUN = re.compile(r"[A-Za-z0-9+/_=](?:[A-Za-z0-9+/_=.-]{6,}[A-Za-z0-9+/_=])")
_MIXED = re.compile(r"[0-9]|[a-z][A-Z]")
#: Characters of a candidate and of the text before and behind it that the network reads.
BEFORE, INSIDE, BEHIND = 24, 40, 8
WIDTH = BEFORE + INSIDE + BEHIND
#: From one window of a longer candidate to the next.
STEP = 20
#: Findings and other candidates that are passed over one after the other; parts of so many run side by side.
PART = 8192
#: Units of averaged weights and of moments, and cells of a unit of held-out logits.
UNITS, CELLS = (2.0**44, 2.0**52), 4096
_EMBED, _FILTERS, _SPAN = 12, 24, 5


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' findings, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the text's candidates."""
    return [m.span() for m in _RUN.finditer(text) if m.end() - m.start() >= 20 or _MIXED.search(m.group())]


class Reach:
    """Sorted findings, asked in logarithmic time how far those that start in time reach."""

    def __init__(self, base: list[tuple[int, int, int]]):
        self.starts, self.ends = [a for a, _, _ in base], list(accumulate((e for _, _, e in base), max))

    def _before(self, place: int) -> int:
        """The farthest end of the findings that start before the place, -1 without any."""
        i = bisect_left(self.starts, place)
        return self.ends[i - 1] if i else -1

    def touches(self, start: int, end: int) -> bool:
        return self._before(end) > start

    def covers(self, start: int, end: int) -> bool:
        """Whether one finding holds the whole span."""
        return self._before(start + 1) >= end


def window(text: str, start: int, end: int) -> bytes:
    """The candidate's characters in their context, one byte each, at fixed places."""
    parts = (text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0"), text[start : min(end, start + INSIDE)].ljust(INSIDE, "\0"), text[end : end + BEHIND].ljust(BEHIND, "\0"))
    return "".join(parts).encode("latin-1", "replace")


def windows(text: str, start: int, end: int) -> list[bytes]:
    """The candidate's window, and behind its first INSIDE characters more of them up to its end."""
    return [window(text, start, end), *[window(text, s, s + INSIDE) for s in (min(k, end - INSIDE) for k in range(start + STEP, end - INSIDE + STEP, STEP))]]


def secret_part(text: str, start: int, kind: int, end: int) -> tuple[int, int]:
    """Of an assignment the value, else the whole finding: what the network is to know."""
    m = _ASSIGN.match(text, start) if kind == 0 else None
    return m.span(2) if m else (start, end)


class Network:
    """Embedding, one convolution with rectified filters, the largest and mean response, a logistic unit."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.w = {
            "embed": r.normal(0, 0.5, (256, _EMBED)), "filters": r.normal(0, (_SPAN * _EMBED) ** -0.5, (_SPAN * _EMBED, _FILTERS)),
            "bias": np.zeros(_FILTERS), "out": r.normal(0, 0.2, 2 * _FILTERS), "out_bias": np.zeros(1),
        }
        self.slope, self.shift, self.threshold = 1.0, 0.0, float("inf")

    def _forward(self, x: np.ndarray):
        rows = self.w["embed"][x]
        cols = np.lib.stride_tricks.sliding_window_view(rows, _SPAN, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WIDTH - _SPAN + 1, _SPAN * _EMBED)
        act = np.maximum(cols @ self.w["filters"] + self.w["bias"], 0)
        top = act.argmax(1)
        pooled = np.concatenate([np.take_along_axis(act, top[:, None], 1)[:, 0], act.mean(1)], 1)
        return cols, act, top, pooled, pooled @ self.w["out"] + self.w["out_bias"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 256])[-1] for i in range(0, len(x), 256)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(x) + self.shift, -40, 40)))

    def epoch(self, x: np.ndarray, y: np.ndarray, order: np.ndarray, m: dict, v: dict, step: int, rate: float = 0.01) -> int:
        """Adam over the rows in this order; m and v are its moments, step the steps done; the steps done then."""
        for i in range(0, len(order), 64):
            part = order[i : i + 64]
            cols, act, top, pooled, z = self._forward(x[part])
            d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[part]) / len(part)
            dp = d[:, None] * self.w["out"]
            da = np.repeat(dp[:, None, _FILTERS:] / act.shape[1], act.shape[1], 1)
            np.put_along_axis(da, top[:, None], np.take_along_axis(da, top[:, None], 1) + dp[:, None, :_FILTERS], 1)
            da *= act > 0
            g = {"out": pooled.T @ d, "out_bias": np.array([d.sum()]), "bias": da.sum((0, 1)), "filters": np.tensordot(cols, da, ((0, 1), (0, 1)))}
            dc = (da @ self.w["filters"].T).reshape(len(part), -1, _SPAN, _EMBED)
            g["embed"] = np.zeros_like(self.w["embed"])
            for k in range(_SPAN):
                np.add.at(g["embed"], x[part][:, k : k + dc.shape[1]], dc[:, :, k])
            step += 1
            for k, a in self.w.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                a -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return step

    def calibrate(self, z: np.ndarray, t: np.ndarray, kind: np.ndarray, n: np.ndarray, recall: float) -> Network:
        """Platt's calibration and the threshold, the largest that keeps the recall in each kind of positives, on held-out logits, labels and kinds, n of each."""
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -40, 40)))
            self.slope -= 0.1 * float(np.average((p - t) * z, weights=n)) / max(1.0, float(np.average(z * z, weights=n)))
            self.shift -= 0.1 * float(np.average(p - t, weights=n))
        p = 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -40, 40)))
        self.threshold = float("inf")
        for k in np.unique(kind[t == 1]):
            own = np.flatnonzero((t == 1) & (kind == k))
            own = own[np.argsort(p[own])]
            upto = np.cumsum(n[own])
            self.threshold = min(self.threshold, float(p[own[np.searchsorted(upto, int((upto[-1] - 1) * (1 - recall)), "right")]]))
        return self

    def fit(self, x: np.ndarray, y: np.ndarray, recall: float, group: np.ndarray | None = None, kind: np.ndarray | None = None, epochs: int = 6, rate: float = 0.01, seed: int = 2) -> Network:
        """epoch() on four fifths of the groups (of the rows, if none are given), calibrate() on the rest."""
        r = np.random.default_rng(seed)
        held = held_out(np.arange(len(x)) if group is None else group, r)
        own, out = np.flatnonzero(~held), np.flatnonzero(held)
        m, v, step = {k: np.zeros_like(a) for k, a in self.w.items()}, {k: np.zeros_like(a) for k, a in self.w.items()}, 0
        for _ in range(epochs):
            r.shuffle(own)
            step = self.epoch(x, y, own, m, v, step, rate)
        return self.calibrate(self.logits(x[out]), y[out], (np.zeros(len(x), int) if kind is None else kind)[out], np.ones(len(out)), recall) if len(out) else self


def held_out(group: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """Which rows a fifth of the groups holds."""
    order = r.permutation(int(group.max()) + 1)
    out = np.zeros(len(order), bool)
    out[order[: len(order) // 5]] = True
    return out[group]


def labelled(docs: DataFrame) -> DataFrame:
    """(window, label): every distinct window of the findings and of the other candidates, from one pass."""

    def work(ids: list, text: list[str]) -> dict:
        rows = []
        for t in text:
            base = base_spans(t)
            reach = Reach(base)
            rows += [(window(t, *secret_part(t, *b)), 1.0) for b in base]
            rows += [(window(t, *c), 0.0) for c in candidates(t) if not reach.touches(*c)]
        rows = list(dict.fromkeys(rows))
        return {"window": [r[0] for r in rows], "label": [r[1] for r in rows]}

    return map_texts(texts(docs), work, "window binary, label double").dropDuplicates()


#: Characters of a made secret, at least, unless the one in whose place it stands is shorter.
LEAST = 20
_LETTERS = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
_KEYS = [np.frombuffer(x, np.uint8) for x in (b"0123456789abcdef", b"0123456789ABCDEF", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")]


def _filled(x: np.ndarray, r: np.random.Generator, alphabets: list[np.ndarray]) -> np.ndarray:
    """The same windows with characters drawn from one of the alphabets in place of the candidate's, LEAST of them or more."""
    out = x.copy()
    inside = out[:, BEFORE : BEFORE + INSIDE]
    for row in inside:
        letters = alphabets[r.integers(len(alphabets))]
        row[:] = np.where(row == 0, 0, letters[r.integers(0, len(letters), INSIDE)])
        row[r.integers(min(LEAST, np.count_nonzero(row)), np.count_nonzero(row) + 1) :] = 0
    return out


def _words(x: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """The same windows with words and numbers: one candidate in four is of digits, the others of letters, one in three capital."""
    out = _filled(x, r, [_LETTERS, _LETTERS, _LETTERS - 32, np.frombuffer(b"0123456789", np.uint8)])
    inside = out[:, BEFORE : BEFORE + INSIDE]
    joint = (r.random(inside.shape) < 0.1) & (inside != 0)
    inside[:] = np.where(joint, np.frombuffer(b"_-./", np.uint8)[r.integers(0, 4, inside.shape)], inside)
    return out


def _elsewhere(x: np.ndarray, places: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """The candidates of x in the contexts of places."""
    out = places[r.integers(0, len(places), len(x))].copy()
    out[:, BEFORE : BEFORE + INSIDE] = x[:, BEFORE : BEFORE + INSIDE]
    return out


def made(x: np.ndarray, y: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows, labels, kinds and groups: those given, and what is made of the findings among them."""
    r = np.random.default_rng([5, seed])
    found, other = x[y == 1], x[y == 0]
    places = np.concatenate([other, found])
    keys = _filled(found, r, _KEYS)
    more = [(keys, 1.0), (_elsewhere(keys, places, r), 1.0), (_words(found, r), 0.0), (_words(_elsewhere(found, places, r), r), 0.0)]
    group = np.r_[np.arange(len(x)), np.tile(np.flatnonzero(y == 1), len(more))]  # what is made of a finding is held out with it
    kind = np.r_[np.zeros(len(x), int), np.repeat(np.arange(1, len(more) + 1), len(found))]
    return np.concatenate([x, *[m for m, _ in more]]), np.r_[y, *[np.full(len(m), t) for m, t in more]], kind, group


def parts(seen: DataFrame, size: int) -> DataFrame:
    """(part, n, windows, labels, kinds, held): all rows of labelled() and what is made of them, dealt by hash to parts of about
    size rows, one row for each; n: how many are trained on."""
    number = max(1, -(-seen.count() // size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part,), rows in grouped(batches):
            x, y, kind, group = made(np.array([np.frombuffer(r[2], np.uint8) for r in rows]).reshape(-1, WIDTH), np.array([r[1] for r in rows]), part)
            held = held_out(group, np.random.default_rng([2, part]))
            cols = [pa.array([a], t) for a, t in ((part, pa.int32()), (int((~held).sum()), pa.int64()), *((a.tobytes(), pa.binary()) for a in (x, y, kind.astype(np.int8), held)))]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "n", "windows", "labels", "kinds", "held"])

    dealt = seen.select(F.pmod(F.xxhash64("window"), F.lit(number)).cast("int").alias("part"), "label", "window").repartition(number, "part").sortWithinPartitions("part", F.desc("label"), F.xxhash64("window"), "window")
    return dealt.mapInArrow(lean(run), T.StructType.fromDDL("part int, n long, windows binary, labels binary, kinds binary, held binary"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The parts of a task: number, rows trained on, windows, labels, kinds, held."""
    for b in batches:
        for part, n, x, y, kind, held in zip(*(c.to_pylist() for c in b.columns), strict=True):
            yield part, n, np.frombuffer(x, np.uint8).reshape(-1, WIDTH), np.frombuffer(y), np.frombuffer(kind, np.int8), np.frombuffer(held, bool)


def _flat(*dicts: dict) -> np.ndarray:
    return np.concatenate([d[k].ravel() for d in dicts for k in sorted(d)])


def _unflat(flat: np.ndarray, like: dict) -> list[dict]:
    """What _flat() made of dicts with arrays of these shapes."""
    out, at = [], 0
    while at < len(flat):
        out.append({})
        for k in sorted(like):
            out[-1][k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
            at += like[k].size
    return out


def _averaged(rows: DataFrame, net: Network, m: dict, v: dict, step: int, epoch: int, total: int) -> tuple[dict, dict, dict, int]:
    """Weights, moments and steps after one epoch of each part from the same weights, averaged by the parts' rows: as whole numbers of 1 / UNITS, so
    that the order of adding is nothing to the result."""
    shared = rows.sparkSession.sparkContext.broadcast((net, m, v))
    scale = np.repeat(UNITS, [_flat(net.w).size, 2 * _flat(net.w).size])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, steps = np.zeros(len(scale), np.int64), 0
        for part, n, x, y, _, held in _read(batches):
            own, (w, m, v) = Network(), [{k: a.copy() for k, a in d.items()} for d in (shared.value[0].w, *shared.value[1:])]
            own.w = w
            steps = max(steps, own.epoch(x, y, np.random.default_rng([3, part, epoch]).permutation(np.flatnonzero(~held)), m, v, step))
            sums += np.round(_flat(w, m, v) * (n / total) * scale).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(scale) + 1)), pa.array(np.r_[sums, steps])], names=["i", "value"])

    got = rows.mapInArrow(lean(run), T.StructType.fromDDL("i long, value long")).groupBy("i").agg(F.sum("value").alias("value"), F.max("value").alias("most")).collect()
    got.sort(key=lambda r: r.i)
    return *_unflat(np.array([r.value for r in got[:-1]]) / scale, net.w), got[-1].most


def _logits(rows: DataFrame, net: Network) -> list:
    """(cell, label, kind, n): the held-out rows by their logits, down to whole cells of 1 / CELLS."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, x, y, kind, held in _read(batches):
            cell = np.floor(np.clip(shared.value.logits(x[held]), -64, 64) * CELLS).astype(np.int64)
            key, n = np.unique(np.stack([cell, y[held].astype(np.int64), kind[held]], 1), axis=0, return_counts=True) if len(cell) else (np.zeros((0, 3), np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*map(pa.array, key.T), pa.array(n)], names=["cell", "label", "kind", "n"])

    return sorted(rows.mapInArrow(lean(run), T.StructType.fromDDL("cell long, label long, kind long, n long")).groupBy("cell", "label", "kind").agg(F.sum("n").alias("n")).collect())


def train(docs: DataFrame, recall: float = 0.95, size: int | None = None, epochs: int = 6) -> Network:
    """A network trained on all findings and candidates of docs: parts of `size` rows (PART) are passed over side by side, and averaged after each epoch."""
    net, seen = Network(), saved(labelled(docs), "findings")
    if seen.where("label = 1").isEmpty():
        discard(seen)
        return net  # no threshold is reached: nothing is added
    rows = saved(parts(seen, size or PART), "parts")
    m, v, step = {k: np.zeros_like(a) for k, a in net.w.items()}, {k: np.zeros_like(a) for k, a in net.w.items()}, 0
    total = rows.agg(F.sum("n")).first()[0]
    for epoch in range(epochs):
        net.w, m, v, step = _averaged(rows, net, m, v, step, epoch, total)
    held = np.array([tuple(r) for r in _logits(rows, net)], float).reshape(-1, 4)
    discard(seen, rows)
    return net.calibrate((held[:, 0] + 0.5) / CELLS, held[:, 1], held[:, 2], held[:, 3], recall) if len(held) else net


def spans(text: str, net: Network) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The patterns' findings, and all findings with the network's."""
    base, found = base_spans(text), candidates(text)
    reach = Reach(base)
    more: list[tuple[int, int, int]] = []
    if net.threshold < float("inf"):
        for i in range(0, len(found), 512):
            part = found[i : i + 512]
            read = [windows(text, *c) for c in part]
            p = net.probability(np.array([np.frombuffer(w, np.uint8) for own in read for w in own]))
            most = np.maximum.reduceat(p, np.cumsum([0, *map(len, read)])[:-1])
            more += [(s, 3, e) for (s, e), q in zip(part, most, strict=True) if q >= net.threshold and not reach.covers(s, e)]
    return base, sorted(base + more)


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def find(docs: DataFrame, net: Network) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def work(ids: list, text: list[str]) -> dict:
        both = [spans(t, shared.value) for t in text]
        counts = [[sum(k == kind for _, k, _ in base) for base, _ in both] for kind in range(3)]
        return {
            "doc_id": ids, "n_assign": counts[0], "n_access": counts[1], "n_hex": counts[2],
            "base_sha256": [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in both], "spans": [written(found) for _, found in both],
        }

    return map_texts(texts(docs), work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(docs: DataFrame, net: Network, mark: str = "[SECRET]") -> DataFrame:
    """docs, all columns, with every finding in their texts replaced by mark; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(at).to_pylist():
                if t is not None:
                    parts, end = [], 0
                    for s, _, e in spans(t, shared.value)[1]:
                        if s >= end:
                            parts += [t[end:s], mark]
                        end = max(end, e)
                    t = "".join([*parts, t[end:]]) if parts else t
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == at else c for k, c in enumerate(b.columns)], names=b.schema.names)

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(lean(run), T.StructType([T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType) for f in docs.schema]))


def op9_secret_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, train(docs))
