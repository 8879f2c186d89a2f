"""A quality classifier: Naive Bayes support vectors (op 2).

Indicators of hashed n-grams (words, pairs of words, four characters, and marks of repetition) are scaled
by the logarithm of their classes' count ratio; a linear hinge-loss model over them is fitted by dual
coordinate descent.  The counts cover every labelled training row and are made by Spark over a fixed number
of hash slots; the descent sees a documented, bounded sample of them (SAMPLE rows of each label, by hash).
A held-back part of the sample turns margins into probabilities; its rows weigh as many labelled rows as
they stand for, so that scores keep the labels' shares among all training rows when a label is sampled.

Null or empty text: no indicators, the score of the model's intercept.  Labels that are null or neither 0
nor 1 teach nothing; a document labelled twice teaches once for each different label.  Texts are read whole, whatever their
length; equal texts have equal scores; rows that repeat a doc_id each count and are each scored; a null doc_id teaches nothing,
is not held out and is scored.  An empty table gives no rows; tables without labels give every text the same score.
Other columns are ignored by scored() and kept by accepted().
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import encoded, lean, map_texts, mix, saved, spans_hash, table, texts, touched, word_spans

SLOTS = 1 << 18
#: Counts that are added up in one task.
PIECE = 1 << 15
#: Rows of each label, at most, that the descent sees.
SAMPLE = 3000
#: A calibrated score of this or more is of good quality.
GOOD = 0.7


def features(text: str) -> np.ndarray:
    """The slots of the text's n-grams, ascending, each once."""
    data = encoded(text)
    starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros(0, np.int32)
    w = spans_hash(data, starts, ends)
    pairs = mix(w[:-1] * np.uint64(31) + w[1:])
    d = data.astype(np.uint32)
    grams = d[:-3] | d[1:-2] << 8 | d[2:-1] << 16 | d[3:] << 24 if len(d) > 3 else np.zeros(0, np.uint32)
    same = np.flatnonzero(np.r_[False, w[1:] == w[:-1]])
    marks = [np.uint64(7)] * bool(len(same)) + [np.uint64(8)] * bool(10 * len(same) > len(w)) + [np.uint64(9 + i) for i, k in enumerate((2, 4, 8)) if len(np.unique(w)) * k < len(w)]
    all_ = np.concatenate([w, pairs, mix(grams.astype(np.uint64) + np.uint64(1 << 40)), mix(np.array(marks, np.uint64))])
    slot = (all_ >> np.uint64(20)).astype(np.int64) % SLOTS
    if len(slot) < 1_500:
        return np.unique(slot).astype(np.int32)
    hit = np.zeros(SLOTS, bool)
    hit[slot] = True
    return np.flatnonzero(hit).astype(np.int32)


def fold(doc_id, n: int) -> int:
    """The remainder of the checksum of an id's digits; -1 for a null id."""
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def scaled(rows: list[np.ndarray], scale: np.ndarray) -> list[np.ndarray]:
    """The indicators times scale, rows of unit length."""
    out = [scale[x].astype(np.float32) for x in rows]
    return [v / np.float32(max(1e-9, np.sqrt(np.sum(np.square(v, dtype=float))))) for v in out]


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, slots: int, cost: float = 1.0, passes: int = 12, seed: int = 1) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss over scaled indicators; weights and intercept."""
    r = np.random.default_rng(seed)
    w, bias, alpha = np.zeros(slots), 0.0, np.zeros(len(rows))
    norm = np.array([np.sum(np.square(v, dtype=float)) for v in values]) + 1.0
    most = cost * np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum()))
    for _ in range(passes):
        for i in r.permutation(len(rows)):
            gap = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gap / norm[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return w, bias


class Model:
    """Weights of slots (already scaled) and the calibration of margins; taught: whether any row taught it."""

    def __init__(self, scale: np.ndarray, weight: np.ndarray, bias: float, slope: float, shift: float, taught: bool = True):
        self.taught = taught
        self.scale, self.weight, self.bias, self.slope, self.shift = scale.astype(np.float32), (scale * weight).astype(np.float32), bias, slope, shift

    def margin(self, slots: np.ndarray) -> float:
        if not len(slots):
            return self.bias
        return float(self.weight[slots].sum(dtype=float)) / max(1e-9, float(np.sqrt(np.sum(np.square(self.scale[slots], dtype=float))))) + self.bias

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features(text)) + self.shift, -40, 40))))


def calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins and 0/1 labels, by Newton's method with smoothed targets."""
    w = np.ones(len(z)) if weight is None else weight
    t = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y <= 0).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        g = np.array([np.sum(w * (p - t) * z) + 1e-3 * (a - 1), np.sum(w * (p - t))])
        s = w * p * (1 - p) + 1e-9
        h = np.array([[np.sum(s * z * z) + 1e-3, np.sum(s * z)], [np.sum(s * z), np.sum(s)]])
        step = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        step *= min(1.0, 3 / max(1e-9, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
    return max(a, 0.1), b


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["y", "h", "n", "data"])


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, sample: int = SAMPLE) -> Model:
    """Learn from the labelled rows outside the held-out fold."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    known = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where(crc % folds != held_out).distinct()

    known = known.withColumn("h", F.xxhash64("doc_id"))
    cut = [known.where(F.col("y") == k).select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0] for k in (0, 1)]
    known = known.withColumn("take", F.coalesce(*[F.when(F.col("y") == k, F.col("h") <= F.lit(c)) for k, c in enumerate(cut) if c is not None], F.lit(False))).drop("h")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of the sample, and per task the counts of slots by label, behind them that of rows."""
        count, any_ = np.zeros((2, SLOTS + 1), np.uint32), False
        for b in batches:
            out = []
            for i, t, y, take in zip(*(c.to_pylist() for c in b.columns), strict=True):
                slots = features(t)
                count[y, slots] += 1
                count[y, SLOTS] += 1
                any_ = True
                if take:
                    out.append((y, 0, i, slots.tobytes()))
            yield _rows(out)
        if any_:
            flat = count.ravel()
            yield _rows([(k // PIECE, -1, 0, flat[k : k + PIECE].tobytes()) for k in range(0, len(flat), PIECE)])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tasks' counts of each piece of the slots, added up as they come."""
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for piece, data in zip(b.column("piece").to_pylist(), b.column("data"), strict=True):
                total[piece] = total.get(piece, 0) + np.frombuffer(data.as_buffer(), np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], names=["piece", "data"])

    kind = T.StructType.fromDDL("y int, h long, n long, data binary")
    # labels grow with the corpus, so they are never broadcast
    got = saved(touched(texts(docs).where("doc_id is not null"), known).join(known.hint("merge"), "doc_id").select("doc_id", "text", "y", "take").mapInArrow(lean(counted), kind), "taught")
    counts = np.zeros(2 * (SLOTS + 1), np.int64)
    for r in got.where("h = -1").select(F.col("y").alias("piece"), "data").repartition("piece").mapInArrow(lean(summed), T.StructType.fromDDL("piece int, data binary")).toLocalIterator():
        counts[r.piece * PIECE : r.piece * PIECE + len(r.data) // 8] = np.frombuffer(r.data, np.int64)
    counts, rows = np.split(counts.reshape(2, SLOTS + 1), [SLOTS], 1)
    picked = sorted(((r.y, r.n, np.frombuffer(r.data, np.int32)) for r in got.where("h = 0").select("y", "n", "data").toLocalIterator()), key=lambda r: r[:2])  # SAMPLE rows of each label at most
    p, q = counts[1] + 1, counts[0] + 1
    scale = np.log((p / p.sum()) / (q / q.sum()))
    scale[counts.sum(0) == 0] = 0.0
    slots, y = [r[2] for r in picked], np.array([1.0 if r[0] else -1.0 for r in picked])
    if len(set(y.tolist())) < 2:
        share = float(np.clip(y.mean() / 2 + 0.5, 0.01, 0.99)) if len(y) else 0.5
        return Model(np.zeros(SLOTS), np.zeros(SLOTS), 0.0, 1.0, float(np.log(share / (1 - share))), bool(len(y)))
    stands = rows[:, 0] / np.maximum(1, [np.sum(y < 0), np.sum(y > 0)])  # labelled rows for each of the sample, by label
    stands = stands * len(y) / rows.sum()
    third = np.arange(len(y)) % 3 == 0
    values = scaled(slots, scale)
    w, bias = descend([s for s, h in zip(slots, third, strict=True) if not h], [v for v, h in zip(values, third, strict=True) if not h], y[~third], SLOTS)
    part = Model(scale, w, bias, 1.0, 0.0)
    slope, shift = calibrate(np.array([part.margin(s) for s, h in zip(slots, third, strict=True) if h]), y[third], stands[(y[third] > 0).astype(int)])
    return Model(scale, *descend(slots, values, y, SLOTS), slope, shift)


def scored(docs: DataFrame, model: Model, folds: int = 4, held_out: int = 2) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(ids: list, text: list[str]) -> dict:
        score = [shared.value.score(t) for t in text]
        return {"doc_id": ids, "held_out": [fold(i, folds) == held_out for i in ids], "score": score, "predicted": [int(s >= GOOD) for s in score]}

    return map_texts(texts(docs), work, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """docs, all columns, without those of low quality; all of them if nothing was taught."""
    if not model.taught:
        return docs.withColumn("text", F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([shared.value.score(t or "") >= GOOD for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(lean(run), T.StructType([T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType) for f in docs.schema]))


def op2_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
