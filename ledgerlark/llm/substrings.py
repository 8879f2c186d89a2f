"""Exact repeats of word sequences across and within documents, by fixed-block anchors (op 6).

A window of 2b words holds a whole aligned block of b words wherever it starts.  So:

1. Every document's non-overlapping blocks of b words are the index, and all its rolling windows of b
   words are the probes.  A window value met twice, at least once as a block, is an anchor.
2. Around anchors, hits are extended: the full windows that hold an anchor are compared exactly (by wider
   hashes), and each that also starts earlier is a repeat.  Overlapping repeats join to maximal ones.
3. The words that repeats cover go.

Probes travel packed, a row for each slice of texts and bucket of hashes; what a slice holds twice is
settled in the slice, so a passage in a third of all documents costs a bucket one entry for each slice.
Texts are shuffled only where repeats touch them.

Null text: no words.  A null doc_id takes no part and keeps its text.  Rows that repeat a doc_id count as
one document, so they do not remove each other.  Of equal places the smaller doc_id, then the earlier start, stays.  Texts are
read whole, whatever their length; an empty table gives no rows; other columns are ignored by digests() and kept by trimmed().
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, chunks, encoded, fresh, lean, rolling, saved, spans_hash, table, texts, touched, word_spans

#: Characters of a slice; buckets of hashes, one in memory at a time, for each shuffle partition.
SLICE = 2 << 20
BUCKETS = 4
#: Places that a task gathers before it sends them.
REPLIES = 1 << 19
PACKED = "target int, ids binary, counts binary, at binary, hash binary, flag binary"
_NAMES = ["target", "ids", "counts", "at", "hash", "flag"]


# --- packed entries -----------------------------------------------------------------------------


def _planes(x: np.ndarray) -> bytes:
    """The bytes of equal place together: those that hardly change compress to nothing."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplanes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack(target: np.ndarray, doc: np.ndarray, at: np.ndarray, hash: np.ndarray, flag: np.ndarray) -> pa.RecordBatch:
    """A row for each target; entries in order of document and place."""
    order = np.argsort(target, kind="stable")
    target, doc, at, hash, flag = (x[order] for x in (target, doc, at, hash, flag))
    edge = np.flatnonzero(np.r_[True, np.diff(target) != 0, True]) if len(target) else np.zeros(1, int)
    rows: list[tuple] = []
    for s, e in zip(edge[:-1], edge[1:], strict=True):
        d = doc[s:e]
        new = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        place = at[s:e].astype("<u4")
        rows.append((int(target[s]), _planes(np.diff(d[new], prepend=0)), _planes(np.diff(np.r_[new, e - s]).astype("<u4")), _planes(np.diff(place, prepend=np.uint32(0))), hash[s:e].tobytes(), np.packbits(flag[s:e]).tobytes()))
    return _rows(rows)


def unpack(row: tuple, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    doc = np.repeat(np.cumsum(_unplanes(row[1], "<i8")), _unplanes(row[2], "<u4"))
    at = np.cumsum(_unplanes(row[3], "<u4"), dtype=np.uint32).astype(np.int64)
    return doc, at, np.frombuffer(row[4], kind), np.unpackbits(np.frombuffer(row[5], np.uint8), count=len(at)).astype(bool)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    key, rows = None, []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if r[0] != key:
                if rows:
                    yield key, rows
                key, rows = r[0], []
            rows.append(r)
    if rows:
        yield key, rows


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if k == 0 else pa.binary()) for k in range(6)], names=_NAMES)


def _by_target(df: DataFrame) -> DataFrame:
    return df.repartition("target").sortWithinPartitions("target")


def _spread(doc: np.ndarray, parts: int) -> np.ndarray:
    return ((doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts


def _replies(found: Iterator[tuple[np.ndarray, np.ndarray] | pa.RecordBatch], groups: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Places found, gathered over a task's buckets, as a row for each group of documents; rows settled
    before pass through."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def packed() -> pa.RecordBatch:
        doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
        by = np.lexsort((at, doc))
        held.clear()
        return pack(-1 - _spread(doc[by], groups), doc[by], at[by], np.zeros(len(by), kind), np.zeros(len(by), bool))

    for x in found:
        if isinstance(x, pa.RecordBatch):
            yield x
        else:
            held.append(x)
            if sum(len(d) for d, _ in held) > REPLIES:
                yield packed()
    if held:
        yield packed()


def _none(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(n, "<u4"), np.zeros(n, bool)


# --- 1: blocks and probes -----------------------------------------------------------------------


def _word_hashes(text: str, seed: int = 1) -> np.ndarray:
    data = encoded(text)
    return spans_hash(data, *word_spans(data), seed)


def anchors(docs: DataFrame, block: int, window: int, parts: int, groups: int) -> DataFrame:
    """Packed (document, place) of all windows of block words met twice, once at least as a block."""

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, text in chunks([c.to_pylist() for c in b.columns], 1, SLICE):
                got = []
                for i, t in zip(ids, text, strict=True):
                    w = _word_hashes(t)
                    if len(w) >= window:
                        got.append((i, rolling(w, block)))
                if not got:
                    continue
                n = np.array([len(h) for _, h in got])
                doc, hash = np.repeat(np.array([i for i, _ in got], np.int64), n), np.concatenate([h for _, h in got])
                at = np.concatenate([np.arange(k) for k in n])
                by = np.argsort(hash, kind="stable")
                new = np.r_[True, hash[by][1:] != hash[by][:-1]]
                count = np.diff(np.r_[np.flatnonzero(new), len(by)])
                aligned = np.logical_or.reduceat(at[by] % block == 0, np.flatnonzero(new))
                first = by[new]
                keep = np.argsort(first)
                first, aligned, count = first[keep], aligned[keep], count[keep]
                # target < 0: settled here, for the documents; else a bucket of hashes; twice here: no reply is needed
                twice = np.zeros(len(hash), bool)
                twice[by] = np.repeat(np.diff(np.r_[np.flatnonzero(new), len(by)]) > 1, np.diff(np.r_[np.flatnonzero(new), len(by)]))
                yield pack(-1 - _spread(doc[twice], groups), doc[twice], at[twice], *_none(int(twice.sum())))
                h = hash[first]
                yield pack(((h >> np.uint64(40)) % np.uint64(parts)).astype(np.int64), doc[first], at[first], h.astype("<u4"), aligned)

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray] | pa.RecordBatch]:
        for target, rows in _groups(batches):
            if target < 0:
                yield _rows(rows)
                continue
            doc, at, hash, block_ = (np.concatenate(x) for x in zip(*(unpack(r, "<u4") for r in rows), strict=True))
            by = np.argsort(hash, kind="stable")
            edge = np.flatnonzero(np.r_[True, hash[by][1:] != hash[by][:-1]])
            n = np.diff(np.r_[edge, len(by)])
            hit = np.repeat((n > 1) & np.logical_or.reduceat(block_[by], edge), n)
            own = by[hit]
            yield doc[own], at[own]

    sent = texts(docs).where("doc_id is not null").mapInArrow(lean(probes), T.StructType.fromDDL(PACKED))
    return _by_target(sent).mapInArrow(lean(lambda b: _replies(matched(b), groups, "<u4")), T.StructType.fromDDL(PACKED))


def runs(found: DataFrame, name: str) -> DataFrame:
    """Packed places gathered by document: (doc_id, first array, n array), stretches of adjoining places."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):
            doc, at = (np.concatenate(x) for x in zip(*(unpack(r, "<u4")[:2] for r in rows), strict=True))
            by = np.lexsort((at, doc))
            doc, at = doc[by], at[by]
            new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)])
            last = at[np.r_[new[1:] - 1, len(at) - 1]]
            d, start, n = doc[new], at[new], last - at[new] + 1
            edge = np.flatnonzero(np.r_[True, d[1:] != d[:-1], True])
            lists = [pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (start, n)]
            yield pa.RecordBatch.from_arrays([pa.array(d[edge[:-1]]), *lists], names=["doc_id", "first", "n"])

    return saved(_by_target(found).mapInArrow(lean(gathered), T.StructType.fromDDL("doc_id long, first array<int>, n array<int>")), name)


# --- 2: windows that also start earlier ---------------------------------------------------------


def repeats(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, first, n): stretches of starts of windows whose words also start earlier."""
    block = window // 2
    groups = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = BUCKETS * groups
    hits = runs(anchors(docs, block, window, parts, groups), "anchors")
    some = touched(texts(docs).where("doc_id is not null"), hits).join(hits, "doc_id").select("doc_id", "text", "first", "n")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, text, first, n in chunks([c.to_pylist() for c in b.columns], 1, SLICE):
                got = []
                for i, t, fs, ns in zip(ids, text, first, n, strict=True):
                    w = _word_hashes(t)
                    many = len(w) - window + 1
                    if many < 1:
                        continue
                    edge = np.zeros(len(w) + 2, np.int64)
                    for f, k in zip(fs, ns, strict=True):  # the windows that hold one of the anchors f .. f+k-1
                        edge[max(0, f - (window - block))] += 1
                        edge[min(f + k, len(w) + 1)] -= 1
                    at = np.flatnonzero(np.cumsum(edge)[:many] > 0)
                    got.append((np.full(len(at), i), at, rolling(w, window)[at], rolling(_word_hashes(t, 2), window, 2)[at]))
                if not got:
                    continue
                doc, at, hash, deal = (np.concatenate(x) for x in zip(*got, strict=True))
                by = np.lexsort((at, doc, deal, hash))
                new = np.r_[True, (hash[by][1:] != hash[by][:-1]) | (deal[by][1:] != deal[by][:-1])] if len(by) else np.zeros(0, bool)
                lead = by[new][np.cumsum(new) - 1]
                late = by[(doc[lead] != doc[by]) | (at[lead] != at[by])]
                late = late[np.lexsort((at[late], doc[late]))]
                yield pack(-1 - _spread(doc[late], groups), doc[late], at[late], np.zeros(len(late), "<u8"), np.zeros(len(late), bool))
                own = by[new]
                own = own[np.lexsort((at[own], doc[own]))]
                yield pack((deal[own] % np.uint64(parts)).astype(np.int64), doc[own], at[own], hash[own].astype("<u8"), np.zeros(len(own), bool))

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray] | pa.RecordBatch]:
        for target, rows in _groups(batches):
            if target < 0:
                yield _rows(rows)
                continue
            doc, at, hash, _f = (np.concatenate(x) for x in zip(*(unpack(r, "<u8") for r in rows), strict=True))
            by = np.lexsort((at, doc, hash))
            new = np.r_[True, hash[by][1:] != hash[by][:-1]]
            lead = by[new][np.cumsum(new) - 1]
            own = by[(doc[lead] != doc[by]) | (at[lead] != at[by])]
            yield doc[own], at[own]

    sent = some.mapInArrow(lean(windows), T.StructType.fromDDL(PACKED))
    return runs(_by_target(sent).mapInArrow(lean(lambda b: _replies(later(b), groups, "<u8")), T.StructType.fromDDL(PACKED)), "repeats")


# --- 3: removal ---------------------------------------------------------------------------------


def covered(words: int, first: list[int] | None, n: list[int] | None, window: int) -> np.ndarray:
    """Which words the repeats cover."""
    edge = np.zeros(words + 1, np.int64)
    for f, k in zip(first or [], n or [], strict=True):
        edge[min(f, words)] += 1
        edge[min(f + k - 1 + window, words)] -= 1
    return np.cumsum(edge)[:words] > 0


def with_repeats(docs: DataFrame, window: int) -> tuple[DataFrame, str, str]:
    """docs with two columns, and their names: the first places and the lengths of the repeats in each document; only documents
    with repeats are shuffled."""
    first, n = fresh(docs, "__first"), fresh(docs, "__n")
    found = repeats(docs, window).withColumnsRenamed({"first": first, "n": n})
    plain = touched(docs, found, other=True).withColumns({c: F.lit(None).cast("array<int>") for c in (first, n)})
    return plain.unionByName(touched(docs, found).join(found, "doc_id", "left")), first, n


def digests(docs: DataFrame, window: int) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the digest of the words kept, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, t, first, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = WORD.findall(t)
                gone = covered(len(words), first, n, window)
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
                rows.append((i, len(words), int(gone.sum()), hashlib.sha256(" ".join(kept).encode("utf-8", "surrogatepass")).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return with_repeats(texts(docs), window)[0].mapInArrow(lean(run), T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string"))


_PIECE = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def trimmed(docs: DataFrame, window: int) -> DataFrame:
    """docs, all columns, their texts without repeats; other words keep the blanks behind them.

    A text that is a repeat from end to end leaves nothing and its row goes; an empty or null text stays.
    """

    def cut(text, first, n):  # Series to Series
        out = []
        for t, f, k in zip(text, first, n, strict=True):
            if f is not None and t is not None:
                lead = len(t) - len(t.lstrip("\x20\t\n\x0b\x0c\r"))
                words = _PIECE.findall(t)
                gone = covered(len(words), list(f), list(k), window).tolist()
                t = t[:lead] + "".join(w for w, g in zip(words, gone, strict=True) if not g)
                t = None if all(gone) else t
            out.append(t)
        return text.__class__(out, dtype=object)

    marked, first, n = with_repeats(docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string")), window)
    new = F.pandas_udf(cut, T.StringType())(F.col("text"), F.col(first), F.col(n))
    plain = marked.where(F.col(first).isNull())
    changed = marked.where(F.col(first).isNotNull()).withColumn("text", new).where("text is not null")
    return plain.unionByName(changed).select(*docs.columns)


def op6_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), 20)


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(0, len(ws) - 19)) AS pos FROM w WHERE len(ws) >= 20),
k AS (SELECT doc_id, pos, md5(array_to_string(ws[pos + 1 : pos + 20], ' ')) AS h FROM p),
r AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS i FROM k) WHERE i > 1),
g AS (SELECT doc_id, list_sort(list_distinct(flatten(list(range(pos, pos + 20))))) AS gone FROM r GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i - 1)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN g ON g.doc_id = w.doc_id
"""
