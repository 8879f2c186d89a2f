"""Documents with nearly equal sets of word shingles, by T-occurrence search (op 5).

1. A shingle that no other text has cannot be shared, so a document with more such shingles than a link may
   leave unshared has no partner.  The first look sends a share of all shingles, picked by their hash, to
   buckets, which count how many of each document's are alone; most documents end here.
2. The second look sends all shingles of the documents left and learns how rare each is.  A document keeps
   its rarest shingles, as many as a link may leave unshared and one more: linked documents share one of
   them.  Documents that share one are tied, and a connected group of ties is a shard: linked documents are
   always in one shard, and no pair is written out.
3. In a shard, inverted lists answer each document's T-occurrence query: short lists are merged, the long
   ones that DivideSkip sets aside are probed by binary search, documents that reach the overlap are tested
   exactly.  Pairs already connected are skipped.  Large shards are first compared with a pivot for each
   band of sizes; what hangs together by pivots is not compared with itself again, the rest is cut by size
   into bands and tiles, and two tiles that may hold links meet in a task of their own.
4. The links' connected components name the smallest doc_id.

Documents with equal sets form a class, which is searched once.  Null or empty texts and texts without words:
n_shingles 0, linked with nothing.  A null doc_id stays unlinked and has a null component.  Rows that repeat a
doc_id are each compared by their own text and each returned.  Texts are read whole, whatever their length;
an empty table gives no rows; other columns are ignored.  Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FILTER_BITS, chunks, components, discard, encoded, fresh, grouped, lean, lower_ascii, member_filter, planes, rolling, saved, spans_hash, table, texts, touched, unplanes, word_spans

#: Shingles of a tile of a large shard.
TILE = 1_500_000
#: Characters of a slice of texts.
SLICE = 4 << 20
#: DivideSkip's weight of a long list's probe against the merge.
MU = 0.01


def shingles(text: str, words: int) -> np.ndarray:
    """The set of word-shingle hashes, ascending; a shorter text is one shingle."""
    data = lower_ascii(encoded(text))
    h = spans_hash(data, *word_spans(data))
    return np.unique(rolling(h, min(words, len(h)))) if len(h) else h


def set_key(s: np.ndarray) -> int | None:
    return int.from_bytes(hashlib.md5(s.tobytes()).digest()[:8], "little", signed=True) if len(s) else None


def least(n: int, pct: int) -> int:
    """The shared shingles that any partner of a set of n needs."""
    return -(-pct * n // 100)


def spare(n: int, pct: int) -> int:
    """The shingles of a set of n that a partner may lack."""
    return n - least(n, pct)


# --- 1: the first look --------------------------------------------------------------------------

_LOOK = "target int, slice long, each binary, hash binary, place int, doc_id long, n long, key long, sent boolean"
_LOOK_KINDS = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())


def _dealt(hash: np.ndarray, parts: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order by bucket, and (bucket, from, to) in it."""
    target = (hash % np.uint64(parts)).astype(np.int64)
    order = np.argsort(target, kind="stable")
    edge = np.flatnonzero(np.r_[True, np.diff(target[order]) != 0, True]) if len(order) else np.zeros(1, int)
    return order, [(int(target[order[s]]), int(s), int(e)) for s, e in zip(edge[:-1], edge[1:], strict=True)]


def _short(hash: np.ndarray) -> bytes:
    return (hash >> np.uint64(20)).astype("<u4").tobytes()


def first_look(docs: DataFrame, words: int, pct: int, parts: int) -> DataFrame:
    """Rows for documents (target -1: slice, place, doc_id, n, key, sent) and for buckets (each, hash)."""
    most = np.uint64(min(1.0, 3 * (100 - pct) / 100) * float(1 << 63)) * np.uint64(2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32  # type: ignore[union-attr]
        for b in batches:
            for ids, text in chunks([c.to_pylist() for c in b.columns], 1, SLICE):
                seen: set[int] = set()
                rows, some = [], []
                for place, (i, t) in enumerate(zip(ids, text, strict=True)):
                    s = shingles(t, words)
                    key = set_key(s)
                    new = key is not None and i is not None and key not in seen
                    if new:
                        seen.add(key)
                    some.append(s[: np.searchsorted(s, most)] if new else s[:0])
                    rows.append((-1, number, None, None, place, i, len(s), key, new))
                hash, row = np.concatenate(some), np.repeat(np.arange(len(some)), [len(s) for s in some])
                order, deal = _dealt(hash, parts)
                for target, s, e in deal:
                    own = order[s:e]
                    rows.append((target, number, planes(np.bincount(row[own], minlength=len(ids)).astype("<u4")), _short(hash[own]), None, None, None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_LOOK_KINDS)], names=[x.split()[0] for x in _LOOK.split(", ")])
                number += 1

    return texts(docs).mapInArrow(lean(run), T.StructType.fromDDL(_LOOK))


def alone(look: DataFrame) -> DataFrame:
    """(slice, place, alone): how many of the shingles sent no other text has."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches):
            hash = [np.frombuffer(r[3], "<u4") for r in rows]
            _, at, n = np.unique(np.concatenate(hash), return_inverse=True, return_counts=True)
            one, start, out = n[at] == 1, 0, []
            for r, h in zip(rows, hash, strict=True):
                each = unplanes(r[2], "<u4")
                row = np.repeat(np.arange(len(each)), each)
                out.append(planes(np.bincount(row, one[start : start + len(h)], len(each)).astype("<u4")))
                start += len(h)
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array(out, pa.binary())], names=["slice", "n"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (number,), rows in grouped(batches):
            total = sum(unplanes(r[1], "<u4").astype(np.int64) for r in rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), number)), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["slice", "place", "alone"])

    sent = look.where("target >= 0").select("target", "slice", "each", "hash")
    replies = sent.repartition("target").sortWithinPartitions("target").mapInArrow(lean(counted), T.StructType.fromDDL("slice long, n binary"))
    return replies.repartition("slice").sortWithinPartitions("slice").mapInArrow(lean(summed), T.StructType.fromDDL("slice long, place int, alone long"))


# --- 2: the second look -------------------------------------------------------------------------


def whole_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(slice, keys, n, hash): the whole sets of the wanted documents, and of a few others that pass the filter."""
    member = docs.sparkSession.sparkContext.broadcast(member_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, number = member.value, TaskContext.get().partitionId() << 32  # type: ignore[union-attr]
        for b in batches:
            at = b.column("bit").to_numpy()
            b = b.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            for text, _ in chunks([c.to_pylist() for c in b.columns], 0, SLICE):
                sets = {set_key(s): s for s in (shingles(t, words) for t in text) if len(s)}
                if sets:
                    cols = [np.fromiter(sets, "<i8").tobytes(), np.array([len(s) for s in sets.values()], "<u4").tobytes(), np.concatenate(list(sets.values())).astype("<u8").tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([number]), *[pa.array([c], pa.binary()) for c in cols]], names=["slice", "keys", "n", "hash"])
                    number += 1

    marked = texts(docs).where("doc_id is not null").select("text", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("bit"))
    return marked.mapInArrow(lean(run), T.StructType.fromDDL("slice long, keys binary, n binary, hash binary"))


def second_look(sets: DataFrame, pct: int, parts: int) -> DataFrame:
    """(key, n, m, ids, prefix) of the classes left: n shingles, m of which others have too (ids), the rarest of them."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, data in zip(b.column("slice").to_pylist(), b.column("hash").to_pylist(), strict=True):
                hash = np.frombuffer(data, "<u8")
                order, deal = _dealt(hash, parts)
                out = [(target, number, _short(hash[order[s:e]])) for target, s, e in deal]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["target", "slice", "hash"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (target,), rows in grouped(batches):
            hash = [np.frombuffer(r[2], "<u4") for r in rows]
            _, at, n = np.unique(np.concatenate(hash), return_inverse=True, return_counts=True)
            rank = np.split(np.minimum(n, 255).astype(np.uint8)[at], np.cumsum([len(h) for h in hash])[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([target] * len(rows), pa.int32()), pa.array([x.tobytes() for x in rank], pa.binary())], names=["slice", "target", "rank"])

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches):
            keys, n, hash = (np.frombuffer(rows[0][k], kind) for k, kind in ((3, "<i8"), (4, "<u4"), (5, "<u8")))
            rank = np.empty(len(hash), np.uint8)
            rank[_dealt(hash, parts)[0]] = np.frombuffer(b"".join(r[2] for r in rows[1:]), np.uint8)
            out, start = [], 0
            for key, size in zip(keys.tolist(), n.tolist(), strict=True):
                h, r = hash[start : start + size], rank[start : start + size]
                start += size
                multi = r > 1
                m = int(multi.sum())
                if size - m > spare(size, pct):
                    continue
                h, r = h[multi], r[multi]
                first = np.lexsort((h, r))[: spare(size, pct) + 1 - (size - m)]
                out.append((key, size, m, planes(h.astype("<u8")), h[first].view(np.int64)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["key", "n", "m", "ids", "prefix"])

    replies = sets.select("slice", "hash").mapInArrow(lean(send), T.StructType.fromDDL("target int, slice long, hash binary")).repartition("target").sortWithinPartitions("target").mapInArrow(lean(rare), T.StructType.fromDDL("slice long, target int, rank binary"))
    no = F.lit(None).cast("binary")
    both = sets.select("slice", F.lit(-1).alias("target"), no.alias("rank"), "keys", "n", "hash").union(replies.select("slice", "target", "rank", no, no, no))
    return both.repartition("slice").sortWithinPartitions("slice", "target").mapInArrow(lean(picked), T.StructType.fromDDL("key long, n long, m long, ids binary, prefix array<long>"))


def shards(members: DataFrame) -> DataFrame:
    """(key, shard): members that may have a partner, by connected ties."""
    postings = members.select("key", F.explode("prefix").alias("s"))
    lists = postings.groupBy("s").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first <> last").select("s", "first")
    return components(postings.join(lists, "s").select(F.col("key").alias("a"), F.col("first").alias("b"))).withColumnsRenamed({"node": "key", "component": "shard"})


# --- 3: the search ------------------------------------------------------------------------------


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers of the ranges start .. start+n-1, one after another."""
    return np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))


def search(sets: list[np.ndarray], n: np.ndarray, tile: np.ndarray, group: np.ndarray, pct: int) -> Iterator[tuple[int, int]]:
    """Links that connect the sets as all links would.

    sets: the shingles that may be shared, of n in all; tile: two sets of one tile are not compared, unless all
    are of one; group: sets of one group (not -1) are connected already."""
    order = np.argsort(n, kind="stable")
    size, tile, count = n[order], tile[order], len(order)
    one = bool((tile == tile[0]).all())
    own_size = np.array([len(sets[i]) for i in order], np.int64)
    flat, rec = np.concatenate([sets[i] for i in order]), np.repeat(np.arange(count), own_size)
    by = np.argsort(flat, kind="stable")
    edge = np.flatnonzero(np.r_[True, np.diff(flat[by]) != 0, True])
    df = np.diff(edge)
    shingle = np.empty(len(flat), np.int64)
    shingle[by] = np.repeat(np.arange(len(df)), df)
    lists, posting = rec[by], np.repeat(np.arange(len(df)), df) * count + rec[by]
    root, first = np.arange(count), np.r_[0, np.cumsum(own_size)]
    _, lead, at = np.unique(group[order], return_index=True, return_inverse=True)
    root = np.where(group[order] == -1, root, lead[at])
    for x in range(1, count):
        own = shingle[first[x] : first[x + 1]]
        own = own[df[own] > 1]
        need = least(int(size[x]), pct)
        if len(own) < need:
            continue
        own = own[np.argsort(df[own], kind="stable")]
        longest = int(df[own[-1]])
        skip = min(need - 1, int(need / (MU * np.log2(max(longest, 2)) + 1)))
        short, long = own[: len(own) - skip], own[len(own) - skip :]
        met = np.sort(lists[ranges(edge[short], df[short])], kind="stable")  # the merge of the short lists
        met = met[np.searchsorted(met, np.searchsorted(size, least(int(size[x]), pct))) : np.searchsorted(met, x)]
        if not len(met):
            continue
        at = np.flatnonzero(np.r_[True, met[1:] != met[:-1]])
        y, hits = met[at], np.diff(np.r_[at, len(met)])
        keep = (hits >= need - skip) & (root[y] != root[x])
        if not one:
            keep &= tile[y] != tile[x]
        y, hits = y[keep], hits[keep]
        for s in range(0, len(y), 256):
            part = y[s : s + 256]
            probe = (long[:, None] * count + part[None, :]).ravel()
            found = np.searchsorted(posting, probe)
            both = hits[s : s + 256] + (posting[np.minimum(found, len(posting) - 1)] == probe).reshape(len(long), len(part)).sum(0)
            for z in part[100 * both >= pct * (size[x] + size[part] - both)]:
                if root[z] != root[x]:
                    root[root == root[z]] = root[x]
                    yield int(order[x]), int(order[z])


def pivoted(large: DataFrame, members: DataFrame, pct: int) -> DataFrame:
    """(key, group): the rows of large shards (shard, band, key, tiles) that links to pivots connect.

    The class with the smallest key is the pivot of its shard and band; every class is compared with the pivots of
    its own and the adjoining bands, in tiles to which these pivots are sent."""
    pivots = large.groupBy("shard", "band").agg(F.min("key").alias("key")).join(members.select("key", "n", "ids"), "key")
    places = large.select("shard", "band", "tiles").distinct()
    near = pivots.withColumn("band", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)]))).join(places, ["shard", "band"])
    asked = near.select("shard", "band", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("t"), F.lit(0).alias("row"), "key", "n", "ids")
    rows = large.join(members.select("key", "n", "ids"), "key").select("shard", "band", F.pmod(F.xxhash64("key", F.lit(7)), F.col("tiles")).cast("int").alias("t"), F.lit(1).alias("row"), "key", "n", "ids")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, key = [], None
        for b in batches:
            out = []
            for *at, row, own, n, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != key:
                    pivots, key = [], at
                s = unplanes(ids, "<u8")
                if row == 0:
                    pivots.append((own, n, s))
                    continue
                for other, size, p in pivots:
                    both = int((p[np.minimum(np.searchsorted(p, s), len(p) - 1)] == s).sum()) if len(p) else 0
                    if other != own and 100 * both >= pct * (n + size - both):
                        out.append((own, other))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    by = ("shard", "band", "t")
    found = rows.union(asked).repartition(*by).sortWithinPartitions(*by, "row").mapInArrow(lean(compared), T.StructType.fromDDL("a long, b long"))
    return components(found).withColumnsRenamed({"node": "key", "component": "group"})


def meetings(members: DataFrame, shard: DataFrame, pct: int) -> tuple[DataFrame, DataFrame | None]:
    """(key, shard, tile, group, i, j): where the classes of a shard meet; (key, group): what pivots connect already.

    A small shard is one task.  A large one is cut by size into bands, so wide that linked sets are in the same or
    adjoining ones.  The classes that pivots connect to its largest group are its core, which is not compared with
    itself; tiles of the core and of the rest that may hold links meet in a task of their own."""
    width = float(np.log(100 / pct) * (1 + 1e-9)) if pct < 100 else 1.0
    cand = saved(shard.join(members.select("key", "n", "m"), "key"), "cand")
    whole = cand.groupBy("shard").agg(F.sum("m").alias("weight"), F.count("*").alias("c")).where("c > 1").drop("c")
    rows = cand.join(whole, "shard")
    none = F.lit(-1).cast("long")
    small = rows.where(F.col("weight") <= TILE).select("key", "shard", F.lit(0).cast("long").alias("tile"), none.alias("group"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
    large = rows.where(F.col("weight") > TILE).withColumn("band", F.floor(F.log("n") / F.lit(width)).cast("int"))
    if not large.take(1):
        return small, None
    sizes = large.groupBy("shard", "band").agg(F.ceil(F.sum("m") / TILE).cast("int").alias("tiles"))
    group = pivoted(large.join(sizes, ["shard", "band"]).select("shard", "band", "key", "tiles"), members, pct)
    large = saved(large.join(group, "key", "left"), "large")
    core = large.where("group is not null").groupBy("shard", "group").agg(F.sum("m").alias("w")).groupBy("shard").agg(F.max_by("group", F.struct("w", "group")).alias("core"))
    large = saved(large.join(core, "shard", "left").select("shard", "band", "key", "m", F.coalesce("group", none).alias("group"), F.coalesce(F.col("group") == F.col("core"), F.lit(False)).alias("inner")), "tiles")
    tiles = saved(large.groupBy("shard", "band", "inner").agg(F.ceil(F.sum("m") / TILE).cast("int").alias("tiles")), "bands")
    number = lambda band, inner, t: (F.shiftleft(band.cast("long"), 41) + F.shiftleft(inner.cast("long"), 40) + t)
    own = large.join(tiles, ["shard", "band", "inner"]).select("shard", "band", "inner", "key", "group", number(F.col("band"), F.col("inner"), F.pmod(F.xxhash64("key", F.lit(7)), F.col("tiles"))).alias("tile"))
    others = tiles.select("shard", F.col("band").alias("other"), F.col("inner").alias("with"), "tiles")
    near = own.withColumn("other", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)]))).join(others, ["shard", "other"]).where("not (inner and with)")
    meet = near.select("key", "shard", "tile", "group", F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: number(F.col("other"), F.col("with"), t))).alias("o"))
    return small.union(meet.select("key", "shard", "tile", "group", F.least("tile", "o"), F.greatest("tile", "o"))), group


def links(rows: DataFrame, pct: int) -> DataFrame:
    """rows: shard, i, j, tile, group, key, n, ids.  Returns (a, b): links that connect each shard's classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in grouped(batches, 3):
            if len(own) < 2:
                continue
            tile, group, n = (np.array([r[k] for r in own], np.int64) for k in (3, 4, 6))
            got = [(own[x][5], own[y][5]) for x, y in search([unplanes(r[7], "<u8") for r in own], n, tile, group, pct)]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in (0, 1)], names=["a", "b"])

    by = ("shard", "i", "j")
    return rows.repartition(*by).sortWithinPartitions(*by, "key").mapInArrow(lean(run), T.StructType.fromDDL("a long, b long"))


def classed(docs: DataFrame, words: int, pct: int) -> DataFrame:
    """Per row: doc_id, n, key of the set, component_id; linked: 100 * shared shingles >= pct * all shingles of both."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    look = saved(first_look(docs, words, pct, parts), "look")
    own = look.where("target = -1").select("slice", "place", "doc_id", "n", "key", "sent")
    left = own.where("sent").join(alone(look), ["slice", "place"]).where(F.expr(f"alone <= n * {100 - pct} div 100")).select("key").distinct()
    classes = saved(own.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id")), "classes")
    own = saved(own.select("doc_id", "n", "key"), "rows")
    sets = saved(whole_sets(docs, left.join(classes, "key").select("doc_id"), words), "sets")
    discard(look)
    members = saved(second_look(sets, pct, parts).dropDuplicates(["key"]), "members")
    discard(sets)
    spread, by_pivot = meetings(members, shards(members), pct)
    found = links(members.join(spread, "key").select("shard", "i", "j", "tile", "group", "key", "n", "ids"), pct)
    linked = components(found if by_pivot is None else found.union(by_pivot.select(F.col("key").alias("a"), F.col("group").alias("b"))))
    low = linked.join(classes.withColumnRenamed("key", "node"), "node")
    least_id = low.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = saved(classes.join(low.join(least_id, "component").select(F.col("node").alias("key"), "component_id"), "key", "left").select("key", F.coalesce("component_id", "doc_id").alias("component_id")), "named")
    discard(members)
    return own.join(named, "key", "left").select("doc_id", "n", "key", F.expr("if(doc_id is null, null, coalesce(component_id, doc_id))").alias("component_id"))


def similar(docs: DataFrame, words: int, pct: int) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    return classed(docs, words, pct).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def distinct(docs: DataFrame, words: int, pct: int) -> DataFrame:
    """docs, all columns, with one document of each group: the smallest doc_id's.  Of rows with equal doc_id and equal
    sets one stays; rows with equal doc_id and other texts are judged each by itself.  Null ids and texts without
    words stay.  Only documents in groups are shuffled."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    marks = classed(docs, words, pct).where("doc_id is not null and key is not null").groupBy("doc_id", "key").agg(F.count("*").alias("m"), F.max(F.col("doc_id") != F.col("component_id")).alias("gone"))
    some = saved(marks.where("gone or m > 1"), "groups")
    at, key, gone = docs.columns.index("text"), fresh(docs, "__key"), fresh(docs, "__gone")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [set_key(shingles(t or "", words)) for t in b.column(at).cast(pa.string()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int64())], names=[*b.schema.names, key])

    met = touched(docs, some).mapInArrow(lean(keyed), T.StructType([*docs.schema.fields, T.StructField(key, T.LongType())]))
    marked = met.join(some.select("doc_id", F.col("key").alias(key), F.col("gone").alias(gone)), ["doc_id", key], "left")
    plain = marked.where(F.col(gone).isNull())
    firsts = marked.where(~F.col(gone)).dropDuplicates(["doc_id", key])
    return touched(docs, some, other=True).union(plain.select(*docs.columns)).union(firsts.select(*docs.columns))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"), words=3, pct=90)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS g FROM w
), n AS (SELECT doc_id, len(g) AS n FROM s), u AS (SELECT doc_id, unnest(g) AS g FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, least(n.doc_id, coalesce(min(reach.b), n.doc_id)) AS component_id
FROM n LEFT JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n.n
"""
