"""Error detection, question answering, efficiency and resampling statistics over grouped rows.

Undefined stays null where the measure has no meaning (one class absent) and is 0.0 for empty denominators
of rates.  Everything ranks and sums over distinct scores first, so a window sees at most a row for each
distinct score.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .selection import percentiles, running


def _by_score(rows: DataFrame) -> DataFrame:
    """rows (score, label 1 = error): positives and negatives of each distinct score."""
    return rows.where("score is not null").groupBy("score").agg(F.sum("label").cast("long").alias("p"), F.sum(1 - F.col("label")).cast("long").alias("n"))


def _running(rows: DataFrame, order: str, desc: bool, **sums: str) -> DataFrame:
    """rows with running sums (name=column) in the order of a column, each row included: sums within range-sorted parts,
    and of the parts before; no task sees all rows."""
    key = F.col(order).desc() if desc else F.col(order).asc()
    # kept, so that both uses see the same parts: the bounds of two range sorts are two samples
    r = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).withColumn("part", F.spark_partition_id()).persist()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    parts = r.groupBy("part").agg(*[F.sum(c).alias(f"{n}_0") for n, c in sums.items()]).select("part", *[F.coalesce(F.sum(f"{n}_0").over(before), F.lit(0)).alias(f"{n}_0") for n in sums])
    own = Window.partitionBy("part").orderBy(key)
    r = r.withColumns({n: F.sum(c).over(own) for n, c in sums.items()}).join(F.broadcast(parts), "part")
    return r.select(*rows.columns, *[(F.col(n) + F.col(f"{n}_0")).alias(n) for n in sums])


def auroc(rows: DataFrame) -> DataFrame:
    """Mann-Whitney with ties counted half; null if a class is absent."""
    g = _running(_by_score(rows), "score", False, upto="n")
    return g.agg(F.try_divide(F.sum(F.col("p") * (F.col("upto") - F.col("n") / 2)), (F.sum("p") * F.sum("n")).cast("double")).alias("auroc"))


def average_precision(rows: DataFrame) -> DataFrame:
    """Steps at distinct scores from the highest down, no interpolation; null without errors."""
    g = _running(_by_score(rows).withColumn("m", F.col("p") + F.col("n")), "score", True, tp="p", all="m")
    return g.agg(F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("all")), F.sum("p").cast("double")).alias("average_precision"))


def ranked_by(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (by, score, label) of many groups at once: n, errors, AUROC, average precision of each; null as for one group."""
    g = rows.where("score is not null").groupBy(*by, "score").agg(F.sum("label").cast("long").alias("p"), F.sum(1 - F.col("label")).cast("long").alias("n"))
    up = running(g, by, ["score"], F.col("n"), "upto")
    roc = up.groupBy(*by).agg(F.sum(F.col("p") + F.col("n")).alias("cases"), F.sum("p").alias("errors"), F.try_divide(F.sum(F.col("p") * (F.col("upto") - F.col("n") / 2)), (F.sum("p") * F.sum("n")).cast("double")).alias("auroc"))
    down = running(running(g.withColumn("down", -F.col("score")), by, ["down"], F.col("p"), "tp"), by, ["down"], F.col("p") + F.col("n"), "all")
    ap = down.groupBy(*by).agg(F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("all")), F.sum("p").cast("double")).alias("average_precision"))
    return roc.withColumnRenamed("cases", "n").join(ap, by)


def thresholds_by(rows: DataFrame, by: list[str]) -> DataFrame:
    """select_threshold() of each group: by, threshold and its counts and rates."""
    own = rows.where("score is not null").select(*by, F.col("score").cast("double").alias("score"), "label")
    extra = own.select(*by).distinct().select(*by, F.explode(F.array(F.lit(0.0), F.lit(1.0 + 1e-9))).alias("score"))
    counted = own.groupBy(*by, "score").agg(F.sum("label").cast("long").alias("p"), F.sum(1 - F.col("label")).cast("long").alias("n"))
    zero = F.lit(0).cast("long")
    g = counted.unionByName(extra.select(*by, "score", zero.alias("p"), zero.alias("n"))).groupBy(*by, "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).withColumn("down", -F.col("score"))
    g = running(running(g, by, ["down"], F.col("p"), "tp"), by, ["down"], F.col("n"), "fp")
    whole = g.groupBy(*by).agg(F.sum("p").alias("ps"), F.sum("n").alias("ns"))
    r = rates(g.join(whole, by).withColumn("fn", F.col("ps") - F.col("tp")).withColumn("tn", F.col("ns") - F.col("fp")))
    kept = ["score", "tp", "fp", "tn", "fn", "precision", "recall", "f1"]
    best = r.groupBy(*by).agg(F.min(F.struct((-F.col("f1")).alias("a"), (-F.col("recall")).alias("b"), *kept)).alias("best"))
    return best.select(*by, *[F.col(f"best.{c}").alias("threshold" if c == "score" else c) for c in kept])


def contingency(rows: DataFrame, *by: str) -> DataFrame:
    """rows (agreed, correct): how many of each, where agreement is known."""
    a, c = F.col("agreed"), F.col("correct")
    return rows.where(a.isNotNull()).groupBy(*by).agg(F.count_if(a & c).alias("agree_correct"), F.count_if(a & ~c).alias("agree_wrong"), F.count_if(~a & c).alias("disagree_correct"), F.count_if(~a & ~c).alias("disagree_wrong"))


def at_threshold(rows: DataFrame, threshold: Column) -> list[Column]:
    flag = F.col("score") >= threshold
    y = F.col("label") == 1
    return [F.count_if(flag & y).alias("tp"), F.count_if(flag & ~y).alias("fp"), F.count_if(~flag & ~y).alias("tn"), F.count_if(~flag & y).alias("fn")]


def rates(counted: DataFrame) -> DataFrame:
    """Precision, recall, F1 and false rates from tp, fp, tn, fn; 0.0 on empty denominators."""
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    c = {k: F.col(k) for k in ("tp", "fp", "tn", "fn")}
    return counted.withColumns({
        "precision": share(c["tp"], c["tp"] + c["fp"]), "recall": share(c["tp"], c["tp"] + c["fn"]), "f1": share(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"]),
        "fpr": share(c["fp"], c["fp"] + c["tn"]), "fnr": share(c["fn"], c["fn"] + c["tp"]),
    })


def select_threshold(rows: DataFrame, min_recall: float | None = None) -> DataFrame:
    """The threshold among the scores, 0 and just over 1 with the best F1, then recall; with a recall
    floor the best precision, then recall; the smallest of equals."""
    extra = rows.sparkSession.createDataFrame([(0.0,), (1.0 + 1e-9,)], "score double")
    cuts = rows.where("score is not null").select(F.col("score").cast("double").alias("score")).union(extra).distinct()
    g = cuts.join(_by_score(rows).withColumn("score", F.col("score").cast("double")), "score", "left").fillna(0, ["p", "n"])
    whole = g.agg(F.sum("p").alias("ps"), F.sum("n").alias("ns"))  # one row
    g = _running(g, "score", True, tp="p", fp="n").crossJoin(F.broadcast(whole)).withColumn("fn", F.col("ps") - F.col("tp")).withColumn("tn", F.col("ns") - F.col("fp"))
    r = rates(g)
    if min_recall is not None:
        return r.where(F.col("recall") >= min_recall).orderBy(F.desc("precision"), F.desc("recall"), "score").limit(1)
    return r.orderBy(F.desc("f1"), F.desc("recall"), "score").limit(1)


def risk_coverage(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """rows (id, score, label): area under risk against coverage, the best possible, and the excess.

    Positions come from range-sorted parts: ranks within a part plus the rows and errors before it.
    """
    ordered = _positions(rows, ["score", "id"], parts)
    best = _positions(rows, ["label", "id"], parts)
    a = ordered.agg(F.coalesce(F.avg(F.col("errors") / F.col("position")), F.lit(0.0)).alias("aurc"))
    b = best.agg(F.coalesce(F.avg(F.col("errors") / F.col("position")), F.lit(0.0)).alias("optimal"))
    return a.crossJoin(b).withColumn("excess", F.col("aurc") - F.col("optimal"))


def _positions(rows: DataFrame, by: list[str], parts: int | None) -> DataFrame:
    """Running count and running errors in the order of the columns, without one task for all rows."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = rows.select("id", "score", "label").repartitionByRange(n, *by).withColumn("part", F.spark_partition_id()).persist()
    sums = r.groupBy("part").agg(F.count("*").alias("rows"), F.sum("label").alias("errs"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    sums = sums.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows0"), F.coalesce(F.sum("errs").over(before), F.lit(0)).alias("errs0"))
    own = Window.partitionBy("part").orderBy(*by)
    r = r.withColumn("i", F.row_number().over(own)).withColumn("e", F.sum("label").over(own))
    return r.join(F.broadcast(sums), "part").select("id", (F.col("rows0") + F.col("i")).alias("position"), (F.col("errs0") + F.col("e")).alias("errors"))


def holm(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """tests (name, p): step-down decisions; a test is rejected only while all smaller p are."""
    order = Window.orderBy("p", "name")
    m = F.count("*").over(Window.partitionBy())
    t = tests.withColumn("rank", F.row_number().over(order)).withColumn("cut", alpha / (m - F.col("rank") + 1))
    return t.withColumn("rejected", F.min((F.col("p") <= F.col("cut")).cast("int")).over(order) == 1)


def qa_report_by(judged: DataFrame, *by: str) -> DataFrame:
    """qa_report() of each group."""
    mean = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    j = judged.where("not ambiguous and mismatch <> 'missing_gold'")
    counts = j.groupBy(*by, "mismatch").agg(F.count("*").alias("m")).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("mismatch", "m")))).alias("mismatches"))  # a row for each kind
    r = j.groupBy(*by).agg(
        F.count("*").alias("n"), mean(F.col("exact")).alias("exact_match"), mean(F.col("correct")).alias("accuracy"), mean(F.col("abstained")).alias("abstention_rate"),
        mean(F.col("prediction").isNull() & ~F.col("abstained")).alias("parse_failure_rate"), mean(F.col("unit_assumed")).alias("unit_assumption_rate"),
        F.try_divide(F.count_if(F.col("program_executed") & F.col("correct")).cast("double"), F.count("program_executed")).alias("execution_accuracy"),
    )
    return r.join(counts, list(by))


def qa_report(judged: DataFrame) -> DataFrame:
    """judged (correct, exact, mismatch, unit_assumed, abstained, prediction, program_executed, ambiguous): rates over the rows that are
    not ambiguous and have gold, the number of each mismatch; no rows give 0.0, and execution accuracy null."""
    mean = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    j = judged.where("not ambiguous and mismatch <> 'missing_gold'")
    counts = j.groupBy("mismatch").agg(F.count("*").alias("m")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("mismatch", "m")))).alias("mismatches"))
    r = j.agg(
        F.count("*").alias("n"), mean(F.col("exact")).alias("exact_match"), mean(F.col("correct")).alias("accuracy"), mean(F.col("abstained")).alias("abstention_rate"),
        mean(F.col("prediction").isNull() & ~F.col("abstained")).alias("parse_failure_rate"), mean(F.col("unit_assumed")).alias("unit_assumption_rate"),
        F.try_divide(F.count_if(F.col("program_executed") & F.col("correct")).cast("double"), F.count("program_executed")).alias("execution_accuracy"),
    )
    return r.crossJoin(counts)  # one row each


def tolerance_sensitivity(judged: DataFrame, taus: list[float], *by: str) -> DataFrame:
    """judged (correct: by everything but the size of the error, rel_err): accuracy at each tolerance, from one reading of the answers."""
    j = judged.select(*by, "correct", "rel_err", F.explode(F.array(*[F.lit(t) for t in taus])).alias("tau"))
    right = F.col("correct") & F.coalesce(F.col("rel_err") <= F.col("tau"), F.lit(True))
    return j.groupBy(*by, "tau").agg(F.count("*").alias("n"), F.avg(right.cast("int")).alias("accuracy"))


def cost_matched(reports: DataFrame, arm: str, left: str, right: str) -> DataFrame:
    """Ratios of two arms' rows of efficiency(): tokens, latency, cost; null where either is undefined or the right one is zero."""
    l, r = (reports.where(F.col(arm) == x) for x in (left, right))
    ratio = lambda c: F.try_divide(F.col(f"l.{c}").cast("double"), F.col(f"r.{c}").cast("double")).alias(f"{c}_ratio")
    return l.alias("l").crossJoin(r.alias("r")).select(F.lit(left).alias("left"), F.lit(right).alias("right"), ratio("tokens_per_question"), ratio("p50"), ratio("cost"))  # a row each


def efficiency(costs: DataFrame, *by: str) -> DataFrame:
    """costs (latency, tokens, cost): percentiles by linear interpolation, tokens a question, priced share."""
    sums = costs.groupBy(*by).agg(F.count("*").alias("questions"), F.avg("tokens").alias("tokens_per_question"), F.sum("tokens").alias("tokens"), F.avg(F.col("cost").isNotNull().cast("double")).alias("cost_coverage"), F.sum("cost").alias("cost"))
    p = percentiles(costs, list(by), "latency", linear={"p50": 0.5, "p95": 0.95})
    if not by:
        return sums.join(p, how="left").fillna(0.0, ["p50", "p95"])  # a row each
    p = p.withColumnsRenamed({c: f"{c}__" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"{c}__")) for c in by]
    return sums.join(p, same, "left").select(*by, "questions", F.coalesce("p50", F.lit(0.0)).alias("p50"), F.coalesce("p95", F.lit(0.0)).alias("p95"), "tokens_per_question", "tokens", "cost_coverage", "cost")


# --- resampling ---------------------------------------------------------------------------------

#: Resamples that the published intervals are made of.
RESAMPLES, SEED = 10_000, 20260826


def _poisson_table() -> tuple[np.ndarray, np.ndarray]:
    """Poisson's distribution function with mean 1, and for each 16 leading bits of a uniform number the draw that they fix, -1 where they do not."""
    upto = np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(20)])
    low, high = (np.searchsorted(upto, (np.arange(1 << 16) + x) / (1 << 16), "right") for x in (0, 1))
    return upto, np.where(low == high, low, -1).astype(np.int8)


_UPTO, _DRAWN = _poisson_table()


def _weights(seed: int, ids: list, resamples: int) -> np.ndarray:
    """How often each row is drawn in each resample: Poisson draws from a generator that the seed and the row's id fix.

    By inversion: 16 bits fix nearly every draw, the few others (one in about 8,000) take 53 more."""
    out = np.empty((len(ids), resamples), np.int64)
    for row, i in zip(out, ids, strict=True):
        bits = np.random.Philox(key=[seed, int.from_bytes(hashlib.blake2b(str(i).encode(), digest_size=8).digest())])
        lead = bits.random_raw(-(-resamples // 4)).astype("<u8").view("<u2")[:resamples]
        row[:] = _DRAWN[lead]
        open_ = np.flatnonzero(row < 0)
        row[open_] = np.searchsorted(_UPTO, (lead[open_] + np.random.Generator(bits).random(len(open_))) / (1 << 16), "right")
    return out


def _summed(rows: DataFrame, work, fields: int) -> list[np.ndarray]:
    """Arrays that work(batches) yields for each task, put together in order of the tasks: the driver gets `fields` arrays for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = work(batches)
        if got is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in got]], names=["part", *[f"x{k}" for k in range(fields)]])

    schema = "part int, " + ", ".join(f"x{k} binary" for k in range(fields))
    parts = sorted(rows.mapInArrow(run, schema).collect(), key=lambda r: r.part)
    return [np.array([np.frombuffer(r[f"x{k}"]) for r in parts]) for k in range(fields)]


def mean_draws(rows: DataFrame, resamples: int = RESAMPLES, seed: int = SEED) -> np.ndarray:
    """rows (id, value): the mean of each resample, nan where it drew nothing.  A task adds up its rows' share of every resample."""

    def work(batches):
        total = np.zeros((2, resamples))
        for b in batches:
            for s in range(0, b.num_rows, 64):
                part = b.slice(s, 64)
                w = _weights(seed, part.column("id").to_pylist(), resamples)
                total += [np.asarray(part.column("value").to_pylist(), float) @ w, w.sum(0)]
        return total

    sums, n = (x.sum(0) if len(x) else np.zeros(resamples) for x in _summed(rows.where("value is not null").select("id", "value"), work, 2))
    return np.divide(sums, n, out=np.full(resamples, np.nan), where=n > 0)


def auroc_draws(rows: DataFrame, resamples: int = RESAMPLES, seed: int = SEED) -> np.ndarray:
    """rows (id, score, label): the AUROC of each resample, nan where a class is absent.  Rows are range-sorted by score; a task
    goes through its range once and hands on, for each resample, its errors, its others and the pairs that it ranks."""

    def work(batches):
        pairs, errors, others = (np.zeros(resamples) for _ in range(3))
        held, score = np.zeros((2, resamples)), None
        seen = False
        for b in batches:
            for i, s, y in zip(*(b.column(c).to_pylist() for c in ("id", "score", "label")), strict=True):
                if s != score:
                    pairs += held[1] * (others + held[0] / 2)
                    errors, others = errors + held[1], others + held[0]
                    held, score = np.zeros((2, resamples)), s
                held[int(y)] += _weights(seed, [i], resamples)[0]
                seen = True
        pairs += held[1] * (others + held[0] / 2)
        return (pairs, errors + held[1], others + held[0]) if seen else None

    ordered = rows.where("score is not null").select("id", F.col("score").cast("double").alias("score"), F.col("label").cast("int").alias("label")).repartitionByRange("score").sortWithinPartitions("score", "id")
    pairs, errors, others = _summed(ordered, work, 3)
    if not len(pairs):
        return np.full(resamples, np.nan)
    before = np.cumsum(others, 0) - others
    total = errors.sum(0) * others.sum(0)
    return np.divide((pairs + errors * before).sum(0), total, out=np.full(resamples, np.nan), where=total > 0)


def auroc_draws_by(rows: DataFrame, by: list[str], resamples: int = RESAMPLES, seed: int = SEED) -> dict[tuple, np.ndarray]:
    """auroc_draws() of every group from one range-sorted pass keyed by group and score; the same weights of a row in all its groups.  The driver gets
    three arrays for each group and task that holds some of it: groups plus tasks in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, order, score, state = None, 0, None, None

        def done() -> pa.RecordBatch:
            pairs, errors, others, held = state
            pairs = pairs + held[1] * (others + held[0] / 2)
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in key] + [pa.array([TaskContext.get().partitionId()], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (pairs, errors + held[1], others + held[0])]], schema=schema_arrow)

        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for *group, i, s, y in zip(*cols, strict=True):
                if group != key:
                    if key is not None:
                        yield done()
                    key, score, state = group, None, (np.zeros(resamples), np.zeros(resamples), np.zeros(resamples), np.zeros((2, resamples)))
                pairs, errors, others, held = state
                if s != score:
                    pairs, errors, others = pairs + held[1] * (others + held[0] / 2), errors + held[1], others + held[0]
                    held, score = np.zeros((2, resamples)), s
                held[int(y)] += _weights(seed, [i], resamples)[0]
                state = pairs, errors, others, held
        if key is not None:
            yield done()

    own = rows.where("score is not null").select(*[F.col(c).cast("string").alias(c) for c in by], "id", F.col("score").cast("double").alias("score"), F.col("label").cast("int").alias("label"))
    schema = T.StructType.fromDDL(", ".join([*[f"`{c}` string" for c in by], "part int, pairs binary, errors binary, others binary"]))
    schema_arrow = to_arrow_schema(schema)
    parts = own.repartitionByRange(*by, "score").sortWithinPartitions(*by, "score", "id").mapInArrow(run, schema).collect()
    groups: dict[tuple, list] = {}
    for r in sorted(parts, key=lambda r: r.part):
        groups.setdefault(tuple(r[c] for c in by), []).append([np.frombuffer(r[c]) for c in ("pairs", "errors", "others")])
    out = {}
    for g, rows_ in groups.items():
        pairs, errors, others = (np.array(x) for x in zip(*rows_, strict=True))
        before = np.cumsum(others, 0) - others
        total = errors.sum(0) * others.sum(0)
        out[g] = np.divide((pairs + errors * before).sum(0), total, out=np.full(resamples, np.nan), where=total > 0)
    return out


def interval(spark: SparkSession, point: float | None, draws: np.ndarray, alpha: float = 0.05) -> DataFrame:
    """One row: point, low, high, undefined resamples, whether zero is outside, and the two-sided p of the difference from zero."""
    known = draws[np.isfinite(draws)]
    low, high = (float(x) for x in np.quantile(known, [alpha / 2, 1 - alpha / 2])) if len(known) else (None, None)
    p = None
    if point is not None and len(known):
        p = min(1.0, 2.0 * float(((known <= 0) if point > 0 else (known >= 0)).mean()))
    outside = low is not None and (low > 0 or high < 0)
    return spark.createDataFrame([(point, low, high, int(len(draws) - len(known)), outside, p)], "point double, low double, high double, undefined int, excludes_zero boolean, p_value double")


def bootstrap_mean(rows: DataFrame, resamples: int = RESAMPLES, seed: int = SEED, alpha: float = 0.05) -> DataFrame:
    """rows (id, value): percentile interval of the mean."""
    return interval(rows.sparkSession, rows.agg(F.avg("value")).first()[0], mean_draws(rows, resamples, seed), alpha)


def bootstrap_auroc(rows: DataFrame, resamples: int = RESAMPLES, seed: int = SEED, alpha: float = 0.05) -> DataFrame:
    return interval(rows.sparkSession, auroc(rows).first()[0], auroc_draws(rows, resamples, seed), alpha)


def paired_auroc(rows: DataFrame, resamples: int = RESAMPLES, seed: int = SEED, alpha: float = 0.05) -> DataFrame:
    """rows (id, score_a, label_a, score_b, label_b): interval and p of AUROC(a) - AUROC(b), both over the same resamples of rows."""
    own = [rows.select("id", F.col(f"score_{x}").alias("score"), F.col(f"label_{x}").alias("label")) for x in "ab"]
    a, b = (auroc(r).first()[0] for r in own)
    point = None if a is None or b is None else a - b
    return interval(rows.sparkSession, point, auroc_draws(own[0], resamples, seed) - auroc_draws(own[1], resamples, seed), alpha)
