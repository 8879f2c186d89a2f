"""Graded cases: whether evidence was retrieved, where an error comes from and of what kind it is."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import normalised
from ..functions.values import degroup, power_of_ten

TOLERANCE = 0.005
STRATA = ["retrieval_caused", "reasoning_caused", "unknown"]
# The kind of error that a disagreement of channels hints at, in this order.
HINTS = [
    ("scale_mismatch", "wrong_scale"),
    ("sign_mismatch", "sign_error"),
    ("currency_mismatch", "wrong_unit"),
    ("unit_kind_mismatch", "wrong_unit"),
]


def holds_anchors(text: Column, anchors: Column) -> Column:
    """Whether a text holds all anchors, digit groups aside."""
    own = normalised(text)
    return F.forall(anchors, lambda a: own.contains(normalised(a)) | degroup(own).contains(degroup(normalised(a))))


def satisfied(items: DataFrame, spans: DataFrame) -> DataFrame:
    """items (question, rank, page, text), spans (question, group_id, page, anchors): the groups that an item satisfies, with its rank.

    Items and spans meet on question and page; a group is satisfied by any of its spans."""
    hit = items.join(spans, ["question", "page"]).where(holds_anchors(F.col("text"), F.col("anchors")))
    return hit.select("question", "group_id", "rank").distinct()


def group_scores(items: DataFrame, spans: DataFrame, ks: list[int]) -> DataFrame:
    """Per question of the gold and k: recall of groups, precision over what was returned, reciprocal rank, all evidence retrieved."""
    hit = satisfied(items, spans)
    grid = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    groups = spans.select("question", "group_id").distinct().join(hit.groupBy("question", "group_id").agg(F.min("rank").alias("first")), ["question", "group_id"], "left").select("*", grid)
    found = F.coalesce(F.col("first") <= F.col("k"), F.lit(False))
    g = groups.groupBy("question", "k").agg(F.avg(found.cast("double")).alias("recall"), F.coalesce(1 / F.min(F.when(found, F.col("first"))), F.lit(0.0)).alias("rr"), F.bool_and(found).alias("all_found"), F.count("*").alias("groups"))
    good = hit.select("question", "rank").distinct().withColumn("good", F.lit(1))
    p = items.select("question", "rank").join(good, ["question", "rank"], "left").select("*", grid).where("rank <= k").groupBy("question", "k").agg((F.count("good") / F.count("*")).alias("precision"))
    return g.join(p, ["question", "k"], "left").fillna(0.0, ["precision"])


def macro(scores: DataFrame, *by: str) -> DataFrame:
    """Means over questions."""
    return scores.groupBy(*by).agg(F.count("*").alias("questions"), F.avg("recall").alias("recall_at_k"), F.avg("precision").alias("precision_at_k"), F.avg("rr").alias("mrr"), F.avg(F.col("all_found").cast("double")).alias("evidence_retrieval_accuracy"))


#: Letters of anchors that are looked for in one reading of the corpus.
LETTERS = 1 << 25


def spans_in(texts: DataFrame, place: str, id_col: str, spans: DataFrame) -> DataFrame:
    """(question, group_id, id): where the spans (question, group_id, place, anchors) of a stated set are held: texts (place, text, id) of
    the same place that hold all their anchors, digit groups aside.

    Each text is read once against all anchors by an automaton that each task builds, so no text meets a span whose anchors it does not
    hold and no place is a key that rows gather under.  More than LETTERS of anchors go in several readings."""
    own = spans.select("question", "group_id", F.col(place).alias("place"), F.transform("anchors", normalised).alias("plain")).withColumn("bare", F.transform("plain", degroup)).distinct()
    size = F.aggregate("plain", F.lit(0), lambda s, x: s + F.length(x))
    n = max(1, -(-(own.agg(F.sum(size)).first()[0] or 0) // LETTERS))
    part = lambda i: own.where(F.pmod(F.xxhash64("question", "group_id", "place", "plain"), F.lit(n)) == i) if n > 1 else own
    read = texts.select(F.col(place).alias("place"), normalised(F.coalesce("text", F.lit(""))).alias("plain"), F.col(id_col).alias("id")).withColumn("bare", degroup(F.col("plain")))
    schema = own.select("question", "group_id").schema.add("id", read.schema["id"].dataType)

    def found(rows: list) -> DataFrame:
        shared = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forms = [{}, {}]  # of each form of the anchors: anchor to the (span, anchor's place) that ask for it
            for i, (_, _, _, plain, bare) in enumerate(shared.value):
                for form, anchors in zip(forms, (plain, bare), strict=True):
                    for k, a in enumerate(anchors):
                        form.setdefault(a, []).append((i, k))
            machines = []
            for form in forms:
                m = ahocorasick.Automaton()
                for a, of in form.items():
                    if a:
                        m.add_word(a, of)
                m.make_automaton()
                machines.append(m)
            always = {x for form in forms for x in form.get("", ())}
            for b in batches:
                out = []
                for place_, plain, id_, bare in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    met = set(always)
                    for m, text in zip(machines, (plain, bare), strict=True):
                        if len(m):
                            for _, of in m.iter(text):
                                met.update(of)
                    counts: dict[int, int] = {}
                    for i, _k in met:
                        counts[i] = counts.get(i, 0) + 1
                    free = [i for i, s in enumerate(shared.value) if not s[3]] if not_asked else ()
                    for i in [*(i for i, c in counts.items() if c == len(shared.value[i][3])), *free]:
                        if shared.value[i][2] == place_ and place_ is not None:
                            out.append((shared.value[i][0], shared.value[i][1], id_))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(to_arrow_schema(schema))], names=schema.names)

        not_asked = any(not r.plain for r in rows)
        return read.select("place", "plain", "id", "bare").mapInArrow(run, schema)

    return reduce(DataFrame.union, [found(part(i).collect()) for i in range(n)]).distinct()


def diagnosed(items: DataFrame, spans: DataFrame, corpus: DataFrame, most: int) -> DataFrame:
    """The groups that the first `most` items miss: ranked_too_low where some chunk of the corpus (page, text, chunk_id) satisfies them,
    else absent_from_index."""
    missed = spans.join(satisfied(items.where(F.col("rank") <= most), spans).select("question", "group_id").distinct(), ["question", "group_id"], "left_anti")
    holders = spans_in(corpus, "page", "chunk_id", missed).groupBy("question", "group_id").agg(F.array_sort(F.collect_set("id")).alias("holders"))
    g = missed.groupBy("question", "group_id").agg(F.array_sort(F.collect_set("page")).alias("pages_allowed")).join(holders, ["question", "group_id"], "left")
    return g.select("question", "group_id", F.when(F.col("holders").isNull(), "absent_from_index").otherwise("ranked_too_low").alias("verdict"), F.slice(F.coalesce("holders", F.array().cast("array<string>")), 1, 5).alias("holders"), "pages_allowed")


def unlisted(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """Gold that is not complete: pages (document_id, page, text) that hold a span's anchors and that its group does not list.
    spans: question, group_id, document_id, page, anchors."""
    hit = spans_in(pages, "document_id", "page", spans)
    return hit.select("question", "group_id", F.col("id").alias("page")).distinct().join(spans, ["question", "group_id", "page"], "left_anti")


def oracle_blocks(spans: DataFrame, chunks: DataFrame, most: int = 8) -> DataFrame:
    """For each question the first chunk (document_id, pos, page, text, chunk_id) of each gold group, E1 and on; none if any group has no chunk.
    spans: question, group_id, group_pos, document_id, page, anchors."""
    hit = chunks.join(spans, ["document_id", "page"]).where(holds_anchors(F.col("text"), F.col("anchors")))
    first = hit.groupBy("question", "group_id", "group_pos").agg(F.min_by("chunk_id", "pos").alias("chunk_id"))
    need = spans.groupBy("question").agg(F.count_distinct("group_id").alias("need"))
    got = first.groupBy("question").agg(F.count("*").alias("got"), F.array_sort(F.collect_list(F.struct("group_pos", "chunk_id"))).alias("c")).join(need, "question").where("got = need")
    return got.select("question", F.posexplode(F.slice(F.array_distinct("c.chunk_id"), 1, most)).alias("i", "chunk_id")).select("question", F.concat(F.lit("E"), (F.col("i") + 1).cast("string")).alias("ref"), "chunk_id")


def evidence_retrieved(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """(question, retrieved): true where the blocks satisfy all gold groups, false where not or without blocks, null where gold has no
    spans or a block's text is not known.  blocks: question, page, text; spans: as of satisfied()."""
    hit = satisfied(blocks.withColumn("rank", F.lit(1)), spans).groupBy("question").agg(F.count_distinct("group_id").alias("met"))
    g = spans.groupBy("question").agg(F.count_distinct("group_id").alias("groups"))
    b = blocks.groupBy("question").agg(F.bool_and(F.coalesce(F.length("text") > 0, F.lit(False))).alias("known"))
    j = g.join(b, "question", "full_outer").join(hit, "question", "left")
    return j.select("question", F.when(F.col("groups").isNull(), F.lit(None).cast("boolean")).when(F.col("known").isNull(), False).when(F.col("known"), F.coalesce(F.col("met") == F.col("groups"), F.lit(False))).alias("retrieved"))


def extraction_faulty(answer: Column, evidence_text: Column) -> Column:
    """False where the evidence holds the answer's figure, blanks aside; null where that is not known.  Never true."""
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    return F.when((F.trim(answer) != "") & (evidence_text != "") & bare(evidence_text).contains(bare(F.trim(answer))), F.lit(False))


def parsed_correctly(metric: Column, searched: Column) -> Column:
    """Whether the metrics searched for hold the gold metric; null where either is missing."""
    return F.when((metric != "") & (searched != ""), F.lower(searched).contains(F.lower(metric)))


def provenance(retrieved: Column, parsed: Column, ambiguous: Column, faulty: Column) -> Column:
    """struct(provenance, confidence) of an error, in a fixed order; unknown is kept apart from false: without a check of the parse and of
    the extraction, reasoning is not concluded."""
    name = (
        F.when(F.coalesce(ambiguous, F.lit(False)), "definitional_ambiguity").when(~parsed, "question_understanding").when(~F.coalesce(retrieved, F.lit(False)), "retrieval")
        .when(faulty, "extraction").when(parsed.isNull() | faulty.isNull(), "undetermined").otherwise("reasoning")
    )
    return F.struct(name.alias("provenance"), F.when(name == "undetermined", "needs_human").otherwise("mechanical").alias("confidence"))


def kind(answer: Column, gold: Column, unit_kind: Column, gold_kind: Column, currency: Column, gold_currency: Column, disagreements: Column) -> Column:
    """struct(kind, confidence) of an error by its figures in units: missing, sign, power of ten, unit, currency, then hints."""
    hint = F.lit(None).cast("string")
    for name, means in reversed(HINTS):
        hint = F.when(F.array_contains(disagreements, name), F.lit(means)).otherwise(hint)
    plain = (
        F.when(answer.isNull(), "unsupported_claim").when(gold.isNull(), "unclassified").when((answer != 0) & (gold != 0) & ((answer > 0) != (gold > 0)), "sign_error")
        .when(power_of_ten(answer, gold, TOLERANCE).isNotNull(), "wrong_scale").when(unit_kind != gold_kind, "wrong_unit").when(currency != gold_currency, "wrong_unit")
    )
    name = F.coalesce(plain, hint, F.lit("unclassified"))
    sure = F.when(name == "unclassified", "needs_human").when(plain.isNotNull(), "mechanical").otherwise("suggested")
    return F.struct(name.alias("kind"), sure.alias("confidence"))


def weakest(*confidences: Column) -> Column:
    rank = [F.when(c == "needs_human", 2).when(c == "suggested", 1).otherwise(0) for c in confidences]
    most = F.greatest(*rank)
    return F.when(most == 2, "needs_human").when(most == 1, "suggested").otherwise("mechanical")


def hallucination(correct: Column, provenance_: Column) -> Column:
    """Whether an answer counts as a hallucination: an error that no second definition excuses."""
    return ~correct & (provenance_ != "definitional_ambiguity")


def stratum(retrieved: Column) -> Column:
    return F.when(retrieved.isNull(), "unknown").when(retrieved, "reasoning_caused").otherwise("retrieval_caused")


def classified(cases: DataFrame) -> DataFrame:
    """cases (correct, answer, gold, unit_kind, gold_kind, currency, gold_currency, disagreements, retrieved, parsed, ambiguous, faulty) with
    provenance, kind, confidence (the weaker of both), hallucination and stratum; correct ones have no provenance and kind."""
    p, k = "__provenance", "__kind"
    c = cases.withColumn(p, provenance(F.col("retrieved"), F.col("parsed"), F.col("ambiguous"), F.col("faulty"))).withColumn(k, kind(*[F.col(x) for x in ("answer", "gold", "unit_kind", "gold_kind", "currency", "gold_currency", "disagreements")]))
    wrong = ~F.col("correct")
    return c.select(
        *cases.columns, F.when(wrong, F.col(f"{p}.provenance")).alias("provenance"), F.when(wrong, F.col(f"{k}.kind")).alias("kind"), F.when(wrong, weakest(F.col(f"{p}.confidence"), F.col(f"{k}.confidence"))).alias("confidence"),
        hallucination(F.col("correct"), F.col(f"{p}.provenance")).alias("hallucination"), stratum(F.col("retrieved")).alias("stratum"),
    )


def graded(records: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """records joined with gold on qid, and one row with the number of records that have no gold."""
    j = records.join(gold.withColumn("known", F.lit(True)), "qid", "left")
    return j.where("known").drop("known"), j.agg(F.count_if(F.col("known").isNull()).alias("without_gold"))


def strata(cases: DataFrame) -> DataFrame:
    """Questions and errors of each stratum, all three always there."""
    all_ = cases.sparkSession.createDataFrame([(s,) for s in STRATA], "stratum string")
    g = cases.groupBy("stratum").agg(F.count("*").alias("questions"), F.count_if(~F.col("correct")).alias("errors"))
    return all_.join(g, "stratum", "left").fillna(0, ["questions", "errors"])


def error_table(cases: DataFrame) -> DataFrame:
    """Errors by provenance, by kind and by both (level: which), as one GROUPING SETS pass."""
    errors = cases.where("not correct").select(F.coalesce("provenance", F.lit("undetermined")).alias("provenance"), F.coalesce("kind", F.lit("unclassified")).alias("kind"))
    g = errors.groupingSets([["provenance"], ["kind"], ["provenance", "kind"]], "provenance", "kind").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return g.select(F.when(F.col("g") == 1, "provenance").when(F.col("g") == 2, "kind").otherwise("both").alias("level"), "provenance", "kind", "n")


def ambiguity_false_positives(cases: DataFrame, threshold: float) -> DataFrame:
    """Of the ambiguous questions with a score: how many, answered correctly, flagged, and the share flagged; null without correct ones."""
    a = cases.where("ambiguous and risk_score is not null")
    flagged = F.count_if(F.col("correct") & (F.col("risk_score") >= threshold))
    return a.agg(F.count("*").alias("ambiguous_questions"), F.count_if("correct").alias("answered_correctly"), flagged.alias("flagged"), F.try_divide(flagged, F.count_if("correct")).alias("false_positive_rate"))


def examples(cases: DataFrame, order: str, most: int = 10) -> DataFrame:
    """The first errors."""
    return cases.where("not correct").orderBy(order).limit(most)
