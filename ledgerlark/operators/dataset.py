"""Gold questions: sets, splits, validation worksheets, checks of gold against pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from .questions import audit, duplicates
from .selection import numbered, running
from .windows import hash_sample

# The columns of a worksheet, the verdicts it may hold, and the status each gives.
WORKSHEET = ["qid", "question", "definition", "ambiguous", "candidate_answer", "candidate_unit", "source_page", "evidence_anchors", "company", "fiscal_year", "verdict", "corrected_answer", "corrected_unit", "notes"]
VERDICTS = {"validated": "validated", "rejected": "rejected", "needs_review": "needs_review", "": "pending"}


def usable() -> Column:
    """Whether a question may serve as gold: validated, with an answer."""
    return F.coalesce((F.col("status") == "validated") & F.col("answer").isNotNull(), F.lit(False))


def views(questions: DataFrame) -> dict[str, DataFrame]:
    """questions (qid, status, answer, ambiguous, …): validated, pending, main_set and ambiguity_subset."""
    v = questions.where(usable())
    return {"validated": v, "pending": questions.where("status = 'pending'"), "main_set": v.where("not ambiguous"), "ambiguity_subset": v.where("ambiguous")}


def counts(questions: DataFrame) -> DataFrame:
    """The header of a written set: how many of each view."""
    return questions.agg(F.count("*").alias("total"), F.count_if(usable()).alias("validated"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(usable() & ~F.col("ambiguous")).alias("main_set"), F.count_if(usable() & F.col("ambiguous")).alias("ambiguity_subset"))


def gold_value(answer: Column, unit: Column) -> Column:
    """An answer and its unit as a figure, by the same parser as any other text."""
    return V.parse(F.concat_ws(" ", F.trim(answer), F.nullif(F.trim(unit), F.lit(""))))


def record_problems(questions: DataFrame) -> DataFrame:
    """(qid, problems) of records with problems.  questions: qid, question, answer, unit, awaiting, evidence (array), definition, ambiguous, status, validator."""
    pinned = F.coalesce(F.col("definition"), F.lit("")) != ""
    return audit(questions, "qid", {
        "empty_question": F.trim(F.coalesce("question", F.lit(""))) == "", "no_gold_answer": F.col("answer").isNull() & ~F.coalesce("awaiting", F.lit(False)),
        "answer_no_figure": F.col("answer").isNotNull() & gold_value(F.col("answer"), F.col("unit")).isNull(), "no_evidence": F.coalesce(F.size("evidence"), F.lit(0)) <= 0,
        "no_definition": ~F.col("ambiguous") & ~pinned, "ambiguous_with_definition": F.col("ambiguous") & pinned, "no_validator": (F.col("status") == "validated") & (F.coalesce("validator", F.lit("")) == ""),
    })


def unique_qids(questions: DataFrame) -> DataFrame:
    """questions, or an error that names the qids which stand twice."""
    twice = [r.qid for r in duplicates(questions, "qid").orderBy("qid").limit(5).collect()]
    if twice:
        raise ValueError(f"qids stand twice: {', '.join(map(str, twice))}")
    return questions


class SealedSplit(RuntimeError):
    """The test split was asked for without leave."""


def split_of(questions: DataFrame, split: str, include_ambiguous: bool = False, include_pending: bool = False, allowed: bool = False, reason: str = "") -> DataFrame:
    """The questions of a split that may serve as gold.  The test split needs leave and a reason, and never holds pending ones."""
    if split == "test":
        if not allowed:
            raise SealedSplit("the test split is sealed: it is opened once, when the method is fixed")
        if not reason.strip():
            raise SealedSplit("access to the test split needs a reason, which is logged")
        if include_pending:
            raise SealedSplit("the test split is never scored against gold that nobody validated")
    q = questions.where(F.col("split") == split)
    q = q if include_pending else q.where(usable())
    return q if include_ambiguous else q.where("not ambiguous")


def access_row(questions: DataFrame, reason: str) -> DataFrame:
    """What the log of test accesses records."""
    return questions.agg(F.current_timestamp().alias("at"), F.lit(reason).alias("reason"), F.count("*").alias("questions"))


def interleaved(questions: DataFrame) -> DataFrame:
    """Questions with their position when companies take turns, the one with fewest questions first.

    In a turn stand the companies that have so many questions, which are the last of all companies by their numbers; so a position is the questions
    of the turns before, and the company's place among all less the companies that are done.  No task holds a company or a turn."""
    sizes = questions.groupBy("company").agg(F.count("*").alias("of"))
    places = numbered(sizes, [], ["of", "company"], "place")
    all_ = sizes.agg(F.count("*").alias("companies"))
    q = numbered(questions, ["company"], ["qid"], "turn")
    turns = q.groupBy("turn").agg(F.count("*").alias("n"))
    turns = running(turns, [], ["turn"], F.col("n"), "upto").crossJoin(F.broadcast(all_)).select("turn", (F.col("upto") - F.col("companies")).alias("start"))  # questions before, less companies that are done
    j = q.join(turns, "turn").join(places.withColumnRenamed("company", "c"), F.col("company").eqNullSafe(F.col("c")))
    return j.withColumn("position", F.col("start") + F.col("place")).drop("turn", "of", "start", "place", "c")


def worksheet(questions: DataFrame) -> DataFrame:
    """The worksheet of questions in turns, verdicts blank.  evidence: array<struct<page, anchors>>."""
    q = interleaved(questions)
    blank = F.lit("")
    return q.select(
        "position", "qid", "question", "definition", F.when(F.col("ambiguous"), "yes").otherwise("no").alias("ambiguous"), F.coalesce("answer", blank).alias("candidate_answer"), F.coalesce("unit", blank).alias("candidate_unit"),
        F.get("evidence", F.lit(0))["page"].alias("source_page"), X.anchors_text(F.col("evidence")).alias("evidence_anchors"), "company", "fiscal_year", blank.alias("verdict"), blank.alias("corrected_answer"), blank.alias("corrected_unit"), blank.alias("notes"),
    )


def imported(questions: DataFrame, sheet: DataFrame, validator: str, pass_number: int = 1) -> DataFrame:
    """questions (qid, answer, unit, status, evidence, second_pass_agreed) with the verdicts of a worksheet, and what happened to each
    (change: untouched, unrecognised, validated, rejected or needs_review).

    A corrected answer replaces the answer and drops the anchors, which cite the old one (anchors_invalidated); one that is no
    figure needs review.  A second pass says whether status and answer are as before."""
    if not validator.strip():
        raise ValueError("a validator must be named")
    verdict = F.replace(F.lower(F.trim(F.coalesce("verdict", F.lit("")))), F.lit(" "), F.lit("_"))
    s = sheet.where("trim(coalesce(qid, '')) <> ''").groupBy(F.trim("qid").alias("qid")).agg(*[F.last(c).alias(c) for c in ("verdict", "corrected_answer", "corrected_unit")])
    s = s.select("qid", verdict.alias("said"), F.nullif(F.trim("corrected_answer"), F.lit("")).alias("new"), F.nullif(F.trim("corrected_unit"), F.lit("")).alias("new_unit"), F.lit(True).alias("listed"))
    j = questions.join(s, "qid", "left").withColumnsRenamed({"answer": "old", "unit": "old_unit", "status": "was"})
    known = F.coalesce(F.col("said").isin([v for v in VERDICTS if v]), F.lit(False))
    answer, unit = F.when(known, F.coalesce("new", "old")).otherwise(F.col("old")), F.when(known & F.col("new").isNotNull(), F.coalesce("new_unit", "old_unit")).otherwise(F.col("old_unit"))
    j = j.withColumn("answer", answer).withColumn("unit", unit).withColumn("corrected", known & F.col("new").isNotNull())
    unread = F.col("corrected") & gold_value(F.col("answer"), F.col("unit")).isNull()
    j = j.withColumn("status", F.when(unread, "needs_review").when(known, F.col("said")).otherwise(F.col("was")))
    again = F.when(known & F.lit(pass_number > 1) & (F.col("was") != "pending"), (F.col("was") == F.col("status")) & F.col("old").eqNullSafe(F.col("answer"))).otherwise(F.col("second_pass_agreed"))
    change = F.when(known, F.col("status")).when(F.col("listed") & (F.col("said") != ""), "unrecognised").otherwise("untouched")
    stale = F.col("corrected") & (F.coalesce(F.size("evidence"), F.lit(0)) > 0)
    return j.select("qid", "answer", "unit", "status", F.when(~stale, F.col("evidence")).alias("evidence"), again.alias("second_pass_agreed"), F.when(known, F.lit(validator)).alias("validator"), change.alias("change"), "corrected", stale.alias("anchors_invalidated"))


def import_report(rows: DataFrame) -> DataFrame:
    """One row of counts over imported()."""
    is_ = lambda x: F.count_if(F.col("change") == x)
    return rows.agg(is_("validated").alias("validated"), is_("rejected").alias("rejected"), is_("needs_review").alias("needs_review"), (is_("untouched") + is_("unrecognised")).alias("untouched"), is_("unrecognised").alias("problems"), F.count_if("corrected").alias("corrections"), F.count_if("anchors_invalidated").alias("anchors_invalidated"))


def unknown_qids(sheet: DataFrame, questions: DataFrame) -> DataFrame:
    """Rows of a worksheet that no question has."""
    return sheet.select("qid").distinct().join(questions.select("qid"), "qid", "left_anti")


def double_pass(questions: DataFrame, fraction: float = 0.2, seed: str = "20260826") -> DataFrame:
    """The questions to validate again: a fixed fifth, one at least."""
    return hash_sample(questions, "qid", seed, fraction)


def agreement(questions: DataFrame) -> DataFrame:
    """How many passed twice, and the share that agreed; null where none did."""
    y = F.col("second_pass_agreed")
    return questions.agg(F.count(y).alias("double_passed"), F.count_if(y).alias("agreed"), F.avg(y.cast("double")).alias("agreement"))


def company_sample(questions: DataFrame, limit: int, seed: str) -> DataFrame:
    """At most `limit` questions in which companies take turns, each in an order by hash."""
    q = questions.withColumn("__h", F.md5(F.concat(F.lit(seed), F.col("qid").cast("string"))))
    return numbered(q, ["company"], ["__h", "qid"], "turn").drop("__h").orderBy("turn", "company").limit(limit)


def located(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """The pages (document_id, page, text) that hold a candidate's row label and one of its figure's printed forms.
    candidates: qid, document_id, label, figure."""
    variants = F.transform(V.searchable_variants(F.col("figure")), lambda v: X.normalised(v))
    c = candidates.select("qid", "document_id", X.normalised(F.col("label")).alias("label"), variants.alias("variants")).where("label <> '' and size(variants) > 0")
    hit = pages.withColumn("own", X.normalised(F.col("text"))).join(c, "document_id").where(F.col("own").contains(F.col("label")))
    return hit.select("qid", "page", "label", F.get(F.filter("variants", lambda v: F.col("own").contains(v)), F.lit(0)).alias("anchor")).where("anchor is not null")


def retrieval_gold(candidates: DataFrame, places: DataFrame) -> DataFrame:
    """Candidates (qid, cited) with the places that hold them as one group of alternatives; left out where no place does or the cited page is not among them."""
    g = places.groupBy("qid").agg(F.array_sort(F.collect_set(F.struct("page", F.array("label", "anchor").alias("anchors")))).alias("any_of"))
    return candidates.join(g, "qid").where("cited is null or exists(any_of, x -> x.page = cited)")


def prechecked(candidates: DataFrame, pages: DataFrame, near: int = 1) -> DataFrame:
    """What a machine finds of each candidate (qid, document_id, cited, figure, label) in the pages (document_id, page, lines): on_cited_page
    (or a page beside it), short_figure (too short to search, found by its label), elsewhere, not_found, no_candidate."""
    c = candidates.withColumn("variants", V.searchable_variants(F.coalesce("figure", F.lit(""))))
    p = c.join(pages, "document_id").withColumn("found", X.first_line_with(F.col("lines"), F.col("variants")).isNotNull()).withColumn("window", X.label_window(F.col("lines"), F.col("label")))
    close = F.abs(F.col("page") - F.col("cited")) <= near
    far = F.struct(F.abs(F.col("page") - F.col("cited")), F.col("page"))
    g = p.groupBy("qid").agg(F.min_by("page", F.when(close & F.col("found"), far)).alias("near_page"), F.min_by("window", F.when(close & F.col("window").isNotNull(), far)).alias("near_window"), F.array_sort(F.collect_set(F.when(F.col("found"), F.col("page")))).alias("pages"))
    short = F.size("variants") == 0
    verdict = (
        F.when(F.trim(F.coalesce("figure", F.lit(""))) == "", "no_candidate").when(short & F.col("near_window").isNotNull(), "short_figure").when(short, "not_found")
        .when(F.col("near_page").isNotNull(), "on_cited_page").when(F.size("pages") > 0, "elsewhere").otherwise("not_found")
    )
    return c.join(g, "qid", "left").select("qid", verdict.alias("precheck"), F.when(verdict == "on_cited_page", F.col("near_page")).alias("page"), F.when(verdict == "elsewhere", F.slice("pages", 1, 8)).alias("also_on_pages"))


def basis_audit(questions: DataFrame, basis: DataFrame) -> DataFrame:
    """Whether the pages of each question's evidence have the basis it asks for: right_basis, wrong_basis, mixed_or_unknown.
    questions: qid, document_id, question, pages (array); basis: document_id, page, basis."""
    q = questions.withColumn("asked", X.asked_basis(F.col("question")))
    at = q.select("qid", "document_id", F.explode("pages").alias("page")).join(basis, ["document_id", "page"]).where("basis <> '-'").groupBy("qid").agg(F.collect_set("basis").alias("bases"))
    j = q.join(at, "qid", "left")
    one = F.size("bases") == 1
    verdict = F.when(one & (F.col("asked") != "?") & ~F.array_contains("bases", F.col("asked")), "wrong_basis").when(one & F.array_contains("bases", F.col("asked")), "right_basis").otherwise("mixed_or_unknown")
    return j.select("qid", "asked", verdict.alias("verdict"))


def basis_counts(questions: DataFrame, basis: DataFrame) -> DataFrame:
    """By company and basis of the cited page ('?': unknown): how many questions, and how many ask for consolidated and cite standalone."""
    j = questions.join(basis.withColumnRenamed("page", "source_page"), ["document_id", "source_page"], "left").withColumn("basis", F.coalesce("basis", F.lit("?")))
    return j.groupBy("company", "basis").agg(F.count("*").alias("n"), F.count_if((F.col("basis") == "standalone") & (X.asked_basis(F.col("question")) == "consolidated")).alias("offenders"))


def corpus_table(companies: DataFrame, questions: DataFrame) -> DataFrame:
    """Candidates and validated questions of each company, none included."""
    g = questions.groupBy("company").agg(F.count("*").alias("candidates"), F.count_if(usable()).alias("validated"))
    return companies.join(g, "company", "left").fillna(0, ["candidates", "validated"])


def basis_failures(basis: DataFrame, known: DataFrame) -> DataFrame:
    """Pages read by hand (document_id, page, expected) that are classified otherwise."""
    return known.join(basis, ["document_id", "page"], "left").where("not (basis <=> expected)")
