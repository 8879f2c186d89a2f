"""Arms compared: detection by stratum, arbitration, hypotheses, ablation contrasts, and the report of them all.

cases: arm, qid, correct, risk_score, stratum, predicted (null: no figure), agreed.  Sets of cases are as large as a
campaign; the statistics over them are distributed, the table of arms is small.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.records import run_efficiency
from . import metrics as M

# Cases below which no claim is made, and what each arm of the ablation leaves out.
LEAST = 10
ABLATION = {
    "B": "the natural-language channel",
    "C": "the executed-program channel",
    "D": "the consistency engine and arbiter",
    "E": "the verification agent",
    "F": "hybrid retrieval, leaving semantic only",
    "G": "the deterministic verifier",
    "H": "cross-model channels, leaving one model on both",
}
# Hypotheses as differences of two arms' detection.
HYPOTHESES = {"H1": ("A", "B5"), "H4": ("A", "H"), "H3": ("A", "G")}
STRATA = ["retrieval_caused", "reasoning_caused", "unknown"]


def _scored(cases: DataFrame) -> DataFrame:
    return cases.where("risk_score is not null").select(F.col("qid").alias("id"), F.col("risk_score").alias("score"), (~F.col("correct")).cast("int").alias("label"))


def detection_by(cases: DataFrame, by: list[str], resamples: int = M.RESAMPLES, threshold: float | None = None) -> DataFrame:
    """For each group with scores n, errors, AUROC with its interval, average precision, threshold with its rates, and whether errors are too few for a
    claim.  One set of passes keyed by group serves all groups, resampling included; a case weighs the same in each."""
    spark = cases.sparkSession
    rows = cases.where("risk_score is not null").select(*by, F.col("qid").alias("id"), F.col("risk_score").alias("score"), (~F.col("correct")).cast("int").alias("label"))
    draws = M.auroc_draws_by(rows, by, resamples)
    ends = []
    for group, d in sorted(draws.items()):
        known = d[np.isfinite(d)]
        low, high = (float(x) for x in np.quantile(known, [0.025, 0.975])) if len(known) else (None, None)
        ends.append((*group, low, high, int(len(d) - len(known))))
    bounds = spark.createDataFrame(ends, ", ".join([*[f"`{c}` string" for c in by], "low double, high double, undefined int"]))  # a row for each group
    if threshold is None:
        cut = M.thresholds_by(rows, by)
    else:
        cut = M.rates(rows.groupBy(*by).agg(*M.at_threshold(rows, F.lit(threshold)))).select(*by, F.lit(threshold).alias("threshold"), "tp", "fp", "tn", "fn", "precision", "recall", "f1")
    return M.ranked_by(rows, by).join(F.broadcast(bounds), by).join(cut, by).withColumn("too_few", F.col("errors") < LEAST)


_NOTHING = {"n": 0, "errors": 0, "undefined": 0, "too_few": True}


def stratified(cases: DataFrame, resamples: int = M.RESAMPLES, threshold: float | None = None, *by: str) -> DataFrame:
    """detection_by() of each stratum and of all cases, pooled; a stratum without scores has a row of nulls with n 0."""
    own = F.array_compact(F.array(F.when(F.col("stratum").isin(STRATA), F.col("stratum")), F.lit("pooled")))
    found = detection_by(cases.withColumn("stratum", F.explode(own)), [*by, "stratum"], resamples, threshold)
    groups = cases.select(*by).distinct() if by else cases.sparkSession.range(1).select()
    grid = groups.select("*", F.explode(F.array(*[F.lit(s) for s in [*STRATA, "pooled"]])).alias("stratum"))
    return grid.join(found, [*by, "stratum"], "left").fillna({k: v for k, v in _NOTHING.items() if k != "too_few"}).withColumn("too_few", F.coalesce("too_few", F.lit(True)))


def detection(cases: DataFrame, resamples: int = M.RESAMPLES, threshold: float | None = None) -> DataFrame:
    """The pooled row of stratified()."""
    return stratified(cases, resamples, threshold).where("stratum = 'pooled'").drop("stratum")


def operating_threshold(cases: DataFrame, arm: str, min_recall: float | None = None, validation_run: str | None = None, reported_run: str | None = None) -> float:
    """The threshold that validation cases choose; an arm without scores has none, and a run never chooses its own."""
    if validation_run is not None and validation_run == reported_run:
        raise ValueError(f"run {reported_run} cannot choose the threshold that it is reported at")
    row = M.select_threshold(_scored(cases.where(F.col("arm") == arm)), min_recall).first()
    if row is None or not _scored(cases.where(F.col("arm") == arm)).take(1):
        raise ValueError(f"arm {arm} has no risk scores: no threshold can be chosen")
    return float(row["score"])


def arbitration(records: DataFrame, *by: str) -> DataFrame:
    """records (triggered, resolved, correct, right_available): one row of counts; the rate is null under LEAST graded cases.

    winnable: resolved cases in which a channel held the right figure; won: those answered rightly."""
    t, r = F.col("triggered"), F.col("triggered") & F.col("resolved")
    graded = r & F.col("correct").isNotNull()
    g = records.groupBy(*by).agg(
        F.count("*").alias("records"), F.count_if(t).alias("triggered"), F.count_if(r).alias("resolved"), F.count_if(t & ~F.col("resolved")).alias("declined"), F.count_if(graded).alias("graded"),
        F.count_if(graded & F.col("correct")).alias("correct"), F.count_if(graded & F.col("right_available")).alias("winnable"), F.count_if(graded & F.col("right_available") & F.col("correct")).alias("won"),
    )
    return g.withColumn("trigger_rate", F.round(F.try_divide("triggered", "records"), 4)).withColumn("rate", F.when(F.col("graded") >= LEAST, F.round(F.try_divide("correct", "graded"), 4)))


def paired(cases: DataFrame, left: str, right: str, committed: bool = False) -> DataFrame:
    """The questions that two arms scored (both with a figure, if committed), for paired_auroc()."""
    own = lambda arm, x: _scored(cases.where((F.col("arm") == arm) & (F.col("predicted").isNotNull() | F.lit(not committed)))).select("id", F.col("score").alias(f"score_{x}"), F.col("label").alias(f"label_{x}"))
    return own(left, "a").join(own(right, "b"), "id")


def _compared(cases: DataFrame, name: str, left: str, right: str, resamples: int, committed: bool = False) -> DataFrame:
    p = paired(cases, left, right, committed)
    n, errors = p.agg(F.count("*"), F.coalesce(F.sum("label_a"), F.lit(0))).first()
    spark = cases.sparkSession
    row = M.paired_auroc(p, resamples) if n >= LEAST else spark.createDataFrame([(None, None, None, 0, False, None)], "point double, low double, high double, undefined int, excludes_zero boolean, p_value double")
    return row.select(F.lit(name).alias("name"), F.lit(left).alias("left"), F.lit(right).alias("right"), F.lit(n).cast("long").alias("n"), F.lit(errors).cast("long").alias("errors"), F.lit(n >= LEAST).alias("testable"), "point", "low", "high", "p_value", (F.col("excludes_zero") & (F.col("point") > 0)).alias("supported_before_correction"))


def _corrected(rows: DataFrame, *by: str) -> DataFrame:
    """rows with Holm's decision within each family; rows that cannot be tested stay out of it."""
    tests = rows.where("testable and p_value is not null")
    families = [r[0] for r in tests.select(*by).distinct().collect()] if by else [None]
    own = [M.holm((tests.where(F.col(by[0]) == f) if by else tests).select(*by, "name", F.col("p_value").alias("p"))) for f in families]
    if not own:
        return rows.withColumn("significant", F.lit(None).cast("boolean"))
    return rows.join(reduce(DataFrame.unionByName, own).select(*by, "name", F.col("rejected").alias("significant")), [*by, "name"], "left")


def hypotheses(cases: DataFrame, resamples: int = M.RESAMPLES) -> DataFrame:
    """A row for each hypothesis on two arms, with Holm's correction over those that can be tested."""
    return _corrected(reduce(DataFrame.unionByName, [_compared(cases, h, a, b, resamples) for h, (a, b) in HYPOTHESES.items()]))


def strata_difference(cases: DataFrame, arm: str = "A") -> DataFrame:
    """H2, one row: AUROC on reasoning-caused and retrieval-caused cases and their difference; not testable under LEAST cases or without both classes."""
    c = cases.where((F.col("arm") == arm) & F.col("risk_score").isNotNull())
    own = [M.auroc(_scored(c.where(F.col("stratum") == s))).withColumnRenamed("auroc", s.split("_")[0]) for s in ("reasoning_caused", "retrieval_caused")]
    n = c.agg(F.count_if(F.col("stratum") == "reasoning_caused").alias("n_reasoning"), F.count_if(F.col("stratum") == "retrieval_caused").alias("n_retrieval"))
    j = n.crossJoin(own[0]).crossJoin(own[1])  # one row each
    return j.withColumn("difference", F.col("reasoning") - F.col("retrieval")).withColumn("testable", (F.least("n_reasoning", "n_retrieval") >= LEAST) & F.col("difference").isNotNull())


def cost_curve(detections: DataFrame, costs: DataFrame) -> DataFrame:
    """H5: arms by AUROC, with tokens a question; arms without a score stay out."""
    return detections.where("auroc is not null").join(costs, "arm").select("arm", "auroc", "tokens_per_question").orderBy(F.desc("auroc"))


def contrasts(cases: DataFrame, baseline: str = "A", resamples: int = M.RESAMPLES) -> DataFrame:
    """What each arm of the ablation loses against the baseline, over all paired questions and over those both answered (family), with Holm's
    correction within a family; under LEAST errors a contrast is underpowered."""
    arms = {r.arm for r in cases.select("arm").distinct().collect()}  # a campaign's arms
    rows = [_compared(cases, f"{baseline}-{arm}", baseline, arm, resamples, family == "committed").withColumn("family", F.lit(family)).withColumn("removes", F.lit(what)) for arm, what in ABLATION.items() if arm in arms and arm != baseline for family in ("all", "committed")]
    if not rows:
        raise ValueError(f"no arm to set against {baseline}")
    return _corrected(reduce(DataFrame.unionByName, rows), "family").withColumn("underpowered", F.col("testable") & (F.col("errors") < LEAST))


def contrast_note(removes, p_value, significant, errors, underpowered):
    """The note of a contrast as it is stored (Columns)."""
    p = F.when(p_value == 0, F.lit(f"p<{1 / M.RESAMPLES:g}")).otherwise(F.concat(F.lit("p="), F.round(p_value, 4).cast("string")))
    said = F.when(significant.isNull(), "not entered into the correction").when(significant, "Holm significant").otherwise("Holm NOT significant")
    return F.concat(F.when(underpowered, "UNDERPOWERED; ").otherwise(""), F.concat_ws("; ", F.concat(F.lit("removes "), removes), p, said, F.concat(errors.cast("string"), F.lit(" error(s) in the paired set"))))


def case_study(cases: DataFrame, by: str, least: int = 15) -> DataFrame:
    """Questions, accuracy, disagreement and agreed errors of each cell, thin under `least`, the hardest first."""
    g = cases.groupBy(by).agg(F.count("*").alias("questions"), F.count_if("correct").alias("correct"), F.count_if(~F.col("agreed")).alias("disagreements"), F.count_if(F.col("agreed") & ~F.col("correct")).alias("both_agree_wrong"))
    g = g.withColumn("accuracy", F.try_divide("correct", "questions")).withColumn("disagreement_rate", F.try_divide("disagreements", "questions")).withColumn("thin", F.col("questions") < least)
    return g.orderBy(F.coalesce("accuracy", F.lit(1.0)), by)


def case_tables(answers: DataFrame, least: int = 15) -> dict[str, DataFrame]:
    """The tables of a case study of one arm.  answers: company, sector, question_type, correct, agreed, verdict, abstained, latency, tokens, provenance and kind
    (of an error), triggered, resolved.  headline has one row, also without answers: no rate is then defined, and none is zero."""
    wrong = answers.where("not correct")
    sums = answers.agg(
        F.count("*").alias("questions"), F.count_distinct("company").alias("companies"), F.count_if("correct").alias("correct"), F.count_if(~F.col("agreed")).alias("not_agreed"), F.count_if(F.col("verdict") == "DISAGREE").alias("disagreed"),
        F.count_if("abstained").alias("abstained"), F.count_if(F.col("agreed") & ~F.col("correct")).alias("both_wrong"), F.avg("tokens").alias("tokens_per_question"), F.count_if("triggered").alias("triggered"), F.count_if(F.col("triggered") & F.col("resolved")).alias("resolved"),
    )
    headline = sums.join(M.percentiles(answers, [], "latency", linear={"p50": 0.5, "p95": 0.95}), how="left")  # a row each
    sector = answers.groupBy("company").agg(F.min("sector").alias("sector"))
    count = lambda c: wrong.groupBy(F.coalesce(c, F.lit("unknown")).alias("name")).agg(F.count("*").alias("n"))
    return {"headline": headline, "companies": case_study(answers, "company", least).join(sector, "company"), "types": case_study(answers, "question_type", least), "provenance": count("provenance"), "kinds": count("kind")}


def _percent(x: Column) -> Column:
    return F.when(x.isNull(), "—").otherwise(F.format_string("%.1f%%", F.round(x * 100, 1)))


def case_lines(tables: dict[str, DataFrame], title: str, corpus: str = "", least: int = 15) -> DataFrame:
    """case_tables() as the lines of a Markdown file: (section, part, rank, name, line), to be sorted by the first four.
    Every table is a relation of lines, so that a study of many companies is never collected."""
    h, spark = tables["headline"], tables["headline"].sparkSession
    words = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    n, share = F.col("questions"), lambda c: F.try_divide(F.col(c), F.col("questions"))
    number = lambda c, places: F.when(F.col(c).isNull(), "—").otherwise(F.format_string(f"%.{places}f", F.round(F.col(c), places)))
    facts = [
        words("| Numerical accuracy | ", _percent(share("correct")), " |"), words("| No agreement: other figures, or none from a channel | ", _percent(share("not_agreed")), " |"),
        words("| Other figures (verdict DISAGREE) | ", F.col("disagreed"), " of ", n, " (", _percent(share("disagreed")), ") |"), words("| Abstention rate | ", _percent(share("abstained")), " |"),
        words("| **Agreed and both wrong** | ", F.col("both_wrong"), " of ", n, " |"), words("| Latency p50 / p95 | ", number("p50", 2), "s / ", number("p95", 2), "s |"), words("| Tokens per question | ", number("tokens_per_question", 0), " |"),
    ]
    first = [words("**", n, "** graded questions from ", F.col("companies"), " companies."), F.when(n < least, words("> **Fewer than ", str(least), " questions: no rate here is a finding.**"))]
    some = h.where("questions > 0")
    told = lambda section, lines, part=1: some.select(F.lit(section).alias("section"), F.lit(part).alias("part"), F.posexplode(F.array(*lines)).alias("rank", "line")).where("line is not null").select("section", "part", F.col("rank").cast("double").alias("rank"), F.lit("").alias("name"), "line")
    thin = F.when(F.col("thin"), "**thin cell**").otherwise("")
    cells = lambda section, t, by, *more: t.select(
        F.lit(section).alias("section"), F.lit(1).alias("part"), F.coalesce("accuracy", F.lit(1.0)).alias("rank"), F.coalesce(F.col(by), F.lit("")).alias("name"),
        words("| ", F.coalesce(by, F.lit("—")), *[x for c in more for x in (" | ", F.coalesce(c, F.lit("—")))], " | ", F.col("questions"), " | ", _percent(F.col("accuracy")), " | ", _percent(F.col("disagreement_rate")), " | ", F.col("both_agree_wrong"), " | ", thin, " |").alias("line"),
    )
    counted = lambda section, t: t.select(F.lit(section).alias("section"), F.lit(1).alias("part"), (-F.col("n")).cast("double").alias("rank"), "name", words("| ", F.col("name"), " | ", F.col("n"), " |").alias("line"))
    parts = [
        told(1, first), told(2, facts), cells(3, tables["companies"], "company", "sector"), cells(4, tables["types"], "question_type"), counted(5, tables["provenance"]), counted(6, tables["kinds"]),
        told(7, [words("The arbiter was asked for ", _percent(share("triggered")), " of the questions; it settled ", F.col("resolved"), " and left ", F.col("triggered") - F.col("resolved"), " open.")]),
    ]
    heads = {
        2: ["## Headline", "", "| | |", "|---|---|"], 3: ["## By company", "", "| Company | Sector | n | Accuracy | No agreement | Both wrong | |", "|---|---|---:|---:|---:|---:|---|"],
        4: ["## By type of question, the hardest first", "", "| Type | n | Accuracy | No agreement | Both wrong | |", "|---|---:|---:|---:|---:|---|"], 5: ["## Errors by provenance", "", "| Provenance | n |", "|---|---:|"],
        6: ["## Errors by kind", "", "| Kind | n |", "|---|---:|"], 7: ["## Arbitration", ""],
    }
    top = [f"# {title}", "", *([corpus, ""] if corpus else [])]
    fixed = spark.createDataFrame([(s, p, float(i), "", x) for s, p, lines in [(s, 0, lines) for s, lines in heads.items()] + [(s, 2, [""]) for s in range(1, 8)] for i, x in enumerate(lines)], "section int, part int, rank double, name string, line string")
    always = spark.createDataFrame([(0, 0, float(i), "", x) for i, x in enumerate(top)], fixed.schema)
    nothing = h.where("questions = 0").select(F.lit(1).alias("section"), F.lit(0).alias("part"), F.lit(0.0).alias("rank"), F.lit("").alias("name"), F.lit("No results yet: the campaign has not run. A table of zeros would say otherwise.").alias("line"))
    there = some.select(F.lit(True).alias("there"))  # a row, or none
    return reduce(DataFrame.unionByName, [always, nothing, fixed.crossJoin(F.broadcast(there)).drop("there"), *parts])


def report(cases: DataFrame, resamples: int = M.RESAMPLES, threshold: float | None = None) -> DataFrame:
    """stratified() of every arm, by arm and stratum, from one set of passes over all cases."""
    return stratified(cases, resamples, threshold, "arm")


def verdicts(cases: DataFrame, costs: DataFrame | None = None, resamples: int = M.RESAMPLES) -> DataFrame:
    """All five hypotheses in one table: name, testable, verdict (supported, not_supported, untestable, or described, for those without a test), the
    difference with its interval, p and Holm's decision over those tested.

    H2: reasoning-caused against retrieval-caused errors of arm A, unpaired and without a test; H5: arms that reach four fifths of arm A's
    AUROC gain over one half at half of its tokens (costs: arm, tokens_per_question); its difference is their number."""
    spark = cases.sparkSession
    tested = hypotheses(cases, resamples).select("name", "testable", "point", "low", "high", "p_value", "significant", F.when(~F.col("testable"), "untestable").when(F.coalesce("significant", F.lit(False)) & F.col("supported_before_correction"), "supported").otherwise("not_supported").alias("verdict"))
    nothing = {c: F.lit(None).cast(t) for c, t in (("low", "double"), ("high", "double"), ("p_value", "double"), ("significant", "boolean"))}
    h2 = strata_difference(cases).select(F.lit("H2").alias("name"), "testable", F.when(F.col("testable"), F.col("difference")).alias("point")).withColumns(nothing).withColumn("verdict", F.when(F.col("testable"), "described").otherwise("untestable"))
    out = tested.unionByName(h2.select(*tested.columns))
    if costs is None:
        return out
    curve = M.ranked_by(cases.where("risk_score is not null").select("arm", F.col("risk_score").alias("score"), (~F.col("correct")).cast("int").alias("label")), ["arm"]).where("auroc is not null").join(costs, "arm")
    full = curve.where("arm = 'A'").select(F.col("auroc").alias("whole"), F.col("tokens_per_question").alias("price"))  # a row at most
    cheap = curve.where("arm <> 'A'").crossJoin(F.broadcast(full)).agg(F.count_if((F.col("auroc") - 0.5 >= 0.8 * (F.col("whole") - 0.5)) & (F.col("tokens_per_question") <= 0.5 * F.col("price"))).alias("cheap"), F.count("*").alias("others"))
    h5 = cheap.select(F.lit("H5").alias("name"), (F.col("others") > 0).alias("testable"), F.col("cheap").cast("double").alias("point")).withColumns(nothing).withColumn("verdict", F.when(F.col("testable"), "described").otherwise("untestable"))
    return out.unionByName(h5.select(*tested.columns))


def campaign_report(cases: DataFrame, judged: DataFrame | None = None, runs: DataFrame | None = None, arbiter: DataFrame | None = None, resamples: int = M.RESAMPLES, threshold: float | None = None) -> dict[str, DataFrame]:
    """Every table of a campaign, each by arm: detection by stratum, agreement against correctness, errors by stratum, answers (judged: arm and as
    qa_report() takes them), cost (runs, as run_efficiency() takes them), arbitration (arbiter: arm and as arbitration() takes it), the
    hypotheses and the contrasts."""
    out = {
        "detection": report(cases, resamples, threshold), "contingency": M.contingency(cases, "arm"),
        "errors": cases.where("not correct").groupBy("arm", F.coalesce("stratum", F.lit("unknown")).alias("stratum")).agg(F.count("*").alias("n")),
    }
    if judged is not None:
        out["answers"] = M.qa_report_by(judged, "arm")
    if runs is not None:
        out["efficiency"] = run_efficiency(runs)
    if arbiter is not None:
        out["arbitration"] = arbitration(arbiter, "arm")
    out["hypotheses"] = verdicts(cases, out["efficiency"].select("arm", "tokens_per_question") if runs is not None else None, resamples)
    out["contrasts"] = contrasts(cases, resamples=resamples)
    return out


def melted(reports: DataFrame) -> DataFrame:
    """report() as rows (arm, stratum, metric, value, ci_low, ci_high, n), the way results are stored; only AUROC has an interval."""
    m = reports.select("arm", "stratum", "n", "low", "high", "auroc", "average_precision").unpivot(["arm", "stratum", "n", "low", "high"], ["auroc", "average_precision"], "metric", "value")
    has = F.col("metric") == "auroc"
    return m.select("arm", "stratum", "metric", "value", F.when(has, F.col("low")).alias("ci_low"), F.when(has, F.col("high")).alias("ci_high"), "n")
