"""Reads and writes over the projected tables, as DataFrames: documents, answers, evidence, experiments, results.

Tables: documents (id, document_id, sha256, filename, company_id, fiscal_year, page_count), companies (id, name), experiments (id,
run_id, split, models), questions (id, qid, text, company, question_type, …), answers (id, experiment_id, question_id, arm, …), evidence (id,
question_id, group_id, page, anchors), results (id, experiment_id, arm, metric, stratum, value, …).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators.projection import insert_missing, upsert

#: The run that holds answers given live, which no statistic counts.
LIVE = "live"


def list_documents(documents: DataFrame, companies: DataFrame, limit: int = 100) -> DataFrame:
    d = documents.join(companies.select(F.col("id").alias("company_id"), F.col("name").alias("company")), "company_id", "left")
    return d.select("document_id", "filename", "company", "fiscal_year", "page_count").orderBy("document_id").limit(_limit(limit, 500))


def get_document(documents: DataFrame, companies: DataFrame, document_id: str) -> DataFrame:
    """One document, or no row."""
    return list_documents(documents.where(F.col("document_id") == document_id), companies, 1)


def document_labels(ids: DataFrame, documents: DataFrame, companies: DataFrame) -> DataFrame:
    """(document_id, label): company and year, else the file's name, else the id."""
    d = documents.join(companies.select(F.col("id").alias("company_id"), F.col("name").alias("company")), "company_id", "left")
    label = F.coalesce(F.nullif(F.concat_ws(" ", "company", "fiscal_year"), F.lit("")), F.nullif("filename", F.lit("")), F.col("document_id"))
    return ids.select("document_id").distinct().join(d.select("document_id", "company", "fiscal_year", "filename"), "document_id", "left").select("document_id", label.alias("label"))


def _limit(n: int, most: int) -> int:
    if not 1 <= n <= most:
        raise ValueError(f"limit must be between 1 and {most}")
    return n


def list_answers(answers: DataFrame, experiments: DataFrame, questions: DataFrame, run_id: str | None = None, arm: str | None = None, qid: str | None = None, limit: int = 200) -> DataFrame:
    """Answers with their run and question, newest first."""
    e, q = experiments.select(F.col("id").alias("experiment_id"), "run_id"), questions.select(F.col("id").alias("question_id"), "qid", F.col("text").alias("question"))
    e, q = (e if run_id is None else e.where(F.col("run_id") == run_id)), (q if qid is None else q.where(F.col("qid") == qid))
    a = answers if arm is None else answers.where(F.col("arm") == arm)
    return a.join(e, "experiment_id").join(q, "question_id").orderBy(F.desc("id")).limit(_limit(limit, 1000))


def get_answer(answers: DataFrame, experiments: DataFrame, questions: DataFrame, channels: DataFrame, evidence: DataFrame, verifications: DataFrame, answer_id: int) -> DataFrame:
    """One answer with its question, channels, gold evidence in order and verification."""
    a = list_answers(answers.where(F.col("id") == answer_id), experiments, questions, limit=1)
    c = channels.where(F.col("answer_id") == answer_id).groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("channel", "available", "value", "failure_reason"))).alias("channels"))
    asked = answers.where(F.col("id") == answer_id).select("question_id")
    g = evidence.join(asked, "question_id", "left_semi").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("page", "id", "group_id", "anchors"))).alias("evidence"))
    v = verifications.where(F.col("answer_id") == answer_id).select("answer_id", F.struct("triggered", "resolution", "resolved", "value").alias("verification"))
    return a.join(c, a["id"] == c["answer_id"], "left").drop("answer_id").join(g, "question_id", "left").join(v, a["id"] == v["answer_id"], "left").drop("answer_id")


def get_verification(verifications: DataFrame, answer_id: int) -> DataFrame:
    return verifications.where(F.col("answer_id") == answer_id)


def get_evidence(evidence: DataFrame, questions: DataFrame, qid: str) -> DataFrame:
    """A question's gold spans by page, then id."""
    q = questions.where(F.col("qid") == qid).select(F.col("id").alias("question_id"))
    return evidence.join(q, "question_id", "left_semi").orderBy("page", "id")


def list_arms(arms: DataFrame) -> DataFrame:
    """Configured arms, each name once, in order."""
    return arms.dropDuplicates(["name"]).orderBy("name")


def recorded_arms(answers: DataFrame) -> DataFrame:
    return answers.select("arm").distinct().orderBy("arm")


def list_experiments(experiments: DataFrame, answers: DataFrame, results: DataFrame) -> DataFrame:
    """Experiments with the number of their answers and results, counted apart, latest run first."""
    n = lambda t, name: t.groupBy(F.col("experiment_id").alias("id")).agg(F.count("*").alias(name))
    return experiments.join(n(answers, "answers"), "id", "left").join(n(results, "results"), "id", "left").fillna(0, ["answers", "results"]).orderBy(F.desc("run_id"))


def with_data(listed: DataFrame) -> DataFrame:
    """Experiments of list_experiments() that are not live and have answers or results."""
    return listed.where((F.col("run_id") != LIVE) & ((F.col("answers") > 0) | (F.col("results") > 0)))


def evaluation_results(results: DataFrame, experiments: DataFrame, run_id: str | None = None, arm: str | None = None, metric: str | None = None) -> DataFrame:
    """Measured values with their run, in one total order."""
    r = results.join(experiments.select(F.col("id").alias("experiment_id"), "run_id"), "experiment_id")
    for column, value in (("run_id", run_id), ("arm", arm), ("metric", metric)):
        r = r if value is None else r.where(F.col(column) == value)
    return r.orderBy("run_id", "arm", "metric", "stratum")


def corpus_stats(answers: DataFrame, experiments: DataFrame, **tables: DataFrame) -> DataFrame:
    """(relation, n): rows of each table, and answers and graded answers outside the live run."""
    own = answers.join(experiments.where(F.col("run_id") != LIVE).select(F.col("id").alias("experiment_id")), "experiment_id", "left_semi")
    out = own.agg(F.count("*").alias("answers"), F.count("correct").alias("graded")).unpivot([], ["answers", "graded"], "relation", "n")
    for name, t in tables.items():
        out = out.unionByName(t.agg(F.lit(name).alias("relation"), F.count("*").alias("n")))
    return out


def registered(documents: DataFrame, new: DataFrame) -> DataFrame:
    """documents and the new ones (sha256, filename) whose content is not known yet, their id the start of its hash."""
    return insert_missing(documents.select("document_id", "sha256", "filename"), new.select(F.substring("sha256", 1, 16).alias("document_id"), "sha256", "filename"), ["sha256"])


def ingest_registry(documents: DataFrame, companies: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """companies and documents with a registry's records (document_id, sha256, filename, company, fiscal_year, page_count): companies by name, documents by id."""
    names = records.where("coalesce(company, '') <> ''").select(F.col("company").alias("name")).distinct().join(companies, "name", "left_anti")
    top = companies.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    new = names.crossJoin(top).select((F.col("top") + F.row_number().over(Window.orderBy("name"))).alias("id"), "name")  # a row for each new company
    all_ = companies.select("id", "name").unionByName(new)
    rows = records.join(all_.withColumnsRenamed({"id": "company_id", "name": "company"}), "company", "left").select("document_id", "sha256", "filename", "company_id", "fiscal_year", "page_count")
    return upsert(documents.select(*rows.columns), rows, ["document_id"]), all_


def ingest_facts(old: DataFrame, facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Facts of known documents by their full key, amounts as decimals; those no longer found are gone for the documents that facts has."""
    key = ["document_id", "chunk_id", "row_label", "column_index"]
    live = facts.join(documents, "document_id", "left_semi").dropDuplicates(key)
    return old.join(live.select("document_id").distinct(), "document_id", "left_anti").unionByName(live.select(*old.columns))


def ingest_run(answers: DataFrame, records: DataFrame, questions: DataFrame, graded: DataFrame, experiment_id: int) -> DataFrame:
    """answers with a run's records (arm, qid, answer, risk_score, …): one for each known question and arm, earlier ones of the run replaced;
    those not graded (graded: arm, qid, correct, stratum) have null."""
    r = records.where("arm is not null and qid is not null").join(questions.select("qid", F.col("id").alias("question_id")), "qid").join(graded, ["arm", "qid"], "left")
    new = r.withColumn("experiment_id", F.lit(experiment_id).cast("long")).select(*answers.columns)
    return upsert(answers, new, ["experiment_id", "question_id", "arm"])


def ingest_results(results: DataFrame, rows: DataFrame, experiment_id: int) -> DataFrame:
    """results with a report's rows (arm, metric, stratum, value, …), by experiment, arm, metric and stratum."""
    return upsert(results, rows.withColumn("experiment_id", F.lit(experiment_id).cast("long")).select(*results.columns), ["experiment_id", "arm", "metric", "stratum"])


def persist_live(answers: DataFrame, record: DataFrame, experiment_id: int) -> DataFrame:
    """An answer given live, in place of the last one to the same question."""
    return upsert(answers, record.withColumn("experiment_id", F.lit(experiment_id).cast("long")).select(*answers.columns), ["experiment_id", "question_id", "arm"])
