"""The projected tables as a whole: deletes that follow foreign keys, runs that replace their children, and the full ingest.

A store is a folder of tables, each at the path its newest manifest row names.  A step writes its table only where its rows changed (a digest that
does not depend on their order tells), and its manifest row last: an ingest that stopped is simply started again, steps that are in
change nothing, and the same sources twice change nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import latest, record

#: (child, its column, parent, its column), parents first.
RELATIONS = [
    ("documents", "company_id", "companies", "id"), ("facts", "document_id", "documents", "document_id"), ("evidence", "question_id", "questions", "id"), ("answers", "question_id", "questions", "id"), ("answers", "experiment_id", "experiments", "id"),
    ("reasoning_runs", "answer_id", "answers", "id"), ("program_runs", "answer_id", "answers", "id"), ("verification_runs", "answer_id", "answers", "id"), ("hallucination_events", "answer_id", "answers", "id"), ("results", "experiment_id", "experiments", "id"),
]

_CHANNEL = "id long, answer_id long, model string, available boolean, failure_reason string, value string, canonical double"
TABLES = {
    "companies": "id long, name string",
    "documents": "document_id string, sha256 string, filename string, company_id long, fiscal_year string, page_count int",
    "facts": "document_id string, chunk_id string, row_label string, column_index int, amount decimal(38,6)",
    "questions": "id long, qid string, text string, document_id string, split string, gold_text string, gold_unit string, validation_status string",
    "evidence": "question_id long, group_id string, page int, anchors array<string>",
    "experiments": "id long, run_id string, source_path string, natural_model string, program_model string",
    "answers": "id long, experiment_id long, question_id long, arm string, answer_text string, abstained boolean, agreed boolean, verdict string, consistency_score double, risk_score double, correct boolean, stratum string, latency_seconds double, error string",
    "reasoning_runs": _CHANNEL, "program_runs": _CHANNEL,
    "verification_runs": "id long, answer_id long, triggered boolean, available boolean, resolution string, resolved boolean, value string",
    "hallucination_events": "id long, answer_id long, provenance string, kind string, label_confidence string, counts_as_hallucination boolean",
    "results": "experiment_id long, arm string, metric string, stratum string, value double",
}
MANIFEST = "collection string, version long, built_at timestamp, path string, n long, digest string"


def key_of(*columns: str) -> Column:
    """A number for a natural key: the same in every run, so that no step has to hand out numbers."""
    return F.xxhash64(*columns)


def cascade(tables: dict[str, DataFrame], root: str, gone: DataFrame, relations: list[tuple[str, str, str, str]] = RELATIONS) -> dict[str, DataFrame]:
    """The tables without the rows of root whose key gone (one column, named as the key) holds, and without everything that refers to them, directly
    or through others.  Keyed anti-joins all the way; no key comes to the driver.  Relations name parents first; a row without a parent's key stays."""
    out, lost = dict(tables), {}
    column = gone.columns[0]
    lost[root] = tables[root].join(gone.distinct(), column, "left_semi")
    out[root] = tables[root].join(gone.distinct(), column, "left_anti")
    for child, own, parent, key in relations:
        if parent not in lost or child not in out:
            continue
        dead = lost[parent].select(F.col(key).alias(own)).distinct()
        hit = out[child].join(dead, own, "left_semi")
        lost[child] = hit if child not in lost else lost[child].unionByName(hit)
        out[child] = out[child].join(dead, own, "left_anti")
    return out


def run_rows(records: DataFrame, questions: DataFrame, graded: DataFrame, run_id: str, config: dict) -> dict[str, DataFrame]:
    """A run's records (arm, question_id, answer, …, natural, program, verification as structs) as rows of the answers and of all their children.

    Records without arm or question and those of unknown questions are left out; graded (arm, qid, correct, stratum, label struct) says
    what was right, and what it does not say stays null.  Of two records of a question and arm the last by written stays."""
    experiment = key_of("run_id")
    r = records.where("arm is not null and question_id is not null").withColumn("run_id", F.lit(run_id))
    r = r.groupBy("run_id", "arm", "question_id").agg(F.max_by(F.struct(*[c for c in r.columns if c not in ("run_id", "arm", "question_id")]), "written").alias("r")).select("run_id", "arm", "question_id", "r.*")
    r = r.join(questions.select(F.col("qid").alias("question_id"), F.col("id").alias("question")), "question_id").join(graded.withColumnRenamed("qid", "question_id"), ["arm", "question_id"], "left")
    r = r.withColumn("experiment", experiment).withColumn("id", key_of("experiment", "question", "arm"))
    no = lambda c: F.coalesce(c, F.lit(False))
    answers = r.select("id", F.col("experiment").alias("experiment_id"), F.col("question").alias("question_id"), "arm", F.col("answer").alias("answer_text"), no(F.col("abstained")).alias("abstained"), "agreed", "verdict", "consistency_score", "risk_score", "correct", "stratum", "latency_seconds", "error")

    def channel(name: str) -> DataFrame:
        c = F.col(name)
        return r.where(c.isNotNull()).select(key_of("id", "arm").alias("id"), F.col("id").alias("answer_id"), F.lit(config.get(f"{name}_model")).cast("string").alias("model"), no(c["available"]).alias("available"), c["failure_reason"].alias("failure_reason"), c["value"].alias("value"), c["canonical"].cast("double").alias("canonical"))

    v, label = F.col("verification"), F.col("label")
    return {
        "answers": answers, "reasoning_runs": channel("natural"), "program_runs": channel("program"),
        "verification_runs": r.select(key_of("id", "arm").alias("id"), F.col("id").alias("answer_id"), no(v["triggered"]).alias("triggered"), no(v["available"]).alias("available"), v["resolution"].alias("resolution"), no(v["resolved"]).alias("resolved"), v["value"].alias("value")),
        "hallucination_events": r.where(label.isNotNull()).select(
            key_of("id", "arm").alias("id"), F.col("id").alias("answer_id"), F.coalesce(label["provenance"], F.lit("undetermined")).alias("provenance"), F.coalesce(label["kind"], F.lit("unclassified")).alias("kind"),
            F.coalesce(label["confidence"], F.lit("needs_human")).alias("label_confidence"), F.coalesce(label["counts_as_hallucination"], F.lit(True)).alias("counts_as_hallucination"),
        ),
    }


def replaced(tables: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """tables with a run's rows: its answers replace those of the same id, and their old children all go, also where there is no new one."""
    ids = new["answers"].select("id")
    of = ids.withColumnRenamed("id", "answer_id")
    old = {t: tables[t].join(of, "answer_id", "left_anti") if t != "answers" else tables[t].join(ids, "id", "left_anti") for t in new}
    return {**tables, **{t: old[t].unionByName(new[t]) for t in new}}


# --- the store ------------------------------------------------------------------------------------


def load(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the store as it is now; one never written is empty."""
    now = latest(spark, f"{path}/manifest", MANIFEST, name)
    return spark.read.schema(TABLES[name]).parquet(now.path) if now else spark.createDataFrame([], TABLES[name])


def save(spark: SparkSession, path: str, name: str, rows: DataFrame) -> tuple[int, bool]:
    """(rows, whether anything changed).  The table is written first; its manifest row, which makes it live, only if its digest is new."""
    now = latest(spark, f"{path}/manifest", MANIFEST, name)
    own = f"{path}/tables/{name}/{uuid.uuid4().hex}"
    columns = spark.createDataFrame([], TABLES[name]).schema
    rows.select(*[F.col(f.name).cast(f.dataType) for f in columns]).write.parquet(own)
    made = spark.read.schema(columns).parquet(own).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*columns.names).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest")).first()
    if now and (now.n, now.digest) == (made.n, made.digest):
        return now.n, False
    row = spark.createDataFrame([(name, (now.version if now else 0) + 1, own, made.n, made.digest)], "collection string, version long, path string, n long, digest string")
    record(row.withColumn("built_at", F.current_timestamp()), f"{path}/manifest")
    return made.n, True


def ingest(spark: SparkSession, path: str, registry: DataFrame | None = None, facts: DataFrame | None = None, dataset: DataFrame | None = None, runs: dict[str, tuple[DataFrame, DataFrame, dict]] | None = None, reports: dict[str, DataFrame] | None = None) -> dict[str, tuple[int, bool]]:
    """Everything that is given, in order of dependency; {table: (rows, changed)}.

    registry (document_id, sha256, filename, company, fiscal_year, page_count): documents by id and companies by name are added or updated.
    facts (document_id, chunk_id, row_label, column_index, amount): all that are live; what is no longer among them goes.
    dataset (qid, question, document_id, split, answer, unit, status, evidence): questions by qid, each with its evidence replaced.
    runs: run_id to (records, graded, config), as run_rows() takes them.  reports: run_id to rows (arm, metric, stratum, value)."""
    counts: dict[str, tuple[int, bool]] = {}

    def put(name: str, rows: DataFrame) -> None:
        n, changed = save(spark, path, name, rows)
        counts[name] = n, changed or counts.get(name, (0, False))[1]

    def upsert(name: str, rows: DataFrame, *key: str) -> None:
        new = rows.dropDuplicates(list(key))
        put(name, load(spark, path, name).join(new.select(*key), list(key), "left_anti").unionByName(new.select(*load(spark, path, name).columns)))

    if registry is not None:
        named = registry.where("coalesce(company, '') <> ''").select(F.col("company").alias("name")).distinct()
        upsert("companies", named.select(key_of("name").alias("id"), "name"), "name")
        upsert("documents", registry.withColumn("company_id", F.when(F.coalesce("company", F.lit("")) != "", key_of("company"))), "document_id")
    if facts is not None:
        put("facts", facts.join(load(spark, path, "documents").select("document_id"), "document_id", "left_semi").dropDuplicates(["document_id", "chunk_id", "row_label", "column_index"]))
    if dataset is not None:
        q = dataset.dropDuplicates(["qid"]).withColumn("id", key_of("qid"))
        upsert("questions", q.join(load(spark, path, "documents").select("document_id", F.col("document_id").alias("known")), "document_id", "left").select("id", "qid", F.col("question").alias("text"), F.col("known").alias("document_id"), "split", F.col("answer").alias("gold_text"), F.col("unit").alias("gold_unit"), F.col("status").alias("validation_status")), "qid")
        spans = q.select(F.col("id").alias("question_id"), F.explode("evidence").alias("g")).select("question_id", F.coalesce("g.group_id", F.lit("")).alias("group_id"), F.explode("g.any_of").alias("s")).select("question_id", "group_id", "s.page", "s.anchors")
        put("evidence", load(spark, path, "evidence").join(q.select(F.col("id").alias("question_id")), "question_id", "left_anti").unionByName(spans))
    for run_id, (records, graded, config) in sorted((runs or {}).items()):
        one = spark.createDataFrame([(run_id, config.get("source_path"), config.get("natural_model"), config.get("program_model"))], "run_id string, source_path string, natural_model string, program_model string")
        upsert("experiments", one.withColumn("id", key_of("run_id")), "run_id")
        new = run_rows(records, load(spark, path, "questions"), graded, run_id, config)
        after = replaced({t: load(spark, path, t) for t in new}, new)
        for t in [t for t in new if t != "answers"] + ["answers"]:  # children first: an answer that is in has its own
            put(t, after[t])
    for run_id, rows in sorted((reports or {}).items()):
        upsert("results", rows.withColumn("experiment_id", F.xxhash64(F.lit(run_id))), "experiment_id", "arm", "metric", "stratum")
    return counts
