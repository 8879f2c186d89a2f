"""Run records, registries and worksheets, with schemas given and never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import SCALES, parse
from ..operators.dataset import unique_qids
from ..operators.selection import percentiles

CHANNEL = "struct<available:boolean,applicable:boolean,failure_reason:string,value:string,canonical:string,usage:struct<prompt_tokens:bigint,completion_tokens:bigint,reasoning_tokens:bigint,reported_total_tokens:bigint,total_tokens:bigint,latency_seconds:double,cost_usd:double,cached:boolean>>"
RUN = f"question string, arm string, question_id string, answer string, abstained boolean, risk_score double, agreed boolean, verdict string, consistency_score double, natural {CHANNEL}, program {CHANNEL}, deterministic {CHANNEL}, tokens_used bigint, latency_seconds double, stratum string, error string, samples array<{CHANNEL}>, verification struct<triggered:boolean,available:boolean,resolution:string,resolved:boolean,value:string>"


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Append-only JSON lines; a torn last line is dropped."""
    return spark.read.schema(RUN).option("mode", "DROPMALFORMED").json(path)


def append_runs(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def remaining(grid: DataFrame, done: DataFrame) -> DataFrame:
    """The (arm, question_id) pairs that have no record yet."""
    return grid.join(done.select("arm", "question_id").distinct(), ["arm", "question_id"], "left_anti")


def usage_rows(runs: DataFrame) -> DataFrame:
    """A row for each call that recorded tokens, of the channels and of every sample (natural_sample), and the tokens that no call
    accounts for as a row of its own (unattributed)."""
    own = [F.struct(F.lit(c).alias("channel"), F.col(f"{c}.usage").alias("u")) for c in ("natural", "program", "deterministic") if c in runs.columns]
    parts = F.array(*own)
    if "samples" in runs.columns:
        parts = F.concat(parts, F.transform(F.coalesce("samples", F.array().cast(runs.schema["samples"].dataType)), lambda s: F.struct(F.lit("natural_sample").alias("channel"), s["usage"].alias("u"))))
    calls = runs.select("question_id", "arm", F.explode(parts).alias("c")).where("c.u is not null")
    total = F.greatest(F.coalesce("c.u.reported_total_tokens", F.lit(0)), F.coalesce("c.u.total_tokens", F.lit(0)))
    rows = calls.select("question_id", "arm", "c.channel", total.alias("tokens"), F.col("c.u.latency_seconds").alias("latency"), F.col("c.u.cost_usd").alias("cost")).where("tokens > 0")
    counted = rows.groupBy("question_id", "arm").agg(F.sum("tokens").alias("counted"))
    rest = runs.join(counted, ["question_id", "arm"], "left").select("question_id", "arm", F.lit("unattributed").alias("channel"), F.greatest(F.lit(0), F.coalesce("tokens_used", F.lit(0)) - F.coalesce("counted", F.lit(0))).alias("tokens"), F.lit(None).cast("double").alias("latency"), F.lit(None).cast("double").alias("cost"))
    return rows.unionByName(rest.where("tokens > 0"))


def run_efficiency(runs: DataFrame) -> DataFrame:
    """Per arm: questions, calls that recorded tokens, their tokens, tokens a question, tokens of no call, share of questions that went to the
    arbiter, median and 95th percentile of the latency, and tokens by channel."""
    u = usage_rows(runs)
    by = u.where("channel <> 'unattributed'").groupBy("arm", "channel").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("calls"))
    sums = by.groupBy("arm").agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "tokens")))).alias("tokens_by_channel"))  # a row for each channel
    rest = u.where("channel = 'unattributed'").groupBy("arm").agg(F.sum("tokens").alias("unattributed_tokens"))
    q = runs.groupBy("arm").agg(F.count("*").alias("questions"), F.avg(F.coalesce("verification.triggered", F.lit(False)).cast("double")).alias("trigger_rate"))
    late = percentiles(runs.select("arm", F.coalesce("latency_seconds", F.lit(0.0)).alias("latency")), ["arm"], "latency", linear={"p50": 0.5, "p95": 0.95})
    out = q.join(sums, "arm", "left").join(rest, "arm", "left").join(late, "arm", "left").fillna(0, ["calls", "tokens", "unattributed_tokens"])
    return out.select("arm", "questions", "calls", "tokens", (F.col("tokens") / F.col("questions")).alias("tokens_per_question"), "unattributed_tokens", "trigger_rate", "p50", "p95", "tokens_by_channel")


def answer_records(runs: DataFrame, gold: DataFrame) -> DataFrame:
    """Runs as rows to grade, one for each answer to a question of the gold (question_id, amount, unit_kind, currency, ambiguous): the
    prediction read again from the answer's text, and whether a program ran (null: none was asked)."""
    own = runs.select("arm", "question_id", parse(F.nullif("answer", F.lit(""))).alias("p"), F.coalesce("abstained", F.lit(False)).alias("abstained"), F.when(F.col("program").isNotNull(), F.coalesce("program.available", F.lit(False))).alias("program_executed"), "stratum")
    g = gold.select("question_id", F.col("amount").alias("gold"), F.col("unit_kind").alias("gold_kind"), F.col("currency").alias("gold_currency"), "ambiguous")
    return own.join(g, "question_id").select("arm", "question_id", F.col("p.amount").alias("prediction"), F.col("p.scale").alias("scale"), F.coalesce("p.unit_kind", F.lit("unknown")).alias("unit_kind"), F.col("p.currency").alias("currency"), "abstained", "program_executed", "stratum", "gold", "gold_kind", "gold_currency", "ambiguous")


def registered(files: DataFrame) -> DataFrame:
    """Files (path, content) of the binary source: a record for each distinct content."""
    r = files.select("path", F.sha2("content", 256).alias("sha256"), F.length("content").alias("bytes"), (F.substring("content", 1, 5) == F.lit(b"%PDF-")).alias("is_pdf"))
    return r.groupBy("sha256").agg(F.min("path").alias("path"), F.max("bytes").alias("bytes"), F.bool_or("is_pdf").alias("is_pdf")).withColumn("document_id", F.substring("sha256", 1, 16))


def write_worksheet(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


# --- chunks -------------------------------------------------------------------------------------

CHUNK_FIELDS = "chunk_id string, kind string, text string, document_id string, page int, section string, table_index int, part int, total_parts int, context_scale string, context_currency string, company string, fiscal_year string"


def chunk_json(chunks: DataFrame) -> DataFrame:
    """(document_id, value): each chunk as one JSON line with a fixed schema."""
    names = [f.split()[0] for f in CHUNK_FIELDS.split(", ")]
    own = [F.col(n) if n in chunks.columns else F.lit(None).alias(n) for n in names]
    return chunks.select("document_id", F.to_json(F.struct(*own)).alias("value"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """JSON lines in a folder for each document."""
    chunk_json(chunks).write.mode("overwrite").partitionBy("document_id").text(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks as written; a malformed line or a scale that no table of scales has stops the read."""
    rows = spark.read.schema(CHUNK_FIELDS).option("mode", "FAILFAST").json(path)
    known = F.col("context_scale").isNull() | F.col("context_scale").isin(list(SCALES))
    return rows.withColumn("context_scale", F.when(known, F.col("context_scale")).otherwise(F.raise_error(F.concat(F.lit("unknown scale: "), F.col("context_scale")))))


def block_texts(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """blocks (question, pos, chunk_id) with the page and text of their chunks; null where the chunk is not known."""
    return blocks.join(chunks.select("chunk_id", "page", "text"), "chunk_id", "left")


def retrieved_text(blocks: DataFrame) -> DataFrame:
    """(question, text): the texts of a question's blocks in order, joined by line ends."""
    own = F.array_sort(F.collect_list(F.struct("pos", F.nullif("text", F.lit("")).alias("text"))))
    return blocks.groupBy("question").agg(F.array_join(own["text"], "\n").alias("text"))


# --- gold sets, reports -------------------------------------------------------------------------

QUESTION = (
    "qid string, question string, company string, fiscal_year string, document_id string, answer struct<text:string,unit:string,source_page:int,source_note:string>, definition string, ambiguous boolean, question_type string, difficulty string, "
    "evidence array<struct<group_id:string,any_of:array<struct<page:int,printed_page:int,anchors:array<string>>>>>, validation struct<status:string,validator:string,validated_on:string,pass_number:int,notes:string,second_pass_agreed:boolean>, split string, provenance map<string,string>"
)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """The questions of a gold set's file, flat: answer, unit, status and validator as columns; a qid that stands twice stops the read."""
    q = spark.read.schema(f"set_id string, version string, questions array<struct<{', '.join(f'{a}: {b}' for a, b in (x.split(' ', 1) for x in _fields(QUESTION)))}>>").option("multiLine", True).json(path).select("set_id", "version", F.explode("questions").alias("q"))
    flat = q.select("set_id", "version", "q.*").withColumnsRenamed({"answer": "gold"})
    out = flat.withColumn("answer", F.col("gold.text")).withColumn("unit", F.col("gold.unit")).withColumn("status", F.coalesce("validation.status", F.lit("pending"))).withColumn("validator", F.col("validation.validator")).withColumn("second_pass_agreed", F.col("validation.second_pass_agreed"))
    out = out.withColumn("awaiting", F.coalesce(F.element_at("provenance", "answer_left_blank"), F.lit("")) != "").withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))
    return unique_qids(out)


def _fields(ddl: str) -> list[str]:
    """The fields of a DDL text, cut at the commas outside of brackets."""
    out, depth, now = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]


def write_dataset(questions: DataFrame, header: DataFrame, path: str) -> None:
    """One JSON document: the header (one row, counts among its columns) and the questions in order of qid.  A gold set is
    written by hand and small; it is one file by its format."""
    q = questions.agg(F.array_sort(F.collect_list(F.struct("qid", *[c for c in questions.columns if c != "qid"]))).alias("questions"))
    header.crossJoin(q).coalesce(1).write.mode("overwrite").json(path)


def file_manifest(files: DataFrame) -> DataFrame:
    """(path, sha256, bytes) of files (path, content) of the binary source."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.length("content").alias("bytes"))


def write_report(report: DataFrame, path: str) -> None:
    """A report's rows as JSON lines."""
    report.write.mode("overwrite").json(path)


def markdown(rows: DataFrame, title: str, columns: list[str], most: int = 1000) -> str:
    """A small table (at most `most` rows) as Markdown under a title; null: a dash, doubles with three places."""
    shown = [F.when(F.col(c).isNull(), "—").otherwise(F.format_number(c, 3) if dict(rows.dtypes)[c] == "double" else F.col(c).cast("string")).alias(c) for c in columns]
    lines = [" | ".join(r) for r in rows.select(*shown).limit(most).collect()]
    return "\n".join([f"# {title}", "", f"| {' | '.join(columns)} |", "|" + "---|" * len(columns), *[f"| {x} |" for x in lines]])


def write_lines(lines: DataFrame, path: str, *by: str) -> None:
    """Lines (a column line) as text in the order of by: files whose names follow each other, range-sorted and never collected."""
    lines.orderBy(*by).select("line").write.mode("overwrite").text(path)


def write_case_study(lines: DataFrame, path: str) -> None:
    """case_lines() as Markdown."""
    write_lines(lines, path, "section", "part", "rank", "name")


def write_retrieval_gold(gold: DataFrame, path: str) -> None:
    """retrieval_gold() as one JSON document for each document: its questions with their groups of places, and of which splits they are."""
    g = gold.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("qid", "question", "any_of"))).alias("questions"), F.array_sort(F.collect_set("split")).alias("splits"))
    label = F.when(F.array_contains("splits", "test"), "test").when(F.size("splits") == 0, "unknown").otherwise(F.array_join("splits", "+"))
    g.select("document_id", label.alias("split"), "questions").write.mode("overwrite").json(path)
