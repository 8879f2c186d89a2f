"""Queries on gold sets, worksheets and checks of gold: every order is a question of its customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..operators import dataset as DS
from .base import query, rounded, table

_Q = """q AS (SELECT o_orderkey AS qid, o_custkey AS company, ['validated', 'pending', 'rejected', 'validated'][o_orderkey % 4 + 1] AS status, CASE WHEN o_orderkey % 5 <> 0 THEN round(o_totalprice, 2)::DECIMAL(18,2)::VARCHAR END AS answer, o_orderkey % 6 = 0 AS ambiguous, o_orderkey % 3 AS k FROM orders)"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("qid"), F.col("o_custkey").alias("company"), F.element_at(F.array(*[F.lit(s) for s in ("validated", "pending", "rejected", "validated")]), (k % 4 + 1).cast("int")).alias("status"),
        F.when(k % 5 != 0, F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string")).alias("answer"), F.lit("INR").alias("unit"), (k % 6 == 0).alias("ambiguous"), F.concat(F.lit("What was the consolidated figure of "), F.col("o_orderpriority"), F.lit("?")).alias("question"),
        F.when(k % 3 != 0, "as reported").alias("definition"), F.when(k % 7 != 0, F.array(F.struct(F.lit(12).alias("page"), F.array(F.lit("Revenue"), F.round("o_totalprice", 0).cast("long").cast("string")).alias("anchors")))).alias("evidence"),
        F.when(k % 8 != 0, "ann").alias("validator"), (k % 10 == 0).alias("awaiting"), F.lit("2023-24").alias("fiscal_year"), F.element_at(F.array(*[F.lit(s) for s in ("train", "validation", "test")]), (k % 3 + 1).cast("int")).alias("split"),
        F.lit(None).cast("boolean").alias("second_pass_agreed"),
    )


@query(f"WITH {_Q} SELECT count(*) AS total, count(*) FILTER (status = 'validated' AND answer IS NOT NULL) AS validated, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'validated' AND answer IS NOT NULL AND NOT ambiguous) AS main_set, count(*) FILTER (status = 'validated' AND answer IS NOT NULL AND ambiguous) AS ambiguity_subset FROM q")
def dataset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DS.counts(_questions(spark, sf_dir))


@query(f"WITH {_Q} SELECT qid FROM q WHERE k = 1 AND status = 'validated' AND answer IS NOT NULL AND NOT ambiguous")
def validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usable questions of the validation split."""
    return DS.split_of(_questions(spark, sf_dir), "validation").select("qid")


@query(f"""WITH {_Q}, p AS (SELECT qid, list_filter([CASE WHEN answer IS NULL AND qid % 10 <> 0 THEN 'no_gold_answer' END, CASE WHEN qid % 7 = 0 THEN 'no_evidence' END, CASE WHEN NOT ambiguous AND qid % 3 = 0 THEN 'no_definition' END,
CASE WHEN ambiguous AND qid % 3 <> 0 THEN 'ambiguous_with_definition' END, CASE WHEN status = 'validated' AND qid % 8 = 0 THEN 'no_validator' END], lambda x: x IS NOT NULL) AS p FROM q) SELECT qid, array_to_string(p, ',') AS problems FROM p WHERE len(p) > 0""")
def dataset_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions whose records break a rule, and which."""
    return DS.record_problems(_questions(spark, sf_dir)).select("qid", F.array_join("problems", ",").alias("problems"))


@query(f"""WITH {_Q}, n AS (SELECT company, count(*) AS n FROM q GROUP BY company), t AS (SELECT qid, company, row_number() OVER (PARTITION BY company ORDER BY qid) AS turn FROM q)
SELECT row_number() OVER (ORDER BY turn, n, company) AS position, qid, coalesce((SELECT answer FROM q x WHERE x.qid = t.qid), '') = '' AS blank, CASE WHEN qid % 7 <> 0 THEN 'p12: Revenue|' || round((SELECT o_totalprice FROM orders WHERE o_orderkey = qid), 0)::BIGINT::VARCHAR ELSE '' END AS evidence_anchors FROM t JOIN n USING (company)""")
def worksheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validation worksheet of all questions, companies in turns, the one with fewest first."""
    w = DS.worksheet(_questions(spark, sf_dir))
    return w.select("position", "qid", (F.col("candidate_answer") == "").alias("blank"), F.coalesce("evidence_anchors", F.lit("")).alias("evidence_anchors"))


def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filled worksheet: verdicts by key, some unknown; every ninth answer corrected, every eighteenth to no figure."""
    k = F.col("o_orderkey")
    verdict = F.element_at(F.array(*[F.lit(v) for v in (" Validated", "rejected", "needs review", "", "maybe")]), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").where(k % 2 == 0).select(k.alias("qid"), verdict.alias("verdict"), F.when(k % 18 == 0, "unclear").when(k % 9 == 0, "77").alias("corrected_answer"), F.lit(None).cast("string").alias("corrected_unit"))


_I = f"""{_Q}, v AS (SELECT qid, status, answer, qid % 2 = 0 AND qid % 5 < 3 AS known, qid % 2 = 0 AND qid % 5 = 4 AS unread, qid % 2 = 0 AND qid % 5 < 3 AND qid % 18 = 0 AS fixed, ['validated', 'rejected', 'needs_review'][qid % 5 + 1] AS said FROM q),
i AS (SELECT qid, CASE WHEN fixed THEN 'unclear' ELSE answer END AS answer, CASE WHEN fixed THEN 'needs_review' WHEN known THEN said ELSE status END AS status, CASE WHEN fixed THEN 'needs_review' WHEN known THEN said WHEN unread THEN 'unrecognised' ELSE 'untouched' END AS change, fixed AS corrected, fixed AND qid % 7 <> 0 AS anchors_invalidated FROM v)"""


@query(f"WITH {_I} SELECT qid, coalesce(answer, '-') AS answer, status, change, corrected, anchors_invalidated FROM i")
def import_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions after a worksheet came back."""
    i = DS.imported(_questions(spark, sf_dir), _sheet(spark, sf_dir), "ann")
    return i.select("qid", F.coalesce("answer", F.lit("-")).alias("answer"), "status", "change", "corrected", "anchors_invalidated")


@query(f"WITH {_I} SELECT count(*) FILTER (change = 'validated') AS validated, count(*) FILTER (change = 'rejected') AS rejected, count(*) FILTER (change = 'needs_review') AS needs_review, count(*) FILTER (change IN ('untouched', 'unrecognised')) AS untouched, count(*) FILTER (change = 'unrecognised') AS problems, count(*) FILTER (corrected) AS corrections, count(*) FILTER (anchors_invalidated) AS anchors_invalidated FROM i")
def import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DS.import_report(DS.imported(_questions(spark, sf_dir), _sheet(spark, sf_dir), "ann"))


@query("""WITH n AS (SELECT count(*) AS n FROM orders) SELECT o_orderkey AS qid FROM orders, n QUALIFY row_number() OVER (ORDER BY md5('20260826' || o_orderkey::VARCHAR), o_orderkey) <= greatest(1, round_even(n * 0.2::DOUBLE, 0))""")
def double_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifth of all questions that is validated twice, by hash."""
    return DS.double_pass(_questions(spark, sf_dir)).select("qid")


_PAGES = r"""p AS (SELECT conv_id, turn, lower(trim(regexp_replace(coalesce(text, ''), '[\s\x{A0}]+', ' ', 'g'))) || ' total ' || (conv_id * 1000 + turn)::VARCHAR || ' end' AS t FROM conversations)"""


def _filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a filing: a page for each turn, which ends in a labelled figure of its own."""
    c = table(spark, sf_dir, "conversations")
    figure = (F.col("conv_id") * 1000 + F.col("turn")).cast("string")
    return c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page"), F.concat(F.coalesce("text", F.lit("")), F.lit("\nTotal "), figure, F.lit(" end")).alias("text"))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One claim for each filing: the figure of its first page, cited there, a page off, or far away; figures no page has."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("turn").alias("first"))
    k = F.col("conv_id")
    return c.select(k.alias("qid"), k.alias("document_id"), F.lit("Total").alias("label"), F.when(k % 5 == 0, "").when(k % 5 == 4, "98765432123").otherwise((k * 1000 + F.col("first")).cast("string")).alias("figure"), (F.col("first") + F.when(k % 5 == 2, 1).when(k % 5 == 3, 50).otherwise(0)).cast("long").alias("cited"))


@query(f"""WITH {_PAGES}, c AS (SELECT conv_id, min(turn) AS first FROM conversations GROUP BY conv_id), v AS (SELECT conv_id, first, conv_id % 5 AS k, (conv_id * 1000 + first)::VARCHAR AS f FROM c),
h AS (SELECT v.conv_id, min(turn) AS page, count(*) AS n FROM v JOIN p ON p.conv_id = v.conv_id AND contains(t, f) AND contains(t, 'total') WHERE k IN (1, 2, 3) AND length(f) >= 3 GROUP BY v.conv_id)
SELECT v.conv_id AS qid, CASE WHEN k = 0 THEN 'no_candidate' WHEN length(f) < 3 AND k <> 4 THEN CASE WHEN k = 3 THEN 'not_found' ELSE 'short_figure' END WHEN k = 4 OR h.page IS NULL THEN 'not_found' WHEN k = 3 AND NOT EXISTS (SELECT 1 FROM p WHERE p.conv_id = v.conv_id AND abs(turn - first - 50) <= 1 AND contains(t, f)) THEN 'elsewhere' ELSE 'on_cited_page' END AS precheck FROM v LEFT JOIN h ON h.conv_id = v.conv_id""")
def prechecked_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a machine finds of each claim on its cited page, beside it, and elsewhere."""
    p = _filing(spark, sf_dir).select("document_id", "page", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("lines"))
    return DS.prechecked(_claims(spark, sf_dir), p).select("qid", "precheck")


@query(f"""WITH {_PAGES}, c AS (SELECT conv_id, min(turn) AS first FROM conversations GROUP BY conv_id), v AS (SELECT conv_id, conv_id % 5 AS k, (conv_id * 1000 + first)::VARCHAR AS f FROM c)
SELECT v.conv_id AS qid, turn AS page, 'total' AS label FROM v JOIN p ON p.conv_id = v.conv_id AND contains(t, f) WHERE k IN (1, 2, 3) AND length(f) >= 3""")
def located_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that hold each claim's label and figure in one of its printed forms."""
    return DS.located(_filing(spark, sf_dir), _claims(spark, sf_dir)).select("qid", "page", "label")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'right_basis' WHEN 1 THEN 'wrong_basis' ELSE 'mixed_or_unknown' END AS verdict FROM orders""")
def basis_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the pages cited have the basis that each question asks for."""
    k = F.col("o_orderkey")
    q = table(spark, sf_dir, "orders").select(k.alias("qid"), k.alias("document_id"), F.when(k % 4 == 3, "What was revenue?").otherwise("What was consolidated revenue?").alias("question"), F.array(F.lit(1), F.lit(2)).alias("pages"))
    b = table(spark, sf_dir, "orders").select(k.alias("document_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("page")).withColumn("basis", F.when(F.col("document_id") % 4 == 1, "standalone").when((F.col("document_id") % 4 == 2) & (F.col("page") == 2), "standalone").otherwise("consolidated"))
    return DS.basis_audit(q, b).select(F.col("qid").alias("o_orderkey"), "verdict")


@query("""WITH l AS (SELECT l_orderkey, list(round(l_extendedprice * 100)::BIGINT) AS prices, max(l_extendedprice) AS last FROM lineitem GROUP BY l_orderkey), a AS (SELECT o_orderkey, o_orderstatus, o_totalprice, prices, round(CASE WHEN month(o_orderdate) % 2 = 0 THEN last ELSE o_totalprice END * 100)::BIGINT AS cents FROM orders JOIN l ON l_orderkey = o_orderkey)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE (cents // 100)::VARCHAR || '.' || lpad((cents % 100)::VARCHAR, 2, '0') END AS figure, NOT list_contains(prices, cents) AS contradicts, CASE WHEN o_totalprice >= 200000 THEN 'crore' WHEN o_totalprice >= 100000 THEN 'lakhs' END AS conflict FROM a""")
def reviewed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as a reviewer wrote them: an order's highest price or its total as a figure, in a conclusion or in words; the prices that its lines cite; scales
    given to quotients."""
    l = table(spark, sf_dir, "lineitem")
    own = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("page"), F.array(F.lit("Price"), F.format_number("l_extendedprice", 2)).alias("anchors")))).alias("evidence"), F.max("l_extendedprice").alias("last"))
    o = table(spark, sf_dir, "orders").join(own, "o_orderkey")
    number = F.format_number(F.when(F.month("o_orderdate") % 2 == 0, F.col("last")).otherwise(F.col("o_totalprice")), 2)
    said = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" "), number, F.lit(" %"))).when(F.col("o_orderstatus") == "O", F.concat(F.lit("Working: by hand.\nConclusion: the margin is "), number, F.lit(" percent"))).otherwise("not clear")
    unit = F.when(F.col("o_totalprice") >= 200000, "INR crore").when(F.col("o_totalprice") >= 100000, "lakhs").otherwise("%")
    return o.select("o_orderkey", X.bare_figure(said).alias("figure"), X.contradicts_anchors(number, X.anchors_text(F.col("evidence"))).alias("contradicts"), X.unit_conflict(F.lit("What was the net margin?"), F.lit(""), unit).alias("conflict"))


@query("""WITH p AS (SELECT o_orderkey, o_orderkey % 2 = 1 AS minus, (round(o_totalprice * 100))::BIGINT::VARCHAR AS w, o_orderkey % 3 = 0 AS frac FROM orders),
g AS (SELECT *, CASE WHEN length(w) <= 3 THEN w ELSE regexp_replace(reverse(regexp_replace(reverse(substr(w, 1, length(w) - 3)), '(\\d{2})', '\\1,', 'g')), '^,', '') || ',' || right(w, 3) END AS indian FROM p)
SELECT o_orderkey, indian || CASE WHEN frac THEN '.5' ELSE '' END AS indian, (CASE WHEN length(w) > 5 THEN 3 WHEN length(w) > 3 THEN 2 ELSE 1 END * CASE WHEN frac THEN 2 ELSE 1 END * CASE WHEN minus THEN 3 ELSE 1 END)::INT AS forms FROM g""")
def figure_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices in hundredths, some negative, some with a half, in all forms that a report prints."""
    k = F.col("o_orderkey")
    figure = F.concat(F.when(k % 2 == 1, "-").otherwise(""), F.round(F.col("o_totalprice") * 100).cast("long").cast("string"), F.when(k % 3 == 0, ".50").otherwise(""))
    o = table(spark, sf_dir, "orders").select("o_orderkey", V.figure_variants(figure).alias("v"), (k % 3 == 0).alias("frac"))
    own = F.filter("v", lambda x: x.rlike(r"^\d{1,2}(,\d{2})*,\d{3}(\.5)?$") & (x.contains(".") == F.col("frac")))
    short = F.filter("v", lambda x: ~x.rlike(r"[-(,]") & (x.contains(".") == F.col("frac")))
    return o.select("o_orderkey", F.coalesce(F.get(own, F.lit(0)), F.get(short, F.lit(0))).alias("indian"), F.size("v").alias("forms"))
