"""Ordered and document queries over events, documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dataset as DS
from ..operators import documents as D
from ..operators import windows as W
from .base import query, rounded, table

_LETTERS = r"length(regexp_replace(coalesce(text, ''), '[^\p{L}]', '', 'g'))"


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS v_filled, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS v_source
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def ffill_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's last purchase so far and where it was."""
    e = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value")))
    return W.forward_fill(e, ["user_id"], ["ts", "event_id"], "v", "event_id").select("event_id", "user_id", "v_filled", "v_source")


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events), m AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY pos) AND pos > 1 THEN 0 ELSE 1 END AS new FROM o),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM m) SELECT user_id, run::BIGINT AS run, event_type, min(pos) AS first, max(pos) AS last, count(*) AS n FROM r GROUP BY user_id, run, event_type""")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of one event type in each user's order."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return W.runs(e, ["user_id"], ["pos"], "event_type").select("user_id", "run", "event_type", "first", "last", "n")


@query("""SELECT event_id, count(*) OVER w AS requests, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) OVER w::BIGINT AS weight
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)""")
def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and tokens in the hour up to each event of a user."""
    e = table(spark, sf_dir, "events")
    return W.sliding_rate(e, ["user_id"], "ts", 3600, F.get_json_object("props", "$.k").cast("long")).select("event_id", "requests", "weight")


@query("""WITH p AS (SELECT doc_id // 5 AS source, doc_id, unnest(list_distinct(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(rtrim(x, chr(13)))))) AS line FROM (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN 'Report of group ' || (doc_id // 5)::VARCHAR || chr(10) ELSE '' END || coalesce(text, '') AS text FROM documents)),
n AS (SELECT doc_id // 5 AS source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY 1), s AS (SELECT source, line, count(DISTINCT doc_id) AS on_pages FROM p WHERE length(line) BETWEEN 4 AND 119 AND NOT regexp_matches(line, '^[0-9]+$') GROUP BY ALL)
SELECT source, md5(line) AS line, on_pages, pages FROM s JOIN n USING (source) WHERE pages >= 4 AND on_pages >= greatest(3, pages // 2)""")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on half of the documents of each five that follow each other; four of them open with a header."""
    five = F.floor(F.col("doc_id") / 5)
    d = table(spark, sf_dir, "documents").withColumn("source", five).withColumn("text", F.concat(F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("Report of group "), five.cast("string"), F.lit("\n"))).otherwise(""), F.coalesce("text", F.lit(""))))
    return W.repeated_lines(d, "source", "doc_id", "text").select("source", F.md5("line").alias("line"), "on_pages", "pages")


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('20260826' || doc_id::VARCHAR), doc_id) AS i, round_even(count(*) OVER (PARTITION BY lang) * 0.3::DOUBLE, 0) AS cut FROM documents)
SELECT doc_id, lang, CASE WHEN i <= cut THEN 'development' WHEN i <= 2 * cut THEN 'validation' ELSE 'test' END AS split FROM r""")
def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.split_30_30_40(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", ["lang"], "20260826").select("doc_id", "lang", "split")


@query("""WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY source), r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents)
SELECT doc_id, source, row_number() OVER (ORDER BY turn, n, source) AS position FROM r JOIN g USING (source)""")
def balanced_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in the order in which sources take turns, the smallest source first."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), F.col("source").alias("company"))
    return DS.interleaved(d).select(F.col("qid").alias("doc_id"), F.col("company").alias("source"), "position")


@query(f"""SELECT lang, count(*) AS documents, count(*) FILTER (length(trim(coalesce(text, ''))) < 60) AS needs_ocr, count(*) FILTER ({_LETTERS} >= 0.45 * length(text) AND length(text) > 0 AND len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: regexp_matches(w, '\\p{{L}}'))) >= 8) AS prose,
sum(length(text) // 4)::BIGINT AS approx_tokens FROM documents GROUP BY lang""")
def extraction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: documents, those with too little text, those that are prose, tokens at four letters each."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count("*").alias("documents"), F.count_if(F.length(F.trim(F.coalesce(t, F.lit("")))) < 60).alias("needs_ocr"), F.count_if(X.is_prose(t)).alias("prose"),
        F.sum(F.floor(F.length(t) / 4)).cast("long").alias("approx_tokens"),
    )


@query("""SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS lines, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: contains(x, '|'))) AS pipe_lines FROM documents""")
def table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each document are rows between pipes."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(lines).alias("lines"), F.size(F.filter(lines, lambda x: X.pipe_cells(x).isNotNull())).alias("pipe_lines"))


@query()
def packed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into chunks of whole sentences with an overlap."""
    return D.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 1200, 200).select("doc_id", "part", "total_parts", F.length("chunk").alias("n_chars"), F.sha2("chunk", 256).alias("chunk_sha256"))


_BLOCK = """'[E' || turn::VARCHAR || '] p.' || turn::VARCHAR || ' | ' || role || ' | figures in INR crore' || chr(10) || CASE WHEN length(trim(coalesce(text, ''))) > 120 THEN substr(trim(coalesce(text, '')), 1, 120) || chr(10) || '... [evidence truncated]' ELSE trim(coalesce(text, '')) END"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("turn").cast("string")
    block = X.evidence_block(F.concat(F.lit("E"), n), F.concat(F.lit("p."), n), F.col("role"), F.lit("INR"), F.lit("crore"), F.col("text"), 120)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", block.alias("block"))


@query(f"SELECT conv_id, turn, md5({_BLOCK}) AS shown FROM conversations")
def evidence_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a block of evidence, cut at 120 letters."""
    return _blocks(spark, sf_dir).select("conv_id", "turn", F.md5("block").alias("shown"))


@query(f"""SELECT conv_id, md5(coalesce(string_agg(CASE WHEN role = 'user' THEN {_BLOCK} END, chr(10) || chr(10) ORDER BY turn), 'NO EVIDENCE WAS RETRIEVED.' || chr(10) || 'You must not answer from prior knowledge. Report that the evidence needed to answer is unavailable.')) AS prompt, count(*) AS turns FROM conversations GROUP BY conv_id""")
def evidence_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's turns of a conversation in order, as the evidence of one prompt."""
    own = F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "block"))))
    return _blocks(spark, sf_dir).groupBy("conv_id").agg(F.md5(X.evidence_text(own["block"])).alias("prompt"), F.count("*").alias("turns"))


@query("""SELECT conv_id, turn, ('0x' || substr(sha256(text), 1, 2))::INT % 2 = 1 AS swapped, 'FI' || substr(sha256(conv_id::VARCHAR || '|' || turn::VARCHAR || '|' || role), 1, 8) AS qid FROM conversations""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of presentation and stable question ids."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.swapped(F.col("text")).alias("swapped"), X.stable_id("FI", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("role")).alias("qid"))


@query("""WITH y AS (SELECT o_orderkey, year(o_orderdate) + 20 AS y FROM orders) SELECT o_orderkey, y::VARCHAR || '-' || lpad(((y + 1) % 100)::VARCHAR, 2, '0') AS fiscal_year,
CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS named, array_to_string(list_transform(range(y, y + 12), lambda k: k::VARCHAR || '-' || lpad(((k + 1) % 100)::VARCHAR, 2, '0')), ',') AS window FROM y""".replace(" AS window", ' AS "window"'))
def fiscal_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fiscal year written in two ways in a question and read back, every other time beside another; the years that may report it."""
    y = F.year("o_orderdate") + 20
    asked = F.concat(F.lit("Revenue for the year ended March 31, "), (y + 1).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(", as in FY "), X.fiscal_label(y))).otherwise(F.concat(F.lit(" against "), X.fiscal_label(y - 1))))
    o = table(spark, sf_dir, "orders").select("o_orderkey", X.fiscal_years(asked).alias("years"), X.only_fiscal_year(asked).alias("only"), X.fiscal_window(y).alias("w"))
    return o.select("o_orderkey", F.coalesce("only", F.try_element_at("years", F.lit(-1))).alias("fiscal_year"), F.size("years").alias("named"), F.array_join("w", ",").alias("window"))
