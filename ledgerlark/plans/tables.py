"""Queries on pages and tables: every order is printed as a pipe table, every conversation is a filing of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as B
from ..functions import text as X
from ..operators import binding as N
from ..operators import documents as D
from .base import query, rounded, table

#: A lexicon for the queries: alias, canonical name, statement, unit.
LEXICON = [
    ("trade payables", "trade payables", "consolidated balance sheet", "currency"),
    ("accounts payable", "trade payables", "consolidated balance sheet", "currency"),
    ("total assets", "total assets", "consolidated balance sheet", "currency"),
    ("revenue", "revenue from operations", "consolidated statement of profit and loss", "currency"),
    ("goodwill", "goodwill", "consolidated balance sheet", "currency"),
]


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "alias string, canonical string, statement string, unit_kind string")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each order: a header, and a row for each line, its label by the line's number; prices of odd lines in parentheses."""
    n = F.col("l_linenumber") % 3
    label = F.when(n == 1, "Trade payables:").when(n == 2, "Total assets").otherwise("Revenue ageing schedule of others")
    price = F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2)
    row = F.concat(F.lit("| "), label, F.lit(" | 2.14 | "), F.col("l_quantity").cast("int").cast("string"), F.lit(" | "), F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("("), price, F.lit(")"))).otherwise(price), F.lit(" |"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("r")))).alias("r"))
    text = F.concat(F.lit("Balance sheet\n(All figures in INR crore)\n| Particulars | Note | As at March 31, 2024 | 2022-23 |\n|---|---|---|---|\n"), F.array_join("r.r", "\n"))
    key = F.col("l_orderkey").cast("string")
    return rows.select(
        F.concat(F.lit("d"), key, F.lit(":p1:t0:0")).alias("chunk_id"), key.alias("document_id"), F.lit("table").alias("kind"), text.alias("text"), F.lit(1).alias("page"), F.lit("Balance sheet").alias("section"), F.lit(0).alias("table_index"),
        F.lit("crore").alias("context_scale"), F.lit("INR").alias("context_currency"), F.lit("Acme").alias("company"), F.lit("2023-24").alias("fiscal_year"),
    )


_FACTS = """l AS (SELECT l_orderkey::VARCHAR AS document_id, CASE l_linenumber % 3 WHEN 1 THEN 'trade payables' ELSE 'total assets' END AS metric, l_quantity::INT::DOUBLE AS q, CASE WHEN l_linenumber % 2 = 1 THEN -l_extendedprice ELSE l_extendedprice END AS p FROM lineitem WHERE l_linenumber % 3 <> 0)"""


@query(f"WITH {_FACTS} SELECT document_id, metric, 2 AS column_index, '2024' AS year, 'column_header' AS year_source, q AS amount, 'crore' AS scale FROM l UNION ALL SELECT document_id, metric, 3, '2023', 'column_header', round(p, 2), 'crore' FROM l")
def table_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of every order's table, under the years of its header, its note column left out."""
    f = D.facts(_chunks(spark, sf_dir), lexicon(spark))
    return f.select("document_id", "metric", "column_index", "year", "year_source", F.col("amount").cast("double").alias("amount"), "scale")


@query(f"WITH {_FACTS}, a AS (SELECT metric, '2024' AS year, q AS amount FROM l UNION ALL SELECT metric, '2023', p FROM l) SELECT metric, year, count(*) AS facts, round(sum(amount), 2) AS total FROM a GROUP BY ALL")
def facts_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.facts(_chunks(spark, sf_dir), lexicon(spark))
    return f.groupBy("metric", "year").agg(F.count("*").alias("facts"), F.round(F.sum("amount").cast("double"), 2).alias("total"))


def _bound(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    c = _chunks(spark, sf_dir)
    blocks = c.select(F.col("document_id").alias("question"), F.lit(1).alias("block"), "text", F.col("context_scale").alias("scale"), F.col("context_currency").alias("currency"), F.lit("p.1").alias("citation"))
    metrics = c.select(F.col("document_id").alias("question"), F.posexplode(F.array(*[F.lit(n) for n in names])).alias("pos", "metric"))
    return N.bind_operands(metrics, blocks, lexicon(spark))


_BOUND = """m AS (SELECT DISTINCT l_orderkey, unnest([{'n': 0, 'm': 'Accounts payable'}, {'n': 1, 'm': 'total assets'}, {'n': 2, 'm': 'goodwill'}]) AS m FROM lineitem),
v AS (SELECT l_orderkey, l_linenumber % 3 - 1 AS n, count(DISTINCT l_quantity) AS d, min(l_quantity) AS q FROM lineitem WHERE l_linenumber % 3 <> 0 GROUP BY ALL),
b AS (SELECT m.l_orderkey::VARCHAR AS question, m.m.n AS pos, m.m.m AS metric, coalesce(d = 1, false) AS bound, CASE WHEN d = 1 THEN q * 10000000 END AS value, CASE WHEN d IS NULL THEN 'no_row' WHEN d > 1 THEN 'rows_disagree' END AS note FROM m LEFT JOIN v ON v.l_orderkey = m.l_orderkey AND v.n = m.m.n)"""


@query(f"WITH {_BOUND} SELECT * FROM b")
def bind_from_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three metrics of every order bound to its table's rows: by label, in the first column of figures, unless rows disagree."""
    return _bound(spark, sf_dir, ["Accounts payable", "total assets", "goodwill"]).select("question", "pos", "metric", "bound", F.col("value").cast("double").alias("value"), "note")


@query(f"""WITH {_BOUND}, w AS (SELECT question, question::BIGINT AS k, max(value) FILTER (pos = 0) AS a, max(value) FILTER (pos = 1) AS c, bool_and(bound) AS complete FROM b WHERE pos < 2 GROUP BY question)
SELECT question, k % 4 <> 2 AS applicable, complete AND k % 4 IN (0, 1) AS available, CASE WHEN complete THEN round(CASE k % 4 WHEN 0 THEN a / c WHEN 1 THEN a + c END, 6) END AS value,
CASE WHEN k % 4 = 2 THEN 'no arithmetic to verify' WHEN NOT complete THEN 'operands not bound' WHEN k % 4 = 3 THEN 'number of years required' END AS failure_reason FROM w""")
def deterministic_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What arithmetic alone says of the bound operands: ratios, sums, look-ups, growth without years."""
    b = _bound(spark, sf_dir, ["Accounts payable", "total assets"])
    k = F.col("question").cast("long") % 4
    specs = b.select("question").distinct().select("question", F.when(k == 0, "ratio").when(k == 1, "sum").when(k == 2, "lookup").otherwise("cagr").alias("operation"), F.lit(None).cast("int").alias("years"))
    return N.deterministic(specs, b).select("question", "applicable", "available", rounded("value", "value"), "failure_reason")


_HEADS = ["Consolidated Balance Sheet", "Standalone Statement of Profit and Loss", "Consolidated and standalone financial statements", "Notes", "The consolidated figures of the balance sheet are discussed at length on the pages that follow this one here"]


@query("""WITH p AS (SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN 'consolidated' WHEN 1 THEN 'standalone' END AS own FROM conversations)
SELECT conv_id, turn, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '-') AS basis FROM p""")
def statement_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The basis that each page's running header declares, carried forward; both, neither and long lines declare none."""
    k = (F.col("conv_id") + F.col("turn")) % 5
    head = F.element_at(F.array(*[F.lit(h) for h in _HEADS]), (k + 1).cast("int"))
    p = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("\n"), head, F.lit("\n\n12\nx\n")).alias("text"))
    return D.statement_basis(p, "conv_id", "turn", "text")


@query("""WITH d AS (SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) % 5 AS form FROM orders)
SELECT o_orderkey, CASE form WHEN 0 THEN y::VARCHAR WHEN 1 THEN y::VARCHAR WHEN 3 THEN '20' || right(y::VARCHAR, 2) END AS year, CASE form WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS literals FROM d""")
def header_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year that a column's header names: order dates as a day, the fiscal span that ends then, two years, a short fiscal year, none."""
    y, form = F.year("o_orderdate"), F.month("o_orderdate") % 5
    cell = F.when(form == 0, F.concat(F.lit("As at March 31, "), y)).when(form == 1, X.fiscal_label(y - 1)).when(form == 2, F.concat_ws(" ", y.cast("string"), (y - 1).cast("string"))).when(form == 3, F.concat(F.lit("FY"), F.substring(y.cast("string"), 3, 2))).otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", B.header_year(cell).alias("year"), F.size(B.years_in(cell)).alias("literals"))


@query("""WITH p AS (SELECT p_partkey, p_retailprice, CASE WHEN p_retailprice >= 975 THEN 'crore' WHEN p_retailprice >= 950 THEN 'lakh' WHEN p_retailprice >= 925 THEN 'million' END AS scale, p_size > 25 AS declares FROM part),
m AS (SELECT *, CASE WHEN scale IS NULL THEN 'EUR' WHEN declares THEN 'INR' ELSE 'USD' END AS currency FROM p)
SELECT p_partkey, CASE WHEN declares THEN scale END AS declared, scale AS mentioned, currency, '(All figures in ' || currency || ' ' || coalesce(scale, '') || ')' || CASE WHEN p_partkey % 7 <> 3 THEN ' [units declared on page ' || (p_partkey % 7)::VARCHAR || ', not on this page]' ELSE '' END AS banner FROM m""")
def unit_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units that a caption declares or mentions, by the price and size of the part that it is about, and how a chunk states them."""
    scale = F.when(F.col("p_retailprice") >= 975, "crore").when(F.col("p_retailprice") >= 950, "lakhs").when(F.col("p_retailprice") >= 925, "millions")
    text = F.when(scale.isNull(), F.concat(F.lit("€ prices of "), "p_name")).when(F.col("p_size") > 25, F.concat(F.lit("Prices of "), "p_name", F.lit(" (in Rs. "), scale, F.lit(")"))).otherwise(F.concat("p_name", F.lit(" sold for $ 5 "), scale))
    p = table(spark, sf_dir, "part").select("p_partkey", B.scale_context(text, strict=True).alias("s"), B.scale_context(text).alias("m"))
    return p.select("p_partkey", F.col("s.scale").alias("declared"), F.col("m.scale").alias("mentioned"), F.col("m.currency").alias("currency"), B.unit_banner(F.col("m.scale"), F.col("m.currency"), F.lit(3), F.col("p_partkey") % 7).alias("banner"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), s AS (SELECT doc_id, trim(rtrim(line, chr(13))) AS s FROM l),
w AS (SELECT doc_id, s, regexp_split_to_array(s, '[ \t\x0B\f\r]+') AS w, regexp_replace(s, '[^\p{L}]', '', 'g') AS letters FROM s WHERE s <> '' AND length(s) <= 90),
t AS (SELECT *, list_filter(w, lambda x: regexp_matches(x, '^\p{L}') AND lower(x) NOT IN ('a','an','and','as','at','by','for','from','in','of','on','or','the','to','with')) AS title FROM w),
h AS (SELECT doc_id FROM t WHERE NOT regexp_matches(s, '[.,;:]$') AND len(w) <= 12 AND lower(w[-1]) NOT IN ('a','an','and','as','at','by','for','from','in','of','on','or','the','to','with','is','are','was','were','under','over','into','that','which')
 AND length(regexp_replace(s, '[^)]', '', 'g')) <= length(regexp_replace(s, '[^(]', '', 'g'))
 AND (regexp_matches(s, '^\s*(?:[Nn]ote\s+)?\d+(?:\.\d+)*\s+[A-Z]') OR (length(letters) > 3 AND NOT regexp_matches(letters, '[^\p{Lu}]')) OR (len(title) >= 2 AND len(list_filter(title, lambda x: regexp_matches(x, '^\p{Lu}')))::DOUBLE / len(title) >= 0.7)))
SELECT d.doc_id, count(h.doc_id) AS headings FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id GROUP BY d.doc_id""")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each document look like headings."""
    lines = F.split(F.coalesce("text", F.lit("")), r"\r?\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(lines, B.is_heading)).cast("long").alias("headings"))


@query()
def chunked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one-page filings whose first ten words are a table too: table chunks first, then prose that the table does not hold."""
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page"), "text")
    words = F.slice(F.split("text", r"\s+"), 1, 10)
    t = d.select("document_id", "page", F.lit(0).alias("table_index"), F.array(F.array(F.lit("Words"), F.lit("2024")), F.array(F.array_join(words, " "), F.lit("1,234"))).alias("rows"))
    return D.chunk_documents(d, t).select("chunk_id", "kind", "part", "total_parts", F.sha2("text", 256).alias("text_sha256"))
