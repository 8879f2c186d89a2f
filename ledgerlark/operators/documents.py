"""Documents to pages, sections and chunks; table chunks to facts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as B
from ..functions import text as X
from ..functions import values as V
from ..sources.shared import small_batches
from .windows import repeated_lines

# Characters of a text chunk, of its overlap, of a table chunk, and of the shortest paragraph kept.
TEXT_CHARS, OVERLAP, TABLE_CHARS, PARAGRAPH_CHARS = 1000, 120, 700, 40
# Characters of a page with a text layer, pages of a file that may be an error page, and what such pages say.
TEXT_LAYER_CHARS, ERROR_PAGES = 100, 3
ERROR_MARKS = ["access denied", "you don't have permission", "forbidden", "404 not found", "page not found", "request blocked", "are you a robot", "enable javascript"]

_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def split_paragraph(text: str, most: int = TEXT_CHARS, overlap: int = OVERLAP) -> list[str]:
    """A paragraph in parts of whole sentences, each but the first opened by the end of the part before; a sentence
    longer than a part is sliced, its slices overlapping."""
    if len(text) <= most:
        return [text]
    parts, held = [], ""
    for sentence in _SENTENCE_END.split(text):
        if len(sentence) > most:
            parts += [held, *(sentence[at : at + most] for at in range(0, len(sentence), most - overlap))]
            held = ""
        elif len(held) + 1 + len(sentence) > most:
            parts.append(held)
            held = f"{held[-overlap:] if 0 < overlap < len(held) else ''} {sentence}".strip()
        else:
            held = f"{held} {sentence}".strip()
    return [p for p in [*parts, held] if p]


def chunks(docs: DataFrame, key: str, text: str, most: int, overlap: int) -> DataFrame:
    """(key, part, total_parts, chunk); a document without text has none.  Greedy packing carries state
    from sentence to sentence, so it runs in a vectorised function, a document at a time."""

    small_batches(docs.sparkSession)

    @F.pandas_udf("array<string>")
    def pack(s: pd.Series) -> pd.Series:
        return s.map(lambda t: split_paragraph(t, most, overlap) if t else [])

    c = docs.select(key, pack(F.col(text)).alias("c"))
    return c.select(key, F.size("c").alias("total_parts"), F.posexplode("c").alias("part", "chunk")).select(key, "part", "total_parts", "chunk")


def validated(files: DataFrame, pages: DataFrame, min_pages: int = 1) -> DataFrame:
    """files (path, content), pages (path, page, text): status valid, needs_ocr or rejected, with its problems and text coverage."""
    p = pages.groupBy("path").agg(
        F.count("*").alias("page_count"), F.count_if(F.length(F.trim(F.coalesce("text", F.lit("")))) >= TEXT_LAYER_CHARS).alias("pages_with_text"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("total_characters"),
        F.lower(F.concat_ws(" ", F.collect_list(F.when(F.col("page") <= ERROR_PAGES, F.col("text"))))).alias("opening"),
    )
    r = files.join(p, "path", "left").fillna(0, ["page_count", "pages_with_text", "total_characters"])
    marks = F.filter(F.array(*[F.lit(m) for m in ERROR_MARKS]), lambda m: F.col("opening").contains(m))
    error_page = (F.col("page_count") <= ERROR_PAGES) & (F.size(marks) > 0)
    problem = (
        F.when(F.octet_length("content") == 0, "file is empty").when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "missing %PDF- magic bytes")
        .when(F.coalesce(error_page, F.lit(False)), "content looks like a server error page").when(F.col("page_count") < min_pages, "too few pages")
    )
    status = F.when(problem.isNotNull(), "rejected").when(F.col("pages_with_text") == 0, "needs_ocr").otherwise("valid")
    return r.select("path", status.alias("status"), problem.alias("problem"), "page_count", "pages_with_text", "total_characters", F.coalesce(F.try_divide("pages_with_text", "page_count"), F.lit(0.0)).alias("text_coverage"))


def needs_ocr(text: Column, least: int = 60) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < least


def ocr_confidence(words: DataFrame, *by: str) -> DataFrame:
    """words (text, confidence): mean confidence of scored words, of those with digits alone, and whether either is low."""
    scored = words.where("confidence >= 0 and trim(coalesce(text, '')) <> ''")
    digits = F.avg(F.when(F.col("text").rlike("[0-9]"), F.col("confidence")))
    out = scored.groupBy(*by).agg(F.avg("confidence").alias("mean_confidence"), digits.alias("digit_confidence"), F.count("*").alias("words"))
    return out.withColumn("low", F.least("mean_confidence", "digit_confidence") < 70)


def clean_pages(pages: DataFrame) -> DataFrame:
    """pages (document_id, page, text) without lines that repeat as headers and footers, and the section each page ends in."""
    repeated = repeated_lines(pages, "document_id", "page", "text").groupBy("document_id").agg(F.collect_set("line").alias("gone"))
    lines = F.split(F.coalesce("text", F.lit("")), r"\r?\n")
    kept = F.when(F.col("gone").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains("gone", F.trim(x))))
    out = pages.join(repeated, "document_id", "left").withColumn("kept", kept)
    out = out.select("document_id", "page", F.array_join("kept", "\n").alias("text"), (F.size(lines) - F.size("kept")).alias("lines_removed"))
    w = Window.partitionBy("document_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("section", F.last(B.last_heading(F.col("text")), ignorenulls=True).over(w)).withColumn("replacement_chars", F.length(F.regexp_replace("text", "[^�]", "")))


def table_contexts(tables: DataFrame, pages: DataFrame) -> DataFrame:
    """tables (document_id, page, table_index, rows) with header, header_rows, caption, and scale and currency: of the
    caption, else of the last page so far that declares one."""
    w = Window.partitionBy("document_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    own = B.scale_context(F.col("text"), strict=True)
    declared = F.last(F.when(own["scale"].isNotNull(), F.struct(own["scale"].alias("scale"), own["currency"].alias("currency"), F.col("page").alias("page"))), ignorenulls=True).over(w)
    t = tables.join(pages.select("document_id", "page", F.col("text").alias("page_text"), declared.alias("declared")), ["document_id", "page"], "left")
    t = t.withColumn("caption", B.caption(F.coalesce("page_text", F.lit("")), F.col("rows"))).withColumn("said", B.scale_context(F.col("caption"))).withColumn("head", B.merged_header(F.col("rows")))
    return t.select(
        *tables.columns, F.col("head.header").alias("header"), F.col("head.rows").alias("header_rows"), F.nullif(F.substring(F.trim("caption"), 1, 300), F.lit("")).alias("caption"),
        F.coalesce("said.scale", "declared.scale").alias("context_scale"), F.when(F.col("said.scale").isNotNull(), F.col("said.currency")).otherwise(F.coalesce("said.currency", "declared.currency")).alias("context_currency"),
        F.when(F.col("said.scale").isNotNull(), F.col("page")).otherwise(F.col("declared.page")).alias("scale_source_page"),
    )


def table_chunks(tables: DataFrame, most: int = TABLE_CHARS) -> DataFrame:
    """tables as of table_contexts() with section: chunks of whole rows under the header, as many as fit each; one at least."""
    title = F.coalesce("section", F.concat(F.lit("Table on page "), F.col("page").cast("string")))
    prefix = F.concat(title, F.lit("\n"), B.unit_banner(F.col("context_scale"), F.col("context_currency"), F.col("page"), F.col("scale_source_page")), F.lit("\n"))
    body = F.when(F.col("header_rows") > 0, F.slice("rows", F.col("header_rows") + 1, F.greatest(F.size("rows"), F.lit(1)))).when(F.col("header").isNotNull(), F.filter("rows", lambda r: r != F.col("header"))).otherwise(F.col("rows"))
    none = F.array().cast("array<array<string>>")
    t = tables.withColumn("prefix", prefix).withColumn("body", body).withColumn("opening", F.length("prefix") + F.length(B.pipe_table(F.when(F.col("header").isNotNull(), F.array("header")).otherwise(none), F.col("header"))))
    t = t.withColumn("again", F.length("prefix") + F.coalesce(F.length(F.array_join("header", " | ")), F.lit(0)))
    size = lambda r: F.aggregate(r, F.lit(0), lambda s, c: s + F.length(c)) + 3 * F.size(r)

    def packed(acc: Column, row: Column) -> Column:
        full = (acc["rows"] > 0) & (acc["size"] + size(row) > most)
        part = acc["part"] + full.cast("int")
        return F.struct(part.alias("part"), (F.when(full, F.lit(0)).otherwise(acc["rows"]) + 1).alias("rows"), (F.when(full, F.col("again")).otherwise(acc["size"]) + size(row)).cast("int").alias("size"), F.concat(acc["out"], F.array(part)).alias("out"))

    start = F.struct(F.lit(0).alias("part"), F.lit(0).alias("rows"), F.col("opening").cast("int").alias("size"), F.array().cast("array<int>").alias("out"))
    t = t.withColumn("of", F.aggregate("body", start, packed)["out"])
    t = t.withColumn("total_parts", F.greatest(F.coalesce(F.array_max("of"), F.lit(0)) + 1, F.lit(1))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("total_parts") - 1)))
    own = F.filter("body", lambda r, i: F.get(F.col("of"), i) == F.col("part"))
    return t.select(
        F.concat_ws(":", "document_id", F.concat(F.lit("p"), F.col("page").cast("string")), F.concat(F.lit("t"), F.col("table_index").cast("string")), F.col("part").cast("string")).alias("chunk_id"), F.lit("table").alias("kind"),
        F.concat("prefix", B.pipe_table(own, F.col("header"))).alias("text"), "document_id", "page", "section", "table_index", "part", "total_parts", "context_scale", "context_currency",
    )


def text_chunks(pages: DataFrame, numerals: DataFrame, chunks_before: DataFrame, most: int = TEXT_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """pages (document_id, page, text, section): the paragraphs that are prose and no spillover of the page's tables.

    numerals (document_id, page, numerals): the tables' numerals; chunks_before (document_id, n): chunks that number first."""

    small_batches(pages.sparkSession)

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: split_paragraph(t, most, overlap))

    p = pages.select("document_id", "page", "section", F.posexplode(F.split(F.trim("text"), r"\n\s*\n")).alias("k", "paragraph")).withColumn("paragraph", F.trim(F.col("paragraph"), F.lit(" \n\t\r")))
    p = p.where((F.length("paragraph") >= PARAGRAPH_CHARS) & X.is_prose(F.col("paragraph"))).join(numerals, ["document_id", "page"], "left")
    p = p.where(~F.coalesce(B.is_spillover(F.col("paragraph"), F.col("numerals")), F.lit(False)))
    p = p.select("document_id", "page", "section", "k", F.posexplode(cut("paragraph")).alias("part", "text")).join(chunks_before, "document_id", "left")
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("page", "k", "part")) - 1 + F.coalesce("n", F.lit(0))
    none = F.lit(None).cast("string")
    return p.select(
        F.concat_ws(":", "document_id", F.concat(F.lit("p"), F.col("page").cast("string")), F.concat(F.lit("x"), number.cast("string"))).alias("chunk_id"), F.lit("text").alias("kind"), "text", "document_id", "page", "section",
        F.lit(None).cast("int").alias("table_index"), "part", F.lit(1).alias("total_parts"), none.alias("context_scale"), none.alias("context_currency"),
    )


def chunk_documents(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """Chunks of whole documents: tables first, then prose that no table holds already.  pages: document_id, page, text;
    tables: document_id, page, table_index, rows."""
    clean = clean_pages(pages)
    t = table_chunks(table_contexts(tables, pages).join(clean.select("document_id", "page", "section"), ["document_id", "page"], "left"))
    numerals = tables.select("document_id", "page", F.explode(F.flatten("rows")).alias("cell")).groupBy("document_id", "page").agg(F.array_distinct(F.flatten(F.collect_set(F.regexp_extract_all("cell", F.lit(r"\d[\d,.]*"), F.lit(0))))).alias("numerals"))
    return t.unionByName(text_chunks(clean, numerals, t.groupBy("document_id").agg(F.count("*").alias("n"))))


def coverages(tables: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: shares of tables with a scale and of pages with text, 0 where there are none; scales that were inherited; pages of text
    beyond a model's limit are counted by truncated()."""
    t = tables.agg(F.coalesce(F.avg(F.col("context_scale").isNotNull().cast("double")), F.lit(0.0)).alias("scale_coverage"), F.count_if(B.inherited(F.col("page"), F.col("scale_source_page"))).alias("inherited"))
    return t.crossJoin(pages.agg(F.coalesce(F.avg((F.length(F.trim("text")) >= TEXT_LAYER_CHARS).cast("double")), F.lit(0.0)).alias("text_coverage")))  # one row each


def truncated(texts: DataFrame, text: str, most_tokens: int) -> DataFrame:
    """How many texts have more tokens than a model reads, at four letters a token."""
    return texts.agg(F.count_if(F.floor(F.length(text) / 4) > most_tokens).alias("truncated"), F.count("*").alias("texts"))


def structure(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pages, the sections with their first and last page, and the tables with their first chunk, of chunks."""
    known = chunks.where("page is not null")
    sections = known.where("coalesce(section, '') <> ''").groupBy("document_id", F.substring("section", 1, 400).alias("title")).agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"))
    tables = known.where("kind = 'table' and table_index is not null").groupBy("document_id", "page", "table_index").agg(*[F.min_by(c, "part").alias(c) for c in ("chunk_id", "context_scale", "context_currency")])
    return known.select("document_id", "page").distinct(), sections, tables


def _rows(text: Column) -> Column:
    own = lambda line: F.regexp_extract(F.trim(line), r"^\|(.+)\|\s*$", 1)
    inside = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), own), lambda x: x != "")
    return F.transform(inside, lambda x: F.transform(F.split(x, r"\|"), lambda c: F.trim(c)))


def metric_of(labels: DataFrame, label: str, lexicon: DataFrame) -> DataFrame:
    """(label, metric, unit_kind): each label that opens with an alias of the lexicon (alias, canonical, unit_kind), the longest one."""
    p = labels.select(label).distinct().withColumn("alias", F.explode(B.label_prefixes(F.col(label))))
    hit = p.join(lexicon.select(F.lower("alias").alias("alias"), "canonical", "unit_kind"), "alias")
    best = F.max_by(F.struct("canonical", "unit_kind"), F.struct(F.length("alias"), F.col("canonical")))
    return hit.groupBy(label).agg(best.alias("m")).select(label, F.col("m.canonical").alias("metric"), F.col("m.unit_kind").alias("expected"))


def facts(chunks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """chunks: chunk_id, document_id, kind, text, page, section, table_index, context_scale, context_currency, company,
    fiscal_year, and years (map<column, year>) where a part inherits them.

    The header is the first of six pipe rows that names years and carries no figures, else the first row, and then
    the inherited years hold.  A row is cut at its labels, so that panels side by side keep their own figures; merged cells
    give a fact for each figure, whose years the merged header names in the same order."""
    c = chunks.where("kind = 'table'")
    if "years" not in c.columns:
        c = c.withColumn("years", F.lit(None).cast("map<int,string>"))
    c = c.withColumn("rows", _rows(F.col("text")))  # tables without rows end at explode; the outer form has no filter that would work out rows again
    heads = F.filter(F.slice("rows", 1, B.HEADER_ROWS), lambda r: F.exists(r, lambda x: B.header_year(x).isNotNull()) & ~B.carries_data(r))
    c = c.withColumn("head", F.get(heads, F.lit(0)))
    c = c.withColumn("header", F.coalesce("head", F.get("rows", F.lit(0)))).withColumn("years", F.when(F.col("head").isNotNull(), B.column_years(F.col("head"))).otherwise(F.col("years"))).withColumn("notes", B.note_columns(F.col("header")))
    r = c.select("chunk_id", "document_id", "page", "section", "table_index", "context_scale", "context_currency", "company", "fiscal_year", "header", "years", "notes", F.posexplode_outer("rows").alias("row", "cells"))
    r = r.where("row is not null").withColumn("segment", F.explode_outer(B.row_segments(F.col("cells")))).withColumn("row_label", F.get("cells", F.col("segment.label")))
    r = r.join(metric_of(r, "row_label", lexicon), "row_label").where("segment.stop > segment.first")
    v = r.withColumn("i", F.explode(F.sequence(F.col("segment.first"), F.col("segment.stop") - 1))).withColumn("cell", F.get("cells", F.col("i")))
    v = v.where(~F.array_contains("notes", F.col("i")) & F.col("cell").rlike(B.NUMERIC)).withColumn("all", B.figures(F.col("cell"))).withColumn("merged", F.size("all") > 1)
    v = v.select("*", F.posexplode_outer("all").alias("k", "figure"))  # a numeric cell has a figure
    money = F.col("expected") == "currency"
    value = V.plain(F.col("figure"), F.when(money, F.col("context_scale")), F.when(money, F.col("context_currency")), F.when(F.col("expected") == "ratio", F.lit("ratio")))
    named = B.years_in(F.coalesce(F.get("header", F.col("i")), F.lit("")))
    at = F.try_element_at("years", F.col("i") + F.col("k"))
    year = F.when(~F.col("merged"), at).when(F.size(named) == F.size("all"), F.get(named, F.col("k"))).otherwise(at)
    v = v.withColumn("v", value).withColumn("stated", year)
    source = F.when(F.col("stated").isNotNull(), "column_header").when(~F.col("merged") & F.col("fiscal_year").isNotNull(), "document_fiscal_year").otherwise("unknown")
    more = F.array_compact(F.array(F.when(F.col("merged"), F.lit("merged_columns")), F.when(F.col("merged") & F.col("stated").isNull(), F.lit("year_not_resolvable_in_merged_cell"))))
    return v.select(
        "chunk_id", "document_id", "page", "section", "table_index", "company", "metric", "row", "row_label", (F.col("i") + F.col("k")).alias("column_index"), F.get("header", F.col("i") + F.col("k")).alias("column_label"),
        F.col("v.amount").alias("amount"), F.col("v.scale").alias("scale"), F.col("v.unit_kind").alias("unit_kind"), F.col("v.currency").alias("currency"), V.canonical(F.col("v.amount"), F.col("v.scale"), F.col("v.unit_kind")).alias("canonical"),
        F.coalesce("stated", F.when(~F.col("merged"), F.col("fiscal_year"))).alias("year"), source.alias("year_source"), F.concat("v.warnings", more).alias("warnings"),
    )


def facts_across(chunks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """facts() of tables cut into parts: later parts without a header take the years of the first part that states them.
    chunks: as of facts(), with part, the place in the table."""
    known = chunks.drop("years").withColumn("table", X.table_key(F.col("chunk_id")))
    stated = facts(known, lexicon).where("year_source = 'column_header'").groupBy("chunk_id", "column_index").agg(F.max_by("year", "row").alias("year"))
    stated = stated.groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("column_index", "year"))).alias("own"))
    before = Window.partitionBy("table").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    given = known.join(stated, "chunk_id", "left").withColumn("years", F.when(F.col("table").isNotNull(), F.first("own", ignorenulls=True).over(before)))
    return facts(given.drop("own", "table"), lexicon)


def by_metric(facts_: DataFrame, year: str | None = None, stated_only: bool = False) -> DataFrame:
    """(metric, facts): the facts of each metric in order, of one year and with stated years alone if asked."""
    f = facts_.where(F.col("year") == year) if year is not None else facts_
    f = f.where("year_source = 'column_header'") if stated_only else f
    return f.groupBy("metric").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "row", "column_index", "amount", "year"))).alias("facts"))


def statement_basis(pages: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """Standalone or consolidated by the first of each page's three opening lines that declares one, carried forward; '-' before any."""
    w = Window.partitionBy(document).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    return pages.select(document, page, F.coalesce(F.last(B.page_basis(F.col(text)), ignorenulls=True).over(w), F.lit("-")).alias("basis"))


def by_basis(hits: DataFrame, basis: DataFrame, *by: str) -> DataFrame:
    """Of each group's hits (with document_id, page) those on consolidated pages, else those on standalone ones; groups with
    neither are left out.  basis: document_id, page, basis."""
    h = hits.join(basis, ["document_id", "page"]).where("basis in ('consolidated', 'standalone')")
    w = Window.partitionBy(*by)
    return h.withColumn("chosen", F.min("basis").over(w)).where("basis = chosen").drop("chosen")
