"""Text, fiscal years and question patterns, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9][a-z0-9.,'-]*"


def tokens(text: Column) -> Column:
    """Lower-cased tokens; numerals keep their points and commas."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def normalised(text: Column) -> Column:
    """Dashes to '-', blanks collapsed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.translate(text, "‐‑‒–—−", "------"), r"(?U)\s+", " ")))


def fiscal_label(start: Column) -> Column:
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(F.pmod(start + 1, F.lit(100)).cast("string"), 2, "0"))


def fiscal_years(text: Column) -> Column:
    """All fiscal years named as 2023-24 or by their last day, March 31, 2024: distinct, sorted, as 'YYYY-YY'."""
    spans = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\b(?:FY\s*)?(20\d\d\s*[-/]\s*\d{2})\b"), F.lit(1)), lambda y: F.regexp_replace(y, r"\s*[-/]\s*", "-"))
    ends = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\bmarch\s+31,?\s*(20\d\d)\b"), F.lit(1)), lambda y: fiscal_label(y.cast("int") - 1))
    return F.array_sort(F.array_distinct(F.concat(spans, ends)))


def only_fiscal_year(text: Column) -> Column:
    years = fiscal_years(text)
    return F.when(F.size(years) == 1, years.getItem(0))


def fiscal_window(start: Column, years: int = 12) -> Column:
    """The labels of a year and those after it."""
    return F.transform(F.sequence(start, start + years - 1), fiscal_label)


def alpha_ratio(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / F.length(text)).otherwise(F.lit(0.0))


def is_prose(text: Column) -> Column:
    """At least .45 letters and eight words with a letter."""
    return (alpha_ratio(text) >= 0.45) & (F.size(F.filter(F.split(text, r"\s+"), lambda w: w.rlike(r"\p{L}"))) >= 8)


# Operations by the first pattern that a question holds.
OPERATIONS = [
    (r"\bcagr\b|\bcompound annual growth\b", "cagr"),
    (r"\bgrow(?:th|n|)\b|\bincrease[d]?\b|\bdecrease[d]?\b|\bchange[d]?\b", "percentage_change"),
    (r"\bmargin\b", "margin"),
    (r"\bratio\b|\breturn on\b", "ratio"),
    (r"\b(?:share|proportion|percentage|fraction)\s+of\b", "percentage_of"),
    (r"\bdifference\b|\bhow much (?:more|less)\b", "difference"),
    (r"\btotal\s+of\b|\bsum\s+of\b|\bcombined\b", "sum"),
    (r"\baverage\b|\bmean\b", "average"),
]

# Words that say nothing of what is asked, phrases that name a period, dates.
STOPWORDS = (
    "what which how much many was were is are did does do had has have the a an of for to in on at as by with from and or that this it its their "
    "company group companys groups"
).split()
PERIOD_PHRASE = r"(?i)\b(?:as\s+at|as\s+on|for\s+the\s+year\s+ended|year\s+ended|during\s+the\s+year|at\s+the\s+end\s+of\s+the\s+(?:financial\s+|fiscal\s+)?year)\b"
DATE = r"(?i)\b(?:31st|31)?\s*(?:january|february|march|april|may|june|july|august|september|october|november|december)\s*,?\s*\d{1,2}?,?\s*(?:20\d\d)?\b"


def content_terms(question: Column) -> Column:
    """The question's words without periods, dates and words that say nothing; empty where nothing is asked."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(question, F.lit("")), PERIOD_PHRASE, " "), DATE, " ")
    words = F.regexp_extract_all(bare, F.lit(r"[A-Za-z0-9][A-Za-z0-9,.'-]*"), F.lit(0))
    return F.filter(words, lambda w: ~F.regexp_replace(F.lower(w), r"^[.,']+|[.,']+$", "").isin(STOPWORDS))


def search_text(question: Column) -> Column:
    """The content words as a query; the question itself where none are left."""
    words = F.regexp_replace(F.array_join(content_terms(question), " "), r"^[ ?.,]+|[ ?.,]+$", "")
    return F.when(words != "", words).otherwise(question)


def with_hint(metric: Column, statement: Column) -> Column:
    """A query for one figure, with the statement that reports it as a soft hint."""
    return F.when(F.coalesce(statement, F.lit("")) != "", F.concat_ws(" ", metric, statement)).otherwise(metric)


def without_company(question: Column, company: Column) -> Column:
    """The question without the company's name, with and without its legal form."""
    quoted = lambda c: F.concat(F.lit("(?i)\\Q"), c, F.lit("\\E"))
    short = F.trim(F.replace(company, F.lit(" Limited"), F.lit("")))
    out = F.when(F.coalesce(company, F.lit("")) != "", F.regexp_replace(F.regexp_replace(question, quoted(company), F.lit(" ")), quoted(short), F.lit(" "))).otherwise(question)
    return F.trim(F.replace(F.regexp_replace(out, r"\s{2,}", " "), F.lit(" ,"), F.lit(",")))


def without_gloss(question: Column) -> Column:
    """The question without a definition in parentheses at its end."""
    return F.trim(F.regexp_replace(question, r"\s*\([^()]*\)\s*(?=\?*$)", ""))


def guessed_fiscal_year(text: Column) -> Column:
    """The fiscal year that a filing's opening names, by the first of three forms; null without one."""
    ended = F.regexp_extract(text, r"(?i)year ended March 31,\s*(\d{4})", 1)
    fy = lambda g: F.regexp_extract(text, r"(?i)FY\s?(\d{4})-(\d{2,4})", g)
    plain = lambda g: F.regexp_extract(text, r"(\d{4})-(\d{2})\b", g)
    span = lambda f: F.when(f(1) != "", F.concat(f(1), F.lit("-"), F.right(f(2), F.lit(2))))
    return F.coalesce(F.when(ended != "", F.concat((ended.cast("int") - 1).cast("string"), F.lit("-"), F.substring(ended, 3, 2))), span(fy), span(plain))


def guessed_company(text: Column) -> Column:
    """The first name before Limited or Ltd, with the legal form written out; null without one."""
    name = F.trim(F.regexp_extract(text, r"\b([A-Z][A-Za-z&.\- ]{2,60}?)\s+(?:Limited|Ltd\.?)\b", 1))
    return F.when(name != "", F.concat(name, F.lit(" Limited")))


def operation(question: Column) -> Column:
    low, out = F.lower(question), F.lit("lookup")
    for pattern, name in reversed(OPERATIONS):
        out = F.when(low.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8))


def swapped(question: Column) -> Column:
    """Whether two answers are shown in the other order: the parity of the question's hash."""
    return F.conv(F.substring(F.sha2(question, 256), 1, 2), 16, 10).cast("int") % 2 == 1


def without_thoughts(text: Column) -> Column:
    """A reply without its thinking blocks, closed or not."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""), r"(?is)<think>.*$", ""))


def evidence_block(ref: Column, citation: Column, section: Column, currency: Column, scale: Column, text: Column, most: int = 1200) -> Column:
    """A block of evidence: reference, citation, section, units, and its text, cut text saying so."""
    units = F.concat_ws(" ", F.nullif(currency, F.lit("")), F.nullif(scale, F.lit("")))
    head = F.concat(F.lit("["), ref, F.lit("] "), F.coalesce(F.nullif(citation, F.lit("")), F.lit("citation unavailable")))
    head = F.concat(head, F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(" | "), section)).otherwise(""), F.when(units != "", F.concat(F.lit(" | figures in "), units)).otherwise(""))
    body = F.trim(F.coalesce(text, F.lit("")))
    return F.concat(head, F.lit("\n"), F.when(F.length(body) > most, F.concat(F.substring(body, 1, most), F.lit("\n... [evidence truncated]"))).otherwise(body))


# What stands in place of evidence where none was retrieved.
NO_EVIDENCE = "NO EVIDENCE WAS RETRIEVED.\nYou must not answer from prior knowledge. Report that the evidence needed to answer is unavailable."


def evidence_text(blocks: Column) -> Column:
    """An array of blocks as one prompt text; an explicit notice for none."""
    return F.when(F.coalesce(F.size(blocks), F.lit(0)) > 0, F.array_join(blocks, "\n\n")).otherwise(F.lit(NO_EVIDENCE))


def program_source(reply: Column) -> Column:
    """The program of a reply: its first fenced block, or all of it without thoughts."""
    bare = without_thoughts(F.coalesce(reply, F.lit("")))
    fenced = F.regexp_extract(bare, r"(?s)```(?:python|py)?\s*(.+?)```", 1)
    return F.trim(F.when(fenced != "", fenced).otherwise(bare), F.lit(" \n\t\r"))


def printable(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"[\x00-\x1f]", " "))


def asked_basis(question: Column) -> Column:
    """Whether a question asks for standalone or consolidated statements; '?' where it names neither."""
    low = F.lower(question)
    return F.when(low.contains("standalone"), "standalone").when(low.contains("consolidated"), "consolidated").otherwise("?")


def restated_basis(text: Column, basis: Column) -> Column:
    return F.when(basis == "consolidated", text).otherwise(F.regexp_replace(text, r"(?i)\bconsolidated\b", "standalone"))


def honest_definition(definition: Column, metric: Column, row_label: Column) -> Column:
    """A definition that says "total" of a row that is none names the row instead."""
    rest = F.regexp_replace(definition, r"^\S+ ", "")
    left = F.when(F.startswith(F.lower(rest), metric), F.ltrim(F.substring(rest, F.length(metric) + 1, F.length(rest)))).otherwise(rest)
    honest = F.trim(F.concat(F.lit("the '"), F.trim(row_label), F.lit("' line item "), left))
    return F.when(~F.startswith(F.lower(definition), F.lit("total ")) | F.lower(row_label).contains("total"), definition).otherwise(honest)


def unit_conflict(question: Column, definition: Column, unit: Column) -> Column:
    """The scale word of a unit given to a question for a quotient, or null."""
    scale = F.regexp_extract(unit, r"(?i)\b(crores?|lakhs?|millions?|billions?|thousands?|cr)\b", 1)
    quotient = F.concat_ws(" ", question, definition).rlike(r"(?i)\b(ratio|margin|return on|yield|coverage|percentage|per\s?cent|percent)\b")
    return F.when((scale != "") & quotient, scale)


def anchors_text(evidence: Column) -> Column:
    """evidence: array<struct<page, anchors>>; 'p12: label|figure ;; p13: ...'."""
    return F.array_join(F.transform(evidence, lambda s: F.concat(F.lit("p"), s["page"].cast("string"), F.lit(": "), F.array_join(s["anchors"], "|"))), " ;; ")


def anchors_label(anchors: Column) -> Column:
    """The first anchor's label: between the page's colon and the bar."""
    first = F.split(anchors, ";;").getItem(0)
    rest = F.when(F.instr(first, ":") > 0, F.regexp_replace(first, r"^[^:]*:", "")).otherwise("")
    return F.trim(F.split(rest, r"\|").getItem(0))


def anchor_figures(anchors: Column) -> Column:
    """The numerals of the anchors, pages aside."""
    return F.regexp_extract_all(F.regexp_replace(F.coalesce(anchors, F.lit("")), r"\bp\d+\s*:", " "), F.lit(r"-?\d[\d,]*\.?\d*"), F.lit(0))


def contradicts_anchors(answer: Column, anchors: Column) -> Column:
    """Whether an answer is a number that none of the anchors' figures equals; null where either has none."""
    number = lambda c: F.replace(c, F.lit(","), F.lit("")).try_cast("double")
    cited = F.filter(F.transform(anchor_figures(anchors), number), lambda x: x.isNotNull())
    target = number(F.trim(answer))
    return F.when(target.isNotNull() & (F.size(cited) > 0), ~F.exists(cited, lambda x: F.abs(x - target) < 1e-9))


def bare_figure(text: Column) -> Column:
    """A worksheet's answer as a bare figure: a plain number, or the percentage that a conclusion names; else null."""
    bare = F.trim(F.regexp_replace(F.replace(F.trim(text), F.lit(","), F.lit("")), "%+$", ""))
    found = F.replace(F.regexp_extract(text, r"(?is)Conclusion:.*?is\s+([0-9][0-9,]*\.?[0-9]*)\s*(?:%|percent)", 1), F.lit(","), F.lit(""))
    return F.when(bare.try_cast("double").isNotNull(), bare).when(found != "", found)


def first_line_with(lines: Column, parts: Column) -> Column:
    """The first of the lines that holds any of the parts, both normalised; null without one."""
    hit = F.filter(lines, lambda line: F.exists(parts, lambda p: normalised(line).contains(normalised(p))))
    return F.trim(F.get(hit, F.lit(0)))


def label_window(lines: Column, label: Column, span: int = 2) -> Column:
    """The first line that holds the label and the lines behind it, as one text; null without one."""
    at = F.array_position(F.transform(lines, lambda line: normalised(line).contains(normalised(label))), F.lit(True))
    own = F.filter(F.transform(F.slice(lines, F.greatest(at.cast("int"), F.lit(1)), span + 1), lambda x: F.trim(x)), lambda x: x != "")
    return F.when((at > 0) & (normalised(label) != ""), F.array_join(own, "  //  "))


def document_of(chunk_id: Column) -> Column:
    return F.when(F.instr(chunk_id, ":") > 0, F.substring_index(chunk_id, ":", 1))


def table_key(chunk_id: Column) -> Column:
    """A chunk's id without its number; null for ids without one."""
    return F.nullif(F.regexp_extract(chunk_id, r"^(.+):\d+$", 1), F.lit(""))


def citation(page: Column, section: Column, table_index: Column, row: Column | None = None, column: Column | None = None) -> Column:
    """'p.12, section, table 2 r3c1', counted from one."""
    cell = F.when(table_index.isNotNull(), F.concat(F.lit("table "), (table_index + 1).cast("string")))
    if row is not None and column is not None:
        cell = F.concat(cell, F.when(row.isNotNull() & column.isNotNull(), F.concat(F.lit(" r"), (row + 1).cast("string"), F.lit("c"), (column + 1).cast("string"))).otherwise(""))
    return F.concat_ws(", ", F.concat(F.lit("p."), page.cast("string")), F.nullif(section, F.lit("")), cell)


def fact_citation(page: Column, section: Column, table_index: Column, column_label: Column) -> Column:
    table = F.when(table_index.isNotNull(), F.concat(F.lit("table "), table_index.cast("string")))
    column = F.when(F.coalesce(column_label, F.lit("")) != "", F.concat(F.lit("column '"), column_label, F.lit("'")))
    return F.concat_ws(", ", F.coalesce(F.concat(F.lit("p."), page.cast("string")), F.lit("page unknown")), F.nullif(section, F.lit("")), table, column)


def resume_hint(seconds: Column) -> Column:
    """When an allowance returns, in words."""
    said = lambda n, unit: F.concat(F.lit("the provider says the allowance returns in ~"), n, F.lit(unit))
    return (
        F.when(seconds.isNull(), "the provider stated no retry delay; its allowance is a rolling window, so re-run rather than waiting for a day boundary")
        .when(seconds < 90, said(F.bround(seconds, 0).cast("int").cast("string"), "s")).when(seconds < 5400, said(F.bround(seconds / 60, 0).cast("int").cast("string"), " minutes"))
        .otherwise(said(F.format_number(seconds / 3600, 1), " hours"))
    )


def retry_delay(body: Column) -> Column:
    """The seconds that a refusal says to wait; null where it says none."""
    m = lambda g: F.regexp_extract(body, r"(?i)(?:try again|retry)\s+in\s+([\d.]+)\s*(ms|milliseconds?|s|secs?|seconds?|m|minutes?)", g)
    n = m(1).try_cast("double")
    return F.when(F.lower(m(2)).rlike("^(ms|millisecond)"), n / 1000).when(F.lower(m(2)).startswith("m"), n * 60).otherwise(n)


# What a refusal says when the allowance is spent, and the wait below which it is not.
EXHAUSTED = ("resource_exhausted", "quota exceeded", "exceeded your current quota", "insufficient_quota", "per day", "per_day", "requests_per_day", "daily limit")
TRANSIENT_SECONDS = 120.0


def allowance_exhausted(body: Column, retry_after: Column) -> Column:
    """Whether a refusal means a spent allowance and not only too fast a pace."""
    named = F.lit(False)
    for mark in EXHAUSTED:
        named = named | F.lower(body).contains(mark)
    return named & ~F.coalesce(retry_after <= TRANSIENT_SECONDS, F.lit(False))


def daily_tokens_used(body: Column) -> Column:
    return F.regexp_extract(body, r"(?is)tokens?\s+per\s+day.*?used\s+(\d+)", 1).try_cast("bigint")


def pipe_cells(line: Column) -> Column:
    """The cells of a row between pipes, or null for other lines."""
    return F.when(F.trim(line).rlike(r"\|"), F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))
