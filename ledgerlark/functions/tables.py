"""Table rows, headers, headings and page contexts, all as built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Figures, years, note columns and labels in cells.
NUMERIC = r"^[(\-−]?\s*[\d][\d,.\s]*\)?$"
FIGURE = r"\(?-?\d[\d,]*(?:\.\d+)?\)?"
YEAR = r"\b(?:19|20)\d{2}\b"
SPAN = r"\b((?:19|20)\d{2})\s*[-/]\s*(\d{4}|\d{2})\b"
FISCAL = r"\b(?:FY|fy)\s?(\d{2,4})\b"
NOTE = r"(?i)^\s*notes?\b"
LABEL = r"[A-Za-z]{3,}"
DATA_CELL = r"^[\s(₹$€]*[-–—]?[\d][\d,.\s]*\)?%?$"
GROUPED_FIGURE = r"^\(?\s*-?\d{1,3}(?:,\d{2,3})+(?:\.\d+)?\s*\)?$|^\(?\s*-?\d+\.\d{1,2}\s*\)?$"
BARE_INTEGER = r"^\(?\s*-?\d{1,6}\s*\)?$"
NOTE_REFERENCE = r"^\d+(?:\.\d+)+(?:\s+and\s+[\d.]+)*$"

# Pipe rows searched for a header, letters that a label may have beyond a metric's name.
HEADER_ROWS, LABEL_SLACK, ROW_SLACK = 6, 12, 4

# How a page declares its scale, then looser mentions; the first pattern found wins.
_UNITS = r"(?:rs\.?|inr|₹|usd|\$)"
SCALE_DECLARED = [
    (rf"\bin\s+{_UNITS}?\s*crores?\b", "crore"),
    (rf"\bin\s+{_UNITS}?\s*lakhs?\b", "lakh"),
    (rf"\bin\s+{_UNITS}?\s*millions?\b", "million"),
    (rf"\bin\s+{_UNITS}?\s*billions?\b", "billion"),
    (rf"\bin\s+{_UNITS}?\s*thousands?\b", "thousand"),
    (rf"\({_UNITS}\s*(?:in\s*)?crores?\)", "crore"),
    (rf"\({_UNITS}\s*(?:in\s*)?lakhs?\)", "lakh"),
    (rf"\({_UNITS}\s*(?:in\s*)?millions?\)", "million"),
]
SCALE_MENTIONED = [
    (r"\bcrores?\b", "crore"),
    (r"\blakhs?\b", "lakh"),
    (r"\bmillions?\b", "million"),
    (r"\bbillions?\b", "billion"),
]
CURRENCY_MENTIONED = [
    (r"₹|\brs\.?\b|\binr\b", "INR"),
    (r"\$|\busd\b", "USD"),
    (r"€|\beur\b", "EUR"),
]

# Words that do not make a title, and words with which no heading ends.
FUNCTION_WORDS = "a an and as at by for from in of on or the to with".split()
FRAGMENT_ENDS = FUNCTION_WORDS + "is are was were under over into that which".split()


def _by(text: Column, patterns: list[tuple[str, str]]) -> Column:
    return reduce(lambda rest, p: F.when(text.rlike("(?i)" + p[0]), F.lit(p[1])).otherwise(rest), reversed(patterns), F.lit(None).cast("string"))


def scale_context(text: Column, strict: bool = False) -> Column:
    """struct(scale, currency) that a text declares (strict), or mentions."""
    return F.struct(_by(text, SCALE_DECLARED if strict else SCALE_DECLARED + SCALE_MENTIONED).alias("scale"), _by(text, CURRENCY_MENTIONED).alias("currency"))


def span_end(text: Column) -> Column:
    """The calendar year in which a fiscal span ends, 1999-00 in 2000; null without a span."""
    start, tail = F.regexp_extract(text, SPAN, 1), F.regexp_extract(text, SPAN, 2)
    century = F.substring(start, 1, 2).try_cast("int") + (tail.try_cast("int") < F.substring(start, 3, 2).try_cast("int")).cast("int")
    return F.when(F.length(tail) == 4, tail).when(tail != "", F.concat(F.lpad(century.cast("string"), 2, "0"), tail))


def years_in(cell: Column) -> Column:
    return F.regexp_extract_all(cell, F.lit(YEAR), F.lit(0))


def header_year(cell: Column) -> Column:
    """The one year that a header cell names: a span's end, a single year, FY24; null for none or several."""
    years, short = years_in(cell), F.regexp_extract(cell, FISCAL, 1)
    fiscal = F.when(F.length(short) == 2, F.concat(F.lit("20"), short)).when(short != "", short)
    return F.when(cell.rlike(f"{YEAR}|{FISCAL}"), F.coalesce(span_end(cell), F.when(F.size(years) == 1, F.get(years, F.lit(0))).when(F.size(years) == 0, fiscal)))


def column_years(header: Column) -> Column:
    """map<column, year> of the header's cells that name one year."""
    pairs = F.filter(F.transform(header, lambda c, i: F.struct(i.alias("i"), header_year(c).alias("y"))), lambda x: x["y"].isNotNull())
    return F.map_from_entries(pairs)


def figures(cell: Column) -> Column:
    """The figures of a cell; several where columns were merged."""
    return F.regexp_extract_all(F.trim(cell), F.lit(FIGURE), F.lit(0))


def carries_data(cells: Column) -> Column:
    """Whether a row has figures beyond its label that are not all years."""
    rest = F.slice(cells, 2, F.greatest(F.size(cells), F.lit(1)))
    return F.exists(rest, lambda c: F.trim(c).rlike(NUMERIC) & F.exists(figures(c), lambda f: ~F.trim(f).rlike(r"^(?:19|20)\d{2}$")))


def is_data_row(cells: Column) -> Column:
    """Whether a row has a label and a numeric cell behind it."""
    rest = F.slice(cells, 2, F.greatest(F.size(cells), F.lit(1)))
    return F.coalesce((F.size(cells) > 0) & (F.trim(F.get(cells, F.lit(0))) != "") & F.exists(rest, lambda c: F.trim(c).rlike(DATA_CELL)), F.lit(False))


def note_columns(header: Column) -> Column:
    return F.filter(F.transform(header, lambda c, i: F.when(c.rlike(NOTE), i)), lambda i: i.isNotNull())


def row_segments(cells: Column) -> Column:
    """array<struct<label, first, stop>>: each label's place and the columns that belong to it, up to the next label."""
    labels = F.filter(F.transform(cells, lambda c, i: F.when(c.rlike(LABEL), i)), lambda i: i.isNotNull())
    return F.transform(labels, lambda at, k: F.struct(at.alias("label"), (at + 1).alias("first"), F.coalesce(F.get(labels, k + 1), F.size(cells)).alias("stop")))


def label_text(label: Column) -> Column:
    """A row label as it is compared with metric names."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(label), r"[^a-z0-9,\s\-]", " "), r"\s+", " "))


def label_prefixes(label: Column) -> Column:
    """What a metric's name must be for a row label to denote it: the label's opening words, at most LABEL_SLACK letters short of all."""
    text = label_text(label)
    words = F.split(text, " ")
    opening = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda n: F.array_join(F.slice(words, 1, n), " "))
    return F.filter(opening, lambda p: (p != "") & (F.length(text) <= F.length(p) + LABEL_SLACK))


def denotes(label: Column, names: Column) -> Column:
    """Whether a row label is one of the names, or one with ROW_SLACK letters behind it."""
    own = F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), r"\s+", " "), r"^[ :*#]+|[ :*#]+$", "")
    return F.exists(names, lambda n: (own == F.lower(n)) | (F.startswith(own, F.lower(n)) & (F.length(own) - F.length(n) <= ROW_SLACK)))


def is_figure(cell: Column) -> Column:
    """Whether a cell is a figure and not a reference to a note."""
    c = F.trim(cell)
    return (c != "") & ~c.rlike(NOTE_REFERENCE) & (c.rlike(GROUPED_FIGURE) | c.rlike(BARE_INTEGER))


def row_figures(cells: Column) -> Column:
    """The figures behind a row's label, merged cells split."""
    parts = lambda c: F.split(F.trim(c), r"\s+")
    own = lambda c: F.when((F.size(parts(c)) > 1) & F.forall(parts(c), is_figure), parts(c)).when(is_figure(c), F.array(c)).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(F.slice(cells, 2, F.greatest(F.size(cells), F.lit(1))), own))


def merged_header(rows: Column) -> Column:
    """struct(header, rows): the rows above the first data row, joined column by column, and their number; rows: array<array<string>>.

    Without a data row among the first four, the first row is the header and none is counted; a table that starts
    with data has none."""
    data = F.transform(F.slice(rows, 1, 4), is_data_row)
    first = F.array_position(data, F.lit(True)).cast("int") - 1
    head = F.slice(rows, 1, F.greatest(first, F.lit(0)))
    width = F.array_max(F.transform(head, F.size))
    columns = F.transform(F.sequence(F.lit(0), F.greatest(width, F.lit(1)) - 1), lambda c: F.array_join(F.filter(F.transform(head, lambda r: F.trim(F.coalesce(F.get(r, c), F.lit("")))), lambda p: p != ""), " "))
    some = lambda cells: F.when(F.exists(cells, lambda c: c != ""), cells)
    return F.struct(
        F.when(F.size(rows) <= 0, F.lit(None)).when(first < 0, some(F.get(rows, F.lit(0)))).when(first > 0, some(columns)).alias("header"),
        F.when((F.size(rows) > 0) & (first > 0), first).otherwise(0).alias("rows"),
    )


def pipe_table(rows: Column, header: Column) -> Column:
    """Rows as lines between pipes, padded to the widest, below the header and its rule."""
    all_ = F.when(header.isNotNull() & ((F.size(rows) == 0) | (F.get(rows, F.lit(0)) != header)), F.concat(F.array(header), rows)).otherwise(rows)
    width = F.array_max(F.transform(all_, F.size))
    cell = lambda c: F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), width - 1), lambda i: cell(F.get(r, i))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), width))
    body = F.when(header.isNotNull(), F.slice(all_, 2, F.greatest(F.size(all_), F.lit(1)))).otherwise(all_)
    lines = F.when(header.isNotNull(), F.concat(F.array(line(header), rule), F.transform(body, line))).otherwise(F.transform(body, line))
    return F.when(F.coalesce(width, F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise("")


def unit_banner(scale: Column, currency: Column, page: Column, source_page: Column) -> Column:
    """A statement of a table's units, and of the page they were taken from."""
    said = F.replace(F.concat(F.lit("(All figures in "), F.coalesce(currency, F.lit("")), F.lit(" "), F.coalesce(scale, F.lit("")), F.lit(")")), F.lit("  "), F.lit(" "))
    from_ = F.when(inherited(page, source_page), F.concat(F.lit(" [units declared on page "), source_page.cast("string"), F.lit(", not on this page]"))).otherwise("")
    return F.when(scale.isNull() & currency.isNull(), "(units not declared in the source document)").otherwise(F.concat(said, from_))


def inherited(page: Column, source_page: Column) -> Column:
    return F.coalesce(source_page != page, F.lit(False))


def caption(page_text: Column, rows: Column) -> Column:
    """The page's text around a table: 400 characters before its first cell and 120 from there; the page's opening without it."""
    first = F.get(F.filter(F.transform(F.flatten(rows), lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda c: c != ""), F.lit(0))
    at = F.instr(page_text, F.substring(first, 1, 40))
    start = F.greatest(at - 400, F.lit(1))
    return F.when(first.isNull() | (at == 0), F.substring(page_text, 1, 400)).otherwise(F.substring(page_text, start, at + 120 - start))


def is_spillover(paragraph: Column, numerals: Column) -> Column:
    """Whether a paragraph is a flattened copy of a table: three numerals and more, no sentence, 60 % of them among the table's."""
    own = F.regexp_extract_all(paragraph, F.lit(r"\d[\d,.]*"), F.lit(0))
    covered = F.size(F.filter(own, lambda n: F.array_contains(numerals, n)))
    return (F.size(own) >= 3) & ~paragraph.rlike(r"[.!?](?:\s|$)") & (covered / F.size(own) >= 0.6)


def is_heading(line: Column) -> Column:
    """Whether a line looks like a heading: short, no fragment; numbered, in capitals, or mostly of capital words."""
    s = F.trim(line)
    words = F.split(s, r"\s+")
    last = F.lower(F.element_at(words, -1))
    broken = (s == "") | (F.length(s) > 90) | s.endswith(".") | (F.size(words) > 12) | s.rlike("[,;:]$") | last.isin(FRAGMENT_ENDS)
    broken = broken | (F.length(F.regexp_replace(s, r"[^)]", "")) > F.length(F.regexp_replace(s, r"[^(]", "")))
    letters = F.regexp_replace(s, r"[^\p{L}]", "")
    capitals = (F.length(letters) > 3) & ~letters.rlike(r"[^\p{Lu}]")
    title = F.filter(words, lambda w: w.rlike(r"^\p{L}") & ~F.lower(w).isin(FUNCTION_WORDS))
    mostly = (F.size(title) >= 2) & (F.size(F.filter(title, lambda w: w.rlike(r"^\p{Lu}"))) / F.nullif(F.size(title), F.lit(0)) >= 0.7)
    return F.coalesce(~broken & (s.rlike(r"^\s*(?:[Nn]ote\s+)?\d+(?:\.\d+)*\s+[A-Z]") | capitals | mostly), F.lit(False))


def last_heading(text: Column) -> Column:
    """The last heading of a page, or null."""
    return F.trim(F.try_element_at(F.filter(F.split(text, r"\r?\n"), is_heading), F.lit(-1)))


def header_basis(line: Column) -> Column:
    """consolidated or standalone, where a short line names a statement and exactly one of them; else null."""
    s = F.trim(line)
    statement = (s != "") & (F.length(s) <= 90) & s.rlike("(?i)financial statement|balance sheet|statement of|schedules")
    c, a = s.rlike("(?i)consolidated"), s.rlike("(?i)standalone")
    return F.when(statement & c & ~a, "consolidated").when(statement & a & ~c, "standalone")


def page_basis(text: Column) -> Column:
    """The basis that the first of a page's three opening lines with one declares."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
    return F.get(F.filter(F.transform(F.slice(lines, 1, 3), header_basis), lambda b: b.isNotNull()), F.lit(0))
