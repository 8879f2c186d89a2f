"""Figures as text and as exact decimals, all as built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(38,6)"

# Scale names and multipliers.
SCALES = {
    "unit": 1,
    "thousand": 10**3,
    "lakh": 10**5,
    "million": 10**6,
    "crore": 10**7,
    "billion": 10**9,
    "trillion": 10**12,
}

# Scale words, the first pattern found wins.
SCALE_PATTERNS = [
    (r"\btrillions?\b", "trillion"),
    (r"\bbillions?\b", "billion"),
    (r"\bmillions?\b", "million"),
    (r"\bthousands?\b", "thousand"),
    (r"\bcrores?\b", "crore"),
    (r"\blakhs?\b", "lakh"),
    (r"\blacs?\b", "lakh"),
    (r"\bbn\b\.?", "billion"),
    (r"\bmn\b\.?", "million"),
    (r"\bcr\b\.?", "crore"),
    (r"'000s?", "thousand"),
]

# Currency marks, the first pattern found wins.
CURRENCY_PATTERNS = [
    (r"\binr\b", "INR"),
    (r"\brs\b\.?", "INR"),
    (r"₹", "INR"),
    (r"\busd\b", "USD"),
    (r"\bus\$", "USD"),
    (r"\$", "USD"),
    (r"\beur\b", "EUR"),
    (r"€", "EUR"),
    (r"\bgbp\b", "GBP"),
    (r"£", "GBP"),
]

# Percentages, a scale letter too vague to use, footnote marks, digit groupings.
PERCENT = r"%|\bper\s?cents?\b|\bpercentage\b"
VAGUE_SCALE = r"(?<![a-z0-9])k(?![a-z0-9])"
FOOTNOTE = r"(?i)(?:\s*[*#†‡]+|\s*\([a-z]{1,2}\))+$"
WESTERN = r"^\d{1,3}(?:,\d{3})+$"
INDIAN = r"^\d{1,2}(?:,\d{2})+,\d{3}$"
NUMBER = r"-?\d[\d,]*(?:\.\d+)?"

# The powers of ten between scales that are mixed up.
POWERS = (-12, -9, -7, -6, -5, -3, -2, -1, 1, 2, 3, 5, 6, 7, 9, 12)


def _first(text: Column, patterns: list[tuple[str, str]], otherwise: Column) -> Column:
    return reduce(lambda rest, p: F.when(text.rlike("(?U)" + p[0]), F.lit(p[1])).otherwise(rest), reversed(patterns), otherwise)


def _without_first(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """The text with the first place of the first pattern found blanked."""
    blank = lambda p: F.concat(F.regexp_extract(text, f"(?Us)^(.*?)(?:{p})", 1), F.lit(" "), F.regexp_extract(text, f"(?Us)^.*?(?:{p})(.*)$", 1))
    return reduce(lambda rest, p: F.when(text.rlike("(?U)" + p[0]), blank(p[0])).otherwise(rest), reversed(patterns), text)


def multiplier(scale: Column) -> Column:
    return reduce(lambda rest, s: F.when(scale == s[0], F.lit(s[1]).cast("decimal(13,0)")).otherwise(rest), SCALES.items(), F.lit(None).cast("decimal(13,0)"))


def canonical(amount: Column, scale: Column, unit_kind: Column) -> Column:
    """A percentage as a fraction, anything else in units."""
    return F.when(unit_kind == "percent", (amount / F.lit(100).cast("decimal(3,0)")).cast(MONEY)).otherwise((amount * multiplier(scale)).cast(MONEY))


def rescale(amount: Column, scale: Column, unit_kind: Column, to: str) -> Column:
    """The amount in another scale; null for percentages."""
    return F.when(unit_kind != "percent", ((amount * multiplier(scale)).cast("decimal(28,6)") / F.lit(SCALES[to]).cast("decimal(13,0)")).cast(MONEY))


# The steps of reading a figure; each takes the columns of the one before by name and gives its own.


def _marks(m: dict[str, Column]) -> dict[str, Column]:
    return {"currency": _first(m["t"], CURRENCY_PATTERNS, m["context_currency"]), "t": _without_first(m["t"], CURRENCY_PATTERNS)}


def _unit(m: dict[str, Column]) -> dict[str, Column]:
    return {"currency": m["currency"], "kind": F.when(m["t"].rlike("(?U)" + PERCENT), F.lit("percent")).otherwise(F.coalesce(m["context_unit_kind"], F.lit("unknown"))), "t": F.regexp_replace(m["t"], "(?U)" + PERCENT, " ")}


def _scaled(m: dict[str, Column]) -> dict[str, Column]:
    return {"currency": m["currency"], "kind": m["kind"], "stated": _first(m["t"], SCALE_PATTERNS, F.lit(None).cast("string")), "rest": _without_first(m["t"], SCALE_PATTERNS)}


def _bared(m: dict[str, Column]) -> dict[str, Column]:
    second = reduce(lambda a, p: a | (m["rest"].rlike("(?U)" + p[0]) & (m["stated"] != p[1])), SCALE_PATTERNS, m["rest"].rlike(VAGUE_SCALE))
    return {**{c: m[c] for c in ("currency", "kind", "stated")}, "second": second, "trimmed": F.trim(m["rest"]), "bare": F.regexp_replace(F.trim(m["rest"]), FOOTNOTE, "")}


def _numeral(m: dict[str, Column]) -> dict[str, Column]:
    minus = F.regexp_extract(m["bare"], r"(?s)\((.*)\)", 1).rlike(r"\d")
    numeral = F.regexp_extract(F.when(minus, F.translate(m["bare"], "()", "  ")).otherwise(m["bare"]), NUMBER, 0)
    return {**{c: m[c] for c in ("currency", "kind", "stated", "second")}, "minus": minus, "numeral": numeral, "footnote": m["bare"] != m["trimmed"]}


def _figure(m: dict[str, Column]) -> Column:
    stated, kind, numeral, scale = m["stated"], m["kind"], m["numeral"], m["context_scale"]
    whole = F.regexp_replace(F.split(numeral, r"\.").getItem(0), "-", "")
    digits = F.regexp_replace(numeral, "[-,]", "").try_cast(MONEY)
    warnings = F.array_compact(F.array(
        F.when(stated.isNotNull() & m["second"], F.lit("ambiguous_compound_scale")),
        F.when(stated.isNull() & scale.isNotNull(), F.lit("scale_inherited_from_context")),
        F.when(stated.isNull() & scale.isNull() & ~kind.isin("percent", "ratio"), F.lit("no_scale_determined")),
        F.when(m["footnote"], F.lit("footnote_marker_stripped")),
        F.when(numeral.contains(",") & ~whole.rlike(WESTERN) & ~whole.rlike(INDIAN), F.lit("irregular_grouping")),
    ))
    amount = F.when(m["minus"] | numeral.startswith("-"), -digits).otherwise(digits).cast(MONEY)
    final = F.when((kind == "unknown") & m["currency"].isNotNull(), F.lit("currency")).otherwise(kind)
    return F.when(numeral != "", F.struct(amount.alias("amount"), F.coalesce(stated, scale, F.lit("unit")).alias("scale"), final.alias("unit_kind"), m["currency"].alias("currency"), F.array_sort(warnings).alias("warnings")))


_STEPS = (_marks, _unit, _scaled, _bared, _numeral)


def _opened(text: Column) -> Column:
    return F.lower(F.translate(F.trim(F.regexp_replace(text, "[\u00a0\u2007\u2009\u202f]", " ")), "−–—", "---"))


def _context(scale: Column | None, currency: Column | None, unit_kind: Column | None) -> dict[str, Column]:
    return {f"context_{n}": F.lit(None).cast("string") if c is None else c for n, c in (("scale", scale), ("currency", currency), ("unit_kind", unit_kind))}


def parse(text: Column, context_scale: Column | None = None, context_currency: Column | None = None, context_unit_kind: Column | None = None) -> Column:
    """A struct (amount, scale, unit_kind, currency, warnings) or null where the text names no figure.

    Steps in this order: blanks and dashes, currency, percent, scale, second scale word, scale from the
    context, footnote marks, parentheses around digits as minus, the number, its digit grouping.
    One expression for any place; over a whole column parsed() is far faster.
    """
    context = _context(context_scale, context_currency, context_unit_kind)

    def after(steps, m: Column, names: list[str]) -> Column:
        own = {n: m[n] for n in names} | context
        if not steps:
            return _figure(own)
        got = steps[0](own)
        return _let(F.struct(*[c.alias(n) for n, c in got.items()]), lambda x: after(steps[1:], x, list(got)))

    return _let(F.struct(_opened(text).alias("t")), lambda x: after(_STEPS, x, ["t"]))


def plain(figure: Column, context_scale: Column | None = None, context_currency: Column | None = None, context_unit_kind: Column | None = None) -> Column:
    """What parse() gives for a figure of digits, commas, a point, minus signs, parentheses and blanks alone, without the steps that look for words and marks."""
    context = _context(context_scale, context_currency, context_unit_kind)
    return _figure(
        {
            "stated": F.lit(None).cast("string"), "second": F.lit(False), "footnote": F.lit(False), "context_scale": context["context_scale"], "currency": context["context_currency"],
            "kind": F.coalesce(context["context_unit_kind"], F.lit("unknown")), "minus": figure.rlike(r"(?s)\(.*\d.*\)"), "numeral": F.regexp_extract(figure, NUMBER, 0),
        }
    )


def _let(value: Column, then) -> Column:
    """then(value), with the value worked out once."""
    return F.transform(F.array(value), then).getItem(0)


def parsed(rows: DataFrame, name: str, text: Column, context_scale: Column | None = None, context_currency: Column | None = None, context_unit_kind: Column | None = None) -> DataFrame:
    """rows with the figure that parse() reads as a column, one projection for each step, so that code is generated for all of them."""
    p = f"__{name}_"
    context = _context(context_scale, context_currency, context_unit_kind)
    out, names = rows.withColumn(f"{p}t", _opened(text)), ["t"]
    for step in _STEPS:
        got = step({n: F.col(f"{p}{n}") for n in names} | context)
        out, names = out.select(*rows.columns, *[c.alias(f"{p}{n}") for n, c in got.items()]), list(got)
    return out.select(*rows.columns, _figure({n: F.col(f"{p}{n}") for n in names} | context).alias(name))


def relative_difference(a: Column, b: Column) -> Column:
    """Symmetric, zero where both are zero; as a double."""
    top = F.greatest(F.abs(a), F.abs(b)).cast("double")
    return F.when(top == 0, F.lit(0.0)).otherwise(F.abs(a - b).cast("double") / top)


def power_of_ten(a: Column, b: Column, tolerance: float) -> Column:
    """The listed n with |a| about |b| * 10**n, or null; a tolerance under a half leaves one n at most, the nearest."""
    ratio = F.abs(a).cast("double") / F.nullif(F.abs(b).cast("double"), F.lit(0.0))
    n = F.round(F.log10(ratio))
    power = F.pow(F.lit(10.0), n)
    near = F.abs(ratio - power) / F.greatest(ratio, power) <= tolerance
    return F.when((a != 0) & (b != 0) & near & n.isin([float(p) for p in POWERS]), n.cast("int"))


def compatible(left: Column, right: Column) -> Column:
    """Whether two unit kinds can be compared: unknown with all, percent with ratio, else equal ones."""
    dim = lambda k: F.when(k.isin("percent", "ratio"), F.lit("dimensionless")).otherwise(k)
    return (left == "unknown") | (right == "unknown") | (dim(left) == dim(right))


def degroup(text: Column) -> Column:
    """Commas out of canonically grouped figures, others untouched."""
    return F.regexp_replace(text, r"(?<=\d),(?=\d{2,3}(?:\D|$))", "")


def canonical_match(value: Column, gold: Column, tau: float) -> Column:
    """Whether a value in units equals gold within tau; zero only equals zero; false where either is missing."""
    return F.coalesce(F.when(gold == 0, value == 0).otherwise(F.abs(value - gold).cast("double") / F.abs(gold).cast("double") <= tau), F.lit(False))


def agrees(bound: Column, candidate: Column, tau: float = 0.005) -> Column:
    """canonical_match, but null where there is no candidate to compare."""
    return F.when(candidate.isNotNull(), canonical_match(bound, candidate, tau))


def unit_of(text: Column) -> Column:
    """A stated unit as struct(unit_kind, scale, currency): percent, ratio words, else currency or scale."""
    low = F.lower(F.coalesce(text, F.lit("")))
    none = F.lit(None).cast("string")
    scale, currency = _first(low, SCALE_PATTERNS, none), _first(low, CURRENCY_PATTERNS, none)
    percent, ratio = low.contains("percent") | low.contains("%"), low.contains("ratio") | low.contains("times") | low.isin("x", "multiple")
    kind = F.when(percent, "percent").when(ratio, "ratio").when(currency.isNotNull() | scale.isNotNull(), "currency").otherwise("unknown")
    return F.struct(kind.alias("unit_kind"), F.when(percent | ratio, "unit").otherwise(F.coalesce(scale, F.lit("unit"))).alias("scale"), F.when(~(percent | ratio), currency).alias("currency"))


def program_value(value: Column, unit: Column) -> Column:
    """The figure that a program printed, as struct(amount, scale, unit_kind, currency); null where it is no number."""
    amount, u = value.try_cast(MONEY), unit_of(unit)
    return F.when(amount.isNotNull(), F.struct(amount.alias("amount"), u["scale"].alias("scale"), u["unit_kind"].alias("unit_kind"), u["currency"].alias("currency")))


def stated(amount: Column, scale: Column, unit_kind: Column, currency: Column) -> Column:
    """An answer in words, its channel hidden: the amount and its unit."""
    plain = F.regexp_replace(amount.cast("string"), r"\.?0+$", "")
    plain = F.when(amount.cast("string").contains("."), plain).otherwise(amount.cast("string"))
    unit = F.when(unit_kind.isin("percent", "ratio"), unit_kind).otherwise(F.concat_ws(" ", currency, F.when(scale != "unit", scale)))
    return F.when(amount.isNull(), "no answer produced").otherwise(F.trim(F.concat_ws(" ", plain, unit)))


def round_trip(amount: Column, scale: Column, unit_kind: Column, currency: Column) -> Column:
    """A value as text that parse() reads back: currency, amount, scale, percent."""
    return F.concat_ws(" ", currency, amount.cast("string"), F.when(scale != "unit", scale), F.when(unit_kind == "percent", "percent"))


def figure_variants(figure: Column) -> Column:
    """How a figure may be printed: plain, in western and in Indian groups, with its fraction less zeros and without, a
    negative one also in parentheses and with a minus; longest first.  Empty for text that is no figure."""
    raw = F.replace(F.trim(figure), F.lit(","), F.lit(""))
    minus, body = raw.startswith("-"), F.regexp_replace(raw, "^-+", "")
    whole, frac = F.split(body, r"\.").getItem(0), F.regexp_replace(F.coalesce(F.get(F.split(body, r"\."), F.lit(1)), F.lit("")), "0+$", "")
    western = F.regexp_replace(F.regexp_replace(whole, "^0+(?=[0-9])", ""), r"(?<=\d)(?=(?:\d{3})+$)", ",")
    indian = F.when(F.length(whole) > 3, F.regexp_replace(whole, r"(?<=\d)(?=(?:\d{2})*\d{3}$)", ",")).otherwise(whole)
    bodies = F.array_distinct(F.array(whole, western, indian))
    out = F.when(frac != "", F.concat(bodies, F.transform(bodies, lambda b: F.concat(b, F.lit("."), frac)))).otherwise(bodies)
    out = F.when(minus, F.concat(out, F.transform(out, lambda v: F.concat(F.lit("("), v, F.lit(")"))), F.transform(out, lambda v: F.concat(F.lit("-"), v)))).otherwise(out)
    ranked = F.array_sort(F.array_distinct(out), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.when(body.rlike(r"^[0-9.]*[0-9][0-9.]*$"), ranked).otherwise(F.array().cast("array<string>"))


def searchable_variants(figure: Column) -> Column:
    """The variants of three digits and more."""
    return F.filter(figure_variants(figure), lambda v: F.length(F.regexp_replace(v, r"\D", "")) >= 3)


#: An operand of calculate().
OPERAND = f"struct<value:{MONEY},unit_kind:string,currency:string>"


def operand_facts(operands: Column) -> Column:
    """What calculate() needs of an array of OPERAND whatever the operation, as a struct: worked out once where several operations follow."""
    value = F.transform(operands, lambda o: o["value"].cast("double"))
    kinds = F.array_distinct(F.transform(operands, lambda o: o["unit_kind"]))
    known, currencies = F.filter(kinds, lambda k: k != "unknown"), F.array_compact(F.array_distinct(F.transform(operands, lambda o: o["currency"])))
    own = {
        "size": F.size(operands), "missing": F.exists(operands, lambda o: o.isNull() | o["value"].isNull()), "a": F.get(value, F.lit(0)), "b": F.get(value, F.lit(1)),
        "total": F.aggregate(F.transform(operands, lambda o: o["value"]), F.lit(0).cast(MONEY), lambda s, x: (s + x).cast(MONEY)).cast("double"), "product": F.aggregate(value, F.lit(1.0), lambda s, x: s * x),
        "less": (F.get(operands, F.lit(0))["value"] - F.get(operands, F.lit(1))["value"]).cast("double"), "mixed": F.array_contains(kinds, "percent") & (F.size(kinds) > 1),
        "kinds": F.size(known), "kind": F.get(known, F.lit(0)), "currencies": F.size(currencies), "currency": F.get(currencies, F.lit(0)),
    }
    return F.struct(*[c.alias(n) for n, c in own.items()])


def calculate(operation: Column, operands: Column, years: Column | None = None) -> Column:
    """struct(ok, value, unit_kind, currency, error) of an operation on an array of OPERAND, values in units.

    Sums, differences and averages need one unit kind and one currency; change and growth take (before, now) over the
    size of the base, which may be negative; parts and ratios take (part, whole)."""
    return operated(operation, operand_facts(operands), years)


def operated(operation: Column, facts: Column, years: Column | None = None) -> Column:
    """calculate() from operand_facts()."""
    a, b, size, total = facts["a"], facts["b"], facts["size"], facts["total"]
    n = F.lit(None).cast("double") if years is None else years.cast("double")
    additive, pair = operation.isin("sum", "difference", "average"), operation.isin("difference", "ratio", "percentage_change", "growth_rate", "margin", "percentage_of", "cagr")
    error = (
        F.when(F.coalesce(size, F.lit(0)) <= 0, "no operands supplied").when(facts["missing"], "operand missing")
        .when(~operation.isin("sum", "difference", "product", "average", "ratio", "margin", "percentage_of", "percentage_change", "growth_rate", "cagr"), "unsupported operation")
        .when(additive & facts["mixed"], "incompatible unit kinds").when(additive & (facts["kinds"] > 1), "incompatible unit kinds")
        .when(additive & (facts["currencies"] > 1), "different currencies").when(pair & (size != 2), "exactly 2 operands required")
        .when(operation.isin("ratio", "margin", "percentage_of") & (b == 0), "division by zero").when(operation.isin("percentage_change", "growth_rate") & (a == 0), "base of 0")
        .when((operation == "cagr") & n.isNull(), "number of years required").when((operation == "cagr") & (n <= 0), "positive number of years required")
        .when((operation == "cagr") & (a <= 0), "non-positive start").when((operation == "cagr") & (b < 0), "negative end")
    )
    out = (
        F.when(operation == "sum", total).when(operation == "average", total / size).when(operation == "difference", facts["less"])
        .when(operation == "product", facts["product"]).when(operation.isin("ratio", "margin", "percentage_of"), a / F.nullif(b, F.lit(0.0)))
        .when(operation.isin("percentage_change", "growth_rate"), (b - a) / F.nullif(F.abs(a), F.lit(0.0))).when((operation == "cagr") & (a > 0) & (b >= 0) & (n > 0), F.pow(b / F.nullif(a, F.lit(0.0)), 1 / n) - 1)
    )
    kind = F.when(additive, F.coalesce(facts["kind"], F.lit("unknown"))).when(operation == "ratio", "ratio").when(operation == "product", "unknown").otherwise("percent")
    currency = F.when(additive | (operation == "product"), facts["currency"])
    ok = error.isNull()
    return F.struct(ok.alias("ok"), F.when(ok, out).alias("value"), F.when(ok, kind).otherwise("unknown").alias("unit_kind"), F.when(ok, currency).alias("currency"), error.alias("error"))


def presented(result: Column) -> Column:
    """A result of calculate() as the figure a channel answers with: fractions of a percentage times a hundred."""
    return F.when(result["unit_kind"] == "percent", result["value"] * 100).otherwise(result["value"])


def judge(amount: Column, scale: Column, kind: Column, currency: Column, gold: Column, gold_kind: Column, gold_currency: Column, tau: float, assume: bool = True) -> Column:
    """struct(correct, mismatch, rel_err, unit_assumed) of a predicted figure against gold in units.

    In this order: gold, prediction, unit kind, currency, zero, sign, magnitude.  A prediction without a unit kind is
    read under gold's convention if assume, else it is a mismatch of kinds; gold without one is not held against it."""
    silent = (kind == "unknown") & (gold_kind != "unknown")
    own = canonical(amount, scale, F.when(silent, gold_kind).otherwise(kind))
    dim = lambda k: F.when(k.isin("percent", "ratio"), F.lit("dimensionless")).otherwise(k)
    unlike = (kind != "unknown") & (gold_kind != "unknown") & (dim(kind) != dim(gold_kind))
    rel = F.when(gold != 0, F.abs(own - gold).cast("double") / F.abs(gold).cast("double"))
    mismatch = (
        F.when(gold.isNull(), "missing_gold").when(amount.isNull(), "missing_prediction").when(silent & F.lit(not assume), "unit_kind").when(unlike, "unit_kind")
        .when(currency != gold_currency, "currency").when((gold == 0) & (F.abs(own).cast("double") > 1e-9), "magnitude").when(gold == 0, F.lit(None).cast("string"))
        .when(((own > 0) != (gold > 0)) & (own != 0), "sign").when(rel > tau, "magnitude")
    )
    judged = amount.isNotNull() & gold.isNotNull()
    return F.struct(mismatch.isNull().alias("correct"), F.coalesce(mismatch, F.lit("none")).alias("mismatch"), F.when(judged & ~mismatch.isin("unit_kind", "currency") | mismatch.isNull(), rel).alias("rel_err"), F.coalesce(judged & silent & F.lit(assume), F.lit(False)).alias("unit_assumed"))
