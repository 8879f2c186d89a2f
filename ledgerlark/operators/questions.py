"""Questions, gold sets, arms and answers: parsing, audits, classification, generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.values import MONEY


#: Rows of one first word, as a share of all, from which it is joined by broadcast: 1 / FREQUENT, so that there are fewer than FREQUENT such words.
FREQUENT = 200


def trie(lexicon: DataFrame) -> DataFrame:
    """lexicon (alias, canonical) as the edges of a tree of tokens: depth, node (the words so far), token, child, and the canonical name
    where child is a whole alias (of several the last in order)."""
    a = lexicon.select("canonical", X.tokens(F.col("alias")).alias("t")).where("size(t) > 0")
    step = F.explode(F.sequence(F.lit(1), F.size("t"))).alias("depth")
    e = a.select("canonical", "t", step).select("depth", F.array_join(F.slice("t", 1, F.col("depth") - 1), " ").alias("node"), F.get("t", F.col("depth") - 1).alias("token"), F.array_join(F.slice("t", 1, F.col("depth")), " ").alias("child"), F.when(F.col("depth") == F.size("t"), F.col("canonical")).alias("canonical"))
    return e.groupBy("depth", "node", "token", "child").agg(F.max("canonical").alias("canonical"))


def longest_term(texts: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """lexicon (alias, canonical): the canonical name of the longest alias that stands in a text as words, ties to the last in order.

    Every word of a text starts at the root of the lexicon's tree and goes down a level at a time by an equality join on node and next word; what
    finds no edge is dropped.  Words that start more than 1 / FREQUENT of all texts' words meet the root's edges by broadcast."""
    edges = trie(lexicon).persist()
    most = edges.agg(F.max("depth")).first()[0] or 0
    words = texts.select(key, X.tokens(F.col(text)).alias("t"))
    state = words.select(key, F.posexplode("t").alias("at", "token"), "t").select(key, "token", F.slice("t", F.col("at") + 2, max(most - 1, 1)).alias("rest"))
    root = edges.where("depth = 1").select("token", "child", "canonical")
    counts = state.join(root, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n")).persist()
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = F.broadcast(counts.where(F.col("n") * FREQUENT > total).select("token"))  # fewer than FREQUENT
    state = state.join(F.broadcast(root.join(often, "token", "left_semi")), "token").unionByName(state.join(often, "token", "left_anti").join(root.join(often, "token", "left_anti"), "token"))
    hits = []
    for depth in range(1, most + 1):
        hits.append(state.where("canonical is not null").select(key, F.col("child").alias("alias"), "canonical"))
        if depth < most:
            down = edges.where(F.col("depth") == depth + 1).select("node", "token", "child", "canonical")
            on = state.where("size(rest) > 0").select(key, F.col("child").alias("node"), F.get("rest", F.lit(0)).alias("token"), F.slice("rest", 2, most).alias("rest"))
            state = on.join(down, ["node", "token"]).select(key, "rest", "child", "canonical").persist()
    if not hits:
        return texts.select(key, F.lit(None).cast("string").alias("canonical")).where("1 = 0")
    return reduce(DataFrame.unionByName, hits).groupBy(key).agg(F.max_by("canonical", F.struct(F.length("alias"), F.col("alias"))).alias("canonical"))


# Metrics made of others, by the first pattern that a question holds; components, operation and unit.
DERIVED = [
    (r"\breturn\s+on\s+equity\b|\broe\b", "return on equity", ["profit for the year", "total equity"], "ratio", "percent"),
    (r"\breturn\s+on\s+assets\b|\broa\b", "return on assets", ["profit for the year", "total assets"], "ratio", "percent"),
    (r"\bnet\s+profit\s+margin\b|\bprofit\s+margin\b", "net profit margin", ["profit for the year", "revenue from operations"], "margin", "percent"),
    (r"\bcurrent\s+ratio\b", "current ratio", ["total current assets", "total current liabilities"], "ratio", "ratio"),
    (r"\bdebt[\s-]*(?:to|/)[\s-]*equity\b|\bd/e\s+ratio\b|\bgearing\b", "debt to equity ratio", ["borrowings", "total equity"], "ratio", "ratio"),
    (r"\bgoodwill\b.{0,40}\b(?:share|proportion|percentage|fraction)\b|\b(?:share|proportion|percentage|fraction)\b.{0,40}\bgoodwill\b", "goodwill as a share of total assets", ["goodwill", "total assets"], "percentage_of", "percent"),
]


def decomposed(question: Column, derived: list[tuple] = DERIVED) -> Column:
    """struct(metric, components, operation, unit_kind) of the first derived metric that a question names, or null."""
    out = None
    for pattern, metric, components, operation, unit in reversed(derived):
        own = F.struct(F.lit(metric).alias("metric"), F.array(*[F.lit(c) for c in components]).alias("components"), F.lit(operation).alias("operation"), F.lit(unit).alias("unit_kind"))
        out = F.when(question.rlike("(?i)" + pattern), own) if out is None else F.when(question.rlike("(?i)" + pattern), own).otherwise(out)
    return out


def specs(questions: DataFrame, key: str, text: str, lexicon: DataFrame, derived: list[tuple] = DERIVED) -> DataFrame:
    """Question to spec: operation, fiscal year or null, metric, expected unit, derived metric, ambiguities, and the
    sub-questions (metric, search_text, statement), one for each figure needed.

    lexicon: alias, canonical, and statement and unit_kind if known.  A question without content words has no sub-question.
    A derived metric is asked for by its components, each with the statement that reports it; any other question by its
    content words, with the statement only where they are a metric's name and nothing else."""
    for c in ("statement", "unit_kind"):
        if c not in lexicon.columns:
            lexicon = lexicon.withColumn(c, F.lit(None).cast("string"))
    t = F.col(text)
    base = questions.select(key, F.coalesce(t, F.lit("")).alias("q")).select(key, "q", X.content_terms(F.col("q")).alias("terms"), X.fiscal_years(F.col("q")).alias("fiscal_years"), X.only_fiscal_year(F.col("q")).alias("fiscal_year"), decomposed(F.col("q"), derived).alias("made"))
    names = lexicon.groupBy("canonical").agg(F.max("statement").alias("statement"), F.max("unit_kind").alias("unit_kind"), F.collect_set(F.lower("alias")).alias("aliases"))
    base = base.join(longest_term(questions, key, text, lexicon), key, "left").join(names, "canonical", "left").withColumn("stripped", X.search_text(F.col("q")))
    asked = F.size("terms") > 0
    op = F.when(~asked, "lookup").otherwise(F.coalesce("made.operation", X.operation(F.col("q"))))
    own = F.when(op.isin("percentage_change", "margin", "percentage_of", "cagr"), "percent").when(op == "ratio", "ratio").otherwise(F.coalesce("unit_kind", F.lit("currency")))
    unit = F.when(~asked, "unknown").otherwise(F.coalesce("made.unit_kind", own))
    exact = F.array_contains("aliases", F.lower("stripped")) | (F.lower("stripped") == F.lower("canonical"))
    single = F.array(F.struct(F.col("stripped").alias("metric"), F.when(F.coalesce(exact, F.lit(False)), X.with_hint(F.col("stripped"), F.col("statement"))).otherwise(F.col("stripped")).alias("search_text"), F.col("statement").alias("statement")))
    parts = base.where("made is not null").select(key, F.posexplode("made.components").alias("pos", "component")).join(names.select(F.col("canonical").alias("component"), F.col("statement").alias("hint")), "component", "left")
    made = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("component").alias("metric"), X.with_hint(F.col("component"), F.col("hint")).alias("search_text"), F.col("hint").alias("statement")))).alias("subs"))
    made = made.select(key, F.transform("subs", lambda s: F.struct(s["metric"].alias("metric"), s["search_text"].alias("search_text"), s["statement"].alias("statement"))).alias("subs"))
    doubts = F.array_compact(F.array(F.when(~asked, F.lit("no_content")), F.when(asked & F.col("fiscal_year").isNull(), F.lit("no_single_year")), F.when(F.size("fiscal_years") > 1, F.lit("several_years")), F.when(asked & F.col("made").isNull() & F.col("canonical").isNull(), F.lit("unknown_metric"))))
    subs = F.when(~asked, F.array().cast("array<struct<metric:string,search_text:string,statement:string>>")).otherwise(F.coalesce("subs", single))
    return base.join(made, key, "left").select(key, op.alias("operation"), "fiscal_year", F.col("canonical").alias("metric"), unit.alias("expected_unit"), F.when(asked, F.col("made.metric")).alias("derived_metric"), doubts.alias("ambiguities"), subs.alias("sub_questions"))


def coverage(subs: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """subs (key, sub), hits (key, sub, doc): how many documents each sub-question found, none included."""
    return subs.join(hits.groupBy(key, "sub").agg(F.count("*").alias("n")), [key, "sub"], "left").fillna(0, ["n"])


def uncovered(subs: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """The sub-questions that found nothing: what a further round of retrieval asks for."""
    return subs.join(hits, [key, "sub"], "left_anti")


def from_payload(payload: Column, operations: list[str]) -> Column:
    """struct(operation, expected_unit, metrics) of a model's JSON spec; null fields where it is no object or names none known."""
    p = F.from_json(payload, "operation string, expected_unit string, metrics array<string>")
    return F.struct(F.when(F.lower(p["operation"]).isin(operations), F.lower(p["operation"])).alias("operation"), F.nullif(F.trim(p["expected_unit"]), F.lit("")).alias("expected_unit"), F.when(F.size(p["metrics"]) > 0, p["metrics"]).alias("metrics"))


def audit(rows: DataFrame, key: str, problems: dict[str, Column]) -> DataFrame:
    """The rows that have problems, with their names; a null condition is no problem."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in problems.items()]))
    return rows.select(key, found.alias("problems")).where("size(problems) > 0")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


# The classes of failures before a channel replied.
PROVIDER_FAILURES = "QuotaExhaustedError DailyQuotaExhausted RateLimitError ProviderUnavailableError AuthError ModelNotFoundError TimeoutError ReadTimeout ConnectError".split()


def outcome(available: Column, reason: Column, error_type: Column) -> Column:
    """answered, unavailable (no reply came), abstained (the channel declined), else parse_failure."""
    why = F.coalesce(reason, F.lit("unknown"))
    return F.when(available, "answered").when(error_type.isin(PROVIDER_FAILURES), "unavailable").when(why.contains("declined") | why.contains("insufficient"), "abstained").otherwise("parse_failure")


def program_outcome(available: Column, reason: Column, error_type: Column, executed: Column) -> Column:
    """As outcome(), where a program that ran and chose to print nothing abstained."""
    return F.when(available, "answered").when(error_type.isin(PROVIDER_FAILURES), "unavailable").when(F.coalesce(executed, F.lit(False)), "abstained").otherwise("parse_failure")


def outcome_shares(calls: DataFrame) -> DataFrame:
    """calls (channel, outcome): how many of a channel's calls came to each outcome, and their share."""
    n = calls.groupBy("channel", "outcome").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("channel")))  # four rows for a channel


def selected_answer(arbiter: Column, natural: Column, program: Column, deterministic: Column) -> tuple[Column, Column]:
    """The answer that counts and where it is from."""
    source = F.when(arbiter.isNotNull(), "verification_agent").when(natural.isNotNull(), "natural").when(program.isNotNull(), "program").when(deterministic.isNotNull(), "deterministic")
    return F.coalesce(arbiter, natural, program, deterministic), source


def abstained(answer: Column, sufficient: Column, executed: Column, arbiter_ran: Column, arbiter_resolved: Column) -> Column:
    """Whether no answer is a refusal and not a failure: evidence judged insufficient, a program that printed nothing, an arbiter without resolution."""
    no = lambda c: F.coalesce(c, F.lit(False))
    return answer.isNull() & (no(~sufficient) | no(executed) | (no(arbiter_ran) & ~no(arbiter_resolved)))


def modal_fraction(samples: DataFrame, key: str, value: str, tolerance: float = 0.005) -> DataFrame:
    """Per key: samples, the share of the largest cluster, clusters, and risk.

    Samples (in the order of pos) join the first cluster whose first value is near.  risk is .9 of the share outside the
    largest cluster and .1 of the mean distance from it, a distance counting 1 at most; null under two samples."""
    near = lambda a, b: F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))
    g = samples.where(F.col(value).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", F.col(value).cast("double").alias("v")))).alias("s"))
    start = F.array().cast("array<struct<head:double,n:int>>")
    add = lambda acc, s: F.when(F.exists(acc, lambda c: near(c["head"], s["v"])), F.transform(acc, lambda c, i: F.struct(c["head"].alias("head"), (c["n"] + F.when(i == F.array_position(F.transform(acc, lambda d: near(d["head"], s["v"])), F.lit(True)) - 1, 1).otherwise(0)).cast("int").alias("n")))).otherwise(F.concat(acc, F.array(F.struct(s["v"].alias("head"), F.lit(1).alias("n")))))
    c = g.select(key, "s", F.size("s").alias("samples"), F.aggregate("s", start, add).alias("c"))
    most = F.array_max(F.transform("c", lambda x: x["n"]))
    modal = F.get(F.filter("c", lambda x: x["n"] == most), F.lit(0))["head"]
    c = c.withColumn("fraction", most / F.col("samples")).withColumn("modal", modal)
    apart = F.aggregate("s", F.lit(0.0), lambda t, x: t + F.least(F.abs(x["v"] - F.col("modal")) / F.greatest(F.abs("modal"), F.lit(1e-9)), F.lit(1.0))) / F.col("samples")
    risk = F.when(F.col("samples") >= 2, F.least(F.lit(1.0), (1 - F.col("fraction")) * 0.9 + apart * 0.1))
    return c.select(key, "samples", "fraction", F.size("c").alias("clusters"), risk.alias("risk"))


def candidates(facts: DataFrame, min_pages: int = 1) -> DataFrame:
    """facts (document_id, metric, year, page, amount): one lookup question for each metric and year whose
    facts agree on one amount, with a stable id and its evidence pages in order."""
    g = facts.groupBy("document_id", "metric", "year").agg(F.count_distinct("amount").alias("amounts"), F.max("amount").alias("answer"), F.array_sort(F.collect_set("page")).alias("pages"))
    ok = g.where((F.col("amounts") == 1) & (F.size("pages") >= min_pages))
    text = F.concat(F.lit("What was the "), F.col("metric"), F.lit(" in "), F.col("year").cast("string"), F.lit("?"))
    return ok.select(X.stable_id("FI", F.col("document_id").cast("string"), F.col("metric"), F.col("year").cast("string")).alias("qid"), "document_id", "metric", "year", text.alias("question"), F.col("answer").cast(MONEY).alias("answer"), "pages")


def derived_candidates(facts: DataFrame, basis: DataFrame, derived: list[tuple] = DERIVED) -> DataFrame:
    """facts (document_id, metric, page, amount): a question without answer for each derived metric all of whose components a document
    reports on one basis; basis: document_id, page, basis."""
    made = facts.sparkSession.createDataFrame([(m, c, o, u) for _, m, c, o, u in derived], "derived string, components array<string>, operation string, unit_kind string")
    own = made.select("derived", "operation", "unit_kind", F.size("components").alias("need"), F.posexplode("components").alias("pos", "metric"))
    f = facts.join(basis, ["document_id", "page"]).where("basis in ('consolidated', 'standalone')")
    best = f.groupBy("document_id", "metric").agg(F.min("basis").alias("basis"))  # consolidated before standalone
    g = own.join(best, "metric").groupBy("document_id", "derived", "operation", "unit_kind", "need").agg(F.count("*").alias("have"), F.collect_set("basis").alias("bases"), F.array_sort(F.collect_list(F.struct("pos", "metric"))).alias("components"))
    ok = g.where((F.col("have") == F.col("need")) & (F.size("bases") == 1))
    return ok.select(X.stable_id("FI", F.col("document_id").cast("string"), F.col("derived")).alias("qid"), "document_id", F.col("derived").alias("metric"), "operation", "unit_kind", F.get("bases", F.lit(0)).alias("basis"), F.col("components.metric").alias("components"))


def formulations(questions: DataFrame, key: str, text: str, company: str) -> DataFrame:
    """(key, arm, query): each question as it is, without its company, without the gloss at its end, and without both."""
    t, c = F.col(text), F.col(company)
    bare = X.without_company(t, c)
    return questions.select(key, F.inline(F.array(*[F.struct(F.lit(n).alias("arm"), q.alias("query")) for n, q in (("asis", t), ("no_company", bare), ("no_gloss", X.without_gloss(t)), ("both", X.without_gloss(bare)))])))


def movement(before: DataFrame, after: DataFrame, key: str, k: int) -> DataFrame:
    """How many entered and left the top k between two rankings (key, rank)."""
    j = before.select(key, F.col("rank").alias("b")).join(after.select(key, F.col("rank").alias("a")), key, "full_outer")
    top = lambda c: F.coalesce(F.col(c) <= k, F.lit(False))
    return j.agg(F.count_if(~top("b") & top("a")).alias("entered"), F.count_if(top("b") & ~top("a")).alias("left"), F.count_if(top("b") & top("a")).alias("stayed"))


def paired(cases: DataFrame, key: str, arm: str, left: str, right: str, ok: str) -> DataFrame:
    """Both, either or neither of two arms right on the same questions."""
    a = cases.where(F.col(arm) == left).select(key, F.col(ok).alias("l"))
    b = cases.where(F.col(arm) == right).select(key, F.col(ok).alias("r"))
    return a.join(b, key).agg(F.count_if(F.col("l") & F.col("r")).alias("both"), F.count_if(F.col("l") & ~F.col("r")).alias("only_left"), F.count_if(~F.col("l") & F.col("r")).alias("only_right"), F.count_if(~F.col("l") & ~F.col("r")).alias("neither"))


def blind_spot(cases: DataFrame, *by: str) -> DataFrame:
    """Answers on which the channels agree and are wrong; the share is null where none agree."""
    c = F.col("agreed") & ~F.col("correct")
    return cases.groupBy(*by).agg(F.count_if(c).alias("count"), F.count_if("agreed").alias("of_agreed"), F.try_divide(F.count_if(c).cast("double"), F.count_if("agreed")).alias("share"))
