"""Arms and campaigns: validity, request and token budgets, what is done and what is left, allowances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import percentiles

from .questions import audit

# Tokens of a prompt, and the ways of retrieval.
PROMPT_TOKENS = 1780
RETRIEVAL = ["none", "semantic", "hybrid", "oracle"]


def is_detector() -> Column:
    """Whether an arm gives a score to detect errors with."""
    return F.col("use_consistency") | (F.col("self_consistency_samples") > 1)


def channels() -> Column:
    return F.array_compact(F.array(F.when(F.col("use_natural"), F.lit("natural")), F.when(F.col("use_program"), F.lit("program")), F.when(F.col("use_deterministic"), F.lit("deterministic"))))


def arm_problems(arms: DataFrame) -> DataFrame:
    """(name, problems) of arms that cannot run as they are set up."""
    return audit(arms, "name", {
        "no_reasoning_channel": ~(F.col("use_natural") | F.col("use_program")), "unknown_retrieval": ~F.col("retrieval").isin(RETRIEVAL), "nothing_to_compare": F.col("use_consistency") & (F.size(channels()) < 2),
        "arbiter_without_consistency": F.col("use_verification_agent") & ~F.col("use_consistency"), "one_sample": F.col("self_consistency_samples") == 1,
    })


def detectors(arms: DataFrame) -> DataFrame:
    """The arms with a score, each once."""
    return arms.where(is_detector()).dropDuplicates(["name"])


def grid(arms: DataFrame, questions: DataFrame) -> DataFrame:
    """(arm, question_id) of all that a campaign is to run; arms are a handful."""
    return questions.select("question_id").crossJoin(arms.select(F.col("name").alias("arm")))


def calls(arms: DataFrame) -> DataFrame:
    """(name, role, calls): model calls that one question takes; the arbiter's as if it always ran."""
    samples = F.greatest(F.lit(1), F.col("self_consistency_samples"))
    parts = F.array(
        F.struct(F.lit("natural_channel").alias("role"), F.when(F.col("use_natural"), samples).otherwise(0).alias("calls")),
        F.struct(F.when(F.col("same_model_both_channels"), "natural_channel").otherwise("program_channel").alias("role"), F.col("use_program").cast("int").alias("calls")),
        F.struct(F.lit("verification_agent").alias("role"), F.col("use_verification_agent").cast("int").alias("calls")),
    )
    return arms.select("name", F.inline(parts)).where("calls > 0").groupBy("name", "role").agg(F.sum("calls").alias("calls"))


def budget(arms: DataFrame, questions: int) -> DataFrame:
    """Requests of each arm and role, of each arm, and in total (GROUPING SETS; null: all), and how many of them the arbiter's are at most."""
    c = calls(arms).withColumn("requests", F.col("calls") * questions)
    g = c.groupingSets([["name", "role"], ["name"], []], "name", "role")
    return g.agg(F.sum("requests").alias("requests"), F.coalesce(F.sum(F.when(F.col("role") == "verification_agent", F.col("requests"))), F.lit(0)).alias("arbiter_upper_bound"))


def by_provider(arms: DataFrame, bindings: DataFrame, questions: int, max_tokens: int) -> DataFrame:
    """(provider, requests, tokens): bindings (role, provider, model) say who serves a role; roles nobody serves are left out."""
    c = calls(arms).groupBy("role").agg((F.sum("calls") * questions).alias("requests")).join(bindings, "role")
    return c.groupBy("provider").agg(F.sum("requests").alias("requests")).withColumn("tokens", F.col("requests") * (PROMPT_TOKENS + max_tokens))


def tokens_per_question(arms: DataFrame, bindings: DataFrame, max_tokens: int, probe: int = 10) -> DataFrame:
    """(provider, tokens) of one question, costed over `probe` questions; a provider that serves none of it has no row."""
    return by_provider(arms, bindings, probe, max_tokens).select("provider", F.floor(F.col("tokens") / probe).alias("tokens"))


def affordable(tokens: Column, per_question: Column) -> Column:
    """Questions that an allowance is enough for; null where it does not bind."""
    return F.when(per_question > 0, F.floor(tokens / per_question))


def days_at(total: Column, per_day: Column) -> Column:
    return F.when(F.coalesce(per_day, F.lit(0)) > 0, total / per_day)


def tokens_available(cap: Column, day: Column, spent: Column, now: Column) -> Column:
    """What is left of today's cap; all of it if nothing was spent today, null without a cap."""
    today = F.when(day == F.to_date(now), F.coalesce(spent, F.lit(0))).otherwise(F.lit(0))
    return F.when(cap.isNotNull(), F.greatest(F.lit(0), cap - today))


def next_reset(now: Column) -> Column:
    return F.date_trunc("day", now) + F.expr("INTERVAL 1 DAY")


def whole_days_before(deadline: Column, now: Column) -> Column:
    """Whole days that begin after now and end before the deadline."""
    return F.greatest(F.lit(0), F.floor((F.unix_timestamp(deadline) - F.unix_timestamp(next_reset(now))) / 86400).cast("int"))


def completed(records: DataFrame) -> DataFrame:
    """The (arm, question_id) pairs that have a record."""
    return records.where("arm is not null and arm <> '' and question_id is not null and question_id <> ''").select("arm", "question_id").distinct()


def expected(arms: DataFrame, questions: DataFrame) -> int | None:
    """How many pairs a finished campaign has; None where either is empty."""
    n = arms.count() * questions.count()
    return n or None


def pooled(runs: DataFrame, configs: DataFrame) -> DataFrame:
    """The records of several runs as one, refused unless all were made with one split and the same models."""
    if configs.select("split", "natural_model", "program_model").distinct().count() > 1:
        raise ValueError("runs with different splits or models cannot be pooled")
    return runs.join(configs.select("run_id"), "run_id", "left_semi")


def pooled_complete(pools: DataFrame, known: DataFrame) -> DataFrame:
    """pools (run_id: names joined by +): the pools whose every part is a known run, with the settings of the first part."""
    p = pools.select("run_id", F.posexplode(F.split("run_id", r"\+")).alias("pos", "part")).join(known.withColumnRenamed("run_id", "part").withColumn("there", F.lit(True)), "part", "left")
    own = [c for c in known.columns if c != "run_id"]
    return p.groupBy("run_id").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("complete"), *[F.min_by(c, "pos").alias(c) for c in own]).where("complete and run_id like '%+%'").drop("complete")


def usage_total(prompt: Column, completion: Column, reasoning: Column, reported: Column) -> Column:
    """What a provider reports, or what its parts add up to, if that is more."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return F.greatest(zero(reported), zero(prompt) + zero(completion) + zero(reasoning))


def billable_output(prompt: Column, completion: Column, reasoning: Column, reported: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return F.greatest(zero(completion) + zero(reasoning), zero(reported) - zero(prompt), F.lit(0))


def equivalent_cost(prompt: Column, completion: Column, in_rate: Column, out_rate: Column) -> Column:
    """What the tokens would cost at a paid rate for a million."""
    return (prompt * in_rate + completion * out_rate) / 1_000_000


def usage_sum(usage: DataFrame, *by: str) -> DataFrame:
    """Usage added up; cached only if all of it was."""
    return usage.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "reasoning_tokens", "reported_total_tokens", "latency_seconds", "cost_usd")], F.bool_and("cached").alias("cached"))


def row_tokens(recorded: Column, natural: Column, program: Column) -> Column:
    """A record's tokens: its own total if it has one, else its channels'."""
    return F.coalesce(F.nullif(recorded, F.lit(0)), F.coalesce(natural, F.lit(0)) + F.coalesce(program, F.lit(0)))


def prompt_cost(rows: DataFrame, column: str) -> DataFrame:
    """Median, 90th by nearest rank, and most of a column."""
    most = rows.agg(F.max(column).alias("max"))
    return most.crossJoin(percentiles(rows, [], column, linear={"median": 0.5}, nearest={"p90": 0.9})).select("median", "p90", "max")  # a row each


def independence(bindings: DataFrame) -> DataFrame:
    """Whether the two reasoning channels have different models: one row (independent, note)."""
    of = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    b = bindings.agg(*[of(r, c).alias(f"{r[0]}_{c}") for r in ("natural_channel", "program_channel") for c in ("provider", "model")])
    note = F.when(F.col("n_provider") != F.col("p_provider"), "cross-provider").when(F.col("n_model") != F.col("p_model"), "same provider, different models").otherwise("both channels bound to one model")
    return b.select(~(F.col("n_provider").eqNullSafe(F.col("p_provider")) & F.col("n_model").eqNullSafe(F.col("p_model"))).alias("independent"), note.alias("note"))


def corrected_estimates(estimates: DataFrame, actual: DataFrame) -> DataFrame:
    """Token estimates (request_id, at, tokens) with the last actual number known of each request in place of its own."""
    last = actual.groupBy("request_id").agg(F.max_by("tokens", "at").alias("actual"))
    return estimates.join(last, "request_id", "left").withColumn("tokens", F.coalesce("actual", "tokens")).drop("actual")
