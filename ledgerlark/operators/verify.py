"""Pairwise consistency of answer channels, and the risk that follows from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import canonical, compatible, parse, power_of_ten, relative_difference
from ..sources.shared import small_methods

TOLERANCE = 0.005
# The factor for each missing channel that could have answered.
COVERAGE = {0: 1.0, 1: 0.9, 2: 0.55, 3: 0.5}
CONFLICT_FACTOR = 0.35
HARD = ["scale_mismatch", "sign_mismatch", "currency_mismatch", "unit_kind_mismatch"]
UNIT = ["scale_mismatch", "currency_mismatch", "unit_kind_mismatch"]
# Weights of the reasons to distrust an answer.
NO_EVIDENCE, CONFLICT, HARD_WEIGHT, NO_CORROBORATION, ARBITER_ABSTAINED, RESIDUAL = 1.0, 0.9, 0.85, 0.45, 0.55, 0.5


def _side_by_side(channels: DataFrame, key: str, more: tuple[str, ...] = ()) -> DataFrame:
    """A row for each key with its three channels as structs c0, c1, c2, more columns included; one shuffle."""
    small_methods(channels.sparkSession)
    c = channels.withColumn("usable", F.col("available") & F.col("amount").isNotNull()).withColumn("v", canonical(F.col("amount"), F.col("scale"), F.col("unit_kind")))
    own = F.struct("usable", "v", "unit_kind", "currency", "applicable", *more)
    return c.groupBy(key).agg(*[F.max(F.when(F.col("channel") == i, own)).alias(f"c{i}") for i in range(3)])


def _those(*said: tuple[Column, Column | str]) -> Column:
    """The texts whose condition holds, in order; without a function of arrays' entries, so that code is generated for it."""
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(c, F.array(F.lit(x) if isinstance(x, str) else x)).otherwise(none) for c, x in said])


def _pair(i: int, j: int) -> Column:
    """The comparison of two channels as a struct, null where one is missing; their relative difference is a column."""
    l, r = F.col(f"c{i}"), F.col(f"c{j}")
    a, b, rel = l["v"], r["v"], F.col(f"r{i}{j}")
    kind = (
        F.when(~(l["usable"] & r["usable"]), "channel_unavailable").when(~compatible(l["unit_kind"], r["unit_kind"]), "unit_kind_mismatch")
        .when(l["currency"] != r["currency"], "currency_mismatch").when(((a > 0) != (b > 0)) & (a != 0) & (b != 0), "sign_mismatch")
        .when(rel <= TOLERANCE, "none").when(power_of_ten(a, b, TOLERANCE).isNotNull(), "scale_mismatch").otherwise("magnitude_mismatch")
    )
    return F.when(l.isNotNull() & r.isNotNull(), F.struct(F.lit(i).alias("left_channel"), F.lit(j).alias("right_channel"), kind.alias("disagreement"), rel.alias("rel")))


def _score(kind: Column, rel: Column) -> Column:
    return F.when(kind == "channel_unavailable", 0.5).when(kind == "none", 1.0).when(kind == "magnitude_mismatch", F.least(F.lit(1.0), TOLERANCE / rel)).otherwise(0.0)


def _compared(channels: DataFrame, key: str, more: tuple[str, ...] = ()) -> DataFrame:
    two = ((0, 1), (0, 2), (1, 2))
    c = _side_by_side(channels, key, more).select("*", *[relative_difference(F.col(f"c{i}.v"), F.col(f"c{j}.v")).alias(f"r{i}{j}") for i, j in two])
    return c.select("*", *[_pair(i, j).alias(f"p{i}{j}") for i, j in two])


def pairs(channels: DataFrame, key: str) -> DataFrame:
    """channels: key, channel (0 natural, 1 program, 2 deterministic), available, applicable, amount, scale,
    unit_kind, currency.  A row for each two channels of a key."""
    p = _compared(channels, key).select(key, F.explode(F.array("p01", "p02", "p12")).alias("p")).where("p is not null").select(key, "p.*")
    far = F.col("disagreement").isin("channel_unavailable", "unit_kind_mismatch", "currency_mismatch")
    return p.select(key, "left_channel", "right_channel", "disagreement", _score(F.col("disagreement"), F.col("rel")).alias("score"), F.when(~far, F.col("rel")).alias("relative_difference"))


def consistency(channels: DataFrame, key: str, more: tuple[str, ...] = ()) -> DataFrame:
    """A report for each key: verdict, score, base_score, coverage, disagreements, channel counts; no join.
    With more (columns of channels) the channels stay beside it, as structs c0, c1, c2 that hold them."""
    p, kept = _compared(channels, key, more), ["c0", "c1", "c2"] if more else []
    every, each = [F.col(f"c{i}") for i in range(3)], [F.col(x) for x in ("p01", "p02", "p12")]
    count = lambda field: sum((F.coalesce(c[field].cast("int"), F.lit(0)) for c in every[1:]), F.coalesce(every[0][field].cast("int"), F.lit(0)))
    comparable = lambda x: x["disagreement"] != "channel_unavailable"
    against = lambda x: F.coalesce((comparable(x) & (x["disagreement"] != "none")).cast("int"), F.lit(0))
    r = p.select(
        key, count("usable").alias("usable"), count("applicable").alias("applicable"), F.least(*[F.when(comparable(x), _score(x["disagreement"], x["rel"])) for x in each]).alias("lowest"),
        F.array_distinct(_those(*[(x["disagreement"] != "none", x["disagreement"]) for x in each])).alias("kinds"), (against(each[0]) + against(each[1]) + against(each[2])).alias("against"),
        F.coalesce(each[0]["disagreement"] == "none", F.lit(False)).alias("two_agree"), (against(each[1]) + against(each[2])).alias("third_against"), *kept,
    )
    short = shortfall(F.col("applicable"), F.col("usable"))
    few = F.col("usable") < 2
    r = r.withColumn("coverage", F.when(short == 0, COVERAGE[0]).when(short == 1, COVERAGE[1]).when(short == 2, COVERAGE[2]).otherwise(COVERAGE[3]))
    r = r.withColumn("conflict", ~few & F.col("two_agree") & (F.col("third_against") > 0)).withColumn("base_score", F.when(few, 0.5).otherwise(F.coalesce("lowest", F.lit(0.5))))
    verdict = F.when(few, "UNCERTAIN").when(F.col("conflict") | (F.col("against") > 0), "DISAGREE").otherwise("AGREE")
    score = F.when(few, 0.5 * F.col("coverage")).otherwise(F.col("base_score") * F.col("coverage") * F.when(F.col("conflict"), CONFLICT_FACTOR).otherwise(1.0))
    kinds = F.array_union(F.col("kinds"), _those((few, "channel_unavailable"), (F.col("conflict"), "deterministic_conflict")))
    kinds = F.when(F.size(kinds) == 0, F.array(F.lit("none"))).otherwise(F.sort_array(kinds))
    return r.select(key, verdict.alias("verdict"), score.alias("score"), "base_score", "coverage", kinds.alias("disagreements"), "usable", "applicable", *kept)


def shortfall(applicable: Column, usable: Column) -> Column:
    """Channels that could have answered and did not."""
    return F.greatest(F.lit(0), applicable - usable)


def to_arbitrate(reports: DataFrame) -> DataFrame:
    """The reports whose disagreement an arbiter is to settle."""
    return reports.where("verdict = 'DISAGREE'")


def abstains(risk_score: Column, threshold: float) -> Column:
    return F.coalesce(risk_score >= threshold, F.lit(False))


def band(risk: Column) -> Column:
    return F.when(risk.isNull(), "UNSCORED").when(risk >= 0.6, "HIGH").when(risk >= 0.25, "MEDIUM").otherwise("LOW")


def confidence_band(verdict: Column, score: Column) -> Column:
    return F.when(verdict == "UNCERTAIN", "UNCERTAIN").when(score >= 0.85, "HIGH").when(score >= 0.5, "MEDIUM").otherwise("LOW")


def combine(signals: Column) -> Column:
    """Damped noisy-or: the strongest signal counts in full, each further one half of what is left."""
    order = F.sort_array(F.filter(signals, lambda s: s > 0), asc=False)
    return F.least(F.lit(1.0), F.aggregate(order, F.lit(0.0), lambda r, s: r + (1 - r) * s * F.when(r == 0, 1.0).otherwise(RESIDUAL)))


def combined(first: Column, *more: Column) -> Column:
    """combine() of a known number of signals, written out, so that code is generated for it."""
    order = F.sort_array(F.array(*[F.greatest(F.lit(0.0), s) for s in (first, *more)]), asc=False)  # greatest: a missing signal is zero, which takes nothing off
    left = reduce(lambda rest, i: rest * (1 - RESIDUAL * F.get(order, F.lit(i))), range(1, len(more) + 1), F.lit(1.0))
    return F.least(F.lit(1.0), 1 - (1 - F.get(order, F.lit(0))) * left)


def risk(reports: DataFrame, evidence_blocks: Column, arbiter_abstained: Column | None = None) -> DataFrame:
    """reports as of consistency(): with risk_score, risk_band and the facets."""
    arbiter = F.lit(False) if arbiter_abstained is None else arbiter_abstained
    has = lambda kinds: F.arrays_overlap(F.col("disagreements"), F.array(*[F.lit(k) for k in kinds]))
    conflict = F.array_contains("disagreements", "deterministic_conflict")
    signals = (
        F.when(evidence_blocks == 0, NO_EVIDENCE).otherwise(0.0), F.when(conflict, CONFLICT).otherwise(0.0), F.when(has(HARD), HARD_WEIGHT).otherwise(0.0),
        F.greatest(F.lit(0.0), 1 - F.col("base_score")), NO_CORROBORATION * (1 - F.col("coverage")), F.when(arbiter, ARBITER_ABSTAINED).otherwise(0.0),
    )
    status = lambda c: F.when(c, "VERIFIED").otherwise("FAILED")
    facets = F.create_map(
        F.lit("evidence"), F.when(evidence_blocks == 0, "FAILED").when(F.col("applicable") > F.col("usable"), "PARTIAL").otherwise("VERIFIED"),
        F.lit("arithmetic"), F.when(F.col("applicable") < 3, "NOT_APPLICABLE").otherwise(status(~conflict)),
        F.lit("agreement"), F.when(F.col("verdict") == "UNCERTAIN", "PARTIAL").otherwise(status(F.col("verdict") == "AGREE")),
        F.lit("unit"), status(~has(UNIT)),
    )
    return reports.withColumn("risk_score", combined(*signals)).withColumn("risk_band", band(F.col("risk_score"))).withColumn("facets", facets)


def bind(facts: DataFrame, metric: str = "metric") -> DataFrame:
    """facts (question, metric, pos, amount, scale, unit_kind): one operand of each metric whose facts all
    give the same canonical value; others are unbound."""
    c = facts.withColumn("canonical", canonical(F.col("amount"), F.col("scale"), F.col("unit_kind")))
    # equal ends, so one value: two numbers for each metric, and no set of its values
    g = c.groupBy("question", metric).agg(F.min("canonical").alias("value"), F.max("canonical").alias("most"))
    one = F.coalesce(F.col("value") == F.col("most"), F.lit(False))
    return g.select("question", metric, F.when(one, F.col("value")).alias("value"), one.alias("bound"))


# --- replies ------------------------------------------------------------------------------------

_REPLY = "answer string, unit string, reasoning string, evidence_used array<string>, figures_used array<string>, sufficient boolean, resolution string"


def natural_reply(payload: Column) -> Column:
    """struct(available, value, sufficient, unit, failure_reason) of a reply's JSON object, taken out of the reply beforehand."""
    p = F.from_json(payload, _REPLY)
    spoken = F.concat_ws(" ", p["answer"], F.nullif(p["unit"], F.lit("")))
    value, sufficient = parse(spoken), F.coalesce(p["sufficient"], F.lit(True))
    why = (
        F.when(F.coalesce(F.trim(payload), F.lit("")) == "", "empty reply").when(p.isNull(), "no JSON object in the reply")
        .when(p["answer"].isNull() & ~sufficient, "channel declined to answer; reported the evidence as insufficient").when(p["answer"].isNull(), "channel declined to answer").when(value.isNull(), "answer could not be parsed as a financial value")
    )
    return F.struct(why.isNull().alias("available"), F.when(why.isNull(), value).alias("value"), sufficient.alias("sufficient"), p["unit"].alias("unit"), why.alias("failure_reason"))


def reply_figure(payload: Column) -> Column:
    """The figure of a reply with its unit, as parse() and parsed() read it; null without an answer."""
    return said_figure(reply(payload))


def reply(payload: Column) -> Column:
    """A reply's JSON object as a struct."""
    return F.from_json(payload, _REPLY)


def said_figure(p: Column) -> Column:
    """reply_figure() of a reply() that is a column by now."""
    return F.when(p["answer"].isNotNull(), F.concat_ws(" ", p["answer"], F.nullif(p["unit"], F.lit(""))))


def arbiter_reply(payload: Column, swapped: Column, figure: Column | None = None, read: Column | None = None) -> Column:
    """struct(resolution, value, resolved, available, failure_reason); candidates shown in the other order are turned back.
    figure: reply_figure() as parsed() read it, where a whole column is read; read: reply() of it, where that is a column, as each field is parsed anew elsewhere."""
    p = reply(payload) if read is None else read
    label = F.lower(F.trim(p["resolution"]))
    value = parse(reply_figure(payload)) if figure is None else figure
    why = F.when(F.coalesce(F.trim(payload), F.lit("")) == "", "empty reply").when(p.isNull(), "no JSON object in the reply").when(p["answer"].isNotNull() & value.isNull(), "the arbiter's figure could not be parsed")
    said = F.when(why.isNotNull(), "unresolved").when(label == "candidate_1", "supports_a").when(label == "candidate_2", "supports_b").when((label == "neither") & value.isNotNull(), "own_answer").when(label == "neither", "supports_neither").otherwise("unresolved")
    said = unswapped(said, swapped)
    return F.struct(said.alias("resolution"), F.when(why.isNull(), value).alias("value"), (why.isNull() & said.isin("supports_a", "supports_b", "own_answer")).alias("resolved"), why.isNull().alias("available"), why.alias("failure_reason"))


def unswapped(resolution: Column, swapped: Column) -> Column:
    return F.when(swapped & (resolution == "supports_a"), "supports_b").when(swapped & (resolution == "supports_b"), "supports_a").otherwise(resolution)


# --- explanations -------------------------------------------------------------------------------

#: What the status of each facet says.
FACET_PROSE = {
    ("agreement", "VERIFIED"): "channels that work apart came to one figure",
    ("agreement", "PARTIAL"): "fewer than two channels came to a figure, so nothing stands against the answer or for it",
    ("agreement", "FAILED"): "the channels came to different figures",
    ("unit", "VERIFIED"): "units, scales and currencies match",
    ("unit", "FAILED"): "units, scales or currencies do not match, so the answer may be off by a power of ten",
    ("evidence", "VERIFIED"): "passages were found and every channel used them",
    ("evidence", "PARTIAL"): "passages were found, but a channel that applies came to no figure",
    ("evidence", "FAILED"): "no passage was found, so nothing supports the answer",
    ("arithmetic", "VERIFIED"): "the calculation from the tables gives the same figure",
    ("arithmetic", "FAILED"): "the calculation from the tables gives another figure than the channels that agree",
    ("arithmetic", "NOT_APPLICABLE"): "nothing is calculated here, so the calculation has no say",
}


def risk_notes(evidence_blocks: Column, arbiter_abstained: Column | None = None) -> Column:
    """What raised the risk of a row of risk(), a sentence for each signal above zero but the score's own shortfall."""
    hard = F.sort_array(F.array_intersect("disagreements", F.array(*[F.lit(k) for k in HARD])))
    said = (
        (evidence_blocks == 0, F.lit("no passage was found")), (F.array_contains("disagreements", "deterministic_conflict"), F.lit("the calculation contradicts channels that agree")),
        (F.size(hard) > 0, F.concat(F.lit("channels differ in kind: "), F.array_join(hard, ", "))), (F.col("coverage") < 1, F.lit("a channel that could have confirmed the answer did not")),
        (F.lit(False) if arbiter_abstained is None else arbiter_abstained, F.lit("the arbiter left the disagreement open")),
    )
    return _those(*said)


def channel_line(name: str, ran: Column, applicable: Column, available: Column, value: Column, reason: Column) -> Column:
    """What one channel said, as a statement."""
    said = lambda text, more: F.concat(F.lit(f"{name}: {text} ("), F.coalesce(reason, F.lit(more)), F.lit(")"))
    return F.when(~F.coalesce(ran, F.lit(False)), f"{name}: not run in this configuration").when(~applicable, said("does not apply to this question", "n/a")).when(~available | value.isNull(), said("produced no figure", "unknown reason")).otherwise(F.concat(F.lit(f"{name}: "), value))


def remedies(evidence_blocks: Column, verdict: Column, missing: Column, arbiter_abstained: Column) -> Column:
    """What would change the risk: an array of codes, the first alone where there is no evidence or no report."""
    found = _those((verdict == "UNCERTAIN", "second_channel"), (missing > 0, "missing_channels"), (verdict == "DISAGREE", "check_cited_pages"), (arbiter_abstained, "arbiter_declined"))
    return F.when(evidence_blocks == 0, F.array(F.lit("retrieve_evidence"))).when(verdict.isNull(), F.array(F.lit("enable_consistency"))).when(F.size(found) == 0, F.array(F.lit("nothing_flagged"))).otherwise(found)


def statements(c0: Column, c1: Column, c2: Column, arbiter: Column | None = None) -> Column:
    """What each channel said (structs with applicable, available, said, reason; null: not run), and the arbiter's resolution where it ran."""
    line = lambda name, c: channel_line(name, c.isNotNull(), F.coalesce(c["applicable"], F.lit(False)), F.coalesce(c["available"], F.lit(False)), c["said"], c["reason"])
    lines = [line("natural", c0), line("program", c1), line("deterministic", c2)]
    if arbiter is None:
        return F.array(*lines)
    ruling = F.concat(F.lit("arbiter: "), arbiter["resolution"], F.coalesce(F.concat(F.lit(" -> "), arbiter["said"]), F.lit("")))
    return F.when(ruling.isNotNull(), F.array(*lines, ruling)).otherwise(F.array(*lines))


def explained(risks: DataFrame, answer: Column, source: Column, evidence_blocks: Column, said: Column | None = None, citations: Column | None = None, arbiter_abstained: Column | None = None) -> DataFrame:
    """risks as of risk(): with statements (said, an array), citations, reasons (a sentence for each facet, then the notes), remedies, caveats, and all
    of it as one text.  A row without a score is given no reason to trust it or not."""
    lines = F.array().cast("array<string>")
    names = ("evidence", "arithmetic", "agreement", "unit")
    risks = risks.withColumns({f"__{f}": F.element_at("facets", f) for f in names})
    status = lambda facet: F.col(f"__{facet}")
    prose = lambda facet: reduce(lambda rest, x: F.when(status(facet) == x[0][1], F.lit(x[1])).otherwise(rest), [x for x in FACET_PROSE.items() if x[0][0] == facet], F.lit(None).cast("string"))
    facets = F.array(*[F.concat_ws(" - ", F.concat(F.lit(f"{f}: "), status(f)), prose(f)) for f in names])
    reasons = F.when(F.col("risk_score").isNull(), F.array(F.lit("nothing here gives a risk score"))).otherwise(F.concat(facets, risk_notes(evidence_blocks, arbiter_abstained)))
    caveats = _those((F.col("risk_score").isNotNull(), "the risk score is uncalibrated: it ranks answers and is no probability"), (source == "deterministic", "the answer comes from the deterministic verifier alone"), (evidence_blocks == 0, "no evidence was retrieved for this question"))
    open_ = F.lit(False) if arbiter_abstained is None else arbiter_abstained
    e = risks.withColumns({
        "statements": lines if said is None else said, "citations": lines if citations is None else F.coalesce(citations, lines), "reasons": reasons,
        "remedies": remedies(evidence_blocks, F.col("verdict"), shortfall(F.col("applicable"), F.col("usable")), open_), "caveats": caveats,
    }).drop(*[f"__{f}" for f in names])
    head = F.concat(F.lit("ANSWER: "), F.coalesce(answer, F.lit("no answer produced")), F.lit("\n  source: "), F.coalesce(source, F.lit("none")), F.lit("\n  risk:   "), F.coalesce(F.format_number("risk_score", 3), F.lit("not scored")), F.lit(" ("), F.col("risk_band"), F.lit(")"))
    block = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"\n\n{title}\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("  "), x)), "\n"))).otherwise("")
    titles = {"EVIDENCE": "citations", "WHAT EACH CHANNEL SAID": "statements", "WHY": "reasons", "WHAT WOULD CHANGE IT": "remedies", "CAVEATS": "caveats"}
    return e.withColumn("text", F.concat(head, *[block(t, F.col(c)) for t, c in titles.items()]))
