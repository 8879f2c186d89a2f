"""Answers in stages: channels are compared, an arbiter's replies settle what they disagree on, risk follows, one answer counts and is explained.

Each stage is a relation on the question's key, so that one partitioning serves them all; an arbiter is asked about disagreements alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import canonical, parsed
from .questions import abstained, selected_answer
from .verify import abstains, arbiter_reply, consistency, explained, reply, risk, said_figure, statements, to_arbitrate

#: What a channel's row holds beside its figure: the figure and the reason as said, whether it judged its evidence sufficient, whether it ran to its end.
SAID = ("available", "said", "reason", "sufficient", "executed")


def asked_next(channels: DataFrame, replies: DataFrame, key: str) -> DataFrame:
    """The disagreements that no reply has come for: key, verdict, disagreements, and both candidates' figures as said."""
    reports = to_arbitrate(consistency(channels, key, SAID))
    return reports.join(replies.select(key), key, "left_anti").select(key, "verdict", "disagreements", F.col("c0.said").alias("candidate_1"), F.col("c1.said").alias("candidate_2"))


def _latest(replies: DataFrame, key: str) -> DataFrame:
    """One reply for each key, read: the last attempt's, of equal ones the greatest text."""
    one = replies.groupBy(key).agg(F.max_by(F.struct("payload", "swapped"), F.struct("attempt", "payload", "swapped")).alias("r")).select(key, "r.payload", F.coalesce("r.swapped", F.lit(False)).alias("swapped"))
    one = one.withColumn("read", reply(F.col("payload")))  # parsed once: its fields are taken from a column
    read = parsed(one, "figure", said_figure(F.col("read"))).select(key, arbiter_reply(F.col("payload"), F.col("swapped"), F.col("figure"), F.col("read")).alias("a"))
    return read.select(key, F.lit(True).alias("replied"), "a.resolution", "a.resolved", F.when(F.col("a.resolved"), _units(F.col("a.value"))).alias("ruled"))


def answered(channels: DataFrame, replies: DataFrame, evidence: DataFrame, key: str, threshold: float | None = None) -> DataFrame:
    """A row for each key of channels: report, arbitration, risk, answer, source, abstained, withheld, and the explanation.

    channels: as consistency() takes them, with SAID.  replies (key, attempt, payload, swapped): a reply to what was no disagreement is
    ignored.  evidence (key, pos, citation): the few blocks a question was answered from.  An answer whose risk reaches the threshold is withheld; null: none is."""
    reports, said = consistency(channels, key, SAID), _latest(replies, key)
    r = reports.join(said, (reports[key] == said[key]) & (reports["verdict"] == "DISAGREE"), "left").drop(said[key])
    cited = evidence.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "citation"))).alias("cited"))
    r = r.join(cited, key, "left").withColumn("citations", F.transform(F.coalesce("cited", F.array().cast("array<struct<pos:int,citation:string>>")), lambda x: F.concat(F.lit("E"), x["pos"].cast("string"), F.lit(": "), F.coalesce(x["citation"], F.lit("")))))
    r = r.withColumns({"arbiter_ran": F.coalesce("replied", F.lit(False)), "arbiter_resolved": F.coalesce("resolved", F.lit(False)), "blocks": F.size("citations")})
    silent, blocks = F.col("arbiter_ran") & ~F.col("arbiter_resolved"), F.col("blocks")
    answer, source = selected_answer(F.col("ruled"), *[F.when(F.col(f"c{i}.usable"), F.col(f"c{i}.v")) for i in range(3)])
    out = risk(r, blocks, silent).withColumns({"answer": answer, "source": source})
    out = out.withColumn("abstained", abstained(F.col("answer"), F.col("c0.sufficient"), F.col("c1.executed"), F.col("arbiter_ran"), F.col("arbiter_resolved")))
    out = out.withColumn("withheld", F.lit(False) if threshold is None else F.col("answer").isNotNull() & abstains(F.col("risk_score"), threshold))
    arbiter = F.when(F.col("arbiter_ran"), F.struct("resolution", F.col("ruled").cast("string").alias("said")))
    lines = statements(F.col("c0"), F.col("c1"), F.col("c2"), arbiter)
    return explained(out, F.col("answer").cast("string"), F.col("source"), blocks, lines, F.col("citations"), silent).drop("c0", "c1", "c2", "cited", "replied", "resolved", "ruled")


def _units(value: Column) -> Column:
    """A figure read by parse(), in units."""
    return canonical(value["amount"], value["scale"], value["unit_kind"])
