"""Verdicts on urls from rules and from the link graph of hosts (op 12).

Rules decide where they fit.  What they say of a host's pages seeds two personalised PageRanks: trust goes from hosts with allowed pages along
links, distrust from hosts with blocked pages against them, as a page that links to bad ones is suspect.  A host is blocked if its
distrust is more than `threshold` times its trust and its share of the pages without a rule, which speak for it: one bad section does not
condemn a host.  Pages without a rule take their host's verdict.

Ranks are whole numbers of 2^-50 and every share is rounded down, so sums do not depend on their order and a task run again
gives the same.  A step sends DAMPING of what the step before sent; a rank is the sum of all steps, which end when less than REST is left
to send: 86 steps at most, whatever the graph.  Every step is a join and a grouping of Spark with its rows written.

A host with many outgoing links is cut into parts of FAN links each, so that no task gets all of them; a host with many incoming ones is added
up before the shuffle.  Hosts that hold more than a two-hundredth of the pages, at most 200, are joined to their pages by
broadcast; all others by a shuffle.

Null url or one without "://": empty host and path, to which no rule applies.  Null html: no links.  A null page_id keeps its row, as do repeated rows,
each counted.  Links: href and src with a host of their own; links within a host say nothing.  An empty table gives no rows; other columns are ignored.
Of two rules as long as each other the one with the longer host wins, then the blocking one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, saved, table

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The part of a rank that is passed on, and the whole in units.
DAMPING, UNITS = 0.85, 1 << 50
#: What may be left unsent, of trust and distrust together.
REST = 1 << 30
#: Links of a part of a host, and the share of all pages from which a host counts as large: 1 / LARGE.
FAN, LARGE = 4096, 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\b(?:href|src)[ \t\r\n\f]*=[ \t\r\n\f]*["']?[ \t\r\n\f]*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"' \t\r\n\f>]+)"""


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, said: the longest rule that fits a page, and its verdict."""
    p = pages.select("page_id", host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    fits = [((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(s) for _, h, s in ordered]
    pick = lambda values: reduce(lambda a, k: F.when(fits[k], F.lit(values[k])).otherwise(a), reversed(range(len(ordered))), F.lit(None).cast("string"))
    return p.withColumns({"rule": pick([h + s for _, h, s in ordered]), "said": pick([v for v, _, _ in ordered])})


def links(pages: DataFrame) -> DataFrame:
    """src, dst, n: how many pages of a host link to another."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    named = pages.select(host_of(F.col("url").cast("string")).alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(_LINK), F.lit(1)), lambda h: F.translate(h, _UPPER, _LOWER)))).alias("dst"))
    return named.where("src <> dst and src <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagated(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """host, trust, distrust in units.

    edges: src, dst, n.  seeds: host, allowed, blocked: numbers of pages."""
    ways = edges.select(F.lit(True).alias("good"), "src", "dst", "n").union(edges.select(F.lit(False), F.col("dst"), F.col("src"), "n"))
    out = ways.groupBy("good", "src").agg(F.sum("n").alias("all"), F.ceil(F.count("*") / FAN).alias("parts"))
    large = F.pmod(F.xxhash64("dst"), F.col("parts"))
    sources = saved(out, "hosts")
    ways = saved(ways.join(sources, ["good", "src"]).select("good", "src", large.alias("part"), "dst", (F.col("n") / F.col("all")).alias("share")), "host-links")
    total = seeds.agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")).first()
    share = lambda c: F.floor(F.col(c) * (UNITS / (total[c] or 1))).cast("long")
    steps = [saved(seeds.select(F.lit(True).alias("good"), "host", share("allowed").alias("mass")).union(seeds.select(F.lit(False), "host", share("blocked"))).where("mass > 0"), "host-rank")]
    while True:
        sent = steps[-1].join(sources, (sources["src"] == F.col("host")) & (sources["good"] == steps[-1]["good"])).select(steps[-1]["good"], "src", "mass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        got = sent.join(ways, ["good", "src", "part"]).groupBy("good", F.col("dst").alias("host")).agg(F.sum(F.floor(F.col("mass") * F.col("share") * DAMPING).cast("long")).alias("mass"))
        steps.append(saved(got.where("mass > 0"), "host-rank"))
        if (steps[-1].agg(F.sum("mass")).first()[0] or 0) < REST:
            break
    mass = lambda good: F.coalesce(F.sum(F.when(F.col("good") == good, F.col("mass"))), F.lit(0)).alias("trust" if good else "distrust")
    ranks = saved(reduce(DataFrame.union, steps).groupBy("host").agg(mass(True), mass(False)), "host-ranks")
    discard(sources, ways, *steps)
    return ranks


def judged(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, threshold: float = 1.0) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and its host's trust and distrust in units."""
    p = ruled(pages, rules)
    seeds = saved(p.groupBy("host").agg(F.count_if(F.col("said") == "allow").alias("allowed"), F.count_if(F.col("said") == "block").alias("blocked"), F.count_if(F.col("said").isNull()).alias("neutral"), F.count("*").alias("pages")), "host-seeds")
    unruled = seeds.agg(F.sum("neutral")).first()[0] or 1
    ranks = propagated(links(pages), seeds)
    own = F.floor(F.col("neutral") * (UNITS / unruled)).cast("long").alias("own")
    of = seeds.join(ranks, "host", "left").select(F.col("host").alias("of"), "pages", F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"), own)
    of = saved(of.withColumn("verdict", F.when(F.col("distrust") > threshold * (F.col("trust") + F.col("own")), "block").otherwise("allow")), "host-verdicts")
    discard(seeds, ranks)
    pages_in_all = of.agg(F.sum("pages")).first()[0] or 0
    large = of["pages"] * LARGE > pages_in_all
    heavy = F.broadcast(of.where(large))  # fewer than LARGE rows
    columns = ["page_id", "host", "path", "rule", F.coalesce("said", "verdict").alias("verdict"), "trust", "distrust"]
    a = p.join(heavy, p["host"] == heavy["of"]).select(columns)
    light = of.where(~large)
    b = p.join(heavy, p["host"] == heavy["of"], "left_anti").join(light, F.col("host") == light["of"]).select(columns)
    return a.union(b)


def op12_host_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


ORACLE = """
WITH RECURSIVE r AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS u FROM pages),
p AS (SELECT page_id, html, coalesce(translate(regexp_extract(u, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(u, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
q AS (SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p),
s AS (SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said FROM q),
seeds AS (SELECT host, count(*) FILTER (said = 'allow') AS allowed, count(*) FILTER (said = 'block') AS blocked, count(*) FILTER (said IS NULL) AS neutral FROM s GROUP BY host),
total AS (SELECT greatest(sum(allowed), 1) AS a, greatest(sum(blocked), 1) AS b, greatest(sum(neutral), 1) AS n FROM seeds),
named AS (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, $x$%s$x$, 1), lambda h: translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) AS dst FROM p),
e AS (SELECT src, dst, count(*) AS n FROM named WHERE src <> dst AND src <> '' GROUP BY src, dst),
ways AS (SELECT good, src, dst, n / sum(n) OVER (PARTITION BY good, src) AS share FROM (SELECT true AS good, src, dst, n FROM e UNION ALL SELECT false, dst, src, n FROM e)),
steps AS (
  SELECT good, host, mass, false AS over FROM (
    SELECT true AS good, host, floor(allowed * (1125899906842624 / a))::BIGINT AS mass FROM seeds, total UNION ALL
    SELECT false, host, floor(blocked * (1125899906842624 / b))::BIGINT FROM seeds, total) WHERE mass > 0
  UNION ALL
  SELECT good, host, mass, sum(mass) OVER () < 1073741824 AS over FROM (
    SELECT steps.good, dst AS host, sum(floor(mass * share * 0.85::DOUBLE)::BIGINT)::BIGINT AS mass FROM steps JOIN ways ON steps.good = ways.good AND steps.host = ways.src WHERE NOT over GROUP BY steps.good, dst) WHERE mass > 0
),
ranks AS (SELECT host, coalesce(sum(mass) FILTER (good), 0)::BIGINT AS trust, coalesce(sum(mass) FILTER (NOT good), 0)::BIGINT AS distrust FROM steps GROUP BY host)
SELECT page_id, s.host, path, rule, coalesce(said, CASE WHEN coalesce(distrust, 0) > 1.0::DOUBLE * (coalesce(trust, 0) + floor(neutral * (1125899906842624 / n))::BIGINT) THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM s JOIN seeds ON s.host = seeds.host LEFT JOIN ranks ON s.host = ranks.host, total
""" % _LINK
