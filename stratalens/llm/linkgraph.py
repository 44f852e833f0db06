"""Verdicts on urls by rules and, without one, by trust and distrust along links between hosts; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.session import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s[^>]*href\s*=\s*["']?\s*(?:https?:)?//([^/"'?#\s>]+)"""

# Rules as (verdict, host and path).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _ruled(rules: list[tuple[str, str]], value: int) -> Column:
    """Verdict (0) or text (1) of the longest rule that fits; null without one."""
    case = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = rule[1].partition("/")
        fits = (F.col("host") == host) | F.col("host").endswith("." + host)
        case = F.when(fits & F.col("path").startswith(slash + path), F.lit(rule[value])).otherwise(case)
    return case


def spread(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, steps: int = 10, tolerance: float = 1e-6, least_mass: float = 1e-12) -> DataFrame:
    """Personalised PageRank over several graphs at once: (graph, host, score).

    ``seeds`` (graph, host, seed) restart the walk, ``edges`` (graph, source, target, share) carry it; the shares of a
    source sum to 1. One join and one partial aggregate a step; every fifth step is stored, which cuts the lineage.
    After ``steps`` steps the walk goes on until five more reach no further host and change no score by more than
    ``tolerance`` of it, or until they move less than ``least_mass`` of all mass, which bounds the steps (about 160 at a
    damping of 0.85) however long a chain is.

    The scores of a graph sum to 1. That is the walk in which mass at hosts without links returns to the seeds: what it
    gives back multiplies all scores by one number.
    """
    start = seeds.select("graph", "host", (F.col("seed") * (1 - damping)).alias("score"))
    scores = stored = start
    step, settled = 0, False
    while step < steps or not settled:
        step += 1
        moved = scores.join(edges.withColumnRenamed("source", "host"), ["graph", "host"]).select("graph", F.col("target").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        scores = start.unionByName(moved).groupBy("graph", "host").agg(F.sum("score").alias("score"))
        if step % 5 == 0:
            scores = materialize(scores)
            before = stored.select("graph", "host", F.col("score").alias("before"))
            moved = F.abs(F.col("score") - F.coalesce("before", F.lit(0.0)))
            change = scores.join(before, ["graph", "host"], "left").agg(F.max(moved / F.col("score")).alias("largest"), (F.sum(moved) / F.sum("score")).alias("mass")).first()
            settled = step >= steps and (change["largest"] is None or change["largest"] <= tolerance or change["mass"] <= least_mass)
            stored = scores
    totals = scores.groupBy("graph").agg(F.sum("score").alias("total"))  # a row a graph
    return scores.join(totals, "graph").select("graph", "host", (F.col("score") / F.col("total")).alias("score"))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, most_distrust: float = 0.5, damping: float = 0.85, steps: int = 10, tolerance: float = 1e-6) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): host, path, the rule that fits and the verdict.

    A host's pages that rules allow are its trusted seed, those that rules block its distrusted seed. Trust follows the
    links between hosts, distrust follows them backwards, to hosts that link to distrusted ones. A page without a rule
    is blocked if distrust is over ``most_distrust`` of its host's trust and distrust together, each a share of its own
    graph's mass, so that many pages on one side do not outweigh the other; a host that neither reaches is allowed. Pages are reduced to one row per host, and links to one row per pair of hosts, before anything
    moves; links within a host do not count.

    A null url, or one without "://", has an empty host and path and is allowed; null html has no links; repeated rows
    are judged each and count each; an empty table gives no rows; other columns are ignored.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    base = base.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    ruled = base.withColumns({"rule": _ruled(rules, 1), "ruled": _ruled(rules, 0)})
    links = F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)))
    pairs = ruled.select(F.col("host").alias("source"), F.explode(links).alias("target")).withColumn("target", F.translate("target", _UPPER, _LOWER))
    pairs = materialize(pairs.where((F.col("source") != F.col("target")) & (F.col("source") != "")).groupBy("source", "target").agg(F.count("*").alias("n")))
    out_of = pairs.groupBy("source").agg(F.sum("n").alias("total"))
    into = pairs.groupBy("target").agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    edges = pairs.join(out_of, "source").select(F.lit("trust").alias("graph"), "source", "target", share.alias("share"))
    edges = edges.unionByName(pairs.join(into, "target").select(F.lit("distrust").alias("graph"), F.col("target").alias("source"), F.col("source").alias("target"), share.alias("share")))
    seeds = ruled.where(F.col("ruled").isNotNull()).groupBy("host", "ruled").agg(F.count("*").alias("seed"))
    seeds = materialize(seeds.select(F.when(F.col("ruled") == "allow", "trust").otherwise("distrust").alias("graph"), "host", F.col("seed").cast("double").alias("seed")))
    scores = spread(seeds, materialize(edges), damping, steps, tolerance)
    trust = F.coalesce(F.sum(F.when(F.col("graph") == "trust", F.col("score"))), F.lit(0.0))
    distrust = F.coalesce(F.sum(F.when(F.col("graph") == "distrust", F.col("score"))), F.lit(0.0))
    blocked = scores.groupBy("host").agg(trust.alias("trust"), distrust.alias("distrust")).where(F.col("distrust") > (F.col("trust") + F.col("distrust")) * most_distrust)
    blocked = materialize(blocked.select("host", F.lit("block").alias("spread")))
    found = ruled.drop("html", "url").join(blocked, "host", "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", "spread", F.lit("allow")).alias("verdict"))


def oracle(rules: list[tuple[str, str]] = RULES, most_distrust: float = 0.5, damping: float = 0.85, steps: int = 10) -> str:
    """The same in SQL for an engine with ``regexp_extract_all``."""
    ordered = sorted(rules, key=lambda r: -len(r[1]))

    def case(value: int) -> str:
        parts = []
        for rule in ordered:
            host, slash, path = rule[1].partition("/")
            parts.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + path}') THEN '{rule[value]}'")
        return "CASE " + " ".join(parts) + " END"

    link = LINK.replace("'", "''")
    walks = []
    for step in range(steps):
        walks.append(f"""s{step + 1} AS MATERIALIZED (SELECT graph, host, sum(score) AS score FROM (
            SELECT graph, host, seed * {1 - damping!r} AS score FROM seeds
            UNION ALL SELECT s.graph, e.target, s.score * e.share * {damping!r} FROM s{step} s JOIN edges e ON s.graph = e.graph AND s.host = e.source) GROUP BY graph, host)""")
    return f"""WITH split AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    ruled AS MATERIALIZED (SELECT *, {case(1)} AS rule, {case(0)} AS ruled FROM split),
    found AS (SELECT host AS source, translate(unnest(list_distinct(regexp_extract_all(coalesce(html, ''), '{link}', 1))), '{_UPPER}', '{_LOWER}') AS target FROM ruled),
    pairs AS MATERIALIZED (SELECT source, target, count(*) AS n FROM found WHERE source <> target AND source <> '' GROUP BY ALL),
    edges AS MATERIALIZED (SELECT 'trust' AS graph, source, target, n / sum(n) OVER (PARTITION BY source) AS share FROM pairs
        UNION ALL SELECT 'distrust', target, source, n / sum(n) OVER (PARTITION BY target) FROM pairs),
    seeds AS MATERIALIZED (SELECT CASE WHEN ruled = 'allow' THEN 'trust' ELSE 'distrust' END AS graph, host, count(*)::DOUBLE AS seed FROM ruled WHERE ruled IS NOT NULL GROUP BY ALL),
    s0 AS (SELECT graph, host, seed * {1 - damping!r} AS score FROM seeds),
    {", ".join(walks)},
    shares AS (SELECT graph, host, score / sum(score) OVER (PARTITION BY graph) AS score FROM s{steps}),
    hosts AS (SELECT host, coalesce(sum(score) FILTER (graph = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (graph = 'distrust'), 0) AS distrust FROM shares GROUP BY host)
    SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.ruled, CASE WHEN h.distrust > (h.trust + h.distrust) * {most_distrust} THEN 'block' END, 'allow') AS verdict
    FROM ruled r LEFT JOIN hosts h ON r.host = h.host"""
