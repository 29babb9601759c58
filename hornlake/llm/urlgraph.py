"""URL filters by link-graph propagation (operator 8), in DataFrame functions only.

A rule (host, path, verdict) fits its host and all subdomains where the url's
path starts with the rule's; the longest rule wins. Urls without a rule get
their host's verdict: trust is a personalised PageRank over host edges that
restarts at hosts with allowed pages, distrust one over reversed edges that
restarts at hosts with blocked pages. A host whose distrust is more than
``THRESHOLD`` of both together is blocked; hosts that neither reaches are allowed.

Edges come from absolute links in ``html``, with their multiplicity; links
within a host don't count. A host without an outgoing edge gives its rank back
to the restarting hosts. Ranks are iterated ``ROUNDS`` times, which leaves less than
``DAMPING`` to that power (0.8 %) of the whole unsettled. Shares of distrust are compared
at ``DIGITS`` decimals, so verdicts don't depend on how many hosts there are. Pages are reduced to host and edge counts before anything is
iterated, and sums are partial before the shuffle, so a host with a third of
all pages is one row a task.

Cases: a null url or one without ``://`` has an empty host and path, no rule
and verdict allow; a null html has no links; repeated rows count as often as
they occur; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize

#: (host, path, verdict), fixed values.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
DAMPING = 0.85
ROUNDS = 30
THRESHOLD = 0.5
DIGITS = 6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; both null without one. Rules are few and fixed."""
    rule = verdict = F.lit(None).cast("string")
    for at, start, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        rule = F.when(fits, F.lit(at + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): absolute links between different hosts. pages: host, html."""
    links = F.expr(r"""regexp_extract_all(coalesce(html, ''), '(?i)(?:href|src)\\s*=\\s*["\']?((?:[a-z][a-z0-9+.-]*:)?//[^"\'\\s>]*)', 1)""")
    to = host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link")))
    found = pages.select(F.col("host").alias("src"), F.explode(links).alias("link")).select("src", to.alias("dst"))
    return found.filter("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def personal_ranks(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(kind, host, rank) by personalised PageRank, several kinds side by side.

    edges: kind, src, dst, n; seeds: kind, host, weight (any positive total a kind). A round is one join and one
    partial sum, written to the shared folder; kinds are few.
    """
    total = {r["kind"]: r["total"] for r in seeds.groupBy("kind").agg(F.sum("weight").alias("total")).collect()}
    per_kind = lambda values: F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))))[F.col("kind")]
    if not total:
        return seeds.select("kind", "host", F.lit(0.0).alias("rank"))
    start = materialize(seeds.select("kind", "host", (F.col("weight") / per_kind(total)).alias("restart")), "seeds")
    ranks = start.select("kind", "host", F.col("restart").alias("rank"))
    if edges.isEmpty():
        return ranks
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("degree"))
    share = materialize(edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("degree")).alias("share")), "shares")
    for _ in range(rounds):
        flow = share.join(ranks, ["kind", "host"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("share") * F.col("rank")).alias("rank"))
        moved = materialize(flow, "moved")
        kept = {r["kind"]: r["kept"] for r in moved.groupBy("kind").agg(F.sum("rank").alias("kept")).collect()}
        back = {k: (1 - damping) + damping * max(0.0, 1.0 - kept.get(k, 0.0)) for k in total}  # restart, and what hosts without edges give back
        new = moved.select("kind", "host", (F.col("rank") * damping).alias("rank")).union(start.select("kind", "host", F.col("restart") * per_kind(back)))
        ranks = new.groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
    return ranks


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, rounds: int = ROUNDS, damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of ``pages``."""
    pages = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    pages = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    ruled = pages.withColumn("rule", rule).withColumn("ruled", verdict)
    part = lambda what: F.avg((F.coalesce(F.col("ruled"), F.lit("")) == what).cast("double"))
    hosts = materialize(ruled.filter("host <> ''").groupBy("host").agg(part("allow").alias("allowed"), part("block").alias("blocked")), "hosts")
    edges = materialize(host_edges(pages), "host-edges")
    ways = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(edges.select(F.lit("distrust"), "dst", "src", "n"))
    seeds = [hosts.filter(f"{c} > 0").select(F.lit(k).alias("kind"), "host", F.col(c).alias("weight")) for k, c in (("trust", "allowed"), ("distrust", "blocked"))]
    ranks = personal_ranks(ways, seeds[0].union(seeds[1]), rounds, damping)
    rank = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)).alias(k)
    scores = ranks.groupBy("host").agg(rank("trust"), rank("distrust"))
    judged = ruled.select("page_id", "host", "path", "rule", "ruled").join(scores, "host", "left").fillna(0.0, ["trust", "distrust"])
    share = F.round(F.try_divide(F.col("distrust"), F.col("trust") + F.col("distrust")), DIGITS)
    by_host = F.when((F.col("distrust") > 0) & (share > threshold), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"), "trust", "distrust")
