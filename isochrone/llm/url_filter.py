"""URL verdicts: allow and block rules, and propagation over the graph of hosts where no rule fits.

1. ``parse`` and ``match_rules`` are expressions of one row. A rule fits its host and all subdomains, if
   the path starts with the rule's path; the longest fitting rule decides.
2. ``graph``: hosts with pages and hosts that pages link to, with counts of allowed and blocked urls (its
   pages; for a host without pages the distinct linked urls), and edges: absolute links from a page's
   host to another host, and links between a host and its nearest superdomain among the hosts, both ways.
   One row per pair of hosts, counted map-side, so a hot host costs one row per task and target.
3. ``propagate``: trust flows along the edges from hosts with allowed pages, distrust flows against them
   from hosts with blocked pages (who links to blocked pages is suspect). Both are personalised PageRank
   in units of pages (divided by 1 - damping): a seed counts in full, and every host passes on ``DAMPING``
   of what it has, shared over its edges. A round is one equi-join and one aggregation; ``STEP`` rounds at
   a time are written to the shared folder. Ranks only grow, and each round adds at most ``DAMPING`` of what
   the round before added, so the rest of the sum is known from the growth: rounds go on until it is below
   ``TOLERANCE`` for all hosts together.
4. A host is blocked when its distrust exceeds its trust by more than ``THRESHOLD`` per page of its own.

Defined results: a NULL url, or one without ``://``, has empty host and path, matches no rule and is
allowed; NULL html has no links; a distrust less trust that is at the threshold, or above it by no more
than the tolerance, is allowed; a superdomain is sought within ``LABELS`` labels; hosts and paths of any length are taken whole; repeated rows each count
and get the same verdict; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require, stored

#: (verdict, host and path) as given; fixed values.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
DAMPING = 0.85
#: Rounds per written table.
STEP = 4
THRESHOLD = 0.5
#: Pages by which a rank may fall short of its limit.
TOLERANCE = THRESHOLD / 1000
#: A host name has at most this many labels (253 characters).
LABELS = 127
#: Scheme-less rest of the absolute links in anchors.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*[a-z]+(://[^"'\s>]+)"""


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parse(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without ``://``."""
    text = F.coalesce(url, F.lit(""))
    rest = F.when(text.contains("://"), F.regexp_replace(text, "(?s)^.*?://", "")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def match_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, NULL if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, text in sorted(rules, key=lambda r: len(r[1])):  # the last one that fits is the longest
        at, start = text[: text.index("/")], text[text.index("/") :]
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(name)).otherwise(verdict)
    return rule, verdict


def judged_pages(pages: DataFrame, rules=RULES) -> DataFrame:
    require(pages, "page_id", "url")
    host, path = parse(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    return rows.withColumns({"rule": rule, "rule_verdict": verdict})


def linked_urls(pages: DataFrame) -> DataFrame:
    """(src, dst, path, n): absolute links in the pages of host ``src`` to each url, counted."""
    require(pages, "url", "html")
    own, _ = parse(F.col("url"))
    html = F.coalesce("html", F.lit(""))
    links = F.when(html.contains("://"), F.regexp_extract_all(html, F.lit(LINK), F.lit(1))).otherwise(F.array().cast("array<string>"))
    linked = pages.select(own.alias("src"), F.explode(links).alias("link"))
    dst, path = parse(F.col("link"))
    return linked.select("src", dst.alias("dst"), path.alias("path")).where("dst <> ''").groupBy("src", "dst", "path").agg(F.count("*").alias("n"))


def known_hosts(judged: DataFrame, links: DataFrame, rules=RULES) -> DataFrame:
    """(host, pages, allowed, blocked) of hosts with pages, and with ``pages`` 0 of hosts only linked to."""
    counts = [F.count(F.when(F.col("rule_verdict") == v, 1)) for v in ("allow", "block")]
    own = judged.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), counts[0].alias("allowed"), counts[1].alias("blocked"))
    _, verdict = match_rules(F.col("host"), F.col("path"), rules)
    targets = links.select(F.col("dst").alias("host"), "path").distinct().select("host", verdict.alias("rule_verdict"))
    seen = targets.groupBy("host").agg(F.lit(0).cast("long").alias("pages"), counts[0].alias("allowed"), counts[1].alias("blocked"))
    return own.unionByName(seen.join(own.select("host"), "host", "left_anti"))


def host_edges(hosts: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst, n): links between hosts, and between a host and its nearest superdomain both ways."""
    linked = links.select("src", "dst", "n")
    labels = F.split("host", r"\.", -1)
    # from the second label on; of longer names the last labels only
    starts = F.sequence(F.greatest(F.lit(2), F.size("labels") - LABELS + 1), F.size("labels"))
    above = hosts.select("host", labels.alias("labels")).where(F.size("labels") > 1).select(
        F.col("host").alias("src"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice("labels", i, LABELS), "."))).alias("dst"))
    nearest = above.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi").groupBy("src").agg(F.max_by("dst", F.length("dst")).alias("dst"), F.lit(1).cast("long").alias("n"))
    nearest = stored(nearest, "url-superdomains")
    both = linked.unionByName(nearest).unionByName(nearest.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")).where("src <> dst AND src <> '' AND dst <> ''")
    return both.groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(hosts: DataFrame, edges: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) from ``hosts`` (host, allowed, blocked) and ``edges`` (src, dst, n)."""
    seeds = hosts.select(F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), "host", F.col("allowed").cast("double").alias("seed")),
        F.struct(F.lit("distrust").alias("kind"), "host", F.col("blocked").cast("double").alias("seed")),
    )).alias("s")).select("s.*")
    flow = edges.select(F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), "src", "dst", "n"),
        F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"),
    )).alias("e")).select("e.*")
    out = flow.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    share = flow.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("share"))
    seeds = stored(seeds, "url-seeds")
    share = stored(share, "url-shares")
    rank, total = seeds.select("kind", "host", F.col("seed").alias("rank")), None
    while True:
        for _ in range(STEP):
            moved = share.join(rank.where("rank > 0").withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("share") * F.col("rank") * damping).alias("part"))
            parts = moved.unionByName(seeds.select("kind", "host", F.col("seed").alias("part")))
            rank = parts.groupBy("kind", "host").agg(F.sum("part").alias("rank"))
        rank = stored(rank, "url-rank")
        before, total = total, rank.agg(F.sum("rank")).first()[0] or 0.0
        # the growth of STEP rounds is at least STEP times that of the last of them
        if before is not None and (total - before) / STEP * damping / (1 - damping) <= tolerance:
            break
    return rank.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("rank")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    judged = judged_pages(pages, rules)
    links = stored(linked_urls(pages), "url-links")
    hosts = stored(known_hosts(judged, links, rules), "url-hosts")
    ranked = propagate(hosts, host_edges(hosts, links), tolerance)
    # a rank is short of its limit by the tolerance at most, so a host at the threshold cannot be blocked
    bad = F.col("distrust") - F.col("trust") - threshold * F.col("pages") > tolerance
    verdicts = stored(hosts.where("pages > 0").join(ranked, "host").select("host", F.when(bad, "block").otherwise("allow").alias("host_verdict")), "url-verdicts")
    verdict = F.coalesce("rule_verdict", "host_verdict", F.lit("allow"))
    return judged.join(verdicts, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
