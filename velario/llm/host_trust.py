"""URL verdicts: explicit rules first, then trust and distrust spread over host links.

Rules name a host and the beginning of a path; the longest that fits a page
decides. A page that no rule fits gets its host's verdict. Hosts are linked by the
absolute links of their pages, and to their parent domain and back (not to a top-level
one), which is a node even if no page is its own, so that siblings meet. A link to a
page that a rule names makes the page's host a node and a seed, crawled or not. Trust is
a personalised PageRank that starts at the pages allowed by rules; distrust is the same
over reversed links from the blocked pages, for who links to a bad host is suspect. Both
are carried in pages, step by step until all hosts together change by no more than
``tolerance`` of all seeds. A host is blocked where distrust is more than ``share`` of distrust, trust and
``prior`` of its pages: what speaks for a host of which nobody says anything.

DataFrame operations only. Pages are read twice and never shuffled; what is
shuffled are sums by host or pair of hosts, combined before. Hosts with a third of
all pages or links are one row of those sums. Each few steps are written out.

Cases: a null url, or one without ``://``, has empty host and path, fits no rule
and is judged as the host ''; null or empty html has no links; repeated rows count
as pages of their own; an empty table gives no row; other columns are not read.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velario.llm.shared import saved

DAMPING = 0.85
TOLERANCE = 1e-2
STEPS_A_WRITE = 8
SHARE = 0.5
PRIOR = 0.1

_HOST = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?i)(?:href|src)\s*=\s*[\"']?[a-z][a-z0-9+.\-]*(://[^/?#\"'\s<>]+[^\"'\s<>]*)"


@dataclass(frozen=True)
class UrlRule:
    """``host/path`` and what it says; it fits the host, its subdomains, and paths that start so."""

    text: str
    verdict: str

    def fits(self, host, path):
        name, _, rest = self.text.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)


RULES = (UrlRule("com/", "allow"), UrlRule("example.com/en/", "block"), UrlRule("www.example.com/en/", "allow"),
         UrlRule("net/es/", "block"), UrlRule("net/fr/", "block"))


def lower_ascii(text):
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def judged_by_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, the last two null where no rule fits."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rule, verdict = _rule_of(F.col("host"), F.col("path"), rules)
    parts = pages.select("page_id", lower_ascii(F.regexp_extract(url, _HOST, 1)).alias("host"),
                         F.regexp_extract(url, _HOST, 2).alias("path"))
    return parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def _rule_of(host, path, rules):
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):          # a longer rule goes before
        fits = r.fits(host, path)
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def link_counts(pages: DataFrame, rules=RULES) -> DataFrame:
    """``(src, dst, n, allowed, blocked)``: absolute links from pages of one host to
    another, and whether rules allow or block any page that they lead to."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    found = F.regexp_extract_all(F.col("html").cast("string"), F.lit(_LINK), 1)
    links = (pages.where("html is not null")
             .select(lower_ascii(F.regexp_extract(url, _HOST, 1)).alias("src"), F.explode(found).alias("to"))
             .select("src", lower_ascii(F.regexp_extract("to", _HOST, 1)).alias("dst"), F.regexp_extract("to", _HOST, 2).alias("path"))
             .where("src <> dst"))
    _, verdict = _rule_of(F.col("dst"), F.col("path"), rules)
    return links.groupBy("src", "dst").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.max((verdict == "allow").cast("int")).alias("allowed"),
        F.max((verdict == "block").cast("int")).alias("blocked"))


def with_parents(crawled: DataFrame, links: DataFrame) -> tuple:
    """All nodes ``(host, n_pages, allowed, blocked)``, and ``(host, parent)``.

    To the hosts of pages come those that links and rules name, then their parents.
    """
    zero = F.lit(0).cast("bigint")
    named = links.where("allowed = 1 or blocked = 1").groupBy("dst").agg(
        F.coalesce(F.max("allowed"), F.lit(0)).cast("bigint").alias("allowed"),
        F.coalesce(F.max("blocked"), F.lit(0)).cast("bigint").alias("blocked"))
    named = named.join(crawled.select(F.col("host").alias("dst")), "dst", "left_anti")
    hosts = crawled.unionByName(named.select(F.col("dst").alias("host"), zero.alias("n_pages"), "allowed", "blocked"))
    up = hosts.select("host", F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1).alias("parent")).where("parent <> ''")
    more = up.select(F.col("parent").alias("host")).distinct().join(hosts, "host", "left_anti")
    return hosts.unionByName(more.select("host", zero.alias("n_pages"), zero.alias("allowed"), zero.alias("blocked"))), up


def host_edges(hosts: DataFrame, links: DataFrame, up: DataFrame) -> DataFrame:
    """``(src, to, forward, backward)``, two rows a link: trust goes forward by the link's
    share of its source's links, distrust back by its share of those to its target. Hosts and their parents link to each other as by one
    link; one without any link in a direction keeps what it has: it links to itself."""
    known, one = hosts.select(F.col("host").alias("dst")), F.lit(1.0).alias("n")
    both = (links.join(known, "dst", "left_semi").select("src", "dst", "n")
            .unionByName(up.select(F.col("host").alias("src"), F.col("parent").alias("dst"), one))
            .unionByName(up.select(F.col("parent").alias("src"), F.col("host").alias("dst"), one))
            .groupBy("src", "dst").agg(F.sum("n").alias("n")))
    out = both.groupBy("src").agg(F.sum("n").alias("n_out"))
    into = both.groupBy("dst").agg(F.sum("n").alias("n_in"))
    shares = both.join(out, "src").join(into, "dst").select(
        "src", "dst", (F.col("n") / F.col("n_out")).alias("forward"), (F.col("n") / F.col("n_in")).alias("backward"))
    ends = hosts.select(F.col("host").alias("src")).join(out.withColumnRenamed("src", "s"), F.col("src") == F.col("s"),
                                                         "left").join(
        into.withColumnRenamed("dst", "d"), F.col("src") == F.col("d"), "left").where("s is null or d is null")
    own = ends.select("src", F.col("src").alias("dst"), F.when(F.col("s").isNull(), 1.0).otherwise(0.0).alias("forward"),
                      F.when(F.col("d").isNull(), 1.0).otherwise(0.0).alias("backward"))
    whole = shares.unionByName(own)
    none = F.lit(0.0)
    return whole.select("src", F.col("dst").alias("to"), "forward", none.alias("backward")).unionByName(
        whole.select(F.col("dst").alias("src"), F.col("src").alias("to"), none.alias("forward"), "backward"))


def spread(hosts: DataFrame, edges: DataFrame, damping=DAMPING, tolerance=TOLERANCE) -> DataFrame:
    """``hosts(host, n_pages, allowed, blocked)`` with ``trust`` and ``distrust`` in pages.

    A step shrinks what is still to change by ``damping`` at least, so it ends.
    """
    def moved(ranks):
        got = edges.join(ranks, edges["src"] == ranks["host"]).groupBy("to").agg(
            F.sum(F.col("forward") * F.col("trust")).alias("t"), F.sum(F.col("backward") * F.col("distrust")).alias("d"))
        return hosts.join(got, hosts["host"] == got["to"], "left").select(
            "host", "n_pages", "allowed", "blocked",
            ((1 - damping) * F.col("allowed") + damping * F.coalesce("t", F.lit(0.0))).alias("trust"),
            ((1 - damping) * F.col("blocked") + damping * F.coalesce("d", F.lit(0.0))).alias("distrust"))

    seeds = hosts.agg(F.sum(F.col("allowed") + F.col("blocked")).alias("n")).first()["n"] or 0
    ranks = hosts.withColumns({"trust": F.col("allowed").cast("double"), "distrust": F.col("blocked").cast("double")})
    while True:
        before = ranks
        for _ in range(STEPS_A_WRITE):
            ranks = moved(ranks)
        ranks = saved(ranks, "host_ranks")
        old = before.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d"))
        change = F.sum(F.abs(F.col("trust") - F.col("t")) + F.abs(F.col("distrust") - F.col("d")))
        if (ranks.join(old, "host").agg(change.alias("all")).first()["all"] or 0.0) <= tolerance * seeds:
            return ranks


def judge(pages: DataFrame, rules=RULES, damping=DAMPING, tolerance=TOLERANCE, share=SHARE, prior=PRIOR) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of each page."""
    ruled = judged_by_rules(pages, rules)
    crawled = saved(ruled.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("verdict") == "allow").alias("allowed"),
        F.count_if(F.col("verdict") == "block").alias("blocked")), "crawled_hosts")
    links = saved(link_counts(pages, rules), "host_links")
    hosts, up = with_parents(crawled, links)
    hosts = saved(hosts, "hosts")
    edges = saved(host_edges(hosts, links, up), "host_edges")
    ranks = spread(hosts, edges, damping, tolerance)
    bad = F.col("distrust") > share * (F.col("distrust") + F.col("trust") + prior * F.col("n_pages"))
    verdicts = ranks.select("host", F.when(bad, "block").otherwise("allow").alias("host_verdict"))
    return ruled.join(verdicts, "host").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", "host_verdict").alias("verdict"))
