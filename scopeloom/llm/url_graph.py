"""URL verdicts: rules first, then trust and distrust spread over the graph of hosts, all in DataFrame operations."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

#: (host, path, verdict); a rule holds for its host and all subdomains where the path starts with the rule's.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
_LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]*)"""


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path joined; the first given of equal length), and its verdict; else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):  # the last to apply is outermost
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def spread(edges: DataFrame, seeds: DataFrame, scratch: Scratch, name: str, damping: float = 0.85, rounds: int = 1_000, least_change: float = 1e-7, least_share: float = 1e-4) -> DataFrame:
    """Personalised PageRank: (host, score). ``edges`` (a, b, share) with the shares of each ``a`` summing to one; ``seeds``
    (host, seed) are where walks start, restart, and go from hosts without links. One join on the linking host and one
    aggregate, partial first, per round; a host with very many links is only ever joined and summed.

    Rounds go on until one changes less than ``least_change`` in sum and less than ``least_share`` of any host's own score,
    so also until no new host is reached: verdicts compare small scores. More than ``rounds`` raise."""
    zero = F.lit(0.0)
    now = scratch.table(seeds.select("host", F.col("seed").alias("score")), f"{name}-0").select("host", "score")
    for k in range(1, rounds + 1):
        moved = now.join(edges, F.col("host") == edges.a).groupBy(F.col("b").alias("host")).agg((F.sum(F.col("score") * F.col("share")) * damping).alias("flow"))
        joined = moved.join(seeds.select("host", "seed"), "host", "full").join(now.withColumnRenamed("score", "old"), "host", "full")
        step = scratch.table(joined.select("host", *[F.coalesce(c, zero).alias(c) for c in ("flow", "seed", "old")]), f"{name}-{k}")
        back = 1 - (step.agg(F.sum("flow")).first()[0] or 0.0)  # restarts, and walks that end where no link leads on
        score = F.col("flow") + F.col("seed") * back
        moved_by = F.abs(score - F.col("old"))
        change, share = (x or 0.0 for x in step.agg(F.sum(moved_by), F.max(F.when(score > 0, moved_by / score))).first())
        scratch.drop(f"{name}-{k - 1}")
        now = step.select("host", score.alias("score"))
        if change < least_change and share < least_share:
            return now
    raise RuntimeError(f"scores did not settle in {rounds} rounds")


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = 0.5, url_col: str = "url", html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict of every row.

    A page's rule decides where one fits. For the others the host does: trust starts from hosts of allowed pages and follows
    links (what the trusted link to is trusted), distrust starts from hosts of blocked pages and follows them backwards (who
    links to the blocked is distrusted), each as a personalised PageRank. A host whose distrust is over ``threshold`` of the
    two blocks; without evidence it allows.

    Null url, or one without ``://``: host and path are empty, no rule, allow. Null html: no links. Repeated rows count and
    return each. Links within a host are no evidence. Empty table: empty result. Further columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    url = F.col(url_col)
    named = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    ruled = named.withColumns({"rule": rule, "by_rule": verdict})
    counts = scratch.table(ruled.where("by_rule is not null").groupBy("host").agg(F.sum((F.col("by_rule") == "allow").cast("long")).alias("good"), F.sum((F.col("by_rule") == "block").cast("long")).alias("bad")), "seeds")
    n_good, n_bad = (x or 0 for x in counts.agg(F.sum("good"), F.sum("bad")).first())
    links = pages.where(F.col(html_col).isNotNull()).select(host_of(url).alias("a"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(html_col), F.lit(_LINK), F.lit(1)))).alias("b"))
    links = links.select("a", ascii_lower(F.col("b")).alias("b")).where("a <> '' and b <> '' and a <> b")
    edges = scratch.table(links.groupBy("a", "b").agg(F.count("*").alias("n")), "edges")

    def shares(e):
        return e.join(e.groupBy("a").agg(F.sum("n").alias("all")), "a").select("a", "b", (F.col("n") / F.col("all")).alias("share"))

    linked = not edges.isEmpty()

    def score(column, total, direction, name):
        seeds = counts.where(F.col(column) > 0).select("host", (F.col(column) / F.lit(float(total or 1))).alias("seed"))
        if not linked:  # walks stay at the seeds
            return seeds.select("host", F.col("seed").alias("score"))
        return spread(scratch.table(shares(direction), f"{name}-shares"), seeds, scratch, name)

    trust = score("good", n_good, edges, "trust").withColumnRenamed("score", "trust")
    distrust = score("bad", n_bad, edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"), "distrust").withColumnRenamed("score", "distrust")
    t, d = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    bad_hosts = scratch.table(trust.join(distrust, "host", "full").where((d > 0) & (d > threshold * (t + d))).select("host", F.lit(True).alias("bad_host")), "bad-hosts")
    by_host = F.when(F.col("bad_host"), F.lit("block")).otherwise(F.lit("allow"))
    out = ruled.join(bad_hosts, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"))
