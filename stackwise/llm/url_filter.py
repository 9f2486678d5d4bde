"""URL filter: allow and block rules, and where none fits, an empirical-Bayes reputation of the host."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host and path prefix): fixed values of the contract.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: A page is blocked if its host's share of good pages lies below CUT with a posterior of about 95 percent (Z deviations).
CUT = 0.5
Z = 1.645
#: Bounds of a prior's strength, in pages; the strength between them is estimated from the labelled pages.
WEAKEST, STRONGEST = 2.0, 200.0
#: Tables of host statistics up to so many rows are broadcast, larger ones are joined by shuffling.
BROADCAST_ROWS = 200_000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a text without "://"."""
    after = F.when(F.instr(url, "://") > 0, F.expr("substr({0}, instr({0}, '://') + 3)".replace("{0}", "url")))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (its host or a subdomain, and its path a prefix) and its verdict; nulls if none fits.

    Equally long rules: the one that comes first in the list.
    """
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])) if len({len(r[1]) for r in rules}) == len(rules) else sorted(reversed(rules), key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def named_host(host: Column) -> Column:
    """The host's name alone, by which outcomes are counted: without a user part and a port."""
    return F.regexp_replace(F.substring_index(host, "@", -1), ":[0-9]*$", "")


def host_levels(host: Column) -> tuple[Column, Column]:
    """Registered domain (the last two labels) and suffix (the last label) of a host."""
    return F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def _strength(mean: Column, spread: Column, pages: Column) -> Column:
    """Method of moments: the beta prior's strength from the variance of the children's shares, kept within bounds.

    spread: the children's variance weighted by pages; pages: the mean number of pages a child, weighted in the same way.
    """
    noise = mean * (1 - mean)
    between = spread - noise / pages
    return F.when(between <= noise / (1 + STRONGEST), F.lit(STRONGEST)).otherwise(F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), noise / between - 1)))


def _levels(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, tuple[float, float]]:
    """Posteriors of hosts (host, mean, deviation, pages), and what is known of a host without labelled pages: by domain (md, dd), by suffix (ms, ds), and else.

    From the top: all pages give the suffixes' prior, a suffix's posterior mean gives the prior of its domains, a domain's
    that of its hosts; each prior's strength comes from how much the children differ. A host without labelled pages has the
    mean of its domain, suffix or all pages, and the variance of that level's posterior, to which each level below adds
    how much its children differ. Every step sums counts that were summed before, so a host with a third of all pages is
    one row per task in the shuffle.
    """
    domain, suffix = host_levels(F.col("host"))
    hosts = outcomes.groupBy("host").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("g")).select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "g")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    total = suffixes.agg(F.sum("n").alias("N"), F.sum("g").alias("G"))

    def moments(children: DataFrame) -> DataFrame:
        """One row: the strength of the prior of a level."""
        m = F.sum("g") / F.sum("n")
        got = children.agg(m.alias("m"), (F.sum(F.col("g") * F.col("g") / F.col("n")) / F.sum("n") - m * m).alias("v"), (F.sum("n") / F.count("*")).alias("p"))
        return got.select("m", _strength(F.col("m"), F.col("v"), F.col("p")).alias("k"))

    top, ks, kd, kh = total.first(), moments(suffixes).first(), moments(domains).first(), moments(hosts).first()
    if not top["N"]:  # nothing is labelled
        half = F.lit(0.5)
        return hosts.select("host", half.alias("mean"), half.alias("deviation"), F.lit(0).cast("long").alias("pages")), domains.select("domain", half.alias("md"), half.alias("dd")), suffixes.select("suffix", half.alias("ms"), half.alias("ds")), (0.5, 0.5)

    def post(g: Column, n: Column, prior: Column, strength: float) -> Column:
        return (g + prior * F.lit(strength)) / (n + F.lit(strength))

    def below(mean, variance, *strengths: float):
        """The variance of a child's share, from that of its ancestor's, through levels of the given strengths."""
        for k in strengths:
            variance = variance + (mean * (1 - mean) - variance) / (k + 1)
        return variance

    s = suffixes.select("suffix", F.col("n").alias("ns"), post(F.col("g"), F.col("n"), F.lit(top["G"] / top["N"]), ks["k"]).alias("ms"))
    d = domains.join(s, "suffix").select("domain", F.col("n").alias("nd"), post(F.col("g"), F.col("n"), F.col("ms"), kd["k"]).alias("md"))
    h = hosts.join(d, "domain")
    mean, md, ms, m = post(F.col("g"), F.col("n"), F.col("md"), kh["k"]), F.col("md"), F.col("ms"), top["G"] / top["N"]
    of_host = h.select("host", mean.alias("mean"), F.sqrt(mean * (1 - mean) / (F.col("n") + F.lit(kh["k"]) + 1)).alias("deviation"), F.col("n").alias("pages"))
    of_domain = d.select("domain", "md", F.sqrt(below(md, md * (1 - md) / (F.col("nd") + kd["k"] + 1), kh["k"])).alias("dd"))
    of_suffix = s.select("suffix", "ms", F.sqrt(below(ms, ms * (1 - ms) / (F.col("ns") + ks["k"] + 1), kd["k"], kh["k"])).alias("ds"))
    return of_host, of_domain, of_suffix, (m, below(m, m * (1 - m) / (top["N"] + 1), ks["k"], kd["k"], kh["k"]) ** 0.5)


def reputation(outcomes: DataFrame) -> DataFrame:
    """Posterior of each host from ``outcomes`` (host, good 0/1, n: pages with that outcome): host, mean, deviation, pages."""
    return _levels(outcomes)[0]


def _small(df: DataFrame) -> DataFrame:
    """df with a hint to broadcast it if it is small enough by count; larger tables are joined by shuffling."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def judge_pages(pages: DataFrame, outcomes: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str]] = RULES, cut: float = CUT, z: float = Z) -> DataFrame:
    """One row per page: key, host, path, rule, verdict, reputation, deviation, labelled.

    ``outcomes`` has host, good (0/1) and n. Without a fitting rule, a page is blocked if mean + z deviations of its host's
    posterior stay under ``cut``, else allowed. A host without labelled pages is judged by its domain's labelled pages, else
    its suffix's, else all (an empty host, too); labelled is 0 then. If nothing is labelled at all, such pages are allowed.
    Reputations go by the host's name without user part and port. Null urls: empty host and path. Repeated rows are judged alike, each by itself.
    """
    host, path = split_url(F.col("url"))
    base = pages.select(pages[key].alias(key), pages[url].cast("string").alias("url")).select(key, host.alias("host"), path.alias("path")).withColumn("named", named_host(F.col("host")))
    rule, says = longest_rule(F.col("host"), F.col("path"), rules)
    domain, suffix = host_levels(F.col("named"))
    hosts, domains, suffixes, (mean, deviation) = _levels(outcomes)
    judged = base.withColumns({"rule": rule, "says": says, "domain": domain, "suffix": suffix}).join(_small(hosts.withColumnRenamed("host", "named")), "named", "left").join(_small(domains), "domain", "left").join(_small(suffixes), "suffix", "left")
    mean, deviation = F.coalesce("mean", "md", "ms", F.lit(mean)), F.coalesce("deviation", "dd", "ds", F.lit(deviation))
    verdict = F.coalesce(F.col("says"), F.when(mean + F.lit(z) * deviation < F.lit(cut), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select(key, "host", "path", "rule", verdict.alias("verdict"), mean.alias("reputation"), deviation.alias("deviation"), F.coalesce("pages", F.lit(0)).cast("long").alias("labelled"))


def outcomes_of(pages: DataFrame, labels: DataFrame, url: str = "url") -> DataFrame:
    """Labelled page outcomes (named host, good, n): the path's first number names the document that the page shows.

    A document is good if its quality is 1 and it isn't toxic; of repeated labels the worst counts.
    """
    host, path = split_url(F.col("url"))
    shown = pages.select(pages[url].cast("string").alias("url")).select(named_host(host).alias("host"), F.regexp_extract(path, r"/([0-9]{1,18})", 1).alias("id")).where("id <> ''")
    good = labels.groupBy(labels["doc_id"].alias("id")).agg(F.min(F.when((F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) != 1), 1).otherwise(0)).alias("good"))
    return shown.withColumn("id", F.col("id").cast("long")).join(good, "id").groupBy("host", "good").agg(F.count("*").alias("n"))
