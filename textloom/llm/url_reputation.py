"""URL filter by host reputation, shrunk by empirical Bayes.

Each level's rate of bad pages has a beta prior whose mean is the rate one level up: all pages, suffix, registered
domain, host. A prior's strength follows from how much the rates of its level's members differ (method of moments). A
host is blocked if the lower bound of its rate lies above the rate of all labelled pages: it is worse than most, and
there are enough outcomes, its own or its domain's, to say so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import small_side, stored

#: Fixed values of the site rules: verdict, host and path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Standard deviations that the bound lies below the mean of a host's rate.
BOUND = 1.0
#: Suffixes of two labels under which names are registered; any other suffix is a host's last label. Fixed values.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "gov.au", "gov.uk", "net.au", "or.jp", "org.au", "org.uk")
HOST_BROADCAST_ROWS = 500_000
#: Least and most strength of a prior, in pages.
WEAK, STRONG = 1.0, 1000.0


def host_of(url: Column) -> Column:
    """From behind the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """Behind the host up to ? # or the end; empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host, or a domain it lies in, and begins the path; else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, site, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(start)
        name, verdict = F.when(fits, site + start).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def _shrunk(level: DataFrame, key: str, above: str) -> DataFrame:
    """level (key, n, bad, prior: rate above) with rate and strength ``s``; the strength is that of the whole level."""
    m = F.sum(F.col("n") * (F.col("bad") / F.col("n") - F.col(above)) ** 2)
    noise = F.sum(F.col(above) * (1 - F.col(above)))
    room = F.sum((F.col("n") - 1) * F.col(above) * (1 - F.col(above)))
    # E[m] = noise + room / (s + 1)
    s = F.coalesce(F.when(m > noise, room / (m - noise) - 1), F.lit(STRONG))
    strength = F.lit(level.agg(F.least(F.greatest(s, F.lit(WEAK)), F.lit(STRONG)).alias("s")).first()["s"])
    return level.withColumns({"s": strength, f"{key}_rate": (F.col("bad") + strength * F.col(above)) / (F.col("n") + strength)})


def host_reputation(outcomes: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(host, domain, suffix, n, rate, bound, usual) of outcomes (host, bad: 0 or 1), as a stored table; null and empty
    hosts and null outcomes are left out. usual: the rate of all outcomes.

    The suffix is a host's last two labels if these are among ``suffixes``, else its last one; the registered domain has one
    label more, if there is one. Outcomes are read once and summed by host before any shuffle. Empty outcomes give no rows.
    """
    rows = outcomes.where("host is not null and host <> '' and bad is not null")
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("double")).alias("bad"))
    two = F.substring_index("host", ".", -2).isin(*suffixes) if suffixes else F.lit(False)
    hosts = stored(
        hosts.withColumns(
            {
                "domain": F.when(two, F.substring_index("host", ".", -3)).otherwise(F.substring_index("host", ".", -2)),
                "suffix": F.when(two, F.substring_index("host", ".", -2)).otherwise(F.substring_index("host", ".", -1)),
            }
        )
    )
    usual = F.lit(hosts.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("rate")).first()["rate"])
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffix = _shrunk(stored(hosts.groupBy("suffix").agg(*sums).withColumn("usual", usual)), "suffix", "usual").select("suffix", "suffix_rate")
    domain = _shrunk(stored(hosts.groupBy("domain", "suffix").agg(*sums).join(suffix, "suffix")), "domain", "suffix_rate").select("domain", "domain_rate")
    out = _shrunk(stored(hosts.join(domain, "domain")), "host", "domain_rate")
    a = F.col("n") + F.col("s")
    sd = F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (a + 1))
    return stored(out.select("host", "domain", "suffix", "n", F.col("host_rate").alias("rate"), (F.col("host_rate") - BOUND * sd).alias("bound"), usual.alias("usual")))


def judge_urls(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url): page_id, host, path, rule, verdict, bound.

    outcomes: (page_id, bad: 0 or 1) of labelled pages; a page may have several. A rule that fits gives the verdict, the
    longest first; else the page is blocked if its host's bound is above the rate of all outcomes. Hosts without labelled
    pages, and urls that are null or have no ://, with empty host and path, are allowed. Repeated pages are judged alike,
    other columns are ignored, null ids have no outcome, and an empty table gives no rows. Urls may be of any length.
    """
    pages = pages.select(F.col("page_id").alias("page_id"), F.col("url").cast("string").alias("url"))
    pages = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labelled = pages.select("page_id", "host").join(outcomes.select("page_id", "bad"), "page_id")
    bounds = small_side(host_reputation(labelled).select("host", "bound", "usual"), HOST_BROADCAST_ROWS)
    rule, verdict = ruled(F.col("host"), F.col("path"))
    by_host = F.when(F.col("bound") > F.col("usual"), "block").otherwise("allow")
    return pages.join(bounds, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), "bound")
