"""URL filtering by empirical-Bayes host reputation.

Labelled pages give each host a count of pages and of bad ones.  A host's rate of bad
pages is shrunk towards its registered domain's, that one's towards its suffix's, and
that one's towards the rate of all pages, by beta-binomial priors whose strengths are
estimated from how much the groups of a level differ (method of moments).  A url is
blocked where even the lower bound of its host's posterior is at or above a limit.
Rules, where one fits, come before the estimate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import checkpointed

#: Blocked at a lower bound of this rate or more; the bound lies so many posterior standard deviations under the mean.
BLOCK_RATE, DEVIATIONS = 0.5, 1.645
#: Bounds of a prior's strength in pages.
WEAKEST, STRONGEST = 1.0, 1_000_000.0
#: Suffixes of several labels under which anyone registers names; give a whole public-suffix list for more.  Some 10,000 rules at most.
SUFFIXES = [f"{second}.{top}" for top, seconds in {
    "uk": "ac co gov ltd me net nhs org plc police sch", "au": "asn com edu gov id net org", "nz": "ac co geek gen govt net org school", "jp": "ac ad co ed go gr lg ne or", "kr": "ac co go ne or re",
    "br": "com edu gov net org", "cn": "ac com edu gov net org", "hk": "com edu gov net org", "tw": "com edu gov idv net org", "in": "ac co edu firm gen gov ind net org", "id": "ac co go or web",
    "za": "ac co gov net org web", "il": "ac co gov net org", "tr": "com edu gen gov net org", "mx": "com edu gob net org", "ar": "com edu gob net org", "co": "com edu gov net org", "pl": "com edu gov net org",
    "ua": "com edu gov net org", "sg": "com edu gov net org", "my": "com edu gov net org", "ph": "com edu gov net org", "th": "ac co go in or", "vn": "com edu gov net org", "ng": "com edu gov net org", "ke": "ac co go or",
    "io": "github gitlab", "com": "appspot blogspot herokuapp myshopify wixsite", "dev": "pages web workers", "app": "netlify vercel web", "net": "azurewebsites cloudfront",
}.items() for second in seconds.split()]
_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def levels(host: Column, suffixes: list[str] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix, a port left out.

    The suffix is the longest of suffixes that ends the host, else the last label; the domain
    has one label more.  ``*.x`` stands for x with any label in front, ``!y.x`` takes y.x out
    of it.  An address is its own domain, and addresses are one suffix.
    """
    bare = F.regexp_replace(host, ":[0-9]*$", "")
    two = F.regexp_extract(bare, "([^.]+[.][^.]+)$", 1)
    domain, suffix = F.when(two == "", bare).otherwise(two), F.regexp_extract(bare, "([^.]*)$", 1)
    tail = lambda n: F.substring_index(bare, ".", -n)
    plain, wild, out = ([r for r in suffixes if r[0] not in "*!"], [r[2:] for r in suffixes if r[0] == "*"], [r[1:] for r in suffixes if r[0] == "!"])
    for n in range(2, max((r.count(".") + 1 for r in suffixes), default=1) + 1):
        # A host of fewer labels is its own tail at every n; a rule has exactly n.
        exact = F.size(F.split(bare, "[.]")) >= n
        fits = exact & (tail(n).isin(plain) | (tail(n - 1).isin(wild) & ~tail(n).isin(out)))
        domain, suffix = F.when(fits, tail(n + 1)).otherwise(domain), F.when(fits, tail(n)).otherwise(suffix)
    for n in sorted({r.count(".") + 1 for r in out}):  # these go before all others
        named = tail(n).isin([r for r in out if r.count(".") + 1 == n])
        domain, suffix = F.when(named, tail(n)).otherwise(domain), F.when(named, tail(n - 1)).otherwise(suffix)
    address = bare.rlike(r"^[0-9]{1,3}([.][0-9]{1,3}){3}$") | bare.startswith("[")
    return F.when(address, bare).otherwise(domain), F.when(address, F.lit("[address]")).otherwise(suffix)


def strength(groups: DataFrame) -> DataFrame:
    """One row (prior_n): the prior's strength, from groups of (n, bad), by the moments of a beta-binomial."""
    sums = groups.where("n > 0").agg(F.sum("n").alias("N"), F.sum("bad").alias("X"), F.sum(F.col("n") * F.col("n")).alias("N2"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("Q"), F.count("*").alias("G"))
    rate = F.col("X") / F.col("N")
    spread = F.try_divide(F.round(F.col("Q"), 9) - F.col("X") * rate, rate * (1 - rate)) - (F.col("G") - 1)
    share = F.try_divide(spread, F.col("N") - F.col("N2") / F.col("N") - (F.col("G") - 1))
    return sums.select(F.when(share > 0, F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), 1 / share - 1))).otherwise(F.lit(STRONGEST)).alias("prior_n"), rate.alias("rate"))


def reputations(outcomes: DataFrame, others: DataFrame | None = None, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """Rows (host, n, bad, mean, lower) from rows (host, bad 0/1): each host's posterior mean and lower bound.

    others (host) are hosts to judge too, with outcomes or without: n and bad are 0 without, and the posterior is the prior
    of the domain, which without outcomes is the suffix's, and that one's the rate of all.
    Rows without a host or an outcome are left out.  With no outcomes at all mean and lower are null.
    """
    domain, suffix = levels(F.col("host"), suffixes)
    hosts = outcomes.where("host is not null and bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    if others is not None:
        bare = others.where("host is not null").select("host").distinct().select("host", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"))
        hosts = hosts.unionByName(bare).groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    hosts = checkpointed(hosts.withColumns({"domain": domain, "suffix": suffix}))  # a row for each host; pages are read once for it
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    shrunk = (F.col("bad") + F.col("prior_n") * F.col("above")) / (F.col("n") + F.col("prior_n"))
    top = suffixes.crossJoin(F.broadcast(strength(suffixes))).withColumn("above", F.col("rate")).select("suffix", shrunk.alias("suffix_mean"))  # one row of strengths
    middle = domains.join(top, "suffix").crossJoin(F.broadcast(strength(domains))).withColumn("above", F.col("suffix_mean")).select("domain", "suffix", shrunk.alias("domain_mean"))
    low = hosts.join(middle, ["domain", "suffix"]).crossJoin(F.broadcast(strength(hosts))).withColumn("above", F.col("domain_mean"))
    low = low.withColumn("mean", shrunk)
    bound = F.col("mean") - DEVIATIONS * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("prior_n") + 1))
    return low.select("host", "n", "bad", "mean", F.greatest(F.lit(0.0), bound).alias("lower"))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule (verdict, host, path) that fits; null where none does.  Rules are code, a few hundred at most."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(said)).otherwise(verdict)
    return text, verdict


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], suffixes: list[str] = SUFFIXES) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict) for every page.

    pages has page_id and url; outcomes has page_id and bad (0 or 1, null unknown), any
    number for a page.  A null url, or one without ``://``, has an empty host and path and
    is judged as the host of that name.  A host without labelled pages is judged by the bound of
    its prior: its domain's rate, else its suffix's, else that of all pages.  Without any
    outcome every host is allowed.  Repeated rows each give a row.
    """
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = outcomes.select(F.col("page_id").cast("long").alias("page_id"), F.col("bad").cast("int").alias("bad"))
    scored = reputations(urls.select("page_id", "host").join(known, "page_id").select("host", "bad"), urls.select("host"), suffixes).select("host", "lower")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("lower") >= BLOCK_RATE, F.lit("block")).otherwise(F.lit("allow"))
    return urls.join(scored, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"))
