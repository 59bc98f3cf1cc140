"""Host reputation by empirical Bayes: labelled outcomes shrunk from host to registered domain to suffix.

Each level's groups give a beta prior to the groups below: its mean is the group's own posterior mean, its strength
follows from how far the rates below spread beyond what counting alone explains (method of moments). A host is blocked
if the lower bound of its posterior rate of bad outcomes exceeds ``limit``; a host without outcomes has its domain's prior.
Rules (allow or block, host and path) go before the method; the longest that fits wins.

The registered domain is the suffix and one label more; suffixes of several labels come as a parameter (``SUFFIXES`` has a
few, the public list can be given). User names and ports do not count, addresses of numbers are domains of their own.

Null url or no ``://``: host and path empty, judged by the overall prior. Very long urls: read whole. Outcomes without a host
are left out. Empty tables: empty result; without outcomes nothing is blocked but by rule. Repeated rows each count; repeated
or null ids do no harm. Of rules that fit and are equally long, the last by name wins. Columns asked for pass through, but for
those named like the output's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, save

#: (verdict, host, path): fits the host and its subdomains where the path starts so.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Blocked above this rate of bad outcomes, at this many standard deviations below the posterior mean.
LIMIT, Z = 0.5, 1.645
#: Bounds of a prior's strength, in outcomes.
WEAKEST, STRONGEST = 1.0, 1000.0

#: Suffixes of two labels under which domains are registered, beside all of one label; the caller may give more.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "co.za", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.kr")

_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _AZ, _AZ.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def bare(host: Column) -> Column:
    """A host without user name and port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def suffix_of(host: Column, suffixes=SUFFIXES) -> Column:
    """The longest of the given suffixes that the host ends in, with its label before it; else the last label."""
    name, out = bare(host), F.substring_index(bare(host), ".", -1)
    for n in sorted({s.count(".") + 1 for s in suffixes}):
        last = F.substring_index(name, ".", -n)
        out = F.when(last.isin([s for s in suffixes if s.count(".") + 1 == n]), last).otherwise(out)
    return F.when(_numbers(name), F.lit("")).otherwise(out)


def domain_of(host: Column, suffixes=SUFFIXES) -> Column:
    """The registered domain: the suffix and the label before it; an address of numbers is its own."""
    name, suffix = bare(host), suffix_of(host, suffixes)
    out = F.substring_index(name, ".", -2)
    for n in sorted({s.count(".") + 1 for s in suffixes}):
        out = F.when(suffix == F.substring_index(name, ".", -n), F.substring_index(name, ".", -n - 1)).otherwise(out) if n > 1 else out
    return F.when(_numbers(name), name).otherwise(out)


def _numbers(name: Column) -> Column:
    return name.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$") | name.startswith("[")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in one, and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # later ones are longer and win
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _strength(n: Column, bad: Column, mean: Column) -> Column:
    """Strength of the prior over groups with counts n, bad around a mean: aggregates over the groups.

    Spread of the rates, weighted by n, against mean * (1 - mean) / n that counting alone makes.
    """
    total, spread = F.sum(n), F.sum(n * F.pow(bad / n - mean, F.lit(2)))
    unit = mean * (1 - mean)
    beyond = (spread - (F.count(F.lit(1)) - 1) * unit) / F.greatest(total - F.sum(n * n) / total, F.lit(1e-9))
    return F.when((beyond <= 0) | (unit <= 0), F.lit(STRONGEST)).otherwise(F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), unit / beyond - 1)))


def reputation(outcomes: DataFrame, suffixes=SUFFIXES) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """From (host, bad 0 or 1): tables of host, domain, suffix and overall priors.

    host: (host, n, bad, a, b) posterior; domain, suffix: (key, mean, strength) prior for what is below; overall: one row.
    """
    rows = outcomes.where("host <> '' and bad is not null")
    host = save(rows.groupBy("host").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("bad").cast("double").alias("bad")), "hosts")
    host = host.withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes))
    domain = save(host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffix = domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    overall = suffix.agg((F.sum("bad") / F.sum("n")).alias("mean"))
    of_all = suffix.crossJoin(F.broadcast(overall)).groupBy("mean").agg(_strength(F.col("n"), F.col("bad"), F.col("mean")).alias("strength"))  # one row beside each suffix

    def below(groups: DataFrame, prior: DataFrame, own: str, parts: DataFrame) -> DataFrame:
        """Mean of each group after its prior, and the strength its own parts show around it."""
        mean = groups.join(prior.select(*({"suffix"} & set(prior.columns)), F.col("mean").alias("pm"), F.col("strength").alias("ps")), "suffix") if "suffix" in prior.columns else groups.crossJoin(F.broadcast(prior.select(F.col("mean").alias("pm"), F.col("strength").alias("ps"))))
        mean = mean.withColumn("mean", (F.col("bad") + F.col("ps") * F.col("pm")) / (F.col("n") + F.col("ps")))
        spread = parts.join(mean.select(own, "mean"), own).groupBy(own, "mean").agg(_strength(F.col("n"), F.col("bad"), F.col("mean")).alias("strength"))
        return spread.join(groups.select(own, *({"suffix"} - {own})), own)

    of_all = save(of_all, "overall", 1)
    of_suffix = save(below(suffix, of_all, "suffix", domain), "suffix-priors", 8)
    of_domain = save(below(domain, of_suffix, "domain", host), "domain-priors")
    host = host.join(of_domain.select("domain", "mean", "strength"), "domain")
    host = host.select("host", "n", "bad", (F.col("bad") + F.col("strength") * F.col("mean")).alias("a"), (F.col("n") - F.col("bad") + F.col("strength") * (1 - F.col("mean"))).alias("b"))
    return host, of_domain.select("domain", "mean", "strength"), of_suffix.select("suffix", "mean", "strength"), of_all


def judge(pages: DataFrame, outcomes: DataFrame, url: str = "url", keep: list[str] | None = None, rules=RULES, limit: float = LIMIT, z: float = Z, suffixes=SUFFIXES) -> DataFrame:
    """Columns ``keep`` with host, path, rule, verdict, and the posterior's mean and lower bound."""
    keep = [c for c in (pages.columns if keep is None else keep) if c.lower() not in ("host", "path", "rule", "verdict", "bad_rate", "bad_bound")]
    host, domain, suffix, overall = reputation(outcomes, suffixes)
    # Every host of the pages gets its posterior once, from the nearest level that has outcomes.
    rows = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    seen = pages.select(host_of(F.col(url)).alias("host")).distinct()
    seen = seen.withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes))
    beta = lambda t, k, p: t.select(k, (F.col("mean") * F.col("strength")).alias(f"a{p}"), ((1 - F.col("mean")) * F.col("strength")).alias(f"b{p}"))
    seen = seen.join(host.select("host", F.col("a").alias("ah"), F.col("b").alias("bh")), "host", "left").join(beta(domain, "domain", "d"), "domain", "left").join(beta(suffix, "suffix", "s"), "suffix", "left")
    seen = seen.crossJoin(F.broadcast(overall.agg(F.first("mean").alias("m"), F.first("strength").alias("k"))))  # one row
    a, b = F.coalesce("ah", "ad", "as", F.col("m") * F.col("k")), F.coalesce("bh", "bd", "bs", (1 - F.col("m")) * F.col("k"))
    mean = a / (a + b)
    seen = seen.select("host", mean.alias("bad_rate"), (mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1))).alias("bad_bound"))
    seen = bounded_broadcast(save(seen, "reputation"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = rows.join(seen, "host", "left").withColumn("rule", name)
    method = F.when(F.col("bad_bound") > limit, "block").otherwise("allow")
    return out.select(*keep, "host", "path", "rule", F.coalesce(verdict, method).alias("verdict"), "bad_rate", "bad_bound")
