"""URL filters by empirical-Bayes host reputation, in native Spark.

Pages with a known outcome count for their host, its registered domain (a label below the suffix) and its suffix (the last
label, or the last two of TWO_LABEL_SUFFIXES). A beta-binomial prior shrinks each level towards the one above: all pages to suffix
to domain to host. Each level's prior strength comes from the spread of its groups' rates by the method of moments, within bounds.
A host is blocked if the lower posterior bound of its share of bad pages is over the limit, which by default is the share over all
pages. The bound is the posterior mean less z posterior deviations: with z = 0.674 three chances in four, in the normal
approximation of the beta distribution, that the host's share is higher. A host without outcomes has its domain's expectation.

Rules come first: a rule (host, path) fits its host and all subdomains if the path starts with the rule's; the longest wins.

Counts are summed before each shuffle and written once; a host of a third of all pages costs a row per task, and pages meet their
host's row by a salt. Three rows of sums reach the driver. For grouping only, a name is the host without user, port and last dot, and an
address of numbers is its own domain. Defined results: a null url or one without :// has an empty host and path, a group like
any other; pages without an outcome count for nothing; other columns pass through, names that begin with _qm_ are taken; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.storage import materialize

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bounds of a level's prior strength, in pages.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 50.0
#: Public suffixes of two labels below which names are registered.
TWO_LABEL_SUFFIXES = [
    "ac.jp", "ac.uk", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.hk",
    "com.mx", "com.my", "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "edu.au", "edu.cn", "gob.mx", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk",
    "ne.jp", "net.au", "net.br", "net.cn", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.nz", "org.uk",
]
_SALTS = 8
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The winning rule's text and verdict, or nulls. rules: (verdict, host, path)."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, at, begin in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(begin))
        text, verdict = F.when(fits, at + begin).otherwise(text), F.when(fits, said).otherwise(verdict)
    return text, verdict


def _strengths(levels: list[DataFrame]) -> list[tuple[float, float]]:
    """For each level of groups (n, bad): the share of bad pages and the prior strength that the spread of the groups' shares tells."""
    sums = None
    for k, groups in enumerate(levels):
        one = groups.filter("n > 0").agg(F.lit(k).alias("level"), F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("spread"))
        sums = one if sums is None else sums.unionByName(one)
    out = []
    for r in sorted(sums.collect(), key=lambda r: r["level"]):
        n, bad = r["n"], r["bad"]
        if not n:
            out.append((0.0, MOST_STRENGTH))
            continue
        share = bad / n
        within, free = share * (1 - share), n - r["squares"] / n - (r["groups"] - 1)
        excess = r["spread"] - bad * bad / n - within * (r["groups"] - 1)
        told = within * free / excess - 1 if excess > 0 and within > 0 and free > 0 else MOST_STRENGTH
        out.append((share, min(max(told, LEAST_STRENGTH), MOST_STRENGTH)))
    return out


def named(hosts: DataFrame) -> DataFrame:
    """hosts with the registered domain and the suffix of column host."""
    name = F.regexp_replace("host", "^.*@|:[0-9]*$|[.]$", "")
    numbers, last = F.regexp_like(name, F.lit("^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$")), F.substring_index(name, ".", -2)
    two = last.isin(TWO_LABEL_SUFFIXES)
    domain = F.when(numbers, name).when(two, F.substring_index(name, ".", -3)).otherwise(last)
    return hosts.withColumn("domain", domain).withColumn("suffix", F.when(numbers, "").when(two, last).otherwise(F.substring_index(name, ".", -1)))


def reputations(outcomes: DataFrame, limit: float | None = None, z: float = 0.674) -> DataFrame:
    """host, n, mean, bound, blocked for every host of outcomes: host, bad (true, false, or null where unknown).

    limit: None for the share of bad pages over all.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"))
    hosts = materialize(named(hosts), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    (share, top), (_, middle), (_, low) = _strengths([suffixes, domains, hosts])
    suffixes = suffixes.select("suffix", ((F.col("bad") + F.lit(share * top)) / (F.col("n") + F.lit(top))).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").select("domain", ((F.col("bad") + F.col("suffix_mean") * F.lit(middle)) / (F.col("n") + F.lit(middle))).alias("domain_mean"))
    mean = (F.col("bad") + F.col("domain_mean") * F.lit(low)) / (F.col("n") + F.lit(low))
    out = hosts.join(domains, "domain").select("host", "n", mean.alias("mean"))
    out = out.withColumn("bound", F.col("mean") - F.lit(z) * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.lit(low + 1))))
    return out.select("host", "n", "mean", "bound", (F.col("bound") > F.lit(share if limit is None else limit)).alias("blocked"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], limit: float | None = None, z: float = 0.674) -> DataFrame:
    """pages with _qm_host, _qm_path, _qm_rule, _qm_verdict, and the host's _qm_n, _qm_mean and _qm_bound.

    outcomes: host and bad of every page; a host of pages that isn't among them is allowed, its figures null.
    """
    known = reputations(outcomes, limit, z).select(F.col("host").alias("_qm_known"), F.col("n").alias("_qm_n"), F.col("mean").alias("_qm_mean"), F.col("bound").alias("_qm_bound"), F.col("blocked").alias("_qm_blocked"))
    known = known.withColumn("_qm_known_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    parsed = pages.withColumn("_qm_host", host_of(F.col("url"))).withColumn("_qm_path", path_of(F.col("url")))
    parsed = parsed.withColumn("_qm_salt", F.pmod(F.xxhash64("url", "_qm_path"), F.lit(_SALTS)).cast("int"))
    rule, verdict = rule_of(F.col("_qm_host"), F.col("_qm_path"), rules)
    out = parsed.join(known, (F.col("_qm_host") == F.col("_qm_known")) & (F.col("_qm_salt") == F.col("_qm_known_salt")), "left")
    said = F.coalesce(verdict, F.when(F.coalesce("_qm_blocked", F.lit(False)), "block").otherwise("allow"))
    return out.withColumn("_qm_rule", rule).withColumn("_qm_verdict", said).drop("_qm_blocked", "_qm_known", "_qm_salt", "_qm_known_salt")
