"""Operator 5, URL filters: Empirical-Bayes reputation of hosts.

Labelled outcomes of pages (bad or not) are counted by host.  A host's bad share is shrunk
towards its registered domain's, that towards its suffix's, and that towards the whole corpus's:
each level's prior is a beta distribution whose mean is the level above and whose strength is
fitted by moments.  A host is blocked when the lower posterior bound of its bad share is above
`BLOCK_ABOVE`.  Hosts without labels get their domain's prior.  Explicit rules go first.

All levels are group-bys with partial sums and equi-joins on host, domain or suffix; a hot host is
one row after pre-aggregation, and the join back to its pages can be split by adaptive execution.
Only one row of moments per level reaches the driver.

Defined results: a null url, or one without `://`, has empty host and path and is allowed unless the
empty host's reputation says otherwise; without labels nothing is blocked by reputation; pages
with equal urls are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the base rule: host, path, verdict.
RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]

#: Public suffixes of two labels; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.jp", "co.nz", "com.br", "co.in"]

BLOCK_ABOVE, BOUND_SDS = 0.5, 1.645
STRENGTH = (1.0, 10_000.0)


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    three = F.substring_index(host, ".", -3)
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(TWO_LABEL_SUFFIXES), three).otherwise(two)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _strength(level: DataFrame) -> float:
    """Strength of the beta prior around ``m``, by moments, from rows (n, k, m)."""
    r = level.filter("n > 0").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("within"),
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("m"), 2)).alias("spread"), F.count("*").alias("groups"),
    ).first()
    if not r["n"] or not r["within"]:
        return STRENGTH[1]
    inner = r["within"] / r["n"]
    extra = (r["spread"] - r["groups"] * inner) / r["n"]  # what sampling alone doesn't explain
    return STRENGTH[1] if extra <= 0 else min(max(inner / extra - 1, STRENGTH[0]), STRENGTH[1])


def reputation(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, float, float]:
    """From rows (host, bad): posteriors (a, b, mean) by host, domain and suffix, the corpus's mean,
    and the strength of the prior that a domain gives its hosts."""
    host = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("k"))
    host = host.select("*", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
    domain = host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffix = domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffix.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    mean = (total["k"] + 0.5) / (total["n"] + 1.0) if total["n"] else 0.0

    def shrunk(level: DataFrame, c: float) -> DataFrame:
        level = level.withColumn("a", F.col("m") * c + F.col("k")).withColumn("b", (1 - F.col("m")) * c + F.col("n") - F.col("k"))
        return level.withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))

    suffix = suffix.withColumn("m", F.lit(mean))
    suffix = shrunk(suffix, _strength(suffix))
    domain = domain.join(suffix.select("suffix", F.col("mean").alias("m")), "suffix")
    domain = shrunk(domain, _strength(domain))
    host = host.join(domain.select("domain", F.col("mean").alias("m")), "domain")
    c = _strength(host)
    return shrunk(host, c), domain, suffix, mean, c


def judge(pages: DataFrame, outcomes: DataFrame, url: str = "url", key: str = "page_id", rules=RULES) -> DataFrame:
    """(key, host, path, rule, verdict, bad_low): ``outcomes`` has (key, bad 0/1), one row or more a page."""
    p = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    labelled = p.select(key, "host").join(outcomes.select(key, F.col("bad").cast("long").alias("bad")).dropna(), key)
    host, domain, suffix, mean, c = reputation(labelled.select("host", "bad"))

    def low(a: Column, b: Column) -> Column:
        n = a + b
        return a / n - BOUND_SDS * F.sqrt(a * b / (n * n * (n + 1)))

    hosts = p.select("host").distinct().select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
    hosts = (
        hosts.join(host.select("host", "a", "b"), "host", "left")
        .join(domain.select("domain", F.col("mean").alias("dm")), "domain", "left")
        .join(suffix.select("suffix", F.col("mean").alias("sm")), "suffix", "left")
    )
    prior = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.coalesce("dm", "sm", F.lit(mean))))
    hosts = hosts.select(
        "host", F.when(F.col("a").isNotNull(), low(F.col("a"), F.col("b"))).otherwise(low(prior * c, (1 - prior) * c)).alias("bad_low")
    )
    p = p.join(hosts, "host", "left")
    rule, fixed = rule_of(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("bad_low") > BLOCK_ABOVE, F.lit("block")).otherwise(F.lit("allow"))
    return p.select(key, "host", "path", rule.alias("rule"), F.coalesce(fixed, learned).alias("verdict"), "bad_low")
