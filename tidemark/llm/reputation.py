"""URL filters: rule lists, and empirical-Bayes reputation of hosts where no rule speaks.

Outcomes of labelled pages (good or bad) are counted by host, registered domain and suffix. Each level's
counts update a beta prior whose mean is the posterior mean of the level above and whose strength is fitted
by moments over that level. A page is blocked if the lower posterior bound of its host's share of bad pages
lies above a limit, so a host is blocked on evidence only, never for being unknown.

Defined results: a url that is null or has no ``://`` has an empty host and path, no rule, and the verdict of
the root prior. Labels that are null, and labels of unknown pages, are no evidence; a page labelled more than
once is bad if any of its labels is. Repeated rows are judged alike. With no label at all everything is
allowed. Joins are null-safe, so null ids give no link.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import written

# Production parameters.
BOUND_Z = 1.6448536269514722  # one-sided 95 % bound
MAX_BAD = 0.35
# Suffixes of two labels under which names are registered; a parameter, not a full public list.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.nz", "com.mx")
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*(/[^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    found = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def levels(host: Column, two_label=TWO_LABEL_SUFFIXES) -> dict[str, Column]:
    """Registered domain and suffix of a host, without user part and port."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    last2 = F.substring_index(name, ".", -2)
    two = last2.isin(list(two_label))
    return {
        "site": name,
        "domain": F.when(two, F.substring_index(name, ".", -3)).otherwise(last2),
        "suffix": F.when(two, last2).otherwise(F.substring_index(name, ".", -1)),
    }


def _strength(rates: DataFrame, by: list[str]) -> DataFrame:
    """Prior strength per parent by moments: how much the children's rates vary beyond their sampling noise.

    With n pages and b bad ones in a child, rate p and parent mean m, the beta-binomial variance is
    m(1-m)(1 + (n-1)/(s+1))/n. Summing n(p-m)^2 over children gives 1/(s+1), from which the strength s follows.
    A strength never exceeds the number of children it rests on.
    """
    m, n = F.col("mean"), F.col("n").cast("double")
    sums = rates.groupBy(*by).agg(
        F.sum(n * F.pow(F.col("bad") / n - m, 2)).alias("spread"),
        F.sum(m * (1 - m)).alias("noise"),
        F.sum(m * (1 - m) * (n - 1)).alias("extra"),
        F.least(F.count(F.lit(1)).cast("double"), F.lit(MAX_STRENGTH)).alias("most"),
    )
    fitted = F.try_divide(F.col("extra"), F.col("spread") - F.col("noise")) - 1
    bounded = F.least(F.greatest(fitted, F.lit(MIN_STRENGTH)), F.col("most"))
    return sums.select(*by, F.when(F.col("spread") <= F.col("noise"), F.col("most")).otherwise(bounded).alias("strength"))


def reputation(outcomes: DataFrame) -> dict[str, DataFrame]:
    """Beta parameters (a, b) from rows (site, domain, suffix, bad 0/1): of every labelled site its posterior, of
    every domain the prior of its sites without labels, of every suffix the prior of its domains without labels.

    Counts are summed before any shuffle, so a hot host arrives as one row per task. The counts of sites and of
    domains are written, since every level reads them again.
    """
    spark = outcomes.sparkSession
    sites = outcomes.groupBy("suffix", "domain", "site").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    sites = written(spark, sites)
    domains = written(spark, sites.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    root = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).select(
        # Jeffreys prior at the root
        F.try_divide(F.coalesce(F.col("bad"), F.lit(0)) + 0.5, F.coalesce(F.col("n"), F.lit(0)) + 1.0).alias("mean")
    )

    def posterior(counts: DataFrame, parent: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
        """Posteriors of the names with labels, and per parent the prior of a name without any."""
        rates = counts.join(parent, by) if by else counts.join(F.broadcast(parent))  # one row
        strength = _strength(rates, by)
        with_prior = rates.join(strength, by) if by else rates.join(F.broadcast(strength))
        prior_a, prior_b = F.col("mean") * F.col("strength"), (1 - F.col("mean")) * F.col("strength")
        known = with_prior.withColumn("a", prior_a + F.col("bad")).withColumn("b", prior_b + F.col("n") - F.col("bad"))
        fresh = parent.join(strength, by).select(*by, prior_a.alias("a"), prior_b.alias("b")) if by else None
        return known, fresh

    def mean(post: DataFrame, by: list[str]) -> DataFrame:
        return post.select(*by, (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"))

    by_suffix, _ = posterior(suffixes, root, [])
    by_domain, new_domain = posterior(domains, written(spark, mean(by_suffix, ["suffix"])), ["suffix"])
    by_site, new_site = posterior(sites, written(spark, mean(by_domain, ["suffix", "domain"])), ["suffix", "domain"])
    return {"site": by_site.select("suffix", "domain", "site", "a", "b"), "domain": new_site, "suffix": new_domain}


def lower_bound(a: Column, b: Column, z: float = BOUND_Z) -> Column:
    """Lower bound of a beta variable by its mean and standard deviation."""
    total = a + b
    return a / total - z * F.sqrt(a * b / (total * total * (total + 1)))


def bad_sites(outcomes: DataFrame, max_bad: float = MAX_BAD) -> DataFrame:
    """Sites, domains and suffixes whose lower bound exceeds ``max_bad``: (level, name).

    A site with labels is judged by its own posterior; a site without any by the prior that its domain gives
    it, and a domain without any by the prior of its suffix.
    """
    post = reputation(outcomes)
    flagged = lambda level: post[level].select(
        F.lit(level).alias("level"), F.col(level).alias("name"), (lower_bound(F.col("a"), F.col("b")) > max_bad).alias("bad")
    )
    return flagged("site").unionByName(flagged("domain")).unionByName(flagged("suffix"))


def judge(pages: DataFrame, outcomes: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """One row per page: id, host, path, rule and verdict.

    ``outcomes`` are labels (id, bad 0/1). Pages of one host share its flags, so flags are joined to the
    hosts first and then to the pages, as tables of one row per name.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    base = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    base = written(pages.sparkSession, base.withColumns(levels(F.col("host"))))

    labels = outcomes.groupBy("id").agg(F.max("bad").alias("bad")).filter("bad is not null")
    # one outcome per labelled page, however often its row is repeated
    labelled = base.groupBy("page_id", "suffix", "domain", "site").agg(F.lit(1).alias("one"))
    evidence = labelled.join(labels, F.col("page_id") == F.col("id")).select("suffix", "domain", "site", "bad")

    flags = written(pages.sparkSession, bad_sites(evidence))
    names = base.groupBy("suffix", "domain", "site").agg(F.count(F.lit(1)).alias("pages"))
    for level in ("site", "domain", "suffix"):
        of_level = flags.filter(F.col("level") == level).select(F.col("name").alias(level), F.col("bad").alias(f"{level}_bad"))
        names = names.join(of_level, level, "left")
    hosts = names.select("site", F.coalesce("site_bad", "domain_bad", "suffix_bad", F.lit(False)).alias("bad"))
    judged = base.join(hosts, "site", "left").withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"),
    )
