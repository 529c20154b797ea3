"""Url filter: fixed rules first, then the reputation of the host, shrunk from suffix to domain to host."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEVELS = ("suffix", "domain", "host")

# Public suffixes of two labels under which names are registered, the commoner ones of the Public Suffix List (publicsuffix.org)
# as of 2024. Any other host is registered under its last label.
TWO_LABEL_SUFFIXES = [
    "ac.in", "ac.jp", "ac.nz", "ac.uk", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn",
    "com.co", "com.eg", "com.hk", "com.mx", "com.my", "com.ng", "com.ph", "com.pk", "com.pl", "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn",
    "go.jp", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "govt.nz", "me.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.in", "net.pl", "net.uk", "or.id", "or.jp",
    "or.kr", "org.au", "org.br", "org.cn", "org.il", "org.in", "org.nz", "org.pl", "org.tr", "org.tw", "org.uk", "org.za",
]


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an url; both empty where it is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, UPPER.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits host (or a parent of it) and path prefix; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is tested first, as it wraps the others
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, F.lit(rule.name)).otherwise(name), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def level_names(host: Column) -> dict[str, Column]:
    """The names a host inherits from: its public suffix, its registered domain (one label more), and itself.

    User and port do not count for the first two; an address of numbers is its own suffix and domain.
    """
    site = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    numbers, last_two = site.rlike(r"^([0-9.]+|\[.*)$"), F.substring_index(site, ".", -2)
    two = last_two.isin(TWO_LABEL_SUFFIXES)
    return {
        "suffix": F.when(numbers, site).when(two, last_two).otherwise(F.substring_index(site, ".", -1)),
        "domain": F.when(numbers, site).when(two, F.substring_index(site, ".", -3)).otherwise(last_two), "host": host,
    }


def _strength(counts: DataFrame, least: float, most: float) -> DataFrame:
    """One row ``strength``: how many observations the prior of this level is worth, by the method of moments.

    For groups of n labelled pages with x bad ones, the spread of x / n beyond what chance gives is the correlation
    within groups; its inverse less one is the strength. Without spread, or with one group, the prior is worth ``most``.
    """
    sums = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count(F.when(F.col("n") > 0, 1)).alias("k"),
        F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).alias("n2"), F.coalesce(F.sum(F.try_divide(F.col("bad") * F.col("bad"), F.col("n").cast("double"))), F.lit(0.0)).alias("x2"),
    )
    p = F.try_divide(F.col("bad").cast("double"), F.col("n"))
    spread = F.col("x2") - F.col("bad") * p  # sum of n (x/n - p)^2
    free = F.col("n") - F.try_divide(F.col("n2").cast("double"), F.col("n")) - (F.col("k") - 1)
    rho = F.when((F.col("n") > 0) & (p > 0) & (p < 1) & (free > 0), F.try_divide(F.try_divide(spread, p * (1 - p)) - (F.col("k") - 1), free))
    bounded = F.greatest(F.lit(1 / (most + 1)), F.least(F.coalesce(rho, F.lit(0.0)), F.lit(1 / (least + 1))))
    return sums.select((1 / bounded - 1).alias("strength"), F.coalesce(p, F.lit(0.5)).alias("mean"))


def host_reputation(outcomes: DataFrame, z: float = 1.645, least: float = 1.0, most: float = 1000.0) -> DataFrame:
    """Posterior share of bad pages per host from (host, bad), where bad is 0, 1 or null (not labelled).

    Counts are taken per host, then per registered domain and public suffix (see ``level_names``). The mean of all
    pages is the prior of a suffix, the posterior mean of a suffix the prior of its domains, and that of a domain the
    prior of its hosts; each level has its own strength. Where hosts differ no more than chance makes them, as in the given tables, the prior is worth
    ``most`` pages and no host stands out; where they do, a few bad pages of a bad host are enough. Returns host, suffix, domain, n, bad, prior, mean and ``bound``,
    the mean less ``z`` standard deviations. Hosts without labels get the mean of their domain. A host of half of all
    pages is counted in parts before the shuffle. An empty table gives no rows.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    hosts = cut_lineage(hosts.select("host", "n", "bad", *[c.alias(k) for k, c in level_names(F.col("host")).items() if k != "host"]))
    parent, parent_key = None, None
    for level in LEVELS:
        above = {"suffix": [], "domain": ["suffix"], "host": ["suffix", "domain"]}[level]
        counts = hosts if level == "host" else hosts.groupBy(level, *above).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        strength, mean = _strength(counts, least, most).first()  # two numbers of the whole level
        if parent is None:
            joined = counts.withColumn("prior", F.lit(mean))
        else:
            joined = counts.join(parent.select(parent_key, F.col("posterior").alias("prior")), parent_key)
        total = F.col("n") + F.lit(strength)
        parent = joined.withColumn("posterior", (F.col("bad") + strength * F.col("prior")) / total).withColumn("weight", total)
        parent_key = level
    sd = F.sqrt(F.col("posterior") * (1 - F.col("posterior")) / (F.col("weight") + 1))
    return parent.select("host", "suffix", "domain", "n", "bad", "prior", F.col("posterior").alias("mean"), (F.col("posterior") - z * sd).alias("bound"))


def url_verdicts(
    pages: DataFrame, outcomes: DataFrame, rules: list[Rule], max_bad: float, id_column: str = "page_id", url_column: str = "url", z: float = 1.645,
) -> DataFrame:
    """Allow or block every url: the longest fitting rule decides, else the host's reputation.

    ``outcomes`` has the labelled results (id_column, bad 0/1), at most one per id; pages without one still give their
    host a row. An url is blocked when the lower bound of its host's share of bad pages exceeds ``max_bad``. Null or odd urls belong
    to the empty host. Returns the id, host, path, rule, verdict, n_labelled, n_bad and bad_bound; repeated rows are kept.
    """
    host, path = url_parts(F.col(url_column))
    parts = pages.select(F.col(id_column).alias("id"), host.alias("host"), path.alias("path"))
    known = outcomes.select(F.col(id_column).alias("id"), "bad").groupBy("id").agg(F.max("bad").alias("bad"))
    labelled = parts.join(known, "id", "left").select("host", "bad")
    reputation = host_reputation(labelled, z).select("host", "n", "bad", "bound")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("bound") > max_bad, F.lit("block")).otherwise(F.lit("allow"))
    return parts.join(reputation, "host", "left").select(
        F.col("id").alias(id_column), "host", "path", name.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"),
        F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), F.round("bound", 6).alias("bad_bound"),
    )
