"""URL filter: rules first, then the reputation of the host.

A page that a rule judges is a labelled outcome. Counts of such outcomes go up from host to registered domain to suffix
to all pages; estimates come down the same way: each level is a beta-binomial whose prior is the estimate of the level
above, with a strength that the spread between its groups gives (method of moments). A page that no rule fits is
blocked if the lower bound of its host's posterior rate of blocked pages exceeds one half.

The registered domain is the label before the suffix and the suffix. A suffix is one label, or two where a country's
last label follows a usual second-level name (co.uk, gov.au) or under a few private ones that give names to strangers.
User names and ports do not count in it; addresses are their own domains, under one suffix.

Null urls and urls without "://" have an empty host and path and share the reputation of the empty host, which is allowed
unless there is evidence against it. Of rules that tie in length the first by text holds. Urls of any length are read as
a whole. An empty table gives an empty result; repeated rows each give a row; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Saved, ascii_lower


@dataclass(frozen=True)
class Rule:
    verdict: str
    prefix: str  # host and path, as in example.org/es/

    @property
    def host(self) -> str:
        return self.prefix.partition("/")[0]

    @property
    def path(self) -> str:
        host, slash, rest = self.prefix.partition("/")
        return slash + rest


RULES = (Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/"))
#: Names that countries register under, and private suffixes.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
PRIVATE = ("blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "vercel.app", "web.app", "wordpress.com")
ADDRESS = r"^([0-9.]+|\[.*)$"
LEVELS = ("suffix", "domain", "host")


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    found = None
    for rule in sorted(rules, key=lambda r: (-len(r.prefix), r.prefix)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = (F if found is None else found).when(fits, F.lit(rule.prefix))
    return found if found is not None else F.lit(None).cast("string")


def name_of(host: Column) -> Column:
    """The host without user name and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def two_labels(names=SECOND_LEVEL, private=PRIVATE) -> str:
    """A pattern for the end of a name whose suffix has two labels."""
    return rf"(^|\.)(({'|'.join(names)})\.[a-z][a-z]|{'|'.join(p.replace('.', '[.]') for p in private)})$"


def suffix_of(name: Column, two: str) -> Column:
    one = F.substring_index(name, ".", -1)
    return F.when(name.rlike(ADDRESS), F.lit("address")).otherwise(F.when(name.rlike(two), F.substring_index(name, ".", -2)).otherwise(one))


def domain_of(name: Column, two: str) -> Column:
    shorter = F.when(name.rlike(two), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    return F.when(name.rlike(ADDRESS), name).otherwise(shorter)


def reputations(hosts: DataFrame, saved: Saved, z: float) -> DataFrame:
    """(host, mean, low) from (host, domain, suffix, n, k): k of n labelled pages are blocked; all hosts have a row."""
    total = hosts.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1.0)).alias("above"))
    top = None
    for level in LEVELS:
        key = list(LEVELS[: LEVELS.index(level) + 1])
        groups = hosts.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        joined = groups.withColumn("above", total.scalar()) if top is None else groups.join(top.select(*key[:-1], "above"), key[:-1])
        # Spread between groups, over all groups that have labelled pages: one row
        p = F.col("above")
        spread = joined.where("n > 0").agg(
            F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - p, 2) / (p * (1 - p))).alias("s"), F.sum("n").alias("rows"), F.count("*").alias("groups")
        )
        share = F.col("groups") / F.col("rows")
        rho = F.when(F.coalesce("rows", F.lit(0)) <= F.col("groups"), F.lit(0.5)).otherwise(F.least(F.lit(0.99), F.greatest(F.lit(0.01), (F.col("s") / F.col("rows") - share) / (1 - share))))
        joined = joined.withColumn("m", spread.select((1 / rho - 1).alias("m")).scalar())
        a, b = F.col("k") + F.col("m") * p, F.col("n") - F.col("k") + F.col("m") * (1 - p)
        top = saved.put(joined.select(*key, a.alias("a"), b.alias("b"), (a / (a + b)).alias("above")), level)  # each level is used twice
    a, b, mean = F.col("a"), F.col("b"), F.col("above")
    return top.select("host", mean.alias("mean"), (mean - z * F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))).alias("low"))


def judge_pages(pages: DataFrame, saved: Saved, id_col: str = "page_id", url_col: str = "url", rules=RULES, z: float = 1.0, most: float = 0.5) -> DataFrame:
    """One row for each row of pages: id, host, path, rule (or null), verdict ("allow" or "block")."""
    page = pages.select(F.col(id_col), F.col(url_col).alias("_url")).select(id_col, host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    page = page.select(id_col, F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    page = page.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("rule"))
    by_rule = None
    for rule in rules:
        by_rule = (F if by_rule is None else by_rule).when(F.col("rule") == rule.prefix, F.lit(rule.verdict))
    page = page.select("*", (by_rule if by_rule is not None else F.lit(None).cast("string")).alias("_said"))
    counts = page.groupBy("host").agg(F.count("_said").alias("n"), F.count(F.when(F.col("_said") == "block", 1)).alias("k"))
    name, two = name_of(F.col("host")), two_labels()
    hosts = counts.select("host", domain_of(name, two).alias("domain"), suffix_of(name, two).alias("suffix"), "n", "k")
    known = reputations(saved.put(hosts, "hosts"), saved, z).select("host", (F.col("low") > most).alias("_bad"))
    judged = page.join(known, "host", "left")
    return judged.select(id_col, "host", "path", "rule", F.coalesce("_said", F.when(F.col("_bad"), "block").otherwise("allow")).alias("verdict"))
