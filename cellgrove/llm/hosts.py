"""URL filters: rules by host and path, and empirical-Bayes reputation of hosts for the rest.

Labelled page outcomes (1: bad) are counted by host. A beta-binomial prior carries the rate from all hosts
to the suffix, from the suffix to the registered domain and from the domain to the host; the prior's
strength at each level is estimated from how far the groups' rates spread (method of moments). A host is
blocked if the lower bound of its posterior, mean - z * deviation, exceeds ``threshold``.

Everything is DataFrame expressions. A null url, or one without ``://``, has empty host and path, fits no
rule and takes the verdict of the empty host. Hosts without outcomes have their domain's posterior; without
any outcome at all the rate is ``default_rate``. Repeated pages and outcomes count as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.common import col, stage

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
# Common public suffixes of two labels, under which everyone may register a name.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "co.in", "co.jp", "co.kr", "co.nz", "co.za",
    "blogspot.com", "github.io", "gitlab.io", "netlify.app", "pages.dev", "herokuapp.com",
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + F.lit(3), F.length(url)))


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or # (or the end), A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or # (or the end)."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_of(host: Column) -> Column:
    """The registered domain: the public suffix and the label before it."""
    return F.when(F.substring_index(host, ".", -2).isin(*SUFFIXES), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def suffix_of(host: Column) -> Column:
    """The public suffix: one of SUFFIXES, else the last label."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def _strength(groups: DataFrame, by: list[str]) -> DataFrame:
    """Prior strength for the children of each parent: n, k by child; method of moments for the beta-binomial."""
    total = groups.groupBy(*by).agg(F.sum("n").alias("nn"), F.sum("k").alias("kk"), F.count("*").alias("g"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("k2n"))
    p = F.col("kk") / F.col("nn")
    spread = F.col("k2n") - F.col("nn") * p * p
    room = F.col("nn") - F.col("n2") / F.col("nn") - (F.col("g") - 1)
    rho = F.when((p > 0) & (p < 1) & (F.col("g") > 1) & (room > 0), (spread / (p * (1 - p)) - (F.col("g") - 1)) / room)
    return total.select(*by, (1 / F.least(F.greatest(F.coalesce(rho, F.lit(0.01)), F.lit(0.001)), F.lit(0.9)) - 1).alias("strength"))


def reputation(outcomes: DataFrame, url_col: str = "url", bad_col: str = "bad", default_rate: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Posterior alpha and beta by host, by domain and by suffix ('' is the whole): three small tables of counts."""
    spark = outcomes.sparkSession
    rows = outcomes.where(col(bad_col).isNotNull()).select(host_of(col(url_col)).alias("host"), col(bad_col).cast("long").alias("bad"))
    hosts = stage(rows.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("k")).select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "k"), "hosts-counts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    whole = hosts.agg(F.coalesce(F.sum("k") / F.sum("n"), F.lit(default_rate)).alias("rate"))
    all_strength = F.coalesce(F.col("strength"), F.lit(99.0))
    top = suffixes.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(_strength(suffixes, [])))  # two one-row tables
    suffix = top.select("suffix", (F.col("k") + all_strength * F.col("rate")).alias("alpha"), (F.col("n") - F.col("k") + all_strength * (1 - F.col("rate"))).alias("beta"))
    suffix = suffix.unionByName(whole.select(F.lit(None).cast("string").alias("suffix"), (F.col("rate") * 99).alias("alpha"), ((1 - F.col("rate")) * 99).alias("beta")))
    suffix = stage(suffix, "hosts-suffix")
    rate = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    up = suffix.where(F.col("suffix").isNotNull()).select("suffix", rate.alias("rate"))
    strength = F.coalesce(F.col("strength"), F.lit(99.0))
    domain = stage(domains.join(up, "suffix").join(_strength(domains, ["suffix"]), "suffix", "left").select("domain", (F.col("k") + strength * F.col("rate")).alias("alpha"), (F.col("n") - F.col("k") + strength * (1 - F.col("rate"))).alias("beta")), "hosts-domain")
    above = domain.select("domain", rate.alias("rate"))
    host = stage(hosts.join(above, "domain").join(_strength(hosts, ["domain"]), "domain", "left").select("host", (F.col("k") + strength * F.col("rate")).alias("alpha"), (F.col("n") - F.col("k") + strength * (1 - F.col("rate"))).alias("beta")), "hosts-host")
    return host, domain, suffix


def _lower_bound(alpha: Column, beta: Column, z: float) -> Column:
    s = alpha + beta
    return alpha / s - F.lit(z) * F.sqrt(alpha * beta / (s * s * (s + 1)))


def apply_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule (its host and path) and rule_verdict to rows with host and path: the longest fitting rule wins.

    rules: a bounded list of (allow or block, host, path); a rule fits its host and all subdomains, if the
    path starts with the rule's. Of equally long rules the one with the longer host wins, then block.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "block")):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return pages.withColumn("rule", name).withColumn("rule_verdict", verdict)


def judge(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, threshold: float = 0.25, z: float = 1.645) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, and risk (the posterior's lower bound for its host)."""
    rows = apply_rules(pages.select(col(id_col).alias(id_col), host_of(col(url_col)).alias("host"), path_of(col(url_col)).alias("path")), rules)
    host, domain, suffix = reputation(outcomes, url_col)
    seen = stage(rows.groupBy("host").agg(F.count("*").alias("pages")), "hosts-seen")
    risk = seen.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
    risk = risk.join(host, "host", "left")
    for level, key in ((domain, "domain"), (suffix.where(F.col("suffix").isNotNull()), "suffix")):
        risk = risk.join(level.select(key, F.col("alpha").alias("a2"), F.col("beta").alias("b2")), key, "left")
        risk = risk.select("host", "domain", "suffix", F.coalesce("alpha", "a2").alias("alpha"), F.coalesce("beta", "b2").alias("beta"))
    whole = suffix.where(F.col("suffix").isNull()).select(F.col("alpha").alias("a2"), F.col("beta").alias("b2"))  # one row
    risk = risk.crossJoin(F.broadcast(whole)).select("host", _lower_bound(F.coalesce("alpha", "a2"), F.coalesce("beta", "b2"), z).alias("risk"))
    out = rows.join(stage(risk, "hosts-risk"), "host", "left")
    verdict = F.coalesce(F.col("rule_verdict"), F.when(F.col("risk") > threshold, "block").otherwise("allow"))
    return out.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "risk")
