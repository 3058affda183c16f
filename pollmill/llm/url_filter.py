"""URL filters: listed rules, and for the rest an empirical-Bayes reputation of the host.

Rules name a host and the start of a path and fit the host and its subdomains; the longest that fits decides. Other pages are judged
by their host's rate of bad pages. Labelled outcomes are counted per host, registered domain and suffix. At each of the three levels
the groups are beta-binomial around the posterior mean of their parent (a suffix around the rate of all outcomes); how many
outcomes the parent counts for comes from the groups' own spread by the method of moments. A host is blocked if the lower bound of
its posterior, mean - z * standard deviation of the beta distribution, is above `limit`: a host with few outcomes falls back on its
domain, and a domain on its suffix. DataFrame functions only.

Counts are partial aggregates; a host or domain that a third of all rows share is looked up by a broadcast of at most 1,024 rows
(`skew.lookup`), the others by shuffle. The host is what stands between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased;
a user name, a port and a final dot count for rules, not for reputation. Null urls and urls without `://` have an empty host and path: they
are one host for reputation. An IP address is its own domain, of the suffix "ip". Outcomes without a page, of a null key, or with a null verdict
don't count; several outcomes of a key: bad if any is. Without any outcome nothing is blocked but by rule. Repeated rows count each. Empty pages
give an empty result. Columns of pages named like the result stay: the result's name gets underscores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pollmill.operators.skew import lookup

from .common import fresh, stored

#: (verdict, rule as host and start of the path)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Suffixes of two labels; a caller passes the list that it keeps.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "com.br", "co.nz", "co.za", "com.cn", "co.in", "co.kr", "com.mx", "com.tr")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A parent counts for 1 to 10,000 outcomes.
LEAST_SPREAD, MOST_SPREAD = 1 / 10_001, 1 / 2


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url.cast("string"), r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url.cast("string"), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null; of equal lengths the one with the longer host."""
    ranked = sorted(rules, key=lambda r: (-len(r[1]), -r[1].index("/")))
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in reversed(ranked):
        name, start = rule[:rule.index("/")], rule[rule.index("/"):]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def places(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column, Column]:
    """(name, registered domain, suffix) of a host."""
    name = F.regexp_extract(host, r"(?s)^(?:.*@)?(.*?)\.?(?::[0-9]*)?$", 1)
    labels = F.split(name, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    two = last(2).isin(*suffixes)
    address = name.rlike(r"^([0-9.]+|\[.*)$")
    return name, F.when(address, name).when(two, last(3)).otherwise(last(2)), F.when(address, "ip").when(two, last(2)).otherwise(last(1))


def spread(groups: DataFrame, mean: str) -> float:
    """The share of variance between groups (n, bad) around their parents' means, by moments, within its bounds."""
    m, n, k = F.col(mean), F.col("n"), F.col("bad")
    own = n * m * (F.lit(1.0) - m)
    extra, most = groups.where(n > 0).agg(F.sum((k - n * m) * (k - n * m) - own), F.sum((n - 1) * own)).first()
    return min(MOST_SPREAD, max(LEAST_SPREAD, extra / most)) if most else MOST_SPREAD


def shrunk(groups: DataFrame, mean: str, out: str) -> DataFrame:
    """groups (n, bad) with the posterior's two parameters and its mean `out`."""
    rho = spread(groups, mean)
    weight = F.lit(1 / rho - 1)
    posterior = groups.withColumns({"a": F.col("bad") + weight * F.col(mean), "b": F.col("n") - F.col("bad") + weight * (F.lit(1.0) - F.col(mean))})
    return posterior.withColumn(out, F.col("a") / (F.col("a") + F.col("b")))


def reputation(outcomes: DataFrame, z: float = 1.6448536269514722) -> DataFrame:
    """(name, n, bad, mean, low) of hosts from their counts (name, domain, suffix, n, bad); low and mean are null without any outcome."""
    hosts = stored(outcomes, "hosts")
    total = F.sum("n"), F.sum("bad")
    domains = stored(hosts.groupBy("domain", "suffix").agg(total[0].alias("n"), total[1].alias("bad")), "domains")
    suffixes = domains.groupBy("suffix").agg(total[0].alias("n"), total[1].alias("bad"))
    n, bad = domains.agg(*total).first()
    if not n:
        return hosts.select("name", "n", "bad", F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("low"))
    top = shrunk(suffixes.withColumn("all_mean", F.lit(bad / n)), "all_mean", "suffix_mean").select("suffix", "suffix_mean")
    middle = shrunk(lookup(domains, stored(top, "suffixes"), ["suffix"]), "suffix_mean", "domain_mean").select("domain", "suffix", "domain_mean")
    best = shrunk(lookup(hosts, stored(middle, "domain_means"), ["domain", "suffix"]), "domain_mean", "mean")
    size = F.col("a") + F.col("b")
    low = F.greatest(F.lit(0.0), F.col("mean") - F.lit(z) * F.sqrt(F.col("a") * F.col("b") / (size * size * (size + 1))))
    return best.select("name", "n", "bad", "mean", low.alias("low"))


def judge(pages: DataFrame, outcomes: DataFrame, url: str = "url", key: Column | str = "page_id", rules: Sequence[tuple[str, str]] = RULES, limit: float = 0.5,
          suffixes: Sequence[str] = SUFFIXES, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """(pages' columns `keep` and a struct: host, path, rule, verdict (allow or block), n_outcomes, n_bad, mean, low of the host; its name).

    outcomes: (key, bad) of labelled pages; `key` names or makes the matching value of a page.
    """
    out, own, ref = fresh(pages, "url_verdict"), fresh(pages, "page_host"), fresh(pages, "page_ref")
    keep = pages.columns if keep is None else keep
    where, path = host_of(F.col(f"`{url}`")), path_of(F.col(f"`{url}`"))
    name, domain, suffix = places(where, suffixes)
    rows = stored(pages.select(*(F.col(f"`{c}`") for c in keep), (F.col(f"`{key}`") if isinstance(key, str) else key).alias(ref), name.alias(own),
                               F.struct(where.alias("host"), path.alias("path"), domain.alias("domain"), suffix.alias("suffix")).alias(out)), "pages")
    seen = rows.groupBy(F.col(own).alias("name"), F.col(f"`{out}`.domain").alias("domain"), F.col(f"`{out}`.suffix").alias("suffix"), F.col(ref).alias("key")).agg(F.count("*").alias("pages"))
    known = outcomes.where("key IS NOT NULL AND bad IS NOT NULL").groupBy("key").agg(F.max(F.col("bad").cast("boolean")).alias("bad"))
    # pages of one key are one row by now; those without a key have no outcome
    found = seen.where("key IS NOT NULL").join(known, "key").select("name", "domain", "suffix", F.col("pages").alias("n"), F.when(F.col("bad"), F.col("pages")).otherwise(0).alias("bad"))
    every = seen.groupBy("name", "domain", "suffix").agg(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"))
    hosts = found.unionByName(every).groupBy("name", "domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    known_hosts = stored(reputation(hosts).select(F.col("name").alias(own), F.struct("n", "bad", "mean", "low").alias(fresh(rows, "known"))), "reputation")
    judged = lookup(rows, known_hosts, [own])
    k = known_hosts.columns[1]
    rule = rule_of(F.col(f"`{out}`.host"), F.col(f"`{out}`.path"), rules)
    by_host = F.when(F.col(f"`{k}`.low") > limit, "block").otherwise("allow")
    made = F.struct(F.col(f"`{out}`.host").alias("host"), F.col(f"`{out}`.path").alias("path"), rule["rule"].alias("rule"), F.coalesce(rule["verdict"], by_host).alias("verdict"),
                    F.col(f"`{k}`.n").alias("n_outcomes"), F.col(f"`{k}`.bad").alias("n_bad"), F.col(f"`{k}`.mean").alias("mean"), F.col(f"`{k}`.low").alias("low"))
    return judged.select(*(F.col(f"`{c}`") for c in keep), made.alias(out)), out


def allowed(pages: DataFrame, outcomes: DataFrame, **options) -> DataFrame:
    """The rows of pages that are not blocked, all columns as they are."""
    rows, out = judge(pages, outcomes, **options)
    return rows.where(F.col(f"`{out}`.verdict") == "allow").select(*(F.col(f"`{c}`") for c in pages.columns))
