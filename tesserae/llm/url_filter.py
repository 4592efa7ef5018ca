"""URL filters: empirical-Bayes reputation of hosts by beta-binomial priors from suffix to domain to host.

Labelled pages give each host bad and good outcomes. A suffix's rate shrinks to the rate of all, a registered domain's
to its suffix's, a host's to its domain's; how hard, the outcomes themselves say, by the method of moments at each
level. A page passes if the upper bound of its host's posterior bad rate is low enough. Everything is aggregates and
joins of distinct hosts; level tables join by key, and only four numbers pass through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.session import written

#: Suffixes of two labels; every other suffix is the last label.
DOUBLE = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "com.br", "co.in", "co.nz", "com.cn", "com.mx", "co.kr", "co.za", "com.tr")
MOST_BAD = 0.4
Z = 1.645
#: Hosts of more than one page in HOT go to all executors with their verdicts.
HOT = 1000
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 10_000.0
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; null where there is none."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(host != "", host)


@dataclass(frozen=True)
class Suffixes:
    """Rules of a public suffix list: names, wildcards (the part behind "*.") and exceptions (the part behind "!")."""

    names: frozenset[str]
    wild: frozenset[str]
    never: frozenset[str]


def read_suffixes(path: str) -> Suffixes:
    """The rules of a file in the form of the public suffix list: one a line, // before remarks."""
    with open(path, encoding="utf-8") as f:
        rules = [line.split()[0].lower() for line in f if line.strip() and not line.startswith("//")]
    names = frozenset(r for r in rules if not r.startswith(("!", "*.")))
    return Suffixes(names, frozenset(r[2:] for r in rules if r.startswith("*.")), frozenset(r[1:] for r in rules if r.startswith("!")))


def levels(host: Column, double: tuple[str, ...] | Suffixes = DOUBLE) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host; a host of digits and dots is its own domain of the suffix ip.

    With rules the longest that fits is taken, an exception before all, and a host that none fits has its last label.
    """
    number = host.rlike(r"^[0-9.]+$")
    if not isinstance(double, Suffixes):
        two = F.substring_index(host, ".", -2)
        suffix = F.when(number, F.lit("ip")).when(two.isin(*double), two).otherwise(F.substring_index(host, ".", -1))
        domain = F.when(number, host).when(two.isin(*double), F.substring_index(host, ".", -3)).otherwise(two)
        return domain, suffix
    tail = {k: F.substring_index(host, ".", -k) for k in range(1, 7)}

    def among(k: int, rules: frozenset[str]) -> Column:
        some = sorted(r for r in rules if r.count(".") == k - 1)
        return tail[k].isin(*some) if some else F.lit(False)

    suffix, domain = F.when(number, F.lit("ip")), F.when(number, host)
    for k in range(5, 0, -1):  # an exception's suffix is what follows its first label
        suffix, domain = suffix.when(among(k, double.never), tail[max(1, k - 1)]), domain.when(among(k, double.never), tail[k])
    for k in range(5, 0, -1):
        fits = among(k, double.names) | (among(k - 1, double.wild) if k > 1 else F.lit(False))
        suffix, domain = suffix.when(fits, tail[k]), domain.when(fits, tail[k + 1])
    return domain.otherwise(tail[2]), suffix.otherwise(tail[1])


def strength(groups: DataFrame, name: str) -> DataFrame:
    """One row: how many outcomes the prior of a level is worth, from groups (k bad of n, prior mean)."""
    v = F.col("prior") * (1 - F.col("prior"))
    q = F.sum(F.pow(F.col("k") - F.col("n") * F.col("prior"), F.lit(2.0)) / F.col("n"))
    share = (q - F.sum(v)) / F.sum(v * (F.col("n") - 1))
    low, high = 1 / (1 + MOST_STRENGTH), 1 / (1 + LEAST_STRENGTH)
    clipped = F.least(F.greatest(F.coalesce(share, F.lit(low)), F.lit(low)), F.lit(high))
    return groups.agg((1 / clipped - 1).alias(name))


def reputations(outcomes: DataFrame, double: tuple[str, ...] | Suffixes = DOUBLE) -> tuple[DataFrame, dict[str, float]]:
    """A table (level, name, k, n, mean) of all suffixes, domains and hosts with outcomes (url, bad), and the rate of all with
    the strengths m0, m1, m2 of the three levels.

    mean is the posterior mean of a suffix or domain, and the prior mean of a host. Null urls and outcomes, and urls
    without a host, are left out. Repeated rows count each. Hosts are counted in one pass over the outcomes and written;
    all else reads that table, and only four numbers come to the driver.
    """
    host = host_of(F.col("url"))
    seen = outcomes.select(host.alias("host"), F.col("bad").cast("double").alias("bad")).dropna()
    hosts = seen.groupBy("host").agg(F.sum("bad").alias("k"), F.count(F.lit(1)).cast("double").alias("n"))
    domain, suffix = levels(F.col("host"), double)
    hosts = written(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    domains = written(hosts.groupBy("domain", "suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    k, n = domains.agg(F.coalesce(F.sum("k"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0.0))).first()
    rate = (k + 1) / (n + 2)

    def mean(m: float) -> Column:
        return ((F.col("k") + F.lit(m) * F.col("prior")) / (F.col("n") + F.lit(m))).alias("mean")

    suffixes = suffixes.withColumn("prior", F.lit(rate))
    m0 = strength(suffixes, "m").first()[0]
    suffixes = written(suffixes.select("suffix", "k", "n", mean(m0)), "suffixes")
    domains = domains.join(suffixes.select("suffix", F.col("mean").alias("prior")), "suffix")
    m1 = strength(domains, "m").first()[0]
    domains = written(domains.select("domain", "k", "n", mean(m1)), "domain-means")
    hosts = hosts.join(domains.select("domain", F.col("mean").alias("prior")), "domain").select("host", "k", "n", "prior")
    m2 = strength(hosts, "m").first()[0]
    every = [t.select(F.lit(level).alias("level"), F.col(t.columns[0]).alias("name"), "k", "n", F.col(t.columns[3]).alias("mean")) for level, t in enumerate((suffixes, domains, hosts))]
    return every[0].unionByName(every[1]).unionByName(every[2]), {"rate": rate, "m0": m0, "m1": m1, "m2": m2}


def scored_urls(pages: DataFrame, outcomes: DataFrame, most_bad: float = MOST_BAD, z: float = Z, double: tuple[str, ...] | Suffixes = DOUBLE) -> DataFrame:
    """(page_id, host, n_labelled, bad_rate, upper, keep) of every row of pages (page_id, url).

    bad_rate and upper are the mean and the bound of the posterior of the host's bad rate, rounded to 6 places; a
    host without outcomes has its domain's, or its suffix's, or all hosts' rate for a prior. keep: upper is at most
    `most_bad`. A null url, or one without a host, is judged by the rate of all. Repeated rows are judged each. Without
    outcomes the rate of all is 0.5. Other columns are not read. `double` names the public suffixes of more than one
    label, or is a `read_suffixes` of a list with wildcards and exceptions.

    Each distinct host is judged once; pages meet the verdicts by host. Hosts of more than one page in HOT, of which
    there are at most HOT, are sent to all executors, so none of them makes a large partition.
    """
    table, r = reputations(outcomes, double)
    p = written(pages.select("page_id", host_of(F.col("url")).alias("host")), "page-hosts")
    domain, suffix = levels(F.col("host"), double)
    asked = p.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter("host is not null").withColumns({"domain": domain, "suffix": suffix})
    for level, name in enumerate(("suffix", "domain", "host")):
        found = table.filter(F.col("level") == level).select(F.col("name").alias(name), F.col("mean").alias(f"{name}_mean"), *((F.col("k"), F.col("n")) if name == "host" else ()))
        asked = asked.join(found, name, "left")
    prior = F.coalesce("domain_mean", "suffix_mean", F.lit(r["rate"]))
    verdicts = asked.select("host", "pages", F.coalesce("k", F.lit(0.0)).alias("k"), F.coalesce("n", F.lit(0.0)).alias("n"), prior.alias("prior"))
    verdicts = written(verdicts, "host-verdicts")
    hot = F.col("pages") * HOT > F.lit(p.count())
    few = verdicts.filter(hot).drop("pages")
    many = verdicts.filter(~hot).drop("pages")
    often = F.broadcast(few.select(F.col("host").alias("hot_host")))
    rare = p.join(often, F.col("host") == F.col("hot_host"), "left_anti").filter("host is not null").join(many, "host", "left")
    nowhere = p.filter("host is null").select("page_id", "host", F.lit(0.0).alias("k"), F.lit(0.0).alias("n"), F.lit(r["rate"]).alias("prior"))
    columns = ("page_id", "host", "k", "n", "prior")
    every = p.join(F.broadcast(few), "host").select(*columns).unionByName(rare.select(*columns)).unionByName(nowhere)
    total = F.col("n") + F.lit(r["m2"])
    mean = (F.col("k") + F.lit(r["m2"]) * F.col("prior")) / total
    upper = mean + z * F.sqrt(mean * (1 - mean) / (total + 1))
    out = every.select("page_id", "host", F.col("n").cast("long").alias("n_labelled"), F.round(mean, 6).alias("bad_rate"), F.round(upper, 6).alias("upper"))
    return out.withColumn("keep", F.col("upper") <= most_bad)


SQL = r"""
WITH l AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
p AS (SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host,
  TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)[^/]*/?(?:[?#].*)?$', 1), '') AS BIGINT) AS doc_id FROM pages),
q AS (SELECT *, CASE WHEN regexp_full_match(host, '[0-9.]+') THEN 'ip' WHEN tail IN ({double}) THEN tail ELSE regexp_extract(host, '([^.]*)$', 1) END AS suffix,
  CASE WHEN regexp_full_match(host, '[0-9.]+') THEN host WHEN tail IN ({double}) THEN regexp_extract(host, '((?:[^.]*\.)?(?:[^.]*\.)?[^.]*)$', 1) ELSE tail END AS domain
  FROM (SELECT *, regexp_extract(host, '((?:[^.]*\.)?[^.]*)$', 1) AS tail FROM p)),
h AS (SELECT host, domain, suffix, sum(bad)::DOUBLE AS k, count(*)::DOUBLE AS n FROM q JOIN l USING (doc_id) WHERE host IS NOT NULL GROUP BY ALL),
e AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS rate FROM h),
s AS (SELECT suffix, sum(k) AS k, sum(n) AS n, any_value(rate) AS prior FROM h, e GROUP BY suffix),
m0 AS (SELECT 1 / least(greatest(coalesce((sum((k - n * prior) ** 2 / n) - sum(prior * (1 - prior))) / nullif(sum(prior * (1 - prior) * (n - 1)), 0), {low}), {low}), {high}) - 1 AS m FROM s),
sm AS (SELECT suffix, (k + m * prior) / (n + m) AS suffix_mean FROM s, m0),
d AS (SELECT domain, sum(k) AS k, sum(n) AS n, any_value(suffix_mean) AS prior FROM h JOIN sm USING (suffix) GROUP BY domain),
m1 AS (SELECT 1 / least(greatest(coalesce((sum((k - n * prior) ** 2 / n) - sum(prior * (1 - prior))) / nullif(sum(prior * (1 - prior) * (n - 1)), 0), {low}), {low}), {high}) - 1 AS m FROM d),
dm AS (SELECT domain, (k + m * prior) / (n + m) AS domain_mean FROM d, m1),
hh AS (SELECT host, k, n, domain_mean AS prior FROM h JOIN dm USING (domain)),
m2 AS (SELECT 1 / least(greatest(coalesce((sum((k - n * prior) ** 2 / n) - sum(prior * (1 - prior))) / nullif(sum(prior * (1 - prior) * (n - 1)), 0), {low}), {low}), {high}) - 1 AS m FROM hh),
r AS (SELECT page_id, q.host, coalesce(hh.n, 0) AS n, (coalesce(hh.k, 0) + m * coalesce(domain_mean, suffix_mean, rate)) / (coalesce(hh.n, 0) + m) AS mean, m
  FROM q CROSS JOIN e CROSS JOIN m2 LEFT JOIN sm ON q.suffix = sm.suffix LEFT JOIN dm ON q.domain = dm.domain LEFT JOIN hh ON q.host = hh.host)
SELECT page_id, host, n::BIGINT AS n_labelled, round(mean, 6) AS bad_rate, round(mean + {z} * sqrt(mean * (1 - mean) / (n + m + 1)), 6) AS upper,
  round(mean + {z} * sqrt(mean * (1 - mean) / (n + m + 1)), 6) <= {most} AS keep FROM r
"""


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of the pages whose url ends in the number of a labelled document; bad: of low quality, or toxic."""
    number = F.expr(r"try_cast(nullif(regexp_extract(url, '/([0-9]+)[^/]*/?(?:[?#].*)?$', 1), '') AS BIGINT)")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("number")).agg(F.max(bad).alias("bad"))
    return pages.select("url", number.alias("number")).join(known, "number").select("url", "bad")


def sql() -> str:
    """DuckDB SQL of scored_urls(pages, page_outcomes(pages, labels))."""
    double = ", ".join(f"'{x}'" for x in DOUBLE)
    for name, value in (("double", double), ("low", repr(1 / (1 + MOST_STRENGTH))), ("high", repr(1 / (1 + LEAST_STRENGTH))), ("z", repr(Z)), ("most", repr(MOST_BAD))):
        filled = SQL if name == "double" else filled
        filled = filled.replace("{" + name + "}", value)
    return filled
