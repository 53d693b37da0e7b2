"""URL filter: explicit rules first, then an empirical-Bayes host reputation.

A page of which the rules say nothing is judged by its host.  Labelled page
outcomes (bad or not) are shrunk through three beta-binomial levels: the rate
of a suffix (``com``) towards the overall rate, the rate of a registered
domain (``example.com``: the suffix and one label more) towards its suffix, and the rate of a host towards its
registered domain.  The strength of each prior is estimated from all the
groups of its level by moments.  A host is blocked if the lower posterior
bound ``mean - z * sd`` of its bad rate is above the limit, so a host with few
labelled pages isn't blocked for one of them.

Only built-in expressions.  Counts are pre-aggregated before their shuffle, so
a host with a third of all pages is no hot key; the reputation table is joined
as the optimizer sees fit (by broadcast under its size threshold, else by a
sort-merge join whose skewed partitions are split).

Defined results: a null url or one without ``://`` has empty host and path, no
rule, and gets the verdict of the empty host, which never has outcomes of its
own: allow.  Hosts without labelled pages get their domain's posterior.
Repeated rows are judged alike, each once.  Null labels count as no outcome.
Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import shared_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Strengths (pseudo-counts) of the priors stay in this range.
STRENGTH_RANGE = (2.0, 500.0)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL_PATTERN, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PATTERN, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) by the longest (verdict, rule) that fits, or nulls; of equal rules the first counts."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        at, _, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


#: Public suffixes of more than one label under which anybody registers; a list of the user's takes their place.
SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "ac.jp", "co.kr", "co.in", "com.br", "com.cn", "com.tw", "com.hk", "com.sg",
    "com.mx", "com.ar", "com.tr", "co.za", "co.il", "github.io", "gitlab.io", "blogspot.com", "wordpress.com", "netlify.app", "vercel.app", "herokuapp.com", "appspot.com", "pages.dev",
)


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The longest of ``suffixes`` that the host ends in, else its last label."""
    out = F.substring_index(host, ".", -1)
    for labels in sorted({s.count(".") + 1 for s in suffixes}):
        end = F.substring_index(host, ".", -labels)
        out = F.when(end.isin(*[s for s in suffixes if s.count(".") + 1 == labels]), end).otherwise(out)
    return out


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The registered domain: the suffix and the label before it; a host that is a suffix is its own."""
    return F.call_function("substring_index", host, F.lit("."), -(F.size(F.split(suffix_of(host, suffixes), r"\.")) + 1))


def _strength(groups: DataFrame) -> DataFrame:
    """Pseudo-counts of the beta prior over groups (n, bad), by moments of the over-dispersion."""
    low, high = STRENGTH_RANGE
    sums = groups.agg(
        F.sum("n").cast("double").alias("t"),
        F.sum("bad").cast("double").alias("b"),
        F.sum(F.col("n") * F.col("n")).cast("double").alias("t2"),
        F.count("*").cast("double").alias("k"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("q"),
    )
    p = F.col("b") / F.col("t")
    within = p * (1 - p)
    between = F.col("q") - F.col("b") * p  # sum of n (p_i - p)^2
    room = F.col("t") - F.col("t2") / F.col("t") - (F.col("k") - 1)
    rho = F.when((F.col("t") > 0) & (within > 0) & (room > 0), (between - within * (F.col("k") - 1)) / (within * room)).otherwise(0.0)
    found = F.when(rho > 0, (1 - rho) / F.when(rho > 0, rho)).otherwise(high)
    mean = F.when(F.col("t") > 0, (F.col("b") + 1) / (F.col("t") + 2)).otherwise(0.5)
    return sums.select(F.least(F.lit(high), F.greatest(F.lit(low), found)).alias("strength"), mean.alias("overall"))


def host_reputation(outcomes: DataFrame, hosts: DataFrame, z: float = 1.645, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Reputation of every host in ``hosts`` (host): posterior ``bad_rate``, its ``low`` bound, and ``n`` outcomes.

    outcomes: (host, bad) with bad 0 or 1, one row per labelled page.
    """
    by_host = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    by_host = hosts.select("host").distinct().join(by_host, "host", "left").fillna(0, ["n", "bad"])
    # a row a host, read seven times below
    by_host = shared_table(by_host.withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes)))
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    by_domain = by_host.groupBy("domain", "suffix").agg(*sums)
    by_suffix = by_domain.groupBy("suffix").agg(*sums)

    def counted(groups: DataFrame) -> DataFrame:
        return _strength(groups.where("n > 0"))

    def shrunk(groups: DataFrame, prior: Column, level: str) -> DataFrame:
        """prior: expected bad rate; each level's one-row strength comes by a broadcast of that row."""
        s = F.broadcast(counted(groups).select(F.lit(1).alias("every"), F.col("strength").alias(f"s_{level}"), F.col("overall").alias(f"o_{level}")))
        return groups.withColumn("every", F.lit(1)).join(s, "every").drop("every").withColumn(f"m_{level}", (F.col("bad") + F.col(f"s_{level}") * prior) / (F.col("n") + F.col(f"s_{level}")))

    suffixes = shrunk(by_suffix, F.col("o_suffix"), "suffix").select("suffix", "m_suffix")
    domains = shrunk(by_domain.join(suffixes, "suffix"), F.col("m_suffix"), "domain").select("domain", "m_domain")
    hosts_ = shrunk(by_host.join(domains, "domain"), F.col("m_domain"), "host")
    m, weight = F.col("m_host"), F.col("n") + F.col("s_host")
    return hosts_.select("host", "n", m.alias("bad_rate"), (m - z * F.sqrt(m * (1 - m) / (weight + 1))).alias("low"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], limit: float = 0.5, z: float = 1.645, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Every row of ``pages`` (page_id, url) with host, path, rule and verdict.

    outcomes: (url, bad), the labelled pages; bad is 0 or 1.  ``limit`` is the
    bad rate that the lower posterior bound must exceed for a block;
    ``suffixes`` are those of more than one label under which domains are registered.
    """
    judged = pages.select("page_id", "url").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"))
    known = outcomes.where("bad is not null").select(host_of(F.col("url")).alias("host"), F.col("bad").cast("long").alias("bad")).where("host <> ''")
    bad_hosts = host_reputation(known, judged.where("host <> ''"), z, suffixes).where(F.col("low") > limit).select("host", F.lit("block").alias("found"))
    return judged.join(bad_hosts, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("said", "found", F.lit("allow")).alias("verdict"))


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of the pages whose path ends in the number of a labelled document: bad if that is of low quality or toxic."""
    text = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:\.html)?/?$", 1)
    numbered = pages.select("url", F.when(text != "", text.cast("long")).alias("doc_id")).where("doc_id is not null")
    marks = labels.groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.coalesce("quality", "toxic").isNotNull(), 0)).alias("bad"))
    return numbered.join(marks.where("bad is not null"), "doc_id").select("url", "bad")


#: The rules of the registered query.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def op9_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return filter_urls(pages, labelled_outcomes(pages, labels), RULES)


SQL = r"""
WITH u AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
keys AS (SELECT DISTINCT host, path FROM u),
fits AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS said
  FROM keys JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN coalesce(quality, toxic) IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY doc_id),
outcomes AS (
  SELECT host, bad FROM (SELECT host, try_cast(nullif(regexp_extract(path, '/([0-9]{1,18})(?:\.html)?/?$', 1), '') AS BIGINT) AS doc_id FROM u) n
  JOIN marks USING (doc_id) WHERE bad IS NOT NULL AND host <> ''),
h AS (
  SELECT k.host, count(o.bad)::DOUBLE AS n, coalesce(sum(o.bad), 0)::DOUBLE AS bad,
         array_to_string(string_split(k.host, '.')[CASE WHEN array_to_string(string_split(k.host, '.')[-2:], '.') IN (SUFFIXES) THEN -3 ELSE -2 END:], '.') AS domain,
         CASE WHEN array_to_string(string_split(k.host, '.')[-2:], '.') IN (SUFFIXES) THEN array_to_string(string_split(k.host, '.')[-2:], '.') ELSE string_split(k.host, '.')[-1] END AS suffix
  FROM (SELECT DISTINCT host FROM u WHERE host <> '') k LEFT JOIN outcomes o ON o.host = k.host GROUP BY k.host),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix),
moments AS (
  SELECT level, sum(n) AS t, sum(bad) AS b, sum(n * n) AS t2, count(*)::DOUBLE AS k, sum(bad * bad / n) AS q
  FROM (SELECT 'h' AS level, n, bad FROM h UNION ALL SELECT 'd', n, bad FROM d UNION ALL SELECT 's', n, bad FROM s) g WHERE n > 0 GROUP BY level),
prior AS (
  SELECT level, CASE WHEN t > 0 AND b / t * (1 - b / t) > 0 AND t - t2 / t - (k - 1) > 0
                     THEN (q - b * (b / t) - b / t * (1 - b / t) * (k - 1)) / (b / t * (1 - b / t) * (t - t2 / t - (k - 1))) ELSE 0 END AS rho,
         (b + 1) / (t + 2) AS overall FROM moments),
strength AS (SELECT l.level, least(500.0, greatest(2.0, CASE WHEN rho > 0 THEN (1 - rho) / rho ELSE 500.0 END)) AS w, coalesce(overall, 0.5) AS overall
             FROM (VALUES ('h'), ('d'), ('s')) l(level) LEFT JOIN prior USING (level)),
sm AS (SELECT suffix, (bad + w * overall) / (n + w) AS m FROM s, strength WHERE level = 's'),
dm AS (SELECT domain, (d.bad + w * sm.m) / (d.n + w) AS m FROM d JOIN sm USING (suffix), strength WHERE level = 'd'),
hm AS (SELECT host, (h.bad + w * dm.m) / (h.n + w) AS m, h.n + w AS weight FROM h JOIN dm USING (domain), strength WHERE level = 'h'),
blocked AS (SELECT host FROM hm WHERE m - 1.645 * sqrt(m * (1 - m) / (weight + 1)) > 0.5)
SELECT u.page_id, u.host, u.path, fits.rule, coalesce(fits.said, CASE WHEN blocked.host IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM u LEFT JOIN fits ON fits.host = u.host AND fits.path = u.path LEFT JOIN blocked ON blocked.host = u.host
""".replace("SUFFIXES", ", ".join(f"'{s}'" for s in SUFFIXES))
