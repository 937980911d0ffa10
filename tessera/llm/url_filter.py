"""URL filters by empirical-Bayes host reputation, in DataFrame functions only.

Labelled outcomes of pages are counted by host. Each level's rate is a beta-binomial posterior
whose prior is centred on the level above (all pages, then suffix, then registered domain, then
host), and whose weight is estimated from the spread of that level's own groups. A host is
blocked only if the upper bound of its posterior lies under the floor, so that few or no labels
never block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

#: (verdict, host, path): a rule fits its host and all subdomains, and paths that start with its.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
# Public suffixes of two labels that are common; others are a parameter.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.mx",
    "co.in", "co.kr", "co.za", "com.tr", "com.tw", "com.ar",
)
FLOOR = 0.5
Z = 2.0
#: Bounds of a prior in labels: one label is counted at every level and must not convict a host.
MIN_WEIGHT, MAX_WEIGHT = 5.0, 1000.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?`` or ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _last_labels(host: Column, suffixes: tuple, more: int) -> Column:
    """The host's suffix and ``more`` labels before it, by the longest that fits."""
    out = F.substring_index(host, ".", -1 - more)
    for k in sorted({s.count(".") + 1 for s in suffixes}):
        fits = F.substring_index(host, ".", -k).isin([s for s in suffixes if s.count(".") + 1 == k])
        out = F.when(fits, F.substring_index(host, ".", -k - more)).otherwise(out)
    return out


def suffix_of(host: Column, suffixes: tuple = ()) -> Column:
    """The longest of ``suffixes`` that the host ends with, else its last label."""
    return _last_labels(host, suffixes, 0)


def domain_of(host: Column, suffixes: tuple = ()) -> Column:
    """The registered domain: the suffix and one label before it."""
    return _last_labels(host, suffixes, 1)


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as ``host/path`` and its verdict, or nulls. One projection."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _prior_weight(groups: DataFrame, parent: str, n: str = "n", good: str = "good") -> Column:
    """Method of moments: m(1-m)/var - 1 over group rates, weighed by counts and kept in bounds."""
    rate = F.col(good) / F.col(n)
    m = F.col(parent)
    noise = F.sum(m * (1 - m))
    spread = F.sum(F.col(n) * (rate - m) * (rate - m))
    # E[spread] = sum m(1-m) (1 + (n - 1) / (weight + 1))
    excess = spread - noise
    room = F.sum((F.col(n) - 1) * m * (1 - m))
    weight = F.when(excess > 0, room / excess - 1).otherwise(F.lit(MAX_WEIGHT))
    return F.coalesce(F.least(F.greatest(weight, F.lit(MIN_WEIGHT)), F.lit(MAX_WEIGHT)), F.lit(MAX_WEIGHT))


def _level(groups: DataFrame, key: str, parents: DataFrame, parent_key: str | None) -> DataFrame:
    """Posterior means of one level: (good + w * parent) / (n + w). Keeps key, mean, n and weight."""
    joined = groups.join(parents, parent_key, "left") if parent_key else groups.crossJoin(F.broadcast(parents))
    weight = joined.where(F.col("n") > 0).agg(_prior_weight(joined, "parent").alias("w"))
    return joined.crossJoin(F.broadcast(weight)).withColumn("mean", (F.col("good") + F.col("w") * F.col("parent")) / (F.col("n") + F.col("w")))


def host_reputation(outcomes: DataFrame, z: float = Z, suffixes: tuple = SUFFIXES) -> DataFrame:
    """``host, n, good, mean, upper`` from ``outcomes(host, good 0/1 or null)``.

    Hosts without labels get their domain's mean with the prior's own width. One-row tables (the
    global rate, a weight) are the only explicit broadcasts. Each level is written once, as the next
    one reads it twice.
    """
    hosts = materialize((
        outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("good"))
        .withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes))
    ), "hosts")
    domains = materialize(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "domains")
    ends = materialize(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "suffixes")
    overall = ends.agg(F.coalesce((F.sum("good") + 1.0) / (F.sum("n") + 2.0), F.lit(0.5)).alias("parent"))
    s = materialize(_level(ends, "suffix", overall, None).select("suffix", F.col("mean").alias("parent")), "suffix-means")
    d = materialize(_level(domains, "domain", s, "suffix").select("domain", F.col("mean").alias("parent")), "domain-means")
    h = _level(hosts, "host", d, "domain")
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("w") + 1))
    return h.select("host", "n", "good", "mean", (F.col("mean") + z * sd).alias("upper"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, floor: float = FLOOR, z: float = Z, suffixes: tuple = SUFFIXES) -> DataFrame:
    """``page_id, host, path, rule, verdict, n, mean, upper`` for each row of ``pages(page_id, url)``.

    ``labels(doc_id, quality, toxic)`` are outcomes: good is quality 1 and not toxic; a label with
    a null quality or page_id counts for nothing, repeated labels count each time. ``suffixes`` are
    those of several labels ("co.uk"), lower-case; under any other a host's suffix is its last label.

    * null url or one without ``://``: empty host and path; such pages share the empty host.
    * null page_id: kept, unlabelled. Empty pages: no rows. No labels: everything is allowed.
    * repeated pages are judged each; extra columns of either table are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("_url"))
    judged = rows.select("page_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    marks = labels.select(
        F.col("doc_id").cast("long").alias("page_id"),
        ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("int").alias("good"),
    ).where("good is not null")
    # Counts come from unique page rows' hosts: a label of a repeated page counts for each row.
    outcomes = judged.select("page_id", "host").join(marks, "page_id", "left").select("host", "good")
    reputation = host_reputation(outcomes, z, suffixes)
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("upper") < floor, "block").otherwise("allow")
    return judged.join(reputation, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "n", "mean", "upper"
    )


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    out = filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return out.select("page_id", "host", "path", "rule", "verdict", F.round("mean", 6).alias("host_mean"))


ORACLE = """
WITH judged AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
marks AS (SELECT doc_id, CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END AS good FROM labels WHERE quality IS NOT NULL),
hosts AS (
  SELECT host, CASE WHEN l[-2:] IN {SUFFIXES} THEN l[-2] || '.' || l[-1] ELSE l[-1] END AS suffix,
    array_to_string(CASE WHEN l[-2:] IN {SUFFIXES} THEN l[-3:] ELSE l[-2:] END, '.') AS domain,
    count(good) AS n, coalesce(sum(good), 0) AS good
  FROM (SELECT *, string_split(host, '.') AS l FROM judged) AS j LEFT JOIN marks ON page_id = doc_id GROUP BY 1, 2, 3),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM domains GROUP BY 1),
overall AS (SELECT (sum(good) + 1.0) / (sum(n) + 2.0) AS parent FROM suffixes),
s0 AS (SELECT suffixes.*, parent FROM suffixes, overall),
sw AS (SELECT coalesce(least(greatest(CASE WHEN sum(n * power(good / n - parent, 2)) - sum(parent * (1 - parent)) > 0 THEN sum((n - 1) * parent * (1 - parent)) / (sum(n * power(good / n - parent, 2)) - sum(parent * (1 - parent))) - 1 ELSE 1000 END, 5), 1000), 1000) AS w FROM s0 WHERE n > 0),
s AS (SELECT suffix, (good + w * parent) / (n + w) AS parent FROM s0, sw),
d0 AS (SELECT domains.*, parent FROM domains JOIN s USING (suffix)),
dw AS (SELECT coalesce(least(greatest(CASE WHEN sum(n * power(good / n - parent, 2)) - sum(parent * (1 - parent)) > 0 THEN sum((n - 1) * parent * (1 - parent)) / (sum(n * power(good / n - parent, 2)) - sum(parent * (1 - parent))) - 1 ELSE 1000 END, 5), 1000), 1000) AS w FROM d0 WHERE n > 0),
d AS (SELECT domain, (good + w * parent) / (n + w) AS parent FROM d0, dw),
h0 AS (SELECT hosts.*, parent FROM hosts JOIN d USING (domain)),
hw AS (SELECT coalesce(least(greatest(CASE WHEN sum(n * power(good / n - parent, 2)) - sum(parent * (1 - parent)) > 0 THEN sum((n - 1) * parent * (1 - parent)) / (sum(n * power(good / n - parent, 2)) - sum(parent * (1 - parent))) - 1 ELSE 1000 END, 5), 1000), 1000) AS w FROM h0 WHERE n > 0),
h AS (SELECT host, (good + w * parent) / (n + w) AS mean, n + w AS weight FROM h0, hw),
rules(what, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fits AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(what, length(h || p)) AS what
  FROM (SELECT DISTINCT host, path FROM judged) j JOIN rules r ON (j.host = r.h OR suffix(j.host, '.' || r.h)) AND starts_with(j.path, r.p)
  GROUP BY host, path)
SELECT page_id, j.host, j.path, f.rule,
  coalesce(f.what, CASE WHEN mean + 2.0 * sqrt(mean * (1 - mean) / (weight + 1)) < 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
  round(mean, 6) AS host_mean
FROM judged j LEFT JOIN fits f ON j.host = f.host AND j.path = f.path LEFT JOIN h ON j.host = h.host
""".replace("{SUFFIXES}", "(" + ", ".join(f"[{x}]" for x in (", ".join(f"'{w}'" for w in s.split(".")) for s in SUFFIXES)) + ")")
