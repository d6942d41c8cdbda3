"""Host reputation by empirical Bayes, in DataFrame operations only.

Labelled outcomes of pages are counted by host and summed to the registered domain
and the suffix above it. Each level is a beta-binomial whose prior mean is its
parent's posterior mean; the prior's strength at a level is one number, fitted to
the spread of the children around their parents by the method of moments. A url is
blocked when the lower posterior bound of its host's bad rate exceeds a limit.
Hosts without labels inherit their domain's posterior, domains theirs from the
suffix, and suffixes from the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of the contract: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Standard errors below the posterior mean, and the bad rate a host must surely exceed to be blocked.
Z, LIMIT = 1.645, 0.2
#: The prior's strength in labelled pages is kept in this range.
WEAKEST, STRONGEST = 1.0, 1000.0


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_host_path(pages: DataFrame) -> DataFrame:
    """Adds host and path; a url that is null or has no :// gets two empty strings."""
    at = F.instr(F.col("url"), "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return (
        pages.withColumn("_rest", F.coalesce(rest, F.lit("")))
        .withColumn("host", lower_ascii(F.regexp_extract("_rest", r"(?s)^([^/?#]*)", 1)))
        .withColumn("path", F.regexp_extract("_rest", r"(?s)^[^/?#]*([^?#]*)", 1))
        .drop("_rest")
    )


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null without one."""
    fits = [
        (v, h + p, ((host == h) | host.endswith("." + h)) & path.startswith(p))
        for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))
    ]
    rule, verdict = F, F
    for v, name, cond in fits:
        rule, verdict = rule.when(cond, F.lit(name)), verdict.when(cond, F.lit(v))
    return rule, verdict


def domain_of(host: Column) -> Column:
    """The last two labels; a host of one label is its own domain."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _strength(children: DataFrame) -> DataFrame:
    """One row: the prior's strength that the children's spread around their prior mean implies.

    children has n labelled pages, k bad ones and the prior mean. For a beta-binomial
    the expected squared deviation of k / n is m (1 - m) (1 + (n - 1) rho) / n, summed
    over children weighted by n; strength is 1 / rho - 1.
    """
    m = F.greatest(F.least(F.col("mean"), F.lit(1 - 1e-9)), F.lit(1e-9))
    spread = F.col("n") * (F.col("k") / F.col("n") - m) * (F.col("k") / F.col("n") - m)
    sums = children.where("n > 0").agg(F.sum(spread).alias("s"), F.sum(m * (1 - m)).alias("e"), F.sum(m * (1 - m) * (F.col("n") - 1)).alias("r"))
    rho = F.when(F.col("r") > 0, (F.col("s") - F.col("e")) / F.col("r")).otherwise(F.lit(0.0))
    strength = F.when(rho <= 0, F.lit(STRONGEST)).otherwise(F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), 1 / rho - 1)))
    return sums.select(F.coalesce(strength, F.lit(STRONGEST)).alias("strength"))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """outcomes: (host, bad 0/1 or null), one row a page. Returns every host with a posterior and its lower bound.

    Pages with a null outcome add no evidence but their hosts are rated. A host is
    one row of the result however many pages it has; only counts are shuffled.
    """
    known = F.when(F.col("bad").isNotNull(), 1).otherwise(0)
    hosts = outcomes.groupBy("host").agg(F.sum(known).cast("double").alias("n"), F.sum(F.coalesce(F.col("bad"), F.lit(0))).cast("double").alias("k"))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    domains = hosts.groupBy("domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("suffix", suffix_of(F.col("domain")))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    # One row each: the whole table's rate, which two pages at half the limit start (so that
    # nothing is blocked without labels), then each level's strength.
    top = suffixes.agg(((F.coalesce(F.sum("k"), F.lit(0.0)) + LIMIT) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 2)).alias("mean"))

    def posterior(level: DataFrame, keep: list[str]) -> DataFrame:
        rated = level.join(F.broadcast(_strength(level)))
        a = F.col("mean") * F.col("strength") + F.col("k")
        total = F.col("strength") + F.col("n")
        return rated.select(*keep, "n", "k", (a / total).alias("post"), total.alias("weight"))

    suffixes = posterior(suffixes.join(F.broadcast(top)), ["suffix"])
    domains = posterior(domains.join(suffixes.select("suffix", F.col("post").alias("mean")), "suffix"), ["domain", "suffix"])
    hosts = posterior(hosts.join(domains.select("domain", F.col("post").alias("mean")), "domain"), ["host", "domain"])
    sd = F.sqrt(F.col("post") * (1 - F.col("post")) / (F.col("weight") + 1))
    return hosts.withColumn("bound", F.col("post") - F.lit(Z) * sd)


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, limit: float = LIMIT) -> DataFrame:
    """Every page's host, path, rule and verdict: the rule's, else block where the host's bound exceeds the limit.

    labels: (page_id, bad). Several labels of a page count as bad if one of them is;
    repeated pages stay repeated. The hosts' verdicts are joined as the set of
    blocked hosts, so that a hot host is split by the adaptive skew join.
    """
    parsed = with_host_path(pages.select("page_id", "url"))
    marks = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    outcomes = parsed.join(marks, "page_id", "left").select("host", "bad")
    bad_hosts = host_reputation(outcomes).where(F.col("bound") > limit).select("host", F.lit("block").alias("_judged"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = parsed.join(bad_hosts, "host", "left")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("_judged"), F.lit("allow")).alias("verdict"))


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    """Judges every page's url; a page is bad when the label of its id says low quality."""
    from tidemark.llm.common import table

    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return judge_urls(table(spark, sf_dir, "pages"), labels)


ORACLE_OP8 = r"""
WITH parsed AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
), marks AS (
  SELECT doc_id AS page_id, max(1 - quality) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), h0 AS (
  SELECT host, cast(count(bad) AS double) AS n, cast(coalesce(sum(bad), 0) AS double) AS k
  FROM parsed LEFT JOIN marks USING (page_id) GROUP BY host
), h1 AS (
  SELECT *, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain FROM h0
), d0 AS (
  SELECT domain, sum(n) AS n, sum(k) AS k, string_split(domain, '.')[-1] AS suffix FROM h1 GROUP BY domain
), s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d0 GROUP BY suffix),
s1 AS (SELECT s0.*, (SELECT (coalesce(sum(k), 0) + 0.2::DOUBLE) / (coalesce(sum(n), 0) + 2) FROM s0) AS mean FROM s0),
sm AS (SELECT 'x' AS one, sum(n * (k / n - mean) * (k / n - mean)) AS s, sum(mean * (1 - mean)) AS e, sum(mean * (1 - mean) * (n - 1)) AS r FROM s1 WHERE n > 0),
ss AS (SELECT coalesce(CASE WHEN r > 0 AND (s - e) / r > 0 THEN greatest(1.0, least(1000.0, r / (s - e) - 1)) ELSE 1000.0 END, 1000.0) AS strength FROM sm),
s2 AS (SELECT suffix, (mean * strength + k) / (strength + n) AS post FROM s1, ss),
d1 AS (SELECT d0.*, post AS mean FROM d0 JOIN s2 USING (suffix)),
dm AS (SELECT sum(n * (k / n - mean) * (k / n - mean)) AS s, sum(mean * (1 - mean)) AS e, sum(mean * (1 - mean) * (n - 1)) AS r FROM d1 WHERE n > 0),
ds AS (SELECT coalesce(CASE WHEN r > 0 AND (s - e) / r > 0 THEN greatest(1.0, least(1000.0, r / (s - e) - 1)) ELSE 1000.0 END, 1000.0) AS strength FROM dm),
d2 AS (SELECT domain, (mean * strength + k) / (strength + n) AS post FROM d1, ds),
h2 AS (SELECT h1.*, post AS mean FROM h1 JOIN d2 USING (domain)),
hm AS (SELECT sum(n * (k / n - mean) * (k / n - mean)) AS s, sum(mean * (1 - mean)) AS e, sum(mean * (1 - mean) * (n - 1)) AS r FROM h2 WHERE n > 0),
hs AS (SELECT coalesce(CASE WHEN r > 0 AND (s - e) / r > 0 THEN greatest(1.0, least(1000.0, r / (s - e) - 1)) ELSE 1000.0 END, 1000.0) AS strength FROM hm),
h3 AS (SELECT host, (mean * strength + k) / (strength + n) AS post, strength + n AS weight FROM h2, hs),
bad AS (SELECT host FROM h3 WHERE post - 1.645 * sqrt(post * (1 - post) / (weight + 1)) > 0.2),
ruled AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parsed
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
