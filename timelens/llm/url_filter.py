"""URL filtering by rules and empirical-Bayes host reputation. DataFrame functions only.

Labelled page outcomes are counted by host. A beta-binomial prior is fitted for each level by the method of
moments and shrinks outcomes from suffix to registered domain to host; a page is blocked when the lower bound of
its host's posterior rate of bad pages exceeds ``max_bad``. Explicit rules override the reputation.

Defined results: a null url, or one without ``://``, has an empty host and path and gets the reputation of the empty
host; hosts without labelled pages fall back on their domain, their suffix, then the overall rate; an empty
table gives no rows; repeated rows are judged alike, row by row; further columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timelens.llm.common import checkpoint, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (action, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "co.jp", "co.nz", "com.br", "co.in", "co.za")

Z, MAX_BAD = 1.64, 0.5
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + F.lit(1), F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host."""
    two = F.substring_index(host, ".", -2)
    suffix = F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))
    domain = F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)
    return domain, suffix


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its action; null where none does."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for does, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        action = F.when(fits, F.lit(does)).otherwise(action)
    return rule, action


def _strength(groups: DataFrame) -> float:
    """Method-of-moments prior strength from (n, bad) by group; groups without labels don't count."""
    r = (
        groups.filter("n > 0")
        .agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.pow("bad", 2.0) / F.col("n")).alias("sq"), F.sum(1.0 / F.col("n")).alias("inv"))
        .first()
    )
    if r["g"] < 2:
        return MOST_STRENGTH
    mean = r["bad"] / r["n"]
    spread = r["g"] * (r["sq"] - r["bad"] * mean) / ((r["g"] - 1) * r["n"])
    excess = spread - mean * (1 - mean) * r["inv"] / r["g"]
    if excess <= 0:
        return MOST_STRENGTH
    return min(MOST_STRENGTH, max(LEAST_STRENGTH, (mean * (1 - mean) - spread) / excess))


def host_reputation(pages: DataFrame, z: float = Z) -> DataFrame:
    """Posterior of the rate of bad pages by host, from (host, pages, bad) where bad is null for unlabelled pages.

    Rows are added up before any shuffle, so a host with a third of all pages costs no more than another.
    """
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = checkpoint(pages.groupBy("host").agg(F.coalesce(F.sum(F.when(F.col("bad").isNotNull(), F.col("pages"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("bad") * F.col("pages")), F.lit(0)).cast("double").alias("bad")).withColumns({"domain": domain, "suffix": suffix}))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    all_n, all_bad = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    base = ((all_bad or 0) + 0.5) / ((all_n or 0) + 1.0)
    m_suffix, m_domain, m_host = (_strength(x) for x in (suffixes, domains, hosts))
    by_suffix = suffixes.select("suffix", ((F.lit(m_suffix * base) + F.col("bad")) / (F.lit(m_suffix) + F.col("n"))).alias("p_suffix"))
    by_domain = domains.join(by_suffix, "suffix").select("domain", ((F.lit(m_domain) * F.col("p_suffix") + F.col("bad")) / (F.lit(m_domain) + F.col("n"))).alias("p_domain"))
    a, b = F.lit(m_host) * F.col("p_domain") + F.col("bad"), F.lit(m_host) * (1 - F.col("p_domain")) + F.col("n") - F.col("bad")
    mean = a / (a + b)
    bound = mean - F.lit(z) * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.join(by_domain, "domain").select("host", F.col("n").alias("host_labels"), mean.alias("bad_rate"), bound.alias("bad_bound"))


def url_filter(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, max_bad: float = MAX_BAD, z: float = Z) -> DataFrame:
    """Judge every row of pages (page_id, url). outcomes: (key, bad 0/1), joined on the number that ends a page's path."""
    host, path = host_and_path(F.col("url"))
    key = F.expr("try_cast(nullif(regexp_extract(path, '/([0-9]+)(?:[.]html)?/?$', 1), '') AS bigint)")
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("key", key)
    known = outcomes.filter("key IS NOT NULL AND bad IS NOT NULL").groupBy("key").agg(F.max("bad").cast("long").alias("bad"))
    # pages are added up by host and key before they meet the labels, so neither a hot host nor the many pages without a key make a hot key
    counted = judged.groupBy("host", "key").agg(F.count("*").alias("pages"))
    labelled = counted.filter("key IS NOT NULL").join(known, "key").select("host", "pages", "bad")
    bare = counted.select("host").distinct().select("host", F.lit(0).cast("long").alias("pages"), F.lit(None).cast("long").alias("bad"))
    reputation = checkpoint(host_reputation(labelled.union(bare), z))
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(action, F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow"))
    return judged.join(reputation, "host", "left").select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.coalesce("host_labels", F.lit(0)).alias("host_labels"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.when(F.col("quality") == 0, 1).when(F.col("quality").isNotNull(), 0).alias("bad"))
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes)


SQL = f"""
WITH rules(action, host, path) AS (VALUES {", ".join(map(str, RULES))}),
rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM rest
), judged AS (
  SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM cut
), keyed AS (
  SELECT *, TRY_CAST(nullif(regexp_extract(path, '/([0-9]+)(?:[.]html)?/?$', 1), '') AS BIGINT) AS key FROM judged
), known AS (
  SELECT doc_id AS key, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1
), hosts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM keyed LEFT JOIN known USING (key) GROUP BY 1
), parts AS (
  SELECT *, string_split(host, '.') AS label, host AS h FROM hosts
), levels AS (
  SELECT host, n, bad, array_to_string(label[-2:], '.') AS two, label FROM parts
), named AS (
  SELECT host, n, bad,
    CASE WHEN two IN {TWO_LABEL_SUFFIXES} THEN array_to_string(label[-3:], '.') ELSE two END AS domain,
    CASE WHEN two IN {TWO_LABEL_SUFFIXES} THEN two ELSE label[-1] END AS suffix FROM levels
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM named GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM named GROUP BY 1),
groups AS (
  SELECT 'h' AS level, n, bad FROM named WHERE n > 0 UNION ALL SELECT 'd', n, bad FROM domains WHERE n > 0 UNION ALL SELECT 's', n, bad FROM suffixes WHERE n > 0
), moments AS (
  SELECT level, count(*) AS g, sum(n) AS n, sum(bad) AS bad, sum(bad * bad / n) AS sq, sum(1.0 / n) AS inv FROM groups GROUP BY 1
), spread AS (
  SELECT level, g, bad / n AS mean, inv, CASE WHEN g > 1 THEN g * (sq - bad * bad / n) / ((g - 1) * n) END AS spread FROM moments
), strength AS (
  SELECT level, CASE WHEN g < 2 OR spread - mean * (1 - mean) * inv / g <= 0 THEN {MOST_STRENGTH}
    ELSE least({MOST_STRENGTH}, greatest({LEAST_STRENGTH}, (mean * (1 - mean) - spread) / (spread - mean * (1 - mean) * inv / g))) END AS m FROM spread
), m AS (
  SELECT coalesce(max(CASE WHEN level = 's' THEN m END), {MOST_STRENGTH}) AS ms, coalesce(max(CASE WHEN level = 'd' THEN m END), {MOST_STRENGTH}) AS md,
    coalesce(max(CASE WHEN level = 'h' THEN m END), {MOST_STRENGTH}) AS mh, (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) FROM suffixes) AS base FROM strength
), by_suffix AS (SELECT suffix, (ms * base + bad) / (ms + n) AS p FROM suffixes, m),
by_domain AS (SELECT d.domain, (md * s.p + d.bad) / (md + d.n) AS p FROM domains d JOIN by_suffix s USING (suffix), m),
posterior AS (SELECT h.host, h.n, mh * d.p + h.bad AS a, mh * (1 - d.p) + h.n - h.bad AS b FROM named h JOIN by_domain d USING (domain), m),
bounds AS (SELECT host, n, a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM posterior),
ruled AS (
  SELECT k.*, (SELECT max_by(r.host || r.path, length(r.host || r.path)) FROM rules r WHERE (k.host = r.host OR ends_with(k.host, '.' || r.host)) AND starts_with(k.path, r.path)) AS rule FROM keyed k
)
SELECT r.page_id, r.host, r.path, r.rule,
  coalesce((SELECT max(action) FROM rules u WHERE u.host || u.path = r.rule), CASE WHEN b.bound > {MAX_BAD} THEN 'block' ELSE 'allow' END) AS verdict, b.n AS host_labels
FROM ruled r JOIN bounds b ON r.host = b.host
"""
