"""Operator 6: URL filters with empirical-Bayes host reputation, in DataFrame functions only.

Rules come first: a rule (host, path) fits its host and all subdomains if the
url's path starts with the rule's path; the longest rule that fits decides.
Other urls are judged by their host's reputation. Outcomes of labelled pages
(bad or not) are counted by host, registered domain and suffix; each level's
rate is shrunk towards the level above with the strength that the level's own
spread shows (beta-binomial moments). A host is blocked if the lower bound of
its posterior bad rate exceeds a limit.

Only counts by host move; the tables joined back have one row a host.

Nulls: a null url, or one without `://`, has empty host and path, fits no rule
and has the reputation of the empty host. Pages without a label count for
nothing. Repeated rows are judged row by row. Empty tables give no rows; with
no outcome at all nothing is blocked by reputation. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import table

#: The rules: verdict, host and path.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: A host is blocked if its posterior rate less Z standard deviations exceeds LIMIT; bounds of the shrinkage strength.
Z, LIMIT, LEAST, MOST = 1.645, 0.5, 2.0, 1000.0

#: Second labels under which countries' registries (two letters) sell names, and sites whose users have names below them.
SECOND = "ac asn co com edu gob gouv gov govt go gr id info lg ltd me mil net ne nhs nom or org plc sch school web"
SHARED = "blogspot.com github.io gitlab.io herokuapp.com netlify.app pages.dev vercel.app web.app wordpress.com workers.dev"
_TWO_LABELS = rf"(^|\.)(({SECOND.replace(' ', '|')})\.[a-z][a-z]|{SHARED.replace('.', chr(92) + '.').replace(' ', '|')})$"
_NUMBERS = r"^[0-9]+(\.[0-9]+){3}$|^\["

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def deciding_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (verdict, rule), or null."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<verdict:string,rule:string>") if out is None else out


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix, without the port: the suffix is the last label, or the last two where a country's
    registry sells names below them or a site's users have names below them; the registered domain is one label more. An
    address of numbers is its own domain and suffix."""
    bare = F.regexp_replace(host, ":[0-9]*$", "")
    two = bare.rlike(_TWO_LABELS)
    numbers = bare.rlike(_NUMBERS)
    suffix = F.when(numbers, bare).when(two, F.substring_index(bare, ".", -2)).otherwise(F.substring_index(bare, ".", -1))
    return F.when(numbers, bare).when(two, F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2)), suffix


def _strength(counts: DataFrame, level: str) -> DataFrame:
    """One row: how many outcomes the prior of a level is worth, from the spread of its groups' rates (moments of the beta-binomial)."""
    g = counts.groupBy(level).agg(F.sum("n").cast("double").alias("n"), F.sum("b").cast("double").alias("b"))
    s = g.agg(F.sum("n").alias("N"), F.sum("b").alias("B"), F.count("*").cast("double").alias("k"), F.sum(F.col("b") * F.col("b") / F.col("n")).alias("q"), F.sum(F.col("n") * F.col("n")).alias("n2"))
    p = F.expr("B / N")
    spread = F.col("q") - F.col("B") * p  # sum of n (rate - p)^2
    one = p * (1 - p)
    room = F.col("N") - F.col("n2") / F.col("N") - (F.col("k") - 1)
    rho = F.when((one > 0) & (room > 0), (spread / one - (F.col("k") - 1)) / room)
    rho = F.greatest(F.least(F.coalesce(rho, F.lit(0.0)), F.lit(1 / (1 + LEAST))), F.lit(1 / (1 + MOST)))
    return s.select(((1 - rho) / rho).alias("k_" + level))


def reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rows (host, n_labelled, n_bad, rate, low): pages have (id, host), outcomes (id, bad)."""
    labelled = pages.join(outcomes, "id").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("b"))
    hosts = pages.select("host").distinct().join(labelled, "host", "left").select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("b", F.lit(0)).alias("b"))
    domain, suffix = levels(F.col("host"))
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    counts = hosts.where("n > 0")
    total = hosts.agg(((F.sum("b") + 1) / (F.sum("n") + 2)).alias("p0"))
    strengths = total.crossJoin(_strength(counts, "suffix")).crossJoin(_strength(counts, "domain")).crossJoin(_strength(counts, "host"))  # one row
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("sn"), F.sum("b").alias("sb"))
    domains = hosts.groupBy("domain").agg(F.sum("n").alias("dn"), F.sum("b").alias("db"))
    got = hosts.join(suffixes, "suffix").join(domains, "domain").crossJoin(F.broadcast(strengths))
    got = got.withColumn("ms", F.expr("(sb + k_suffix * p0) / (sn + k_suffix)")).withColumn("md", F.expr("(db + k_domain * ms) / (dn + k_domain)"))
    got = got.withColumn("alpha", F.expr("b + k_host * md")).withColumn("beta", F.expr("n - b + k_host * (1 - md)"))
    got = got.withColumn("rate", F.expr("alpha / (alpha + beta)"))
    low = F.col("rate") - Z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("alpha") + F.col("beta") + 1))
    return got.select("host", F.col("n").cast("long").alias("n_labelled"), F.col("b").cast("long").alias("n_bad"), "rate", low.alias("low"))


def filtered(pages: DataFrame, outcomes: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, limit: float = LIMIT) -> DataFrame:
    """Rows (key, host, path, rule, verdict, n_labelled, n_bad, bad_rate)."""
    host, path = split_url(F.col(url))
    p = pages.select(F.col(key).alias("id"), host.alias("host"), path.alias("path"))
    rep = reputation(p.select("id", "host"), outcomes)
    got = p.join(rep, "host").withColumn("r", deciding_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("low") > limit, "block").otherwise("allow")
    return got.select(F.col("id").alias(key), "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", own).alias("verdict"), "n_labelled", "n_bad", F.round("rate", 4).alias("bad_rate"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled outcomes of pages: the rows of `labels` with the page's number; bad is toxic or of low quality."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False)).alias("bad"))
    return filtered(table(spark, sf_dir, "pages"), labels)


def _sql_strength(level: str) -> str:
    return f"""
k_{level} AS (SELECT (1 - rho) / rho AS k_{level} FROM (
  SELECT greatest(least(coalesce(CASE WHEN B / N * (1 - B / N) > 0 AND N - n2 / N - (k - 1) > 0
           THEN ((q - B * (B / N)) / (B / N * (1 - B / N)) - (k - 1)) / (N - n2 / N - (k - 1)) END, 0.0), {1 / (1 + LEAST)!r}), {1 / (1 + MOST)!r}) AS rho
  FROM (SELECT sum(n) AS N, sum(b) AS B, CAST(count(*) AS DOUBLE) AS k, sum(b * b / n) AS q, sum(n * n) AS n2
        FROM (SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(sum(b) AS DOUBLE) AS b FROM h WHERE n > 0 GROUP BY {level}))))"""


_SQL_RULE = " ".join(
    f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'"
    for _, r in sorted(RULES, key=lambda x: -len(x[1]))
)
SQL = f"""
WITH p AS (SELECT page_id, translate(regexp_extract(a, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(a, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS a FROM pages)),
l AS (SELECT host, count(*) AS n, sum(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS b FROM p JOIN labels ON doc_id = page_id GROUP BY host),
h AS (SELECT host, coalesce(n, 0) AS n, coalesce(b, 0) AS b, CASE WHEN numbers THEN bare WHEN two THEN array_to_string(list_slice(string_split(bare, '.'), -3, -1), '.') ELSE array_to_string(list_slice(string_split(bare, '.'), -2, -1), '.') END AS domain,
        CASE WHEN numbers THEN bare WHEN two THEN array_to_string(list_slice(string_split(bare, '.'), -2, -1), '.') ELSE string_split(bare, '.')[-1] END AS suffix
  FROM (SELECT host, bare, regexp_matches(bare, '{_NUMBERS}') AS numbers, regexp_matches(bare, '{_TWO_LABELS}') AS two
        FROM (SELECT DISTINCT host, regexp_replace(host, ':[0-9]*$', '') AS bare FROM p)) LEFT JOIN l USING (host)),
{_sql_strength("suffix")}, {_sql_strength("domain")}, {_sql_strength("host")},
t AS (SELECT (sum(b) + 1) / (sum(n) + 2) AS p0 FROM h),
m AS (SELECT h.*, k_suffix, k_domain, k_host, p0, sum(n) OVER (PARTITION BY suffix) AS sn, sum(b) OVER (PARTITION BY suffix) AS sb,
        sum(n) OVER (PARTITION BY domain) AS dn, sum(b) OVER (PARTITION BY domain) AS db FROM h, t, k_suffix, k_domain, k_host),
r AS (SELECT host, n, b, b + k_host * md AS alpha, n - b + k_host * (1 - md) AS beta
      FROM (SELECT *, (db + k_domain * ((sb + k_suffix * p0) / (sn + k_suffix))) / (dn + k_domain) AS md FROM m)),
s AS (SELECT host, n, b, alpha / (alpha + beta) AS rate, alpha + beta AS w FROM r)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN CASE WHEN rule IN ({", ".join(f"'{r}'" for v, r in RULES if v == "allow")}) THEN 'allow' ELSE 'block' END
         WHEN rate - {Z} * sqrt(rate * (1 - rate) / (w + 1)) > {LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
       CAST(n AS BIGINT) AS n_labelled, CAST(b AS BIGINT) AS n_bad, round(rate, 4) AS bad_rate
FROM (SELECT *, CASE {_SQL_RULE} END AS rule FROM p) JOIN s USING (host)
"""
