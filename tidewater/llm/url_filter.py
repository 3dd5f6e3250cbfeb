"""URL filters: explicit rules first, empirical-Bayes host reputation for the rest.

Labelled outcomes of pages (1 good, 0 bad) are counted per host.  Each level is
shrunk to the one above it by a beta-binomial prior: suffix to the overall rate,
registered domain to its suffix, host to its domain.  The strength of each prior
is estimated from the overdispersion of that level (method of moments).  A page is
blocked when its host's good rate lies under ``floor`` with a posterior probability of ``sure`` at
least, that is, when even the upper posterior bound is below it: a host is only blocked on evidence, an
unseen one inherits its domain.  The probability is the beta distribution's, by integration.

Defined results: null url or no ``://`` gives empty host and path, no rule fits and
the prior decides; hosts without a dot are their own domain and suffix; null outcomes
are not counted; an empty outcome table allows everything that no rule blocks.  Input columns named
``host``, ``path``, ``rule`` or ``verdict`` are replaced; all others pass through, whatever their names.

Pages are read for their url only.  The counts per host are pre-aggregated in map
tasks and written once (one row a host).  Host, domain and suffix are looked up for the distinct hosts of the pages; of
these only the blocked ones are joined with the pages, once, one row a host, so that AQE splits a hot host.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.shared import col, columns, table

#: Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "co.jp", "co.nz", "co.za", "com.br", "com.cn", "co.in", "co.kr")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values: (verdict, host, path) of the query's rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: The overdispersion is kept in these bounds, the strength 1/rho - 1 in 1 to 999.
RHO_MIN, RHO_MAX = 1e-3, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), F.coalesce(path, F.lit(""))


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    last2 = F.substring_index(host, ".", -2)
    two = last2.isin(*TWO_LABEL_SUFFIXES) & (host != last2)
    suffix = F.when(two, last2).otherwise(F.substring_index(host, ".", -1))
    domain = F.when(two, F.substring_index(host, ".", -3)).otherwise(last2)
    return domain, suffix


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; a bounded list becomes one expression."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame) -> float:
    """Prior strength from (s, n, mu): successes, trials and the parent's mean of each group."""
    v = F.col("mu") * (1 - F.col("mu"))
    row = groups.agg(
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("mu"), 2)).alias("a"), F.sum(v).alias("b"), F.sum((F.col("n") - 1) * v).alias("c")
    ).first()
    rho = (row.a - row.b) / row.c if row.c else RHO_MAX
    rho = min(RHO_MAX, max(RHO_MIN, rho))
    return 1 / rho - 1


#: Steps of an integral (even), and the reach of its variable.
STEPS, REACH = 128, 8.0


def beta_below(a: Column, b: Column, floor: float) -> Column:
    """The probability that a rate with the distribution Beta(a, b) is under ``floor``.

    Simpson's rule on both sides of the floor, over u with logit(rate) = logit(mode) + sd * sinh(u): what is
    integrated then falls off doubly exponentially, for small counts as for large ones."""
    # In arrays of one, so that each part is worked out once.
    return F.get(F.transform(F.array(F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"))), lambda s: _below(s["a"], s["b"], floor)), F.lit(0))


def _below(a: Column, b: Column, floor: float) -> Column:
    mid, sd = F.ln(a / b), F.sqrt((a + b) / (a * b))
    soft = lambda x: F.greatest(x, F.lit(0.0)) + F.ln(1 + F.exp(-F.abs(x)))
    log = lambda x: -a * soft(-x) - b * soft(x)
    cut = F.greatest(F.lit(-REACH), F.least(F.lit(REACH), F.asinh((F.log(F.lit(floor / (1 - floor))) - mid) / sd)))

    def integral(lo: Column, hi: Column) -> Column:
        def term(total, i):
            u = lo + (hi - lo) * i / STEPS
            weight = F.when((i == 0) | (i == STEPS), 1).when(i % 2 == 1, 4).otherwise(2)
            return total + weight * F.exp(log(mid + sd * F.sinh(u)) - log(mid)) * F.cosh(u)

        return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), term) * (hi - lo)

    under = F.struct(integral(F.lit(-REACH), cut).alias("x"), integral(cut, F.lit(REACH)).alias("y"))
    return F.get(F.transform(F.array(under), lambda s: s["x"] / (s["x"] + s["y"])), F.lit(0))


def host_reputation(outcomes: DataFrame, floor: float = 0.5) -> DataFrame:
    """(level, name, mean, below) for outcomes (host, good): the posterior mean and the probability that the good
    rate is under ``floor``, of each host, and of each domain, suffix and of everything as priors for unseen hosts."""
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = (
        outcomes.where(F.col("good").isNotNull())
        .groupBy("host")
        .agg(F.sum("good").cast("double").alias("s"), F.count("*").cast("double").alias("n"))
        .withColumns({"domain": domain, "suffix": suffix})
    )
    hosts = table(hosts, "hosts")
    total = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    p0 = ((total.s or 0) + 1) / ((total.n or 0) + 2)
    parent, levels = None, []
    for level in ("suffix", "domain", "host"):
        keys = {"suffix": ["suffix"], "domain": ["suffix", "domain"], "host": ["suffix", "domain", "host"]}[level]
        groups = hosts.groupBy(*keys).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        groups = table(groups.withColumn("mu", F.lit(p0)) if parent is None else groups.join(parent, keys[:-1]), "hosts")
        k = _strength(groups)
        a, b = F.col("s") + k * F.col("mu"), F.col("n") - F.col("s") + k * (1 - F.col("mu"))
        mean = a / (a + b)
        levels.append(groups.select(F.lit(level).alias("level"), F.col(level).alias("name"), mean.alias("mean"), beta_below(a, b, floor).alias("below")))
        parent = groups.select(*keys, mean.alias("mu"))
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


def blocked_hosts(hosts: DataFrame, known: DataFrame, sure: float) -> DataFrame:
    """Those of ``hosts`` (host) whose good rate is under the floor with probability ``sure``, by what is known of the
    host, else of its domain, else of its suffix; ``known`` is ``host_reputation``'s result."""
    domain, suffix = domain_and_suffix(F.col("host"))
    seen = hosts.distinct().withColumns({"domain": domain, "suffix": suffix})
    for level in ("host", "domain", "suffix"):
        seen = seen.join(known.where(F.col("level") == level).select(F.col("name").alias(level), F.col("below").alias(f"{level}_p")), level, "left")
    return seen.where(F.coalesce("host_p", "domain_p", "suffix_p", F.lit(0.0)) >= sure).select("host")


def url_filter(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, floor: float = 0.5, sure: float = 0.95, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict; ``outcomes`` has (host, good)."""
    host, path = host_and_path(col(url_col))
    own = columns(pages, "host", "path", "rule", "verdict")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = pages.select(*own, host.alias("host"), path.alias("path")).withColumns({"rule": rule, "__uf_v": verdict})
    known = table(host_reputation(outcomes, floor), "reputation")
    unruled = pages.select(host.alias("host"), path.alias("path")).where(verdict.isNull()).select("host")
    blocked = table(blocked_hosts(unruled, known, sure), "blocked").select(F.col("host").alias("__uf_host"))
    out = out.join(blocked, F.col("host") == F.col("__uf_host"), "left")
    method = F.when(F.col("__uf_host").isNotNull(), "block").otherwise("allow")
    return out.select(*own, "host", "path", "rule", F.coalesce("__uf_v", method).alias("verdict"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, good): a page's outcome is the quality label of the document that its url numbers."""
    host, path = host_and_path(F.col("url"))
    doc = F.regexp_extract(path, r"/([0-9]{1,18})", 1)
    rows = pages.select(host.alias("host"), F.when(doc != "", doc).cast("long").alias("doc_id"))
    return rows.join(labels.select("doc_id", F.col("quality").alias("good")), "doc_id").select("host", "good")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return url_filter(pages, page_outcomes(pages, labels)).drop("url")


def _soft(x: str) -> str:
    return f"(greatest({x}, 0e0) + ln(1 + exp(-abs({x}))))"


def _levels() -> str:
    out, parent = "", "(SELECT p0 AS mu FROM total)"
    for level, keys in (("suffix", ["suffix"]), ("domain", ["suffix", "domain"]), ("host", ["suffix", "domain", "host"])):
        k, up = ", ".join(keys), keys[:-1]
        src = f"(SELECT {k}, sum(s) AS s, sum(n) AS n FROM hosts GROUP BY {k})"
        join = f"{src} g JOIN {level}_up p USING ({', '.join(up)})" if up else f"{src} g, {parent} p"
        out += f"""
, {level}_g AS (SELECT {', '.join('g.' + x if x not in up else x for x in keys)}, s, n, mu FROM {join}),
{level}_k AS (SELECT 1e0 / least({RHO_MAX}e0, greatest({RHO_MIN:f}e0,
   CASE WHEN sum((n - 1) * mu * (1 - mu)) > 0 THEN (sum(n * pow(s / n - mu, 2)) - sum(mu * (1 - mu))) / sum((n - 1) * mu * (1 - mu)) ELSE {RHO_MAX}e0 END)) - 1 AS k FROM {level}_g),
{level}_p AS (SELECT {k}, a / (a + b) AS mu, a + b AS ab FROM (SELECT {k}, s + k * mu AS a, n - s + k * (1 - mu) AS b FROM {level}_g, {level}_k)),
{level}_c AS (SELECT {level} AS name, mu * ab AS a, (1 - mu) * ab AS b, ln(mu / (1 - mu)) AS mid, sqrt(1 / (mu * (1 - mu) * ab)) AS sd FROM {level}_p),
{level}_d AS (SELECT *, greatest(-8e0, least(8e0, ln(-mid / sd + sqrt(mid * mid / sd / sd + 1)))) AS cut FROM {level}_c),
{level}_e AS (SELECT *, CASE side WHEN 0 THEN -8e0 ELSE cut END AS lo, CASE side WHEN 0 THEN cut ELSE 8e0 END AS hi
   FROM {level}_d, (VALUES (0), (1)) v(side), range(401) r(i)),
{level}_f AS (SELECT *, lo + (hi - lo) * i / 400e0 AS t, mid + sd * (exp(lo + (hi - lo) * i / 400e0) - exp(-(lo + (hi - lo) * i / 400e0))) / 2 AS z FROM {level}_e),
{level}_u AS (SELECT name, sum(CASE WHEN side = 0 THEN v END) / sum(v) AS u FROM (
   SELECT name, side, CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * (hi - lo) * (exp(t) + exp(-t))
     * exp(a * ({_soft('-mid')} - {_soft('-z')}) + b * ({_soft('mid')} - {_soft('z')})) AS v FROM {level}_f) GROUP BY name)"""
        child = {"suffix": "domain", "domain": "host"}.get(level)
        if child:
            out += f",\n{child}_up AS (SELECT {k}, mu FROM {level}_p)"
    return out


_HOST = f"translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}')"
_TWO = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
OP4_SQL = f"""
WITH urls AS (
  SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
parsed AS (
  SELECT page_id, {_HOST} AS host,
         regexp_extract(substr(rest, length({_HOST}) + 1), '^[^?#]*', 0) AS path FROM urls),
split AS (SELECT *, string_split(host, '.') AS l, array_to_string(string_split(host, '.')[-2:], '.') AS last2 FROM parsed),
named AS (
  SELECT page_id, host, path,
    CASE WHEN last2 IN ({_TWO}) AND host <> last2 THEN array_to_string(l[-3:], '.') ELSE last2 END AS domain,
    CASE WHEN last2 IN ({_TWO}) AND host <> last2 THEN last2 ELSE l[-1] END AS suffix FROM split),
judged AS (
  SELECT n.host, n.domain, n.suffix, q.quality FROM named n
  JOIN labels q ON q.doc_id = try_cast(nullif(regexp_extract(n.path, '/([0-9]{{1,18}})', 1), '') AS BIGINT)
  WHERE q.quality IS NOT NULL),
hosts AS (SELECT host, domain, suffix, sum(quality)::DOUBLE AS s, count(*)::DOUBLE AS n FROM judged GROUP BY ALL),
total AS (SELECT (coalesce(sum(s), 0) + 1) / (coalesce(sum(n), 0) + 2) AS p0 FROM hosts){_levels()},
rules(kind, h, p) AS (VALUES {', '.join(str(r) for r in RULES)}),
fits AS (
  SELECT page_id, arg_max(kind, length(h || p)) AS kind, arg_max(h || p, length(h || p)) AS rule
  FROM named JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT n.page_id, n.host, n.path, f.rule,
  coalesce(f.kind, CASE WHEN coalesce(hu.u, du.u, su.u, 0) >= 0.95 THEN 'block' ELSE 'allow' END) AS verdict
FROM named n LEFT JOIN fits f USING (page_id)
LEFT JOIN host_u hu ON hu.name = n.host LEFT JOIN domain_u du ON du.name = n.domain LEFT JOIN suffix_u su ON su.name = n.suffix
"""
