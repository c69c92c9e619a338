"""Verdicts on urls: listed rules first, else an empirical-Bayes reputation of the host.

Outcomes are urls with a label (bad or not). Counts of a host are shrunk towards its registered domain, the domain's towards
its suffix, and the suffix's towards all outcomes, by beta-binomial priors. A prior's mean is the parent's own posterior mean
without the child's outcomes, so none counts twice. Its strength, one number a level, comes from the data by moments: how far
children scatter about their parents beyond what binomial draws would. A host is blocked if the lower bound of its posterior
rate (`z` standard deviations below the mean) lies above `limit`. Hosts without outcomes have their domain's prior, so a bad
domain takes new subdomains with it; one bad page of an unknown host does not block it.

All sums are of whole numbers (spreads in millionths), so results do not depend on the order of rows. What is joined is one
row a host, a domain or a suffix; nothing is collected but three strengths and the overall rate. A host that holds a third
of all pages meets its one row in a sort-merge join, which adaptive execution splits.

Cases: a url that is null or has no "://" has an empty host and path, which no rule fits and which share one reputation;
a null label is no outcome; repeated rows count and are judged as often as they occur; without any outcome every host has
the same flat prior and nothing is blocked; an empty table gives no rows; other columns of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Bounds of the correlation within children: a prior is worth (1 - rho) / rho outcomes, 3 at least, so few children prove little.
RHO = (1e-6, 0.25)


class Rule(NamedTuple):
    """A host with its subdomains, and what their paths start with."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(line: str) -> Rule:
    """`block example.com/de/` as a rule; everything from the first slash is the path."""
    action, _, place = line.strip().partition(" ")
    host, slash, path = place.partition("/")
    if action not in ("allow", "block") or not host:
        raise ValueError(f"not a rule: {line!r}")
    return Rule(action, host.translate(str.maketrans(UPPER, LOWER)), slash + path)


def host_of(url: Column) -> Column:
    """What stands between the first :// and the path, A-Z in lower case; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """The path up to ? or #; empty without a ://."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, action) of the longest rule that fits, else null; of two actions for one place, block."""
    found = F.lit(None).cast("struct<rule:string,action:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text, r.action)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.action).alias("action"))).otherwise(found)
    return found


def site(host: Column) -> Column:
    """The name that reputations go by: the host without user, port and closing dot."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"(:[0-9]*)?\.?$", "")


def suffix_of(name: Column, suffixes: Sequence[str]) -> Column:
    """The longest listed suffix of a name, else its last label; an address is its own."""
    labels = F.split(name, r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    listed = F.get(F.filter(tails, lambda t: t.isin(*suffixes)), F.lit(0)) if suffixes else F.lit(None)
    return F.when(name.rlike(r"^[0-9]+(\.[0-9]+){3}$"), name).otherwise(F.coalesce(listed, F.element_at(labels, -1)))


def domain_of(name: Column, suffix: Column) -> Column:
    """The suffix and the label before it."""
    rest = F.substring(name, F.lit(1), F.length(name) - F.length(suffix) - 1)
    return F.when(F.length(name) <= F.length(suffix) + 1, name).otherwise(F.concat_ws(".", F.element_at(F.split(rest, r"\."), -1), suffix))


def _spread(children: DataFrame) -> DataFrame:
    """Sums over children (n, k) of parents (n_p, k_p): squared deviations, and what binomial draws and full agreement would give."""
    n, n_p = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n", "n_p"))  # never a division by 0
    k = F.col("k").cast("double")
    parent = F.col("k_p").cast("double") / n_p
    away = k / n - parent
    draw = parent * (1.0 - parent)
    own = 1.0 - n / n_p
    whole = lambda x: F.sum(F.floor(x * 1e6).cast("long"))
    return children.where("n > 0").agg(
        whole(n * away * away).alias("seen"), whole(draw * own).alias("drawn"), whole(draw * own * n).alias("full"),
    )


def strength(seen: int | None, drawn: int | None, full: int | None) -> float:
    """How many outcomes a prior is worth: (1 - rho) / rho, rho being the correlation within children by moments."""
    least, most = RHO
    rho = (seen - drawn) / (full - drawn) if seen is not None and full > drawn else least
    rho = min(most, max(least, rho))
    return (1.0 - rho) / rho


def _counts(outcomes: DataFrame, url_col: str, bad_col: str, names: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """name, domain, suffix, n, k: of all names, those without outcomes included."""
    bad = outcomes.where(F.col(bad_col).isNotNull()).select(site(host_of(F.col(url_col))).alias("host"), F.col(bad_col).cast("int").alias("bad"))
    known = bad.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("k"))
    zero = F.lit(0).cast("long")
    rows = known.unionByName(names.select("host").distinct().select("host", zero.alias("n"), zero.alias("k")))
    suffix = suffix_of(F.col("host"), suffixes)
    rows = rows.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("suffix", suffix)
    return rows.withColumn("domain", domain_of(F.col("host"), F.col("suffix")))


def reputations(
    outcomes: DataFrame, names: DataFrame, suffixes: Sequence[str] = (), z: float = 1.2816,
    url_col: str = "url", bad_col: str = "bad",
) -> DataFrame:
    """host, domain, suffix, n, k, alpha, beta, lower: the posterior of each host of the outcomes and of `names` (column host)."""
    hosts = stored(_counts(outcomes, url_col, bad_col, names, suffixes), "url-hosts")
    up = {"n": F.sum("n").alias("n"), "k": F.sum("k").alias("k")}
    domains = stored(hosts.groupBy("domain", "suffix").agg(*up.values()), "url-domains")
    ends = domains.groupBy("suffix").agg(*up.values())
    total = ends.agg(*up.values()).first()
    n_all, k_all = (total["n"] or 0), (total["k"] or 0)
    everywhere = (k_all + 0.5) / (n_all + 1.0)

    above = lambda df: df.select(*[F.col(c) for c in df.columns if c not in ("n", "k")], F.col("n").alias("n_p"), F.col("k").alias("k_p"))
    of_host, of_domain, of_suffix = (
        strength(*_spread(rows).first())
        for rows in (
            hosts.join(above(domains), ["domain", "suffix"]), domains.join(above(ends), "suffix"),
            ends.withColumns({"n_p": F.lit(n_all), "k_p": F.lit(k_all)}),
        )
    )
    mean = lambda k, n, many, prior: (k.cast("double") + many * prior) / (n.cast("double") + many)
    n, k = F.col("n"), F.col("k")
    at_suffix = mean(F.col("k_p") - k, F.col("n_p") - n, of_suffix, F.lit(everywhere))
    inner = domains.join(above(ends), "suffix").select("domain", "suffix", F.col("n").alias("n_p"), F.col("k").alias("k_p"), at_suffix.alias("prior"))
    prior = mean(F.col("k_p") - k, F.col("n_p") - n, of_domain, F.col("prior"))
    rows = hosts.join(inner, ["domain", "suffix"]).withColumn("prior", prior)
    rows = rows.withColumns({"alpha": k.cast("double") + of_host * F.col("prior"), "beta": (n - k).cast("double") + of_host * (1.0 - F.col("prior"))})
    a, b = F.col("alpha"), F.col("beta")
    size = a + b
    lower = a / size - z * F.sqrt(a * b / (size * size * (size + 1.0)))
    return rows.select("host", "domain", "suffix", "n", "k", "alpha", "beta", lower.alias("lower"))


def judged(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], suffixes: Sequence[str] = (), limit: float = 0.5, z: float = 1.2816,
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """A row for each page: id, host, path, rule, verdict, by_rule, domain, n_labelled, lower."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumn("name", site(F.col("host")))
    known = reputations(outcomes, rows.select(F.col("name").alias("host")), suffixes, z, url_col)
    known = known.select(F.col("host").alias("name"), "domain", F.col("n").alias("n_labelled"), F.round("lower", 6).alias("lower"), (F.col("lower") > limit).alias("bad"))
    found = rows.join(stored(known, "url-reputation"), "name", "left").withColumn("_r", fitting_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("_r.action"), F.when(F.col("bad"), "block").otherwise("allow"))
    return found.select(
        id_col, "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"), F.col("_r").isNotNull().alias("by_rule"),
        "domain", "n_labelled", "lower",
    )


# --- the same in SQL ------------------------------------------------------------------------------------------------


def _listed(values: Sequence[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _rule_sql(rules: Sequence[Rule], what: str) -> str:
    """The same choice as CASE branches, longest first."""
    ordered = sorted(rules, key=lambda r: (len(r.text), r.text, r.action), reverse=True)
    arm = lambda r: f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, what)}'"
    return "CASE " + " ".join(map(arm, ordered)) + " END"


def judged_sql(outcomes: str, rules: Sequence[Rule], suffixes: Sequence[str], limit: float = 0.5, z: float = 1.2816) -> str:
    """DuckDB SQL for `judged` over the table pages; outcomes: a query that gives url and bad."""
    host = rf"coalesce(translate(regexp_extract(url, '{PARTS}', 1), '{UPPER}', '{LOWER}'), '')"
    name = r"regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*)?\.?$', '')"
    tails = "list_filter(list_transform(range(1, len(labels) + 1), lambda i: array_to_string(labels[i:], '.')), lambda t: t IN (" + (_listed(suffixes) or "NULL") + "))[1]"
    spread = """SELECT sum(floor(n * (k / n - p) * (k / n - p) * 1e6)::BIGINT) AS seen, sum(floor(p * (1.0::DOUBLE - p) * (1.0::DOUBLE - n / n_p) * 1e6)::BIGINT) AS drawn,
      sum(floor(p * (1.0::DOUBLE - p) * (1.0::DOUBLE - n / n_p) * n * 1e6)::BIGINT) AS full
    FROM (SELECT n::DOUBLE AS n, k::DOUBLE AS k, n_p::DOUBLE AS n_p, k_p::DOUBLE / n_p::DOUBLE AS p FROM {rows} WHERE n > 0)"""
    levels = {
        "host": "(SELECT h.n, h.k, d.n AS n_p, d.k AS k_p FROM hosts h JOIN domains d USING (domain, suffix))",
        "domain": "(SELECT d.n, d.k, s.n AS n_p, s.k AS k_p FROM domains d JOIN ends s USING (suffix))",
        "suffix": "(SELECT s.n, s.k, t.n AS n_p, t.k AS k_p FROM ends s, total t)",
    }
    rho = f"least({RHO[1]}::DOUBLE, greatest({RHO[0]}::DOUBLE, CASE WHEN seen IS NOT NULL AND \"full\" > drawn THEN (seen - drawn)::DOUBLE / (\"full\" - drawn)::DOUBLE ELSE {RHO[0]}::DOUBLE END))"
    strengths = ", ".join(f"m_{lvl} AS (SELECT (1.0::DOUBLE - rho) / rho AS m FROM (SELECT {rho} AS rho FROM ({spread.format(rows=rows)})))" for lvl, rows in levels.items())
    return rf"""
WITH urls AS (SELECT page_id, {host} AS host, coalesce(regexp_extract(url, '{PARTS}', 2), '') AS path FROM pages),
rows AS (SELECT *, {name} AS name FROM urls),
labelled AS (SELECT {name} AS name, bad FROM (SELECT {host} AS host, bad FROM ({outcomes}) WHERE bad IS NOT NULL)),
counted AS (SELECT name, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k, string_split(name, '.') AS labels FROM (
  SELECT name, 1 AS n, bad::INT AS k FROM labelled UNION ALL SELECT DISTINCT name, 0, 0 FROM rows) GROUP BY name),
ended AS (SELECT *, CASE WHEN regexp_matches(name, '^[0-9]+(\.[0-9]+){{3}}$') THEN name ELSE coalesce({tails}, labels[-1]) END AS suffix FROM counted),
hosts AS (SELECT *, CASE WHEN length(name) <= length(suffix) + 1 THEN name
  ELSE string_split(substr(name, 1, length(name) - length(suffix) - 1), '.')[-1] || '.' || suffix END AS domain FROM ended),
domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM hosts GROUP BY ALL),
ends AS (SELECT suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM domains GROUP BY ALL),
total AS (SELECT sum(n)::BIGINT AS n, sum(k)::BIGINT AS k, (sum(k)::DOUBLE + 0.5) / (sum(n)::DOUBLE + 1.0) AS rate FROM ends),
{strengths},
inner_ AS (SELECT d.domain, suffix, d.n AS n_p, d.k AS k_p,
  ((s.k - d.k)::DOUBLE + m * rate) / ((s.n - d.n)::DOUBLE + m) AS prior FROM domains d JOIN ends s USING (suffix), total, m_suffix),
outer_ AS (SELECT name, domain, h.n, h.k, ((k_p - h.k)::DOUBLE + m * prior) / ((n_p - h.n)::DOUBLE + m) AS prior FROM hosts h JOIN inner_ USING (domain, suffix), m_domain),
post AS (SELECT name, domain, n, k::DOUBLE + m * prior AS a, (n - k)::DOUBLE + m * (1.0::DOUBLE - prior) AS b FROM outer_, m_host),
known AS (SELECT name, domain, n, a / (a + b) - {z}::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * ((a + b) + 1.0::DOUBLE))) AS lower FROM post)
SELECT page_id, host, path, {_rule_sql(rules, 'text')} AS rule,
  coalesce({_rule_sql(rules, 'action')}, CASE WHEN lower > {limit} THEN 'block' ELSE 'allow' END) AS verdict,
  {_rule_sql(rules, 'text')} IS NOT NULL AS by_rule, domain, n AS n_labelled, round(lower, 6) AS lower
FROM rows JOIN known USING (name)
"""
