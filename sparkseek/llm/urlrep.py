"""URL filter: host and path rules, and for what no rule fits the reputation of the host.

Reputation is empirical Bayes over labelled page outcomes (1: unwanted). Each of the levels suffix, registered domain and host shrinks
its counts x of n to the posterior mean m of the level above, as a beta-binomial with prior Beta(k m, k (1 - m)); above the suffixes
stands the mean of all outcomes, (X + 1/2) / (N + 1). k is fitted to each level by moments: with S the sum of (x - n m)^2, B that of
n m (1 - m) and D that of n (n - 1) m (1 - m), the correlation of two outcomes of a group is (S - B) / D, and k its odds against, held
between `LEAST_K` and `MOST_K`; `DEFAULT_K` where no group has two outcomes. A host is blocked if the lower posterior bound of its
share of unwanted pages, the mean less three deviations, is over `LIMIT`: by Cantelli's inequality the share is over that bound with a
posterior chance of 9 in 10 at least, whatever the shape. A host without outcomes has the prior of its domain: a new host of a domain that
is bad throughout is blocked, one of a mixed domain isn't.

Defined results: a url that is null or has no `://` has an empty host and path; it meets no rule, and its reputation is that of all
such pages. A path that is empty does not start with a rule's `/`. Of rules equally long the one with the longer host counts, then the
first by text, then a block. Userinfo, port and final dots are no part of a registered domain; an address of digits is a domain of its
own, without suffix. Pages of one page_id are rows of their own; several outcomes of a page_id count as one, unwanted if any is.
Outcomes without page_id or without value are none. Columns of `pages` other than page_id and url aren't read.

What is gathered: one row for each host, written once, and three sums for each level. Rules of one host meet in an array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.functions.sizes import if_small
from sparkseek.llm.common import fresh_name, table
from sparkseek.session import materialise

#: Action and rule (host, then path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Suffixes of two labels under which domains are registered; a parameter.
DOUBLE_SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "com.br", "co.in", "co.za", "com.cn")
#: Share of unwanted pages that a host may have, deviations of the bound, and the range of a prior's weight.
LIMIT, DEVIATIONS, LEAST_K, MOST_K, DEFAULT_K = 0.5, 3.0, 1.0, 10_000.0, 10.0
#: Rows of rules or of hosts that are broadcast at most.
FEW = 10_000
LEVELS = ("suffix", "domain", "host")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """action, rule of some pairs."""
    return spark.createDataFrame(list(rules), "action string, rule string")


def with_rule(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule and action (null where none fits) to rows with host and path.

    A host is looked up once for each number of labels that rules have, by equality, so a large table of rules is an ordinary join."""
    r = rules.where("rule is not null and action in ('allow', 'block')").dropDuplicates(["action", "rule"])
    r = r.withColumn("rule_host", F.translate(F.substring_index("rule", "/", 1), _UPPER, _LOWER))
    r = r.withColumn("rule_path", F.substring("rule", F.length("rule_host") + 1, F.length("rule"))).withColumn("labels", F.size(F.split("rule_host", r"\.")))
    numbers = sorted(x.labels for x in r.select("labels").distinct().collect())
    out, found, hidden, top = pages, [], [], fresh_name(pages, "_best")
    for k in numbers:
        own_host, own_rules = fresh_name(pages, f"_host{k}"), fresh_name(pages, f"_rules{k}")
        hidden.append(own_rules)
        fits = F.struct((F.length("rule_host") + F.length("rule_path")).alias("long"), F.length("rule_host").alias("host_long"), "rule", "action", "rule_path")
        own = r.where(F.col("labels") == k).groupBy(F.col("rule_host").alias(own_host)).agg(F.collect_list(fits).alias(own_rules))
        out = out.join(if_small(own, FEW), F.substring_index("host", ".", -k) == F.col(own_host), "left").drop(own_host)
        found.append(F.coalesce(F.filter(own_rules, lambda x: F.col("path").startswith(x["rule_path"])), F.array()))
    if not found:
        return out.withColumns({"rule": F.lit(None).cast("string"), "action": F.lit(None).cast("string")})

    def before(a: Column, b: Column) -> Column:
        return F.when(a["long"] != b["long"], b["long"] - a["long"]).when(a["host_long"] != b["host_long"], b["host_long"] - a["host_long"]).when(a["rule"] < b["rule"], -1).when(a["rule"] > b["rule"], 1).when(a["action"] > b["action"], -1).otherwise(1)

    best = F.get(F.array_sort(F.concat(*found), before), F.lit(0))
    return out.withColumn(top, best).withColumns({"rule": F.col(f"{top}.rule"), "action": F.col(f"{top}.action")}).drop(top, *hidden)


def registered(host: Column) -> tuple[Column, Column]:
    """Suffix and registered domain."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*\z", ""), r"\.+\z", "")
    address = clean.rlike(r"^[0-9.]*\z") | clean.startswith("[")
    two = F.substring_index(clean, ".", -2)
    double = two.isin(*DOUBLE_SUFFIXES)
    suffix = F.when(address, "").when(double, two).otherwise(F.substring_index(clean, ".", -1))
    return suffix, F.when(address, clean).when(double, F.substring_index(clean, ".", -3)).otherwise(two)


def reputation(hosts: DataFrame) -> DataFrame:
    """hosts: host, n, x (outcomes, unwanted ones). Adds suffix, domain, mean and lower: the posterior mean and the bound of each host's share."""
    suffix, domain = registered(F.col("host"))
    own = materialise(hosts.select("host", F.col("n").cast("double").alias("n"), F.col("x").cast("double").alias("x"), suffix.alias("suffix"), domain.alias("domain")), "hosts")
    of = {
        "suffix": own.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x")),
        "domain": own.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("x").alias("x")),
        "host": own,
    }
    total = own.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"), F.coalesce(F.sum("x"), F.lit(0.0)).alias("x")).first()
    above, by = F.lit((total.x + 0.5) / (total.n + 1)), None
    for level in LEVELS:
        got = of[level].withColumn("m", above) if by is None else of[level].join(if_small(by, FEW), LEVELS[LEVELS.index(level) - 1])
        m, n = F.col("m"), F.col("n")
        s = got.agg(F.sum((F.col("x") - n * m) ** 2).alias("s"), F.sum(n * m * (1 - m)).alias("b"), F.sum(n * (n - 1) * m * (1 - m)).alias("d")).first()
        k = weight(s.s, s.b, s.d)
        if level == "host":
            a, b = F.col("x") + k * m, n - F.col("x") + k * (1 - m)
            mean = a / (a + b)
            return got.select("host", "suffix", "domain", "n", mean.alias("mean"), (mean - DEVIATIONS * F.sqrt(mean * (1 - mean) / (a + b + 1))).alias("lower"))
        by = got.select(level, ((F.col("x") + k * m) / (n + k)).alias("m"))
    raise AssertionError


def weight(s: float | None, b: float | None, d: float | None) -> float:
    """The weight k of a level's prior from its three sums."""
    if not d or s is None or b is None:
        return DEFAULT_K
    rho = (s - b) / d
    return MOST_K if rho <= 0 else min(MOST_K, max(LEAST_K, (1 - rho) / rho))


def judge(pages: DataFrame, outcomes: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, suffix, domain, n_outcomes, unwanted (posterior mean) and unwanted_lower of the host for every page.

    outcomes: page_id, unwanted (0 or 1, or boolean)."""
    host, path = host_and_path(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = outcomes.where("page_id is not null and unwanted is not null").groupBy("page_id").agg(F.max(F.col("unwanted").cast("int")).alias("bad"))
    hosts = p.select("page_id", "host").join(known, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("x"))
    of_host = materialise(reputation(hosts), "reputation")
    got = with_rule(p, rules).join(if_small(of_host, FEW), "host")
    verdict = F.coalesce("action", F.when(F.col("lower") > LIMIT, "block").otherwise("allow"))
    return got.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "suffix", "domain", F.col("n").cast("long").alias("n_outcomes"), F.col("mean").alias("unwanted"), F.col("lower").alias("unwanted_lower"))


def op12_urlrep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no outcomes of pages as such: the row of `labels` with a page's number is taken as its outcome, unwanted if it
    says toxic or of no quality."""
    labels = table(spark, sf_dir, "labels").where("quality is not null or toxic is not null")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), F.expr("coalesce(quality = 0, false) or coalesce(toxic = 1, false)").alias("unwanted"))
    got = judge(table(spark, sf_dir, "pages"), outcomes, rule_table(spark))
    return got.withColumns({c: F.round(c, 6) for c in ("unwanted", "unwanted_lower")})


def _sql() -> str:
    last = lambda k: f"regexp_extract(clean, '([^.]*\\.){{0,{k - 1}}}[^.]*$')"
    doubles = ", ".join(f"'{x}'" for x in DOUBLE_SUFFIXES)
    rules = ", ".join(f"('{a}', '{r}', '{r.split('/')[0]}', '{r[len(r.split('/')[0]) :]}')" for a, r in RULES)
    k = lambda level: (
        f"k_{level} AS (SELECT CASE WHEN coalesce(d, 0) = 0 THEN {DEFAULT_K} WHEN s <= b THEN {MOST_K} ELSE least({MOST_K}, greatest({LEAST_K}, (1 - (s - b) / d) / ((s - b) / d))) END AS k FROM "
        f"(SELECT sum((x - n * m) ** 2) AS s, sum(n * m * (1 - m)) AS b, sum(n * (n - 1) * m * (1 - m)) AS d FROM {level}s))"
    )
    return f"""WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
      p AS (SELECT row_number() OVER () AS i, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
      l AS (SELECT doc_id, max(CASE WHEN coalesce(quality = 0, false) OR coalesce(toxic = 1, false) THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
      h0 AS (SELECT host, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS x, regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '\\.+$', '') AS clean
             FROM p LEFT JOIN l ON doc_id = page_id GROUP BY host),
      h1 AS (SELECT *, regexp_matches(clean, '^[0-9.]*$') OR starts_with(clean, '[') AS address, {last(2)} IN ({doubles}) AS double_ FROM h0),
      h AS (SELECT host, n, x, CASE WHEN address THEN '' WHEN double_ THEN {last(2)} ELSE {last(1)} END AS suffix, CASE WHEN address THEN clean WHEN double_ THEN {last(3)} ELSE {last(2)} END AS domain FROM h1),
      suffixs AS (SELECT suffix, sum(n) AS n, sum(x) AS x, (SELECT (sum(x) + 0.5) / (sum(n) + 1) FROM h) AS m FROM h GROUP BY suffix), {k("suffix")},
      domains AS (SELECT h.suffix, domain, sum(h.n) AS n, sum(h.x) AS x, any_value((s.x + k * m) / (s.n + k)) AS m FROM h JOIN suffixs s USING (suffix), k_suffix GROUP BY h.suffix, domain), {k("domain")},
      hosts AS (SELECT h.*, (d.x + k * m) / (d.n + k) AS m FROM h JOIN domains d USING (domain), k_domain), {k("host")},
      b AS (SELECT *, (x + k * m) / (n + k) AS mean, n + k AS w FROM hosts, k_host),
      c AS (SELECT *, mean - {DEVIATIONS} * sqrt(mean * (1 - mean) / (w + 1)) AS lower FROM b),
      u AS (SELECT * FROM (VALUES {rules}) AS v(action, rule, rule_host, rule_path)),
      f AS (SELECT i, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action FROM p JOIN u ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY i)
      SELECT page_id, p.host, path, rule, coalesce(action, CASE WHEN lower > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, suffix, domain, CAST(n AS BIGINT) AS n_outcomes,
             round(mean, 6) AS unwanted, round(lower, 6) AS unwanted_lower FROM p JOIN c USING (host) LEFT JOIN f USING (i)"""


QUERIES = {"op12_urlrep": op12_urlrep}
ORACLE_SQL = {"op12_urlrep": _sql()}
