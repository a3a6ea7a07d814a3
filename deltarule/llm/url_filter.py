"""Operator 9, URL filters, with DataFrame functions only.

Pattern rules are indexed by their rarest literal token. The tokens of a url fetch the
candidate rules, and only those run their regular expression. Host and path rules are
fetched by the suffixes of the host. Up to PLAN_RULES rules are maps inside the plan, and
pages are never shuffled; more rules are a table, which the tokens and host suffixes of
each distinct url are joined with, for the same result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltarule.llm.common import table

#: Rules that a plan holds; beyond, they are a table.
PLAN_RULES = 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class HostRule:
    """Fits its host and all subdomains, if the path starts with the rule's."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """A regular expression over the lower-cased url; every url that it finds holds all of
    ``literals`` as tokens (runs of a-z and 0-9)."""

    pattern: str
    literals: tuple[str, ...]


def phrase(*words: str) -> PatternRule:
    """The words joined by hyphens, as a whole name within the url."""
    return PatternRule(f"(^|[^a-z0-9]){'-'.join(words)}([^a-z0-9]|$)", words)


HOST_RULES = (
    HostRule("org", "/", "allow"),
    HostRule("example.org", "/es/", "block"),
    HostRule("example.org", "/en/1", "block"),
    HostRule("com", "/fr/", "allow"),
    HostRule("com", "/de/", "block"),
)
PATTERN_RULES = (
    phrase("cheap", "pills"), phrase("free", "bets"), phrase("adult", "x"), phrase("spam", "farm"), phrase("online", "casino"), phrase("payday", "loans"),
    phrase("free", "porn"), phrase("xxx"), PatternRule("^[a-z]+://([^/?#]*[.])?porn[.]", ("porn",)), PatternRule("/wp-login[.]php([?#]|$)", ("wp", "login", "php")),
)


def _a_z(column: Column) -> Column:
    return F.translate(column, _UPPER, _LOWER)


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.split(_a_z(url), "[^a-z0-9]+"))


def index(urls: DataFrame, rules: Sequence[PatternRule]) -> dict[str, list[str]]:
    """Patterns by their rarest literal among all urls; the counts are one for each literal of a rule."""
    literals = sorted({x for r in rules for x in r.literals})
    if not literals:
        return {}
    found = urls.select(F.explode(_tokens(F.col("url"))).alias("token")).filter(F.col("token").isin(literals)).groupBy("token").count().collect()
    count = {x["token"]: x["count"] for x in found}
    out: dict[str, list[str]] = {}
    for rule in rules:
        out.setdefault(min(rule.literals, key=lambda x: (count.get(x, 0), x)), []).append(rule.pattern)
    return out


def judge(pages: DataFrame, hosts: Sequence[HostRule] = HOST_RULES, patterns: Sequence[PatternRule] = PATTERN_RULES) -> DataFrame:
    """pages (any frame with url) with host, path, rule and verdict, replacing columns of these names.

    Of fitting host rules the longest wins (ties: the name that sorts last) and gives rule
    and verdict; else rule is null and the verdict is block if a pattern is found, else
    allow. A null url, or one without ``://``, has empty host and path; equal urls have equal
    verdicts, and an empty table gives an empty result.
    """
    made = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c not in made]
    row = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row")
    url = F.coalesce(F.col("url"), F.lit(""))
    if len(hosts) + len(patterns) > PLAN_RULES:
        judged = _joined(pages.select(url.alias("url")).distinct(), hosts, patterns)
        rows = pages.select(row, url.alias("url"))
        # on a hash of the url, so that the rows of a hot url can be split
        rows = rows.withColumn("by", F.xxhash64("url")).join(judged.withColumn("by", F.xxhash64("url")).withColumnRenamed("url", "of"), "by").filter("url = of")
        return rows.select("row.*", *made)
    rows = _parts(pages.select(row, url.alias("url"))).withColumn("best", _best(hosts))
    block = _found(index(pages.select("url"), patterns), F.col("url"))
    return rows.select("row.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.when(block, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def _parts(urls: DataFrame) -> DataFrame:
    """urls (with url, never null) with host and path."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return urls.withColumn("host", _a_z(F.regexp_extract(rest, "^[^/?#]*", 0))).withColumn("path", F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def _joined(urls: DataFrame, hosts: Sequence[HostRule], patterns: Sequence[PatternRule]) -> DataFrame:
    """url (each once), host, path, rule and verdict, by joins with tables of the rules."""
    spark = urls.sparkSession
    rows = _parts(urls)
    held = spark.createDataFrame([(r.host, r.path, len(r.name), r.name, r.verdict) for r in hosts], "at string, begin string, length int, rule string, says string")
    asked = rows.select("url", "path", F.explode(F.array_distinct(_suffixes())).alias("at"))
    best = asked.join(held, "at").filter(F.col("path").startswith(F.col("begin"))).groupBy("url").agg(F.max(F.struct("length", "rule", "says")).alias("best"))
    listed = [(t, p) for t, found in index(urls, patterns).items() for p in found]
    tokens = urls.select("url", F.explode(_tokens(F.col("url"))).alias("token"))
    hit = tokens.join(spark.createDataFrame(listed, "token string, pattern string"), "token").filter(F.rlike(_a_z(F.col("url")), F.col("pattern"))).select("url").distinct()
    rows = rows.join(best, "url", "left").join(hit.withColumn("hit", F.lit(True)), "url", "left")
    return rows.select("url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.says", F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def _suffixes() -> Column:
    """The host and each of its parent domains."""
    labels = F.split("host", "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _map(items: dict[str, Column]) -> Column:
    return F.create_map(*(x for k, v in items.items() for x in (F.lit(k), v)))


def _best(hosts: Sequence[HostRule]) -> Column:
    kind = "struct<length:int,rule:string,verdict:string>"
    if not hosts:
        return F.lit(None).cast(kind)
    by_host: dict[str, list[HostRule]] = {}
    for rule in hosts:
        by_host.setdefault(rule.host, []).append(rule)
    entry = lambda r: F.struct(F.lit(r.path).alias("path"), F.lit(len(r.name)).alias("length"), F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
    held = _map({h: F.array(*map(entry, rules)) for h, rules in by_host.items()})
    found = F.flatten(F.transform(F.filter(_suffixes(), lambda h: F.map_contains_key(held, h)), lambda h: F.element_at(held, h)))
    fitting = F.filter(found, lambda r: F.col("path").startswith(r["path"]))
    return F.array_max(F.transform(fitting, lambda r: F.struct(r["length"].alias("length"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def _found(held: dict[str, list[str]], url: Column) -> Column:
    if not held:
        return F.lit(False)
    by_token = _map({t: F.array(*map(F.lit, patterns)) for t, patterns in held.items()})
    low = _a_z(url)
    asked = F.filter(_tokens(url), lambda t: F.map_contains_key(by_token, t))
    return F.exists(F.flatten(F.transform(asked, lambda t: F.element_at(by_token, t))), lambda p: F.rlike(low, p))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator over all pages."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


SQL = rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(url, '{_UPPER}', '{_LOWER}') AS low, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(host, path, verdict) AS (VALUES {", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in HOST_RULES)}),
f AS (SELECT h.page_id, h.low, h.host, h.path, max({{'n': length(r.host || r.path), 'rule': r.host || r.path, 'verdict': r.verdict}}) AS best
      FROM h LEFT JOIN r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path) GROUP BY ALL)
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.verdict, CASE WHEN {" OR ".join(f"regexp_matches(low, '{r.pattern}')" for r in PATTERN_RULES)} THEN 'block' ELSE 'allow' END) AS verdict FROM f
"""
