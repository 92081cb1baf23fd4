"""URL filters: rules indexed by their rarest literal token.

A rule is a pattern over ``host + path`` of a URL. Every alphanumeric run of
its text that must appear as a whole token in any URL it matches is one of its
literals. The token counts over all distinct URLs tell which literal is
rarest; the rule is indexed under that one. The tokens of a URL fetch the
rules indexed under them, and only for those the regular expression runs. A
rule without a literal is indexed under the empty token, which every URL has.

Only DataFrame functions are used. The final look-up joins on host + path, so
texts of pages never move; equal URLs are judged once. Rows of a URL that very many
pages have meet its verdict by broadcast (``operators.skew``), all others by a shuffle. A null URL, or one
without ``://``, has an empty host and path and is judged as such. Very long URLs are read whole. Repeated
rows give repeated rows, an empty table an empty result. Of rules that match,
host rules go before patterns, then the longest text wins, then the rule's
text in order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowsmith.llm.common import stored, table
from rowsmith.operators.skew import join_unique

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rules go to every task; their index has one row a rule.
MAX_BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    """``host`` with ``path`` fits that host and its subdomains where the path starts with ``path``; without
    ``host``, ``path`` is a pattern found anywhere in host + path, in which ``*`` stands for any text."""
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        if self.host:
            return rf"^(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}"
        return "(?s)" + ".*".join(re.escape(x) for x in self.path.split("*"))

    def literals(self) -> list[str]:
        """Runs that are whole tokens in every match: a letter or digit, or ``*``, next to a run makes it open."""
        text = ("." if self.host else "*") + self.text.lower() + "*"
        return sorted(set(re.findall(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])", text)))


# The rules the query is asked to apply.
HOST_RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
# For URLs that no host rule fits.
PATTERN_RULES = (
    Rule("block", "", "-pills."),
    Rule("block", "", "-farm."),
    Rule("block", "", "casino"),
    Rule("block", "", "/login/*.php"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _tokens(subject: Column) -> Column:
    return F.array_union(F.split(F.lower(subject), "[^a-z0-9]+"), F.array(F.lit("")))


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """The rules as rows: text, verdict, rank (host rules first, then length), regex, literals."""
    rows = F.array(*[F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"),
                              F.lit(bool(r.host)).alias("is_host"), F.lit(len(r.text)).alias("n"),
                              F.lit(r.regex).alias("regex"),
                              F.array(*map(F.lit, r.literals() or [""])).alias("literals")) for r in rules])
    return spark.range(1).select(F.inline(rows))


def rarest_token_index(subjects: DataFrame, rules: DataFrame) -> DataFrame:
    """One row a rule with the literal that the fewest of all ``subjects`` have (ties: the first in order)."""
    literals = rules.select("rule", "regex", F.explode("literals").alias("token"))
    counts = (subjects.select(F.explode(_tokens(F.col("subject"))).alias("token"))
              .join(F.broadcast(literals.select("token").distinct()), "token")
              .groupBy("token").agg(F.count("*").alias("found")))
    rarest = (literals.join(counts, "token", "left").groupBy("rule", "regex")
              .agg(F.min(F.struct(F.coalesce("found", F.lit(0)).alias("found"), "token")).alias("pick")))
    return (rules.join(rarest, ["rule", "regex"])
            .select(F.col("pick.token").alias("token"), "rule", "verdict", "is_host", "n", "regex"))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...], id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """Per row of ``pages``: id, host, path, the deciding rule's text (null: none), whether it is a host rule, verdict."""
    if not rules:
        raise ValueError("no rules given")
    spark = pages.sparkSession
    url = F.coalesce(F.col(url_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    # every different URL is judged once; how often it comes tells which ones may not meet in one task
    counted = stored(rows.groupBy(F.concat("host", "path").alias("subject")).agg(F.count("*").alias("times")), "url_subjects")
    subjects = counted.select("subject")
    index = rarest_token_index(subjects, rule_table(spark, rules))
    if len(rules) <= MAX_BROADCAST_RULES:
        index = F.broadcast(index)
    best = stored(subjects.select("subject", F.explode(_tokens(F.col("subject"))).alias("token"))
            .join(index, "token").where(F.regexp_like("subject", F.col("regex")))
            .groupBy("subject")
            # the smallest of (pattern before host: no, length descending, text) by negated keys
            .agg(F.min(F.struct((~F.col("is_host")).alias("by_pattern"), (-F.col("n")).alias("longer"),
                                "rule", "verdict")).alias("best")), "url_best")
    return (join_unique(rows.withColumn("subject", F.concat("host", "path")), best, ["subject"], "left", counts=(counted, "times"))
            .select(id_col, "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce(~F.col("best.by_pattern"), F.lit(False)).alias("by_host_rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page's URL: ``rule`` names the host rule that decided; a URL without one gets the patterns' verdict."""
    judged = judge_urls(table(spark, sf_dir, "pages"), HOST_RULES + PATTERN_RULES)
    return judged.select("page_id", "host", "path", F.when(F.col("by_host_rule"), F.col("rule")).alias("rule"), "verdict")


OP3_SQL = r"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)),
fits AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN contains(host || path, '-pills.') OR contains(host || path, '-farm.') OR contains(host || path, 'casino')
         OR regexp_matches(host || path, '/login/(.|\n)*\.php') THEN 'block'
       ELSE 'allow' END AS verdict
FROM fits
"""
