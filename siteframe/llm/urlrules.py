"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern with an action. Its literal parts give tokens that any address it fits must
have; the rule is filed under that token which the fewest rules have. An address is cut into its tokens, these
fetch the candidate rules by an equality join, and only candidates run their regular expression. Rules without
a token are filed under the empty token, which every address has.

Patterns match the host in lower case followed by the path. `||name/path` fits a host, its subdomains and paths that start
so; `|` ties a pattern to the begin or end; `*` is any run; `^` is a separator or the end.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteframe.llm.common import BROADCAST_ROWS, lower_az

#: Rules of hosts and paths: the longest that fits decides.
HOST_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Rules of the method for addresses that no host rule fits: any that blocks decides unless one that allows fits, too.
PATTERN_RULES = (
    ("block", "||ads.*^"), ("block", "||ad.*^"), ("block", "||track.*^"), ("block", "||doubleclick.*^"), ("block", "/banner/"), ("block", "/adserver/"),
    ("block", "^casino^"), ("block", "^porn^"), ("block", "^xxx^"), ("block", "^viagra^"), ("block", "^warez^"), ("block", "^torrent^"),
    ("block", "/login^"), ("block", "/signup^"), ("block", "/cart^"), ("block", "/checkout^"), ("block", "/wp-admin/"), ("block", "/cgi-bin/"),
    ("block", ".exe|"), ("block", ".zip|"), ("block", ".jpg|"), ("block", ".png|"), ("block", ".mp4|"), ("allow", "/wiki/"), ("allow", "/help/login^"),
)
_TOKEN = re.compile("[a-z0-9]+")
#: A separator of patterns, for Java's and DuckDB's regular expressions alike.
SEPARATOR = "(?:[^A-Za-z0-9_.%-]|\\z)"


@dataclass(frozen=True)
class Rule:
    number: int
    name: str
    action: str
    regex: str
    token: str
    host_rule: bool
    length: int


def pattern_regex(pattern: str) -> str:
    """The regular expression of a pattern, over host and path."""
    if pattern.startswith("||"):
        head, rest = "^(?:[^/]*[.])?", pattern[2:]
    elif pattern.startswith("|"):
        head, rest = "^", pattern[1:]
    else:
        head, rest = "", pattern
    tail, rest = ("\\z", rest[:-1]) if rest.endswith("|") else ("", rest)
    body = "".join("(?s:.*)" if c == "*" else SEPARATOR if c == "^" else c if c.isalnum() else f"[{c}]" if c not in "\\[]^" else "\\" + c for c in rest)
    return head + body + tail


def pattern_tokens(pattern: str) -> list[str]:
    """Tokens that every address has which the pattern fits: runs of letters and digits with a known border on both sides."""
    start_known = pattern.startswith("|")
    rest = pattern.lstrip("|")
    end_known = rest.endswith("|")
    rest = rest.rstrip("|").lower()
    out = []
    for m in _TOKEN.finditer(rest):
        before = start_known if m.start() == 0 else rest[m.start() - 1] != "*"
        after = end_known if m.end() == len(rest) else rest[m.end()] != "*"
        if before and after:
            out.append(m[0])
    return out


def compile_rules(host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> list[Rule]:
    """Rules with their regular expression and rarest token; of equally rare ones the longest, then the first."""
    named = [(a, p, "||" + p, True) for a, p in host_rules] + [(a, p, p, False) for a, p in pattern_rules]
    tokens = [pattern_tokens(pattern) for _, _, pattern, _ in named]
    often = Counter(t for ts in tokens for t in set(ts))
    rarest = [min(ts, key=lambda t: (often[t], -len(t), t)) if ts else "" for ts in tokens]
    return [Rule(i, name, action, pattern_regex(pattern), token, host, len(name))
            for i, ((action, name, pattern, host), token) in enumerate(zip(named, rarest, strict=True))]


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(r.number, r.name, r.action, r.regex, r.token, r.host_rule, r.length) for r in rules]
    table = spark.createDataFrame(rows, "number int, name string, action string, regex string, token string, host_rule boolean, length int")
    return F.broadcast(table) if len(rules) <= BROADCAST_ROWS else table


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z in lower case; empty if there is no ://."""
    return lower_az(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: list[Rule] | None = None, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) of every row.

    verdict is that of the longest host rule that fits (the first of equally long ones), else block if a pattern that blocks
    fits and none that allows does, else allow; pattern is the first such pattern. A null address, and one without
    ://, has an empty host and path, and no host rule. Repeated rows each get their row, an empty table an empty result. Other columns
    are not read.
    """
    rules = compile_rules() if rules is None else rules
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    # Equal addresses have equal verdicts: each is judged once.
    distinct = rows.select("host", "path").distinct()
    subject = F.concat("host", "path")
    tokens = F.array_distinct(F.concat(F.regexp_extract_all(lower_az(subject), F.lit("[a-z0-9]+"), F.lit(0)), F.array(F.lit(""))))
    fetched = distinct.select("host", "path", F.explode(tokens).alias("token")).join(rule_table(pages.sparkSession, rules), "token")
    hits = fetched.filter(F.regexp_like(subject, F.col("regex")))
    best = F.struct((-F.col("length")).alias("l"), F.col("number"), F.col("name"), F.col("action"))
    first = F.struct("number", "name", "action")
    found = hits.groupBy("host", "path").agg(
        F.min(F.when(F.col("host_rule"), best)).alias("h"),
        F.min(F.when(~F.col("host_rule") & (F.col("action") == "block"), first)).alias("b"),
        F.min(F.when(~F.col("host_rule") & (F.col("action") == "allow"), first)).alias("a"))
    pattern = F.when(F.col("h").isNull(), F.coalesce(F.col("a.name"), F.col("b.name")))
    verdict = F.when(F.col("h").isNotNull(), F.col("h.action")).when(F.col("b").isNotNull() & F.col("a").isNull(), "block").otherwise("allow")
    judged = found.select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.col("h.name").alias("rule"), verdict.alias("found"), pattern.alias("pattern"))
    return (rows.join(judged, (F.col("host") == F.col("__h")) & (F.col("path") == F.col("__p")), "left")
            .select("page_id", "host", "path", "rule", F.coalesce("found", F.lit("allow")).alias("verdict"), "pattern"))
