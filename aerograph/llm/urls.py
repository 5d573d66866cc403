"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host/path rule (``HostRule``) or a pattern (``Pattern``) in which ``*``
is any text and ``^`` a separator or an end. Every rule is filed under one literal
token, the one that the fewest URLs hold; a URL's tokens fetch candidate rules, and
only those run their regular expression. Rules with no whole literal token are run
on every URL. The longest fitting host/path rule decides; else patterns do (a URL
that a pattern fits is blocked); else the URL is allowed.

A null URL or one without ``://`` has an empty host and path. Rows are judged one
by one, so ties and repeated rows are kept; the result holds only the named columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, cut, over_batches, table

#: At most so many rules are shipped to every worker; more are taken in further passes over the URLs.
MAX_RULES = 1_000_000
TOKEN = re.compile(r"[a-z0-9]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPLIT = re.compile(r"://([^/?#]*)([^?#]*)")


@dataclass(frozen=True)
class HostRule:
    """Fits the host and all its subdomains where the URL's path starts with ``path``."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def regex(self) -> str:
        return rf"(?:[^\0]*\.)?{re.escape(self.host)}\0{re.escape(self.path)}"

    def tokens(self) -> set[str]:
        whole = self.path if re.search(r"[^a-z0-9]\Z", self.path) else re.sub(r"[a-z0-9]*\Z", "", self.path)
        return set(TOKEN.findall(self.host)) | set(TOKEN.findall(re.sub("[A-Z]", "*", whole)) if not re.search("[A-Z]", whole) else ())


@dataclass(frozen=True)
class Pattern:
    """Fits where the lower-case URL holds ``text``; such URLs are blocked."""

    text: str

    def regex(self) -> str:
        return "".join({"*": ".*", "^": r"(?:[^a-z0-9]|\A|\Z)"}.get(c, re.escape(c)) for c in self.text)

    def tokens(self) -> set[str]:
        """Literal runs that separators bound on both sides, so that they are whole tokens of any URL that fits."""
        inner = re.sub(r"(?:(?<=\*)|\A)[a-z0-9]+|[a-z0-9]+(?=\*|\Z)", "*", self.text)
        return set(TOKEN.findall(inner))


#: Fixed rules of the query (host, path), with what they decide.
HOST_RULES = (
    HostRule("allow", "org", "/"),
    HostRule("block", "example.org", "/es/"),
    HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"),
    HostRule("block", "com", "/de/"),
)
#: Patterns that decide where no host/path rule fits.
PATTERNS = tuple(Pattern(x) for x in ("^spam-farm^", "^cheap-pills^", "^casino^", "^free-money^", "^ref^x^", "^adserver^", "^click^track^"))


def split_url(url: str | None) -> tuple[str, str]:
    found = SPLIT.search(url) if url else None
    return (found[1].translate(LOWER), found[2]) if found else ("", "")


def rule_token_counts(df: DataFrame, url: str, wanted: set[str]) -> dict[str, int]:
    """In how many of all URLs each of the rules' tokens stands (at most as many rows as the rules have tokens)."""

    def step(batch: pa.RecordBatch) -> dict:
        counts: dict[str, int] = {}
        for x in batch.column(0).to_pylist():
            for t in wanted.intersection(TOKEN.findall(x.translate(LOWER))) if x else ():
                counts[t] = counts.get(t, 0) + 1
        return {"token": list(counts), "n": list(counts.values())}

    counted = over_batches(df.select(df[url]), "token string, n long", step).groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: r["n"] for r in counted.collect()}


def index_rules(rules, counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rule numbers by their rarest token (ties: the longer, then the first token), and those without one."""
    by_token: dict[str, list[int]] = {}
    always = []
    for k, rule in enumerate(rules):
        if tokens := rule.tokens():
            by_token.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(k)
        else:
            always.append(k)
    return by_token, always


def judged(df: DataFrame, host_rules: list[HostRule], patterns: list[Pattern], first: bool) -> DataFrame:
    """One pass over page_id, url, host, path, rule, action and pattern: what fits better than the passes before found."""
    rules = [*host_rules, *patterns]
    by_token, always = index_rules(rules, rule_token_counts(df, "url", set().union(*(r.tokens() for r in rules))))
    sources, n_hosts = [r.regex() for r in rules], len(host_rules)
    shared = Shared(df.sparkSession, (rules, by_token, always, sources))

    def step(batch: pa.RecordBatch) -> dict:
        rules, by_token, always, sources = shared.value
        compiled: dict[int, re.Pattern] = {}
        out = {"page_id": batch.column(0), "url": batch.column(1), "host": [], "path": [], "rule": [], "action": [], "pattern": []}
        before = zip(*(batch.column(i).to_pylist() for i in (4, 5, 6))) if not first else repeat((None, None, None))
        for raw, (rule, action, pattern) in zip(batch.column(1).to_pylist(), before):
            host, path = split_url(raw)
            low = raw.translate(LOWER) if raw else ""
            tokens = set(TOKEN.findall(low))
            for k in sorted([*always, *(k for t in tokens & by_token.keys() for k in by_token[t])]):
                if k not in compiled:
                    compiled[k] = re.compile(sources[k], re.DOTALL)
                if k < n_hosts:
                    if compiled[k].match(f"{host}\0{path}") and (rule is None or len(rules[k].name) > len(rule)):
                        rule, action = rules[k].name, rules[k].action
                elif pattern is None and compiled[k].search(low):
                    pattern = rules[k].text
            for name, x in zip(("host", "path", "rule", "action", "pattern"), (host, path, rule, action, pattern)):
                out[name].append(x)
        return out

    return over_batches(df, "page_id long, url string, host string, path string, rule string, action string, pattern string", step)


def url_verdicts(df: DataFrame, key: str = "page_id", url: str = "url", host_rules=HOST_RULES, patterns=PATTERNS) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern (the first pattern that fits, where no rule does) of every row.

    Of host/path rules with names of equal length the first in order decides.
    """
    rules, out, first = [*host_rules, *patterns], df.select(df[key].alias("page_id"), df[url].alias("url")), True
    for at in range(0, max(1, len(rules)), MAX_RULES):
        some = rules[at : at + MAX_RULES]
        out = judged(out if first else cut(out, "judged"), [r for r in some if isinstance(r, HostRule)], [r for r in some if isinstance(r, Pattern)], first)
        first = False
    verdict = F.coalesce("action", F.when(F.col("pattern").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNull(), F.col("pattern")).alias("pattern"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


OP10_SQL = """
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS url,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *,
         CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
              WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
              WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts),
matched AS (
  SELECT *, CASE WHEN rule IS NULL THEN list_filter(
    ['^spam-farm^', '^cheap-pills^', '^casino^', '^free-money^', '^ref^x^', '^adserver^', '^click^track^'],
    lambda p: regexp_matches(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), replace(p, '^', '(?:[^a-z0-9]|^|$)')))[1] END AS pattern
  FROM ruled)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       pattern
FROM matched
"""
