"""URL filters: pattern rules looked up by their rarest literal token.

A rule is a regular expression over ``host + path`` and the literal tokens
(runs of ASCII letters and digits) that every URL it fits must hold as whole
tokens.  Each rule is filed under that one of its tokens that the fewest URLs
hold, counted over all URLs.  A URL's tokens fetch the rules filed under them,
and only those run their regular expression; rules without a literal token are
always candidates.  The judging pass is one map over the URL column: nothing is
shuffled, so a host with a third of all pages costs nothing extra.

Rules are configuration: they are shipped to every task, and a rule set larger
than ``MAX_RULE_BYTES`` is refused.

Defined results: a null URL, or one without ``://``, has empty host and path and
fits no rule; it is allowed.  An empty table gives an empty result; repeated
rows are judged one by one.  Of two fitting host rules the longer rule string
wins, of equally long ones the earlier.  Pattern rules decide only where no host
rule fits, the earliest first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfarer.llm.tables import fresh

MAX_RULE_BYTES = 64 << 20
TOKEN = re.compile("[A-Za-z0-9]+")
URL = re.compile("://([^/?#]*)([^?#]*)")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """``name`` is reported; ``weight`` ranks fitting rules (0 for pattern rules)."""
    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int = 0


def host_rule(verdict: str, text: str) -> Rule:
    """A rule ``host/path``: fits the host, its subdomains, and paths that start so."""
    slash = text.index("/")
    host, path = text[:slash], text[slash:]
    found = list(TOKEN.finditer(text))
    # The last token may go on in the URL, as paths are prefixes: it is no whole token then.
    whole = [m.group() for m in found if m.end() < len(text)]
    return Rule(text, verdict, rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(whole),
                len(text))


def word_rule(word: str) -> Rule:
    """Blocks hosts with ``word`` as a whole part between dots and hyphens."""
    return Rule(f"host:{word}", "block", rf"(?:[^/]*[.-])?{re.escape(word)}(?:[.-][^/]*)?(?:/|$)",
                tuple(TOKEN.findall(word)))


HOST_RULES = (
    host_rule("allow", "org/"),
    host_rule("block", "example.org/es/"),
    host_rule("block", "example.org/en/1"),
    host_rule("allow", "com/fr/"),
    host_rule("block", "com/de/"),
)
WORDS = ("spam", "pills", "casino", "viagra", "porn", "xxx", "malware", "phishing", "warez")
PATTERN_RULES = tuple(word_rule(w) for w in WORDS)


def split_url(url: str | None) -> tuple[str, str]:
    m = URL.search(url) if url is not None else None
    return (m[1].translate(LOWER), m[2]) if m else ("", "")


def token_counts(urls: DataFrame, column: str, rules) -> dict[str, int]:
    """URLs that hold each rule token: one aggregation over all URLs, a row per rule token."""
    spark = urls.sparkSession
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    ask = spark.createDataFrame([(t,) for t in wanted], "token string")
    target = F.regexp_extract(column, URL.pattern, 1)
    path = F.regexp_extract(column, URL.pattern, 2)
    tokens = F.array_distinct(F.split(F.concat(F.lower(target), path), "[^A-Za-z0-9]+"))
    held = urls.select(F.explode(tokens).alias("token")).join(ask, "token").groupBy("token").count()
    return {r["token"]: r["count"] for r in held.collect()}  # at most the rules' tokens


class RuleIndex:
    """Rules filed under their rarest token."""

    def __init__(self, rules, counts: dict[str, int]):
        self.by_token: dict[str, list] = {}
        self.always: list = []
        for order, rule in enumerate(rules):
            entry = (-rule.weight, order, re.compile(rule.pattern), rule)
            if rule.tokens:
                rarest = min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t))
                self.by_token.setdefault(rarest, []).append(entry)
            else:
                self.always.append(entry)

    def best(self, target: str):
        """(the rule that wins, candidates tried) for ``host + path``."""
        found = list(self.always)
        for token in set(TOKEN.findall(target)):
            found += self.by_token.get(token, ())
        found.sort(key=lambda e: e[:2])
        for tried, (_, _, pattern, rule) in enumerate(found, 1):
            if pattern.match(target):
                return rule, tried
        return None, len(found)


VERDICT = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()),
                        T.StructField("rule", T.StringType()),
                        T.StructField("verdict", T.StringType()),
                        T.StructField("pattern", T.StringType())])


def judge_urls(df: DataFrame, url: str = "url", *, host_rules=HOST_RULES,
               pattern_rules=PATTERN_RULES, default: str = "allow") -> DataFrame:
    """All columns of ``df`` and, last, a struct column ``url_verdict``.

    Its fields: host, path, rule (the host rule that won), verdict, pattern (the
    pattern rule that decided where no host rule did).
    """
    rules = (*host_rules, *pattern_rules)
    size = sum(len(r.name) + len(r.pattern) + 200 for r in rules)
    if size > MAX_RULE_BYTES:
        raise ValueError(f"the rules take about {size} bytes; at most {MAX_RULE_BYTES} are shipped")
    counts = token_counts(df, url, rules)
    out = fresh(df, "url_verdict")[0]
    kind = pa.struct([(f.name, pa.string()) for f in VERDICT.fields])

    def run(batches):
        index = RuleIndex(rules, counts)
        for batch in batches:
            rows = []
            for value in batch.column(url).to_pylist():
                host, path = split_url(value)
                rule, _ = index.best(host + path)
                named = rule is not None and rule.weight > 0
                rows.append({"host": host, "path": path, "rule": rule.name if named else None,
                             "verdict": rule.verdict if rule else default,
                             "pattern": rule.name if rule and not named else None})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)],
                                             [*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, VERDICT)]))


def query(spark, sf_dir) -> DataFrame:
    """op1: the verdict on every page's URL."""
    from wayfarer.session import read_table

    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", *[f"url_verdict.{f.name}" for f in VERDICT.fields])


def _sql() -> str:
    fits = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    by_length = sorted(HOST_RULES, key=lambda r: -r.weight)
    cases = {"rule": "", "verdict": ""}
    for r in by_length:
        h, p = r.name.split("/", 1)
        for c in cases:
            cases[c] += f" WHEN {fits.format(h=h, p='/' + p)} THEN '{r.name if c == 'rule' else r.verdict}'"
    named = "".join(rf" WHEN regexp_matches(host, '(^|[.-]){w}([.-]|$)') AND (path <> '' OR host <> '')"
                    f" THEN 'host:{w}'" for w in WORDS)
    return f"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (
  SELECT *, CASE{cases['rule']} END AS rule, CASE{cases['verdict']} END AS by_rule,
    CASE{named} END AS word FROM u)
SELECT page_id, host, path, rule,
  coalesce(by_rule, CASE WHEN word IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN by_rule IS NULL THEN word END AS pattern
FROM r"""


ORACLE_SQL = _sql()
