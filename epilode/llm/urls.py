"""URL filter rules, looked up by their rarest literal token.

A rule is a pattern over host and path (and what follows): `||` at the start anchors
it to a host or a subdomain, `*` stands for anything, `^` for one character that is
no letter or digit, or for the end.  Where a rule's run of letters and digits is cut
off by other characters on both sides, every URL that fits holds that run as a whole
token.  Each rule is filed under the token that is rarest in the pages' own URLs; a
URL's tokens fetch the rules filed under them, and only those are tried as regular
expressions.  Rules without such a token are tried on every URL.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, from_arrow_type

from epilode.llm.common import add_column, as_batch, ASCII_LOWER, ASCII_UPPER, map_batches
from epilode.session import cut_lineage

#: Rules that are broadcast at a time; more are tried in further passes.
BLOCK = 50_000
DEFAULT = "allow"
_TOKEN = re.compile(r"[^\x00-/:-@\[-`{-\x7f]+")
_LOWER = str.maketrans(ASCII_UPPER, ASCII_LOWER)


class Rule(NamedTuple):
    """`tier` ranks before length: of the rules that fit, the highest tier wins, then the longest."""

    name: str
    pattern: str
    verdict: str
    tier: int = 0


def host_rule(name: str, verdict: str, tier: int = 1) -> Rule:
    """A rule `host/path` that fits the host and its subdomains where the path starts so."""
    return Rule(name, "||" + name, verdict, tier)


def compile_pattern(pattern: str) -> re.Pattern:
    body = pattern.removeprefix("||")
    parts = {"*": ".*", "^": r"(?:[\x00-/:-@\[-`{-\x7f]|$)"}
    regex = "".join(parts.get(c) or re.escape(c) for c in body)
    return re.compile((r"(?:[^/?#]*\.)?" if body != pattern else ".*?") + regex, re.DOTALL)


def whole_tokens(pattern: str) -> list[str]:
    """Runs of letters and digits that a fitting URL must hold as whole tokens."""
    body = pattern.removeprefix("||")
    return [
        m.group() for m in _TOKEN.finditer(body)
        if (m.start() > 0 and body[m.start() - 1] != "*" or m.start() == 0 and body != pattern)
        and m.end() < len(body) and body[m.end()] != "*"
    ]


def split_url(url: str | None) -> tuple[str, str, str]:
    """(host, path, the rest): the host from the first `://`, lower-cased (A-Z); all empty without one."""
    _, mark, tail = (url or "").partition("://")
    if not mark:
        return "", "", ""
    cut = min((i for i in map(tail.find, "/?#") if i >= 0), default=len(tail))
    host, tail = tail[:cut].translate(_LOWER), tail[cut:]
    cut = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return host, tail[:cut], tail[cut:]


class RuleIndex:
    """Rules by their rarest token."""

    def __init__(self, rules: list[Rule], frequency: dict[str, int]):
        self.by_token: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        self.always: list[tuple[Rule, re.Pattern]] = []
        for rule in sorted(set(rules)):
            tokens = whole_tokens(rule.pattern)
            entry = (rule, compile_pattern(rule.pattern))
            if tokens:
                rarest = min(tokens, key=lambda t: (frequency.get(t, 0), t))
                self.by_token.setdefault(rarest, []).append(entry)
            else:
                self.always.append(entry)

    def __getstate__(self):
        return [(t, [r for r, _ in e]) for t, e in self.by_token.items()], [r for r, _ in self.always]

    def __setstate__(self, state):
        self.by_token = {t: [(r, compile_pattern(r.pattern)) for r in rules] for t, rules in state[0]}
        self.always = [(r, compile_pattern(r.pattern)) for r in state[1]]

    def best(self, target: str) -> Rule | None:
        """The rule that decides; among equals the first by name."""
        found = [r for r, p in self.always if p.match(target)]
        for token in set(_TOKEN.findall(target)):
            found += [r for r, p in self.by_token.get(token, ()) if p.match(target)]
        return min(found, key=rank) if found else None


def rank(rule: Rule) -> tuple:
    return -rule.tier, -len(rule.name), rule.name, rule.pattern, rule.verdict


def _frequencies(urls: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """In how many of all URLs each of the rules' tokens occurs; `urls` is the URL alone."""
    wanted = urls.sparkSession.sparkContext.broadcast(frozenset(t for r in rules for t in whole_tokens(r.pattern)))
    schema = pa.schema([("token", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for batch in batches:
            for url in batch.column(0).to_pylist():
                for token in wanted.value.intersection(_TOKEN.findall("".join(split_url(url)))):
                    counts[token] = counts.get(token, 0) + 1
        yield as_batch(list(counts.items()), schema)

    partial = map_batches(urls, run, from_arrow_schema(schema))
    return {r.token: r.n for r in partial.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def judge(
    pages: DataFrame, rules: list[Rule] | DataFrame, into: str = "judged", url_col: str = "url",
    default: str = DEFAULT, block: int = BLOCK,
) -> DataFrame:
    """`pages` and a struct column `into`: `host, path, rule, pattern, verdict, tier`.

    `rules` is a list, or a DataFrame (name, pattern, verdict, tier) of any size, which is
    read in blocks of about `block` rules, one pass over the pages each.  `rule` and
    `pattern` are null where no rule fits and the `default` verdict holds.  Null URLs and
    such without `://` have an empty host and path and fit no rule.  Every row is judged
    alone and keeps its columns; `into` must be a new name.
    """
    spark = pages.sparkSession
    if isinstance(rules, DataFrame):
        rules = cut_lineage(rules.select("name", "pattern", "verdict", F.col("tier").cast("int")).dropna().distinct(), "rules")
        blocks = max(1, -(-rules.count() // block))
        number = F.pmod(F.xxhash64("name", "pattern", "verdict", "tier"), F.lit(blocks))
        parts = ([Rule(*r) for r in rules.where(number == k).collect()] for k in range(blocks))
    else:
        blocks = max(1, -(-len(rules) // block))
        parts = (rules[k * block : (k + 1) * block] for k in range(blocks))
    kind = pa.struct([(c, pa.string()) for c in ("host", "path", "rule", "pattern", "verdict")] + [("tier", pa.int32())])
    columns, url = pages.columns, F.col(url_col).cast("string")
    judged = pages
    for k, part in enumerate(parts):
        shared = spark.sparkContext.broadcast(RuleIndex(part, _frequencies(pages.select(url), part)))

        def values(texts: list, before: list, shared=shared) -> list[dict]:
            out = []
            for text, old in zip(texts, before):
                host, path, rest = split_url(text)
                found = [shared.value.best(host + path + rest)] if host or path else []
                if old and old["rule"] is not None:
                    found.append(Rule(old["rule"], old["pattern"], old["verdict"], old["tier"]))
                best = min((r for r in found if r), key=rank, default=Rule(None, None, default, None))
                out.append(dict(zip(("host", "path", "rule", "pattern", "verdict", "tier"), (host, path, *best))))
            return out

        old = F.col(into) if k else F.lit(None).cast(from_arrow_type(kind))
        judged = add_column(judged, columns, into, kind, [url, old], values)
        if k + 1 < blocks:
            judged = cut_lineage(judged, "judged")
    return judged
