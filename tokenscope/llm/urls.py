"""URL verdicts by pattern rules that are indexed by their rarest literal token.

A rule is a regular expression with a verdict. From its parse tree come the literal tokens (runs of ASCII
letters and digits) that every matching URL must hold as whole tokens; the one that is rarest in the table's
URLs is the rule's key. A rule with alternatives has a key for each of them. A URL's tokens fetch the rules under
them, and only those run their expression. Rules in which some alternative has no such token run on every URL; none
of the rules here is one.

Two kinds of rules share the index: host-and-path rules such as ``block net/``, which fit a host and its
subdomains and of which the longest wins, and patterns on the whole URL, which decide where no host rule fits.

Defined cases: a null URL, or one without ``://``, has an empty host and path and no host rule; a null URL is allowed,
the other is judged by the patterns; every row gives one result row; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenscope.llm.common import map_batches, table

try:
    from re import _constants as sre_constants
    from re import _parser as sre_parser
except ImportError:  # older Pythons
    import sre_constants
    import sre_parse as sre_parser

HOST_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
PATTERN_RULES = (
    (r"\bspam-farm\b", "block"),
    (r"\bcheap-pills\b", "block"),
    (r"\bfree-(?:money|prizes)\b", "block"),
    (r"\b(?:casino|viagra)\b", "block"),
    (r"://[^/?#]*\bxxx\b", "block"),
    (r"/wp-login\.php\b", "block"),
    (r"[?&]utm_medium=spam\b", "block"),
)
MAX_RULES = 200_000
TOKEN = re.compile(r"[a-z0-9]+")
_lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_edge = "\0"


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    verdict: str
    on_host: bool


def host_and_path(url: str | None) -> tuple[str, str]:
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(_lower), re.match(r"[^?#]*", rest[len(host) :])[0]


def host_rule(name: str, verdict: str) -> Rule:
    """A rule for host and path as ``host<newline>path``; the host has no slash, so the first slash begins the path."""
    host, slash, path = name.partition("/")
    after = re.escape(slash + path) if slash else r"(?:/|\Z)"
    return Rule(name, rf"(?:[^/]*\.)?{re.escape(host.translate(_lower))}\n{after}", verdict, True)


#: Choices that are told apart where one part's alternatives meet another's; one part may have any number.
MAX_ALTERNATIVES = 1024


def _alternatives(items: Iterable, first: bool = True) -> list[list[str | None]]:
    """What a pattern's parts match, one list for each choice of its alternatives: literal characters, edges, and None for anything.

    Where choices would be too many, the first parts' are kept and the next stands for anything, or, without first, the other way round.
    """
    out: list[list[str | None]] = [[]]
    for op, arg in items:
        if op is sre_constants.LITERAL:
            parts = [[chr(arg) if chr(arg).isascii() else _edge]]
        elif op is sre_constants.AT:
            parts = [[_edge]]
        elif op is sre_constants.SUBPATTERN and not (arg[1] or arg[2]):
            parts = _alternatives(arg[3], first)
        elif op is sre_constants.BRANCH:
            parts = [x for branch in arg[1] for x in _alternatives(branch, first)]
        else:
            parts = [[None]]
        if len(out) > 1 and len(parts) > 1 and len(out) * len(parts) > MAX_ALTERNATIVES:
            if first:
                parts = [[None]]
            else:
                same = 0
                while same < min(map(len, out)) and all(x[-1 - same] == out[0][-1 - same] for x in out):
                    same += 1
                out = [[None, *out[0][len(out[0]) - same :]]]
        out = [x + y for x in out for y in parts]
    return out


def _tokens(parts: list[str | None]) -> set[str]:
    """Tokens of literal runs; one counts if both of its ends are known: by another literal character or by an assertion."""
    tokens: set[str] = set()
    for run in "".join("\n\n" if c is None else c for c in parts).split("\n\n"):
        pieces = re.findall(r"[a-z0-9]+|[^a-z0-9]", run.translate(_lower))
        tokens |= {t for i, t in enumerate(pieces) if TOKEN.fullmatch(t) and 0 < i < len(pieces) - 1}
    return tokens


def required_tokens(pattern: str) -> list[set[str]]:
    """For each choice of the pattern's alternatives the tokens that stand whole in every string that it matches."""
    tree, found = sre_parser.parse(pattern), []
    for first in (True, False):
        found = list(map(set, dict.fromkeys(frozenset(_tokens(x)) for x in _alternatives(tree, first))))
        if all(found):
            return found
    return found


def tokens_of(url: str) -> set[str]:
    return set(TOKEN.findall(url.translate(_lower)))


class Index:
    """Rules under their rarest token; counts are the URLs that hold a token."""

    def __init__(self, rules: tuple[Rule, ...], counts: dict[str, int]) -> None:
        self.under: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        self.always: list[tuple[Rule, re.Pattern]] = []
        for rule in rules:
            needed = required_tokens(("\\A" if rule.on_host else "") + _bounded(rule))
            entry = (rule, re.compile(rule.pattern, 0 if rule.on_host else re.I | re.A))
            if all(needed):
                for key in {min(tokens, key=lambda t: (counts.get(t, 0), t)) for tokens in needed}:
                    self.under.setdefault(key, []).append(entry)
            else:
                self.always.append(entry)

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int]:
        """host, path, host rule, verdict, and how many expressions ran."""
        host, path = host_and_path(url)
        if url is None:
            return host, path, None, "allow", 0
        found = dict.fromkeys(self.always)
        for t in tokens_of(url):
            found.update(dict.fromkeys(self.under.get(t, ())))
        both, best, blocked = f"{host}\n{path}", None, False
        for rule, regex in found:
            if rule.on_host:
                if (host or path) and (best is None or len(rule.name) > len(best.name)) and regex.match(both):
                    best = rule
            elif not blocked and rule.verdict == "block" and regex.search(url):
                blocked = True
        verdict = best.verdict if best else "block" if blocked else "allow"
        return host, path, best.name if best else None, verdict, len(found)


def _bounded(rule: Rule) -> str:
    """For the token search: a host rule's host begins at a label, which the optional part before it hides."""
    if not rule.on_host:
        return rule.pattern
    host, slash, path = rule.name.partition("/")
    return re.escape("." + host.translate(_lower) + "." + slash + path)


@lru_cache(maxsize=2)
def _index(rules: tuple[Rule, ...], counts: tuple[tuple[str, int], ...]) -> Index:
    return Index(rules, dict(counts))


def token_counts(urls: DataFrame, rules: tuple[Rule, ...]) -> tuple[tuple[str, int], ...]:
    """How many URLs hold each token that some rule needs; the result is no longer than the rules are."""
    wanted = sorted(set().union(*(tokens for r in rules for tokens in required_tokens(_bounded(r)))))
    spark = urls.sparkSession
    tokens = urls.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("url"), F.lit("([a-z0-9]+)")))).alias("token"))
    known = spark.createDataFrame([(t,) for t in wanted], "token string")
    return tuple(sorted((r[0], r[1]) for r in tokens.join(F.broadcast(known), "token").groupBy("token").count().collect()))


def judge(pages: DataFrame, keep: list[str], host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """Columns keep of pages with host, path, rule, verdict and n_tried (expressions run)."""
    rules = tuple(host_rule(*r) for r in host_rules) + tuple(Rule(p, p, v, False) for p, v in pattern_rules)
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} can be sent to every task")
    counts = token_counts(pages, rules)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        index, n = _index(rules, counts), len(keep)
        rows = list(zip(*map(index.judge, batch.column(n).to_pylist())))
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
        columns = [pa.array(list(x), type=k) for x, k in zip(rows, kinds)]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), *columns], names=[*keep, "host", "path", "rule", "verdict", "n_tried"])

    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keep)
    return map_batches(pages.select(*keep, "url"), one, f"{kinds}, host string, path string, rule string, verdict string, n_tried long")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), ["page_id"]).drop("n_tried")


SQL = r"""
with a as (select page_id, url, case when url is null or strpos(url, '://') = 0 then null else substr(url, strpos(url, '://') + 3) end as rest from pages),
b as (select page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
 coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from a),
r(rule, v) as (values ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
fits as (select page_id, max_by(rule, length(rule)) as rule, max_by(v, length(rule)) as v from b join r
 on (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1))) and starts_with(path, substr(rule, strpos(rule, '/'))) group by page_id)
select b.page_id, host, path, rule, coalesce(v, case when regexp_matches(lower(url),
 '\bspam-farm\b|\bcheap-pills\b|\bfree-(money|prizes)\b|\b(casino|viagra)\b|://[^/?#]*\bxxx\b|/wp-login\.php\b|[?&]utm_medium=spam\b') then 'block' else 'allow' end) as verdict
from b left join fits using (page_id)
"""
