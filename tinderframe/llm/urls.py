"""URL filter rules, looked up by their rarest literal token.

A rule is an action, a host and a path. It fits a URL whose host is the rule's or a
subdomain of it and whose path starts with the rule's; ``*`` in a rule's path stands for any
run of characters. Each rule is filed under one literal token: of the tokens that every
fitting URL must contain whole, the one that the fewest URLs of the table have. A URL fetches
the rules filed under its own tokens and only those run their regular expression; rules
without such a token are tried on every URL. Of the rules that fit, the longest wins, then
the smallest in code-point order; without one the default action holds.

Null URLs and URLs without ``://`` have an empty host and path and fit no rule with a host.
Repeated rows are judged one by one; an empty table gives an empty result. The work per URL
is a narrow step of the scan: nothing is shuffled but the token counts, of which there are
as many as the rules have tokens.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tinderframe.llm.common import ascii_lower

TOKEN = r"[A-Za-z0-9]+"
#: Rules that one broadcast index holds; more rules are applied in several passes of a row.
RULES_A_PASS = 100_000
Rule = tuple[str, str, str]  # action, host, path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL, empty where there are none."""
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, form, i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def rule_tokens(rule: Rule) -> set[str]:
    """Tokens that stand whole in every URL the rule fits: the labels of its host, and
    those path tokens that the rule itself bounds on both sides."""
    _, host, path = rule
    found = set(re.findall(TOKEN, host))
    for m in re.finditer(TOKEN, path):
        after = path[m.end() : m.end() + 1]
        if after not in ("", "*") and path[m.start() - 1] != "*":
            found.add(m[0])
    return found


def rule_pattern(rule: Rule) -> str:
    _, host, path = rule
    head = rf"(?:[^/]*\.)?{re.escape(host)}" if host else r"[^/]*"
    return head + r"(?=/|\Z)" + "(?s:.*)".join(map(re.escape, path.split("*")))


def token_counts(urls: DataFrame, tokens: set[str]) -> dict[str, int]:
    """How many rows have each of the given tokens; one row per token reaches the driver."""
    wanted = F.array(*map(F.lit, sorted(tokens)))
    own = F.regexp_extract_all(F.concat("host", F.lit(" "), "path"), F.lit(f"({TOKEN})"))
    hit = urls.select(F.explode(F.array_intersect(own, wanted)).alias("t"))
    return {r["t"]: r["n"] for r in hit.groupBy("t").agg(F.count("*").alias("n")).collect()}


def index_rules(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str | None, list]:
    """Rules by their rarest token (None: no token), as (pattern, length, rule, action)."""
    index = defaultdict(list)
    for rule in rules:
        action, host, path = rule
        token = min(rule_tokens(rule), key=lambda t: (counts.get(t, 0), t), default=None)
        index[token].append((rule_pattern(rule), len(host + path), host + path, action))
    return dict(index)


def _judge(index: dict):
    @F.pandas_udf("rule string, action string, length int")
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        compiled = {t: [(re.compile(p), *rest) for p, *rest in rs] for t, rs in index.items()}
        out = []
        for h, p in zip(host, path):
            url = h + p
            best = (0, "", None)
            for t in {None, *re.findall(TOKEN, h), *re.findall(TOKEN, p)}:
                for pattern, length, name, action in compiled.get(t, ()):
                    if pattern.match(url):
                        best = min(best, (-length, name, action), key=lambda x: x[:2])
            out.append((best[1], best[2], -best[0]) if best[2] else (None, None, 0))
        return pd.DataFrame(out, columns=["rule", "action", "length"])

    return judge


def filter_urls(urls: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """All columns of ``urls`` plus host, path, rule (null where none fits) and verdict;
    input columns of those names are replaced."""
    rules = sorted(set(rules), key=lambda r: (len(r[1] + r[2]), r[1] + r[2], r[0]))
    host, path = host_and_path(F.col(url))
    parts = urls.select(host.alias("host"), path.alias("path"))
    counts = token_counts(parts, set().union(*map(rule_tokens, rules))) if rules else {}
    best = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action"), F.lit(0).alias("length"))
    out = urls.withColumns({"__host": host, "__path": path, "__best": best})
    for at in range(0, len(rules), RULES_A_PASS):  # later passes hold longer rules
        judge = _judge(index_rules(rules[at : at + RULES_A_PASS], counts))
        out = out.withColumn("__new", judge("__host", "__path"))
        out = out.withColumn("__best", F.when(F.col("__new.length") > F.col("__best.length"), F.col("__new")).otherwise(F.col("__best"))).drop("__new")
    return out.withColumns(
        {"host": F.col("__host"), "path": F.col("__path"), "rule": F.col("__best.rule"), "verdict": F.coalesce("__best.action", F.lit(default))}
    ).drop("__host", "__path", "__best")
