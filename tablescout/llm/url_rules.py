"""URL rules found by their rarest literal token, in DataFrame expressions only.

A rule ``host/path`` fits its host and all subdomains where the URL's path starts with ``/path``.
Each rule is indexed under the one of its literal tokens (host labels, path words) that the
fewest URLs have.  A URL's tokens fetch candidate rules from that index, and only the candidates'
regular expressions run.  The index is a hash table inside the expression, so judging URLs needs
neither a join nor a shuffle, and a hot host costs no more than any other row.
"""

from __future__ import annotations

import json
import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import lower_ascii

TOKEN = r"[A-Za-z0-9_\-]+"
INDEX_TYPE = "array<array<struct<token:string,rule:string,verdict:string,pattern:string>>>"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    text = F.coalesce(url, F.lit(""))
    # "." must match line breaks too: a URL is data and may hold any character.
    host = lower_ascii(F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1))
    path = F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return host, path


def rule_pattern(rule: str) -> str:
    """The regular expression of a rule over ``host#path``; neither part can hold a ``#``."""
    host, _, path = rule.partition("/")
    return rf"(?s)^(?:[^#]*\.)?{_quoted(host.lower())}#{_quoted('/' + path)}"


def _quoted(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E" if text else ""


def rule_tokens(rule: str) -> list[str]:
    """Literal tokens that every URL under the rule has whole: host labels and closed path words.

    A path word at the very end may go on in the URL, so it is no whole token.
    """
    host, _, path = rule.partition("/")
    closed = re.findall(rf"{TOKEN}(?=[^A-Za-z0-9_\-])", path)
    return sorted({*re.findall(TOKEN, host.lower()), *closed})


def _url_tokens(host: Column, path: Column) -> Column:
    found = F.regexp_extract_all(F.concat_ws("#", host, path), F.lit(f"({TOKEN})"), F.lit(1))
    return F.array_distinct(found)


def token_rows(pages: DataFrame, url_col: str, tokens: list[str]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens stands; the result has a row per such token."""
    host, path = host_and_path(F.col(url_col))
    known = F.array(*map(F.lit, tokens)).cast("array<string>")
    hits = pages.select(F.explode(F.array_intersect(_url_tokens(host, path), known)).alias("token"))
    return {row["token"]: row["n"] for row in hits.groupBy("token").agg(F.count("*").alias("n")).collect()}


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule (null if none fits), verdict.

    ``rules`` are pairs (verdict, rule), held by the driver; the longest fitting rule wins, of
    equally long ones the last in text order.  URLs that no rule fits get ``default``.  Null URLs
    and those without ``://`` have an empty host and path and no rule.  Repeated rows are judged
    each; other columns are not read.
    """
    host, path = host_and_path(F.col(url_col))
    split = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    if not rules:
        return split.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    tokens = {rule: rule_tokens(rule) for _, rule in rules}
    if empty := [rule for rule, own in tokens.items() if not own]:
        raise ValueError(f"rules without a literal token: {empty}")
    rows = token_rows(pages, url_col, sorted({t for own in tokens.values() for t in own}))
    buckets: list[list[dict[str, str]]] = [[] for _ in range(2 * len(rules) + 1)]
    for verdict, rule in rules:
        rarest = min(tokens[rule], key=lambda t: (rows.get(t, 0), t))
        entry = {"token": rarest, "rule": rule, "verdict": verdict, "pattern": rule_pattern(rule)}
        buckets[zlib.crc32(rarest.encode()) % len(buckets)].append(entry)
    index = F.from_json(F.lit(json.dumps(buckets)), INDEX_TYPE)
    spot = lambda token: F.pmod(F.crc32(token), F.lit(len(buckets))).cast("int")
    fetched = F.transform(
        _url_tokens(F.col("host"), F.col("path")),
        lambda token: F.filter(F.get(index, spot(token)), lambda entry: entry["token"] == token),
    )
    target = F.concat_ws("#", "host", "path")
    fits = F.filter(F.flatten(fetched), lambda entry: F.regexp_like(target, entry["pattern"]))
    best = F.array_max(
        F.transform(fits, lambda e: F.struct(F.length(e["rule"]).alias("n"), e["rule"].alias("rule"), e["verdict"].alias("verdict")))
    )
    judged = split.withColumn("best", best)
    return judged.select(
        id_col, "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )
