"""URL filters: a broadcast trie over reversed host labels and path segments, longest match wins.

A rule is (verdict, host, path). It fits its host and all subdomains when the url's path starts with
the rule's. Among the fitting rules the longest (characters of host and path together) decides; of
equally long ones that with the longer host, then a block. The trie's size is that of the rule list,
which ``compile_rules`` holds under ``MAX_RULES``; beyond it an error is raised, nothing is dropped.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and gets
the default verdict. Empty tables give empty results; repeated urls give repeated rows; further
columns of the input are kept, but for those that the results' names replace.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 2_000_000
_LABELS, _PATHS, _RULES = "labels", "paths", "rules"

Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def compile_rules(rules: Iterable[Rule]) -> dict:
    """The trie: labels from the right, then whole path segments, then rules by their last, open segment."""
    root: dict = {_LABELS: {}}
    for n, (verdict, host, path) in enumerate(rules):
        if n >= MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules: split the list, it is broadcast")
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r}")
        node = root
        for label in reversed(host.lower().split(".")):
            node = node[_LABELS].setdefault(label, {_LABELS: {}})
        *whole, last = path.split("/")
        node = node.setdefault(_PATHS, {_PATHS: {}, _RULES: []})
        for segment in whole:
            node = node[_PATHS].setdefault(segment, {_PATHS: {}, _RULES: []})
        size = (len(host) + len(path), len(host), verdict == "block")
        node[_RULES].append((last, size, host + path, verdict))
    return root


def longest(trie: dict, host: str, path: str) -> tuple[str | None, str | None]:
    """The rule that decides and its verdict, or two nulls."""
    best: tuple | None = None
    node, segments = trie, path.split("/")
    for label in reversed(host.split(".")):
        node = node[_LABELS].get(label)
        if node is None:
            break
        at, depth = node.get(_PATHS), 0
        while at is not None:
            rest = segments[depth] if depth < len(segments) else None
            for last, size, name, verdict in at[_RULES]:
                if rest is not None and rest.startswith(last) and (best is None or size > best[0]):
                    best = (size, name, verdict)
            at, depth = (at[_PATHS].get(rest) if depth < len(segments) - 1 else None), depth + 1
    return (best[1], best[2]) if best else (None, None)


def judge(pages: DataFrame, rules: Iterable[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """Every row with ``host``, ``path``, ``rule`` and ``verdict``. No shuffle: one pass, the trie broadcast."""
    trie = pages.sparkSession.sparkContext.broadcast(compile_rules(rules))

    @F.pandas_udf("rule string, verdict string")
    def decide(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known = trie.value
        for hosts, paths in batches:
            yield pd.DataFrame([longest(known, h, p) for h, p in zip(hosts, paths, strict=True)], columns=["rule", "verdict"])

    named = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    found = named.withColumn("_judged", decide("host", "path"))
    return found.withColumns(
        {"rule": F.col("_judged.rule"), "verdict": F.coalesce("_judged.verdict", F.lit(default))}
    ).drop("_judged")


def keep_allowed(pages: DataFrame, rules: Iterable[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """The rows that are not blocked, with the input's columns only."""
    return judge(pages, rules, url, default).filter(F.col("verdict") == "allow").select(*pages.columns)
