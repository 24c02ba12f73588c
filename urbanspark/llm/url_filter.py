"""URL filter: a trie over reversed host labels, then path segments, broadcast to all tasks.

A rule (verdict, host, path) fits its host and every subdomain when the url's path starts
with the rule's path. The longest fitting rule wins: more host labels first, then the
longer path; at equal length a block beats an allow. A url that no rule fits gets
``default``.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: from there up to ``?``, ``#`` or the end. Null urls and urls without
``://`` have empty host and path, fit no rule and get the default. Repeated rows are
judged one by one, an empty table gives an empty result, other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules of the pages query: fixed values.
PAGE_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: A trie of more rules isn't broadcast; at about 200 bytes a rule this is some 40 MB.
MAX_RULES = 200_000

Rule = tuple[str, str, str]


class Node:
    __slots__ = ("labels", "segments", "ends")

    def __init__(self) -> None:
        self.labels: dict[str, Node] = {}
        self.segments: dict[str, Node] = {}
        #: Last, possibly partial, path segment -> (verdict, rule text).
        self.ends: dict[str, tuple[str, str]] = {}


def build(rules: Iterable[Rule]) -> Node:
    root, n = Node(), 0
    for n, (verdict, host, path) in enumerate(rules, 1):  # noqa: B007
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r}")
        node = root
        for label in reversed(host.lower().split(".")):
            node = node.labels.setdefault(label, Node())
        *whole, last = path.split("/")
        for segment in whole:
            node = node.segments.setdefault(segment, Node())
        held = node.ends.get(last)
        if held is None or held[0] == "allow":
            node.ends[last] = (verdict, host + path)
    if n > MAX_RULES:
        raise ValueError(f"{n} rules; at most {MAX_RULES} are broadcast")
    return root


def _along_path(node: Node, segments: list[str]) -> tuple[str, str] | None:
    best = None
    for k, segment in enumerate(segments):
        fitting = [last for last in node.ends if segment.startswith(last)] if node.ends else ()
        if fitting:
            best = node.ends[max(fitting, key=len)]
        if k + 1 == len(segments) or (node := node.segments.get(segment)) is None:
            break
    return best


def judge(root: Node, host: str, path: str) -> tuple[str, str] | None:
    best, node, segments = None, root, path.split("/")
    for label in reversed(host.split(".")):
        node = node.labels.get(label)
        if node is None:
            break
        best = _along_path(node, segments) or best
    return best


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def verdicts(pages: DataFrame, rules: Iterable[Rule], *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row for each row of ``pages``."""
    trie = pages.sparkSession.sparkContext.broadcast(build(rules))

    @F.pandas_udf("rule string, verdict string")
    def judged(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        root = trie.value
        for hosts, paths in parts:
            found = [judge(root, h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame({"rule": [f and f[1] for f in found], "verdict": [f[0] if f else default for f in found]})

    host, path = host_and_path(F.col(url_col).cast("string"))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    return parts.withColumn("__j", judged("host", "path")).select("page_id", "host", "path", "__j.rule", "__j.verdict")
