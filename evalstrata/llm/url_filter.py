"""URL allow and block lists: a trie over reversed host labels, then path segments.

Each rule lies at the node of its host's labels, last label first, and below
that at the node of its path's whole segments; what its path has after the last
slash is one more level, a table from that rest to the rule, with the lengths
that occur.  One walk along a URL's host and path meets every rule that fits,
and the longest one decides.  The walk costs one lookup a label, a segment and
a length of rest, however many rules share a host.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames

#: Rules that a broadcast trie may hold (about 400 MB); more are refused.
MOST_RULES = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)


@dataclass(frozen=True)
class UrlRule:
    """``host`` and its subdomains, where the path starts with ``path``."""

    verdict: str  # allow or block
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


class Node:
    """Children by label and by segment, and rules by what must follow in the segment reached; each made when first needed."""

    __slots__ = ("labels", "lengths", "rules", "segments")

    def __init__(self):
        self.labels = self.segments = self.rules = None
        self.lengths: tuple[int, ...] = ()  # of the rests in rules, the longest first

    def child(self, side: str, key: str) -> Node:
        table = getattr(self, side)
        if table is None:
            table = {}
            setattr(self, side, table)
        node = table.get(key)
        if node is None:
            node = table[key] = Node()
        return node

    def put(self, rest: str, rule: UrlRule) -> None:
        if self.rules is None:
            self.rules = {}
        old = self.rules.get(rest)
        if old is None or rule.verdict == "block":  # of equal rules block goes first
            self.rules[rest] = rule
        if len(rest) not in self.lengths:
            self.lengths = tuple(sorted({*self.lengths, len(rest)}, reverse=True))

    def longest(self, segment: str) -> UrlRule | None:
        """The rule with the longest rest that ``segment`` starts with."""
        for n in self.lengths:
            if n <= len(segment) and (rule := self.rules.get(segment[:n])) is not None:
                return rule
        return None


def build(rules: list[UrlRule]) -> Node:
    """The trie of ``rules``; a rule's path begins with a slash, its host is lower-cased (A-Z)."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; a trie holds {MOST_RULES}")
    root = Node()
    for rule in rules:
        if rule.verdict not in ("allow", "block") or not rule.path.startswith("/"):
            raise ValueError(f"{rule!r}: verdict allow or block, path from a slash on")
        node = root
        for label in reversed(rule.host.translate(_FOLD).split(".")):
            node = node.child("labels", label)
        *whole, rest = rule.path[1:].split("/")
        for segment in whole:
            node = node.child("segments", segment)
        node.put(rest, rule)
    return root


def decide(root: Node, host: str, path: str) -> UrlRule | None:
    """The longest rule that fits (host and path together); of equal ones block goes first.  An empty path starts with no rule's path."""
    best, size, node = None, 0, root
    segments = path[1:].split("/") if path.startswith("/") else []
    for label in reversed(host.split(".")):
        node = node.labels.get(label) if node.labels else None
        if node is None:
            break
        below = node
        for segment in segments:
            rule = below.longest(segment)
            if rule is not None and (n := len(rule.host) + len(rule.path)) >= size and (n > size or rule.verdict == "block"):
                best, size = rule, n
            below = below.segments.get(segment) if below.segments else None
            if below is None:
                break
    return best


def filter_urls(pages: DataFrame, rules: list[UrlRule], id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule (its text, null where none fits) and verdict for each page.

    The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the
    end, A-Z lower-cased; the path follows up to ``?`` or ``#``.  A null url, or
    one without ``://``, has neither and gets ``otherwise``; so does an empty
    path, with which no rule's path begins.  Urls of any length are read whole;
    repeated rows are judged each; other columns are ignored; an empty table
    gives no rows; no rules leave every page with ``otherwise``.
    """
    held = pages.sparkSession.sparkContext.broadcast(build(rules))
    rest = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    rows = pages.select(F.col(id_col).alias("page_id"), F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1).alias("host"), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"))
    rows = rows.withColumn("host", F.translate("host", _UPPER, _LOWER))

    def step(batch: pa.RecordBatch) -> dict:
        found = [decide(held.value, h, p) for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True)]
        return {c: batch[c] for c in ("page_id", "host", "path")} | {"rule": pa.array([r and r.text for r in found], pa.string()), "verdict": [r.verdict if r else otherwise for r in found]}

    kind = dict(rows.dtypes)["page_id"]
    return frames.columns(rows, f"page_id {kind}, host string, path string, rule string, verdict string", step)
