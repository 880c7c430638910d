"""URL allow and block lists as a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A broadcast trie holds at most so many rules; ``judge_urls`` refuses more.
MOST_RULES = 5_000_000


@dataclass(frozen=True)
class Rule:
    """``verdict`` ("allow" or "block") for ``host``, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    def __post_init__(self):
        if self.verdict not in ("allow", "block"):
            raise ValueError(f"no such verdict: {self.verdict!r}")
        if self.path and not self.path.startswith("/"):
            raise ValueError(f"a path starts with '/': {self.path!r}")

    def __str__(self) -> str:
        return self.host + self.path


class Trie:
    """Host labels from the top-level domain down, then whole path segments, then the rest of a segment.

    A rule's path "/a/b" is the whole segment "a", then the rest "b", which any segment that starts
    with "b" goes on from; "/a/" is "a" and then the rest "", so it needs the slash after "a".
    Equal (host, path) entries: block goes before allow.
    """

    __slots__ = ("root",)

    def __init__(self, rules: Iterable[Rule]):
        # node: {label: node}; under None the host's paths: [rule for the empty path, segments]
        # segments: [{whole segment: segments}, {rest: rule}, size of the longest rest]
        self.root: dict = {}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.lower().split(".")) if rule.host else ():
                node = node.setdefault(label, {})
            paths = node.setdefault(None, [None, None])
            if not rule.path:
                paths[0] = self._stronger(paths[0], rule)
                continue
            if paths[1] is None:
                paths[1] = [{}, {}, 0]
            at = paths[1]
            *whole, rest = rule.path[1:].split("/")
            for segment in whole:
                at = at[0].setdefault(segment, [{}, {}, 0])
            at[1][rest] = self._stronger(at[1].get(rest), rule)
            at[2] = max(at[2], len(rest))

    @staticmethod
    def _stronger(old: Rule | None, new: Rule) -> Rule:
        return old if old is not None and old.verdict == "block" else new

    def find(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits: the most host labels, then the longest path."""
        best, node = None, self.root
        if None in node:
            best = self._by_path(node[None], path)
        if host:
            for label in reversed(host.split(".")):
                node = node.get(label)
                if node is None:
                    break
                if None in node:
                    best = self._by_path(node[None], path) or best
        return best

    @staticmethod
    def _by_path(paths: list, path: str) -> Rule | None:
        best, at = paths[0], paths[1]
        if at is None or not path.startswith("/"):
            return best
        segments = path[1:].split("/")
        for i, segment in enumerate(segments):
            if at[1]:
                hit = next((at[1][segment[:k]] for k in range(min(len(segment), at[2]), -1, -1) if segment[:k] in at[1]), None)
                best = hit or best
            at = at[0].get(segment) if i + 1 < len(segments) else None
            if at is None:
                break
        return best


def judge_urls(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """key, ``host``, ``path``, ``rule``, ``verdict`` of every row's URL.

    The host is what stands after the first "://" up to "/", "?", "#" or the end, with A-Z in lower
    case; the path goes on up to "?", "#" or the end.  A null URL or one without "://" has both
    empty.  The longest fitting rule decides; without one, ``rule`` is null and ``verdict`` is
    ``default``.  The rules are counted before the trie is broadcast (``MOST_RULES``).  Rows may
    repeat; an empty table gives no rows; other columns are ignored.
    """
    import pyarrow as pa

    rules = list(rules)
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules are too many to broadcast; the bound is {MOST_RULES}")
    spark: SparkSession = pages.sparkSession
    trie = spark.sparkContext.broadcast(Trie(rules))
    lower = F.translate  # A-Z only: other letters stay as they are
    after = F.coalesce(F.regexp_extract(pages[url].cast("string"), r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    parts = pages.select(
        pages[key].alias("_key"),
        lower(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
        F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"),
    )

    kind = pages.schema[key].dataType.simpleString()

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = trie.value.find
        for b in batches:
            got = [find(h, p) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            rule, verdict = [None if r is None else str(r) for r in got], [default if r is None else r.verdict for r in got]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[key, "host", "path", "rule", "verdict"])

    return parts.mapInArrow(judged, f"`{key}` {kind}, host string, path string, rule string, verdict string")
