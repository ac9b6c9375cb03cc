"""URL filter: a broadcast trie over reversed host labels and path segments.

A rule is (verdict, host, path). It fits a URL whose host is the rule's or below it and whose path starts with the
rule's, as a string: ``/en/7`` fits ``/en/70``. The trie goes down the host's labels from the right; each of its nodes
holds a trie of path segments, whose nodes hold the rules that end inside the next segment. Of the rules that fit, the
longest (characters of host and path) wins, then the longer host, then block before allow. A URL that no rule fits gets
``default``. Rules that repeat count once; conflicting ones follow the order above.

The rules are broadcast as one object; more than ``MOST_RULES`` are refused, so its size has a bound.
Null URLs and URLs without ``://`` have an empty host and path, which no rule with a host fits. URLs of any length are
read whole, in one pass over their segments. Each row is judged by itself, so repeated pages are reported as often; an
empty table gives an empty result. Other columns pass by name where asked for (``keep``), also those named like a result
of this module's own, as long as no two of the output share a name.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

MOST_RULES = 1_000_000


class Trie:
    """Nodes are numbers; an edge leads from a node by a host label or a path segment to another. Flat, so any depth is sent whole."""

    def __init__(self, rules: list[tuple[str, str, str]], default: str = "allow"):
        if len(rules) > MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} rules")
        self.default, self.nodes = default, 1
        self.labels: dict[tuple[int, str], int] = {}
        self.paths: dict[int, int] = {}
        self.segments: dict[tuple[int, str], int] = {}
        self.ends: dict[int, list[tuple[str, tuple]]] = {}
        for verdict, host, path in rules:
            node = 0
            for label in reversed(host.lower().split(".")):
                node = self._below(self.labels, (node, label))
            at, (*segments, tail) = self._below(self.paths, node), path.split("/")
            for s in segments:
                at = self._below(self.segments, (at, s))
            self.ends.setdefault(at, []).append((tail, (len(host) + len(path), len(host), verdict == "block", verdict, host + path)))

    def _below(self, edges: dict, key) -> int:
        if key not in edges:
            edges[key], self.nodes = self.nodes, self.nodes + 1
        return edges[key]

    def match(self, host: str, path: str) -> tuple[str | None, str]:
        """(rule, verdict) of the rule that wins; (None, default) if none fits."""
        best, node, segments = None, 0, path.split("/")
        for label in reversed(host.split(".")):
            node = self.labels.get((node, label))
            if node is None:
                break
            at = self.paths.get(node)
            for s in segments if at is not None else ():
                for tail, rule in self.ends.get(at, ()):
                    if s.startswith(tail) and (best is None or rule > best):
                        best = rule
                at = self.segments.get((at, s))
                if at is None:
                    break
        return (best[4], best[3]) if best else (None, self.default)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", url_col: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns ``keep`` of every row, host, path, rule (host and path of the one that wins, or null) and verdict."""
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules, default))
    src = pages.select(*keep, F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("_url"))
    rest = F.when(F.locate("://", "_url") > 0, F.expr("substring(_url, locate('://', _url) + 3)")).otherwise("")
    src = src.withColumn("_rest", F.regexp_extract(rest, r"^([^?#]*)", 1))
    host = F.regexp_extract("_rest", r"^([^/]*)", 1)
    host_lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    src = src.select(*keep, host_lower.alias("host"), F.expr("substring(_rest, length(regexp_extract(_rest, '^([^/]*)', 1)) + 1)").alias("path"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields), "rule string", "verdict string"])

    def run(batches):
        known = trie.value
        for batch in batches:
            found = [known.match(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            columns = [*batch.columns, pa.array([r for r, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "rule", "verdict"])

    return map_arrow(src, run, schema)
