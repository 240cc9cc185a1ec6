"""URL allow and block rules by a trie over reversed host labels, then path segments.

A rule fits its host and all subdomains where the URL's path starts with the rule's path; of the rules that fit, the
longest (host and path together, then host) decides, whether it allows or blocks; of an allow and a block entry for the
same place, the block entry counts. The trie is broadcast; a rule set of over `max_rules` entries is joined instead.

Cases: a null URL, or one without `://`, has empty host and path, which no rule fits; a URL without a rule gets the
default verdict; repeated rows get their own results; null ids are kept; an empty page table gives an empty result;
without rules every page gets the default; extra columns are ignored, and kept by name in `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class UrlTrie:
    """Nodes are plain dicts: host labels from the last to the first, then path segments."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.translate(str.maketrans(UPPER, LOWER)).split(".")):
                node = node.setdefault(label, {})
            # the path's closed segments lead to a node; what follows its last slash may match part of a segment
            *closed, rest = path[1:].split("/") if path else [None]
            node = node.setdefault(("path", path[:1]), {})
            for segment in closed:
                node = node.setdefault(segment, {})
            kept = node.setdefault(("ends", rest is None), {})
            if kept.get(rest or "", ("", ""))[1] != "block":
                kept[rest or ""] = (host.translate(str.maketrans(UPPER, LOWER)) + path, verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best, key = None, (-1, -1)
        node, depth, segments = self.root, 0, path[1:].split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            depth += 1 + len(label)
            for start in {"", path[:1]}:
                at = node.get(("path", start))
                if at is None:
                    continue
                for i, segment in enumerate(segments if start else [""]):
                    for rest, found in at.get(("ends", not start), {}).items():
                        if segment.startswith(rest) and (len(found[0]), depth) > key:
                            best, key = found, (len(found[0]), depth)
                    if i + 1 == len(segments) or not start:
                        break
                    at = at.get(segment)  # closed by the slash that follows it
                    if at is None:
                        break
        return best


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url", keep: tuple[str, ...] = ("page_id",), max_rules: int = 500_000) -> DataFrame:
    """The `keep` columns with host, path, rule (null: none fits) and verdict. rules: host, path, verdict."""
    rows = pages.select(*(F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    some = rules.select("host", "path", "verdict").where("host is not null and path is not null").limit(max_rules + 1).collect()
    judged = _by_trie(rows, [tuple(r) for r in some], default) if len(some) <= max_rules else _by_join(rows, rules, default)
    return judged.select(*(F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)), "host", "path", "rule", "verdict")


def _by_trie(rows: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for b in batches:
            found = [trie.find(h, p) if h else None for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f and f[0] for f in found], pa.string()), pa.array([f[1] if f else default for f in found], pa.string())], [*b.schema.names, "rule", "verdict"])

    return rows.mapInArrow(look, rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)}).schema)


def _by_join(rows: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """For rule sets too large to send: each different place offers its host suffixes and closed path prefixes as keys."""
    split = rules.where("host is not null and path is not null").select(
        F.translate("host", UPPER, LOWER).alias("suffix"), F.regexp_extract("path", r"(?s)^(.*/)?([^/]*)$", 1).alias("closed"),
        F.regexp_extract("path", r"(?s)^(.*/)?([^/]*)$", 2).alias("rest"), "verdict",
    )
    split = split.groupBy("suffix", "closed", "rest").agg(F.max("verdict").alias("verdict"))  # block after allow
    places = rows.select("host", "path").distinct().where("host != ''")
    labels = F.split("host", r"\.")
    n = F.size(labels)
    suffixes = places.select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))).alias("suffix"))
    closed = F.concat(F.array(F.lit("")), F.transform(F.filter(F.sequence(F.lit(1), F.length("path") + 1), lambda i: F.substr(F.col("path"), i, F.lit(1)) == "/"), lambda i: F.substr(F.col("path"), F.lit(1), i)))
    keys = suffixes.select("host", "path", "suffix", F.explode(closed).alias("closed"))
    rule = F.concat("suffix", "closed", "rest")
    best = (
        keys.join(split, ["suffix", "closed"]).where(F.startswith("path", F.concat("closed", "rest")))
        .groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("n"), F.length("suffix").alias("h"), rule.alias("rule"), F.col("verdict"))).alias("best"))
    )
    return rows.join(best, ["host", "path"], "left").select(*rows.columns, F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
