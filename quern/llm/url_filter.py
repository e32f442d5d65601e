"""Allow and block rules for URLs, decided by the longest matching rule.

The rules form one trie: labels of the host from the right, then segments of the path. The trie is broadcast while its
rules stay under a byte bound; beyond that the same decision is made by an equi-join on (host suffix, path directory).
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import BROADCAST_BYTES, map_batches

Rule = tuple[str, str, str]  # verdict, host, path prefix

#: Which verdict holds when one rule text is given both ways.
STRONGER = {"allow": 0, "block": 1}


class Trie:
    """Longest match over reversed host labels, then over path segments.

    The deepest host that has a fitting path wins; under one host the longest path wins; block beats allow on one key.
    The last piece of a rule's path is a prefix of the segment at its place, so "/en/1" fits "/en/148.html".
    """

    __slots__ = ("paths", "root")

    def __init__(self, rules: Iterable[Rule] = ()):
        self.root: dict = {}
        for verdict, host, path in rules:
            self.add(verdict, host, path)

    def add(self, verdict: str, host: str, path: str) -> None:
        node = self.root
        for label in reversed(host.split(".")):
            node = node.setdefault(("label", label), {})
        node = node.setdefault("paths", {})
        *whole, last = path.split("/")
        for segment in whole:
            node = node.setdefault(("segment", segment), {})
        ends = node.setdefault("ends", {})
        kept = ends.get(last)
        if kept is None or STRONGER[kept[0]] < STRONGER[verdict]:
            ends[last] = (verdict, host + path)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule text) of the longest rule that fits, or None."""
        node, found = self.root, []
        for label in reversed(host.split(".")):
            node = node.get(("label", label))
            if node is None:
                break
            if "paths" in node:
                found.append(node["paths"])
        segments = path.split("/")
        for node in reversed(found):
            best = None
            for segment in segments:
                ends = node.get("ends")
                if ends:
                    fits = [e for e in ends if segment.startswith(e)]
                    if fits:
                        best = ends[max(fits, key=len)]
                node = node.get(("segment", segment))
                if node is None:
                    break
            if best:
                return best
        return None


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path); both empty for null or where "://" is missing."""
    if url is None:
        return "", ""
    _, sep, rest = url.partition("://")
    if not sep:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, path = rest[:end], rest[end:]
    end = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    if not host.isascii():
        host = host.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).decode()
    else:
        host = host.lower()
    return host, path[:end]


SCHEMA = "page_id long, host string, path string, rule string, verdict string"


def url_filter(
    pages: DataFrame,
    rules: Iterable[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    malformed: str = "block",
    max_broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Judge every URL: page_id, host, path, rule (null: none fits), verdict.

    Null ids stay null, repeated rows give repeated results, an empty table gives an empty one, further columns of the
    input are not read. A URL without a host (also null or empty) gets `malformed`, one that no rule fits `default`.
    Rules of more than max_broadcast_bytes are no longer one broadcast trie but a table to join with, with the same verdicts.
    """
    rules = [(v, h, p) for v, h, p in rules]
    for verdict, _, _ in rules:
        if verdict not in STRONGER:
            raise ValueError(f"a rule's verdict is allow or block, not {verdict!r}")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    if sum(len(h) + len(p) + 200 for _, h, p in rules) > max_broadcast_bytes:
        return _by_join(rows, rules, default, malformed)
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = trie.value.find
        for b in batches:
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            hits = [find(*p) if p[0] else None for p in parts]
            yield pa.record_batch(
                [
                    b.column(0),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([h and h[1] for h in hits], pa.string()),
                    pa.array([h[0] if h else default if p[0] else malformed for h, p in zip(hits, parts, strict=True)], pa.string()),
                ],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return map_batches(rows, judge, SCHEMA, 4096)


def _directory(path: Column) -> Column:
    """The whole segments of a rule's path, which a fitting URL must have too."""
    return F.regexp_extract(path, r"^(?s)(.*/)?", 0)


def _by_join(rows: DataFrame, rules: list[Rule], default: str, malformed: str) -> DataFrame:
    """The same decision for rule sets too large to broadcast: URLs look up their host suffixes and path directories."""
    spark = rows.sparkSession
    held = spark.createDataFrame([(v, h, p, STRONGER[v]) for v, h, p in rules], "verdict string, r_host string, r_path string, strong int")
    held = held.groupBy("r_host", "r_path").agg(F.max_by("verdict", "strong").alias("r_verdict")).withColumn("dir", _directory(F.col("r_path")))
    # what split_url says, as expressions
    rest = F.expr("if(instr(url, '://') > 0, substring(url, instr(url, '://') + 3), '')")
    host = F.regexp_extract("rest", r"^[^/?#]*", 0)
    path = F.regexp_extract(F.expr("substring(rest, length(raw) + 1)"), r"^[^?#]*", 0)
    urls = rows.withColumn("rest", F.coalesce(rest, F.lit(""))).withColumn("raw", host)
    urls = urls.select(F.monotonically_increasing_id().alias("row"), "page_id", F.translate("raw", string.ascii_uppercase, string.ascii_lowercase).alias("host"), path.alias("path"))
    labels, steps = F.split("host", r"\."), F.split("path", "/")
    keys = (
        urls.where(F.col("host") != "")
        .withColumn("labels", labels)
        .withColumn("steps", steps)
        .withColumn("cut", F.explode(F.expr("sequence(1, size(labels))")))
        .withColumn("r_host", F.expr("array_join(slice(labels, cut, size(labels) - cut + 1), '.')"))
        .withColumn("deep", F.explode(F.expr("sequence(0, size(steps) - 1)")))
        .withColumn("dir", F.expr("if(deep = 0, '', concat(array_join(slice(steps, 1, deep), '/'), '/'))"))
        .select("row", "page_id", "host", "path", "cut", "r_host", "dir")
    )
    hits = keys.join(held, ["r_host", "dir"]).where(F.col("path").startswith(F.col("r_path")))
    best = hits.withColumn("n", F.row_number().over(Window.partitionBy("row").orderBy("cut", F.length("r_path").desc()))).where("n = 1")
    best = best.select("row", F.concat("r_host", "r_path").alias("rule"), "r_verdict")
    verdict = F.coalesce("r_verdict", F.when(F.col("host") == "", F.lit(malformed)).otherwise(F.lit(default)))
    return urls.join(best, "row", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
