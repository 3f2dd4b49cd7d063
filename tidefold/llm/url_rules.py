"""URL filters as a sort-merge range join.

A host's labels in reverse order form a canonical key; a rule's host is then the interval of all keys that begin with
it, and these intervals are nested or apart. URLs are range-partitioned and sorted by key; each task sweeps its range
once with the sorted rules beside it and keeps a stack of the rules whose intervals hold the current key. On each
level of the stack, the rules of one host are sorted by path, and the longest fitting path is found the same way: the
last path not above the URL's, or one of the paths that this one begins with. The longest rule (host and path
together) decides; of equally long ones the one with the longer host; of equal rules, block.

Rules are sent to the tasks in blocks of at most ``block_rules``, so what is broadcast has that bound however many
rules there are; with several blocks the sweep is repeated and the longest match kept. A host with a third of all
URLs spreads over tasks, because path and row take part in the range partitioning.

Defined results: a null url, or one without ``://``, has empty host and path and fits no rule. URLs that fit no rule
get ``default``. Repeated rows each get their verdict. Empty tables give empty results, no rules the default.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ends a label in a key; below every character of a host, so a host sorts right before its subdomains.
END = "\x01"


def url_parts(df: DataFrame, url: str) -> DataFrame:
    """df (page_id, url) with host and path."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    return df.withColumns(
        {
            "host": F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER),
            "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
        }
    )


def key_of(host: str) -> str:
    return "".join(label + END for label in reversed(host.split(".")))


class Paths:
    """The rules of one host, sorted by path; above[i] is the longest other path that path i begins with."""

    def __init__(self, key: str, host: str, rules: dict[str, str]):
        self.key, self.host = key, host
        self.paths = sorted(rules)
        self.actions = [rules[p] for p in self.paths]
        self.above: list[int] = []
        for i, p in enumerate(self.paths):
            j = i - 1
            while j >= 0 and not p.startswith(self.paths[j]):
                j = self.above[j]
            self.above.append(j)

    def longest(self, path: str) -> int:
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.above[i]
        return i


def sorted_hosts(rules: list[tuple[str, str, str]]) -> list[Paths]:
    by_host: dict[str, dict[str, str]] = {}
    for host, path, action in rules:
        own = by_host.setdefault(host, {})
        own[path] = "block" if "block" in (action, own.get(path)) else action
    return sorted((Paths(key_of(h), h, own) for h, own in by_host.items()), key=lambda x: x.key)


def sweep(hosts: list[Paths], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Judges URLs that come sorted by key; the stack lives on from batch to batch."""
    stack: list[Paths] = []
    at, before = 0, None
    for batch in batches:
        rules, actions, ranks = [], [], []
        for key, path, rank, rule, action in zip(*(batch.column(c).to_pylist() for c in ("key", "path", "rank", "rule", "action"))):
            if key != before:
                while at < len(hosts) and hosts[at].key <= key:
                    while stack and not hosts[at].key.startswith(stack[-1].key):
                        stack.pop()
                    stack.append(hosts[at])
                    at += 1
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                before = key
            for x in stack:
                i = x.longest(path)
                if i >= 0:
                    new = (len(x.host) + len(x.paths[i])) * 65536 + len(x.host)
                    if new > rank:
                        rank, rule, action = new, x.host + x.paths[i], x.actions[i]
            rules.append(rule)
            actions.append(action)
            ranks.append(rank)
        out = {"rank": pa.array(ranks, pa.int64()), "rule": pa.array(rules, pa.string()), "action": pa.array(actions, pa.string())}
        columns = [out.get(n, batch.column(k)) for k, n in enumerate(batch.schema.names)]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def judge_urls(
    pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow", block_rules: int = 100_000
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages; rules has host, path, action."""
    ship(pages.sparkSession)
    rules = rules.select("host", "path", "action")
    found = rules.limit(block_rules + 1).collect()
    if len(found) <= block_rules:
        blocks = [[tuple(r) for r in found]]
    else:
        n = ceil(1.2 * rules.count() / block_rules)
        part = F.pmod(F.xxhash64("host", "path"), F.lit(n))
        blocks = ([tuple(r) for r in rules.where(part == k).collect()] for k in range(n))
    parts = url_parts(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")), "url").drop("url")
    key = F.concat(F.array_join(F.reverse(F.split("host", r"\.", -1)), END), F.lit(END))
    keyed = parts.withColumns(
        {"key": key, "rank": F.lit(-1).cast("long"), "rule": F.lit(None).cast("string"), "action": F.lit(None).cast("string")}
    )
    swept = keyed.withColumn("row", F.monotonically_increasing_id()).repartitionByRange("key", "path", "row").drop("row")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in keyed.schema])
    for block in blocks:
        hosts = sorted_hosts(block)
        swept = swept.sortWithinPartitions("key").mapInArrow(lambda batches, hosts=hosts: sweep(hosts, batches), schema)
    return swept.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))
