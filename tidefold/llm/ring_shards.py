"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, with DataFrame functions only.

Every shard owns many points of a ring. A row starts at its key's place and goes clockwise to the first shard with
room. All keys between two neighbouring points meet the shards in the same order, so only the row counts of these
arcs are needed to decide who overflows; there are as many arcs as points, whatever the input. Rows of an arc are
ranked, the arc's ranks are dealt to shards as ranges, and a row's slot follows from its rank.

With epsilon 0 a shard's capacity is its exact share, so row counts differ by one at most (law ``rows``). A larger
epsilon lets shards take (1 + epsilon) times the mean, and moves fewer rows when a shard is added.

Defined results: a null text has size 1 and CRC 0. A null key has a place like any other. Repeated rows are rows of
their own, counted together before the shuffle and dealt out again; a key with a third of all rows is no single task.
An empty table gives an empty result. Only the key and text columns are read.
"""

from __future__ import annotations

import hashlib
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_table, written

SLICE_BITS = 16


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(slice, shard) of every virtual node, clockwise."""
    points = []
    for shard in range(shards):
        for v in range(vnodes):
            place = int(hashlib.md5(f"{shard}/{v}".encode()).hexdigest()[:16], 16)
            points.append((place, shard))
    return [(place >> (64 - SLICE_BITS), shard) for place, shard in sorted(points)]


def clockwise(points: list[tuple[int, int]], start: int, shards: int) -> list[int]:
    """The shards in the order in which they are met from the point start on."""
    met: dict[int, None] = {}
    for k in range(len(points)):
        met[points[(start + k) % len(points)][1]] = None
        if len(met) == shards:
            break
    return list(met)


def capacities(rows: int, shards: int, epsilon: float) -> list[int]:
    if epsilon > 0:
        return [ceil((1 + epsilon) * rows / shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def deal(counts: dict[int, int], points: list[tuple[int, int]], shards: int, epsilon: float) -> list[dict]:
    """Ranges of ranks: all arcs offer their rows to the first shard they meet, then what is left to the second."""
    room = capacities(sum(counts.values()), shards, epsilon)
    given, filled = dict.fromkeys(counts, 0), [0] * shards
    order = {arc: clockwise(points, arc, shards) for arc in counts}
    ranges = []
    for hop in range(shards):
        for arc in sorted(counts):
            shard = order[arc][hop]
            take = min(counts[arc] - given[arc], room[shard] - filled[shard])
            if take > 0:
                ranges.append({"arc": arc, "lo": given[arc], "hi": given[arc] + take, "shard": shard, "base": filled[shard]})
                given[arc] += take
                filled[shard] += take
    return ranges


def ring_shards(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shards: int = 16,
    vnodes: int = 128,
    epsilon: float = 0.0,
    cells: int = 16,
    run: int = 65_536,
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row for each row of docs.

    Bounded on the driver: shards * vnodes arc counts, and at most shards times as many ranges. cells: parts of an arc
    that are ranked on their own. run: copies of one row that one task writes out."""
    spark = docs.sparkSession
    points = ring(shards, vnodes)
    first: dict[int, int] = {}
    for at, (place, _) in enumerate(points):
        first.setdefault(place, at)
    arcs, low = [], 0
    for place in sorted(first):
        arcs.append({"arc": first[place], "from": low, "to": place})
        low = place + 1
    if low < 1 << SLICE_BITS:
        arcs.append({"arc": 0, "from": low, "to": (1 << SLICE_BITS) - 1})
    slices = small_table(spark, arcs, "arc int, from int, to int").select(
        "arc", F.explode(F.sequence("from", "to")).alias("slice")
    )
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(key)).alias("place"),
    )
    placed = keyed.withColumn("slice", F.shiftrightunsigned("place", 64 - SLICE_BITS).cast("int"))
    placed = placed.join(F.broadcast(slices), "slice").withColumn("cell", F.pmod(F.col("place"), F.lit(cells)).cast("int"))
    one = ["arc", "cell", "place", "doc_id", "size", "text_crc32"]
    groups = written(placed.groupBy(*one).agg(F.count("*").alias("n")), "ring-rows")

    totals = groups.groupBy("arc", "cell").agg(F.sum("n").alias("n")).collect()  # vnodes * shards * cells at most
    counts: dict[int, int] = {}
    starts = []
    for arc, cell, n in sorted(map(tuple, totals)):
        starts.append({"arc": arc, "cell": cell, "start": counts.get(arc, 0)})
        counts[arc] = counts.get(arc, 0) + n
    starts = F.broadcast(small_table(spark, starts, "arc int, cell int, start long"))
    ranges = small_table(spark, deal(counts, points, shards, epsilon), "arc int, lo long, hi long, shard int, base long")
    ranges = F.broadcast(ranges.groupBy("arc").agg(F.collect_list(F.struct("lo", "hi", "shard", "base")).alias("ranges")))

    before = W.partitionBy("arc", "cell").orderBy("place", "doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, -1)
    ranked = groups.withColumn("rank", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranked = ranked.join(starts, ["arc", "cell"]).withColumn("rank", F.col("rank") + F.col("start"))
    end = F.col("rank") + F.col("n")
    dealt = ranked.join(ranges, "arc").select(
        "doc_id", "size", "text_crc32", "rank", end.alias("end"),
        F.explode(F.filter("ranges", lambda r: (r["lo"] < end) & (r["hi"] > F.col("rank")))).alias("r"),
    )
    dealt = dealt.select(
        "doc_id", "size", "text_crc32", F.col("r.shard").alias("shard"),
        (F.greatest("rank", "r.lo") - F.col("r.lo") + F.col("r.base")).alias("slot"),
        (F.least("end", "r.hi") - F.greatest("rank", "r.lo")).alias("n"),
    )
    # Copies of one row: runs of them are spread over tasks before they are written out.
    single = dealt.where("n = 1").drop("n")
    many = dealt.where("n > 1")
    many = many.withColumn("at", F.explode(F.expr(f"sequence(0L, n - 1, {run}L)"))).repartition("doc_id", "shard", "slot", "at")
    many = many.select(
        "doc_id", "size", "text_crc32", "shard",
        F.explode(F.expr(f"sequence(slot + at, slot + least(at + {run}L, n) - 1)")).alias("slot"),
    )
    law = "rows" if epsilon == 0 else "load"
    return single.unionByName(many).select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
