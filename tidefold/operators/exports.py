"""Incremental keyset exports, known definitions, counts and reconciliation."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import export_id, quest_prefix
from ..functions.calendar import jst_month
from ..storage import written

SETTLED_MS, DEFAULT_LIMIT, MAX_LIMIT = 30_000, 500, 1000


def with_ordered_index(df: DataFrame, cols: list[str], name: str = "index", start: int = 0) -> DataFrame:
    """Dense numbers from start on in the order of cols, which are unique: no single-task window.

    Rows are range-partitioned, sorted and numbered within their partition; a table with a row per partition adds what
    is before."""
    at = F.monotonically_increasing_id()
    sorted_ = written(df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_at", at), "ordered")
    part, inner = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # a row per partition
    joined = sorted_.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.withColumn(name, inner + F.col("_before") + start).drop("_at", "_part", "_before")


def assign_export_ids(df: DataFrame, order: list[str], start: int = 1) -> DataFrame:
    """K6: id and export_id for new facts in the order of their first insert."""
    return with_ordered_index(df, order, "id", start).withColumn("export_id", export_id(F.col("id")))


def settled(df: DataFrame, now_ms: int, time: str = "last_reported") -> DataFrame:
    return df.where(F.col(time) <= now_ms - SETTLED_MS)


def export_page(
    df: DataFrame, now_ms: int, updated_after: int = 0, after_id: str | None = None, limit: int = DEFAULT_LIMIT,
    time: str = "last_reported", id: str = "export_id",
) -> DataFrame:
    """Q1: settled facts after the cursor (time, id), in order; without an id, those of that very time are past."""
    if limit <= 0 or updated_after < 0:
        raise ValueError("limit must be positive and updated_after not negative")
    beyond = F.col(time) > updated_after
    if after_id is not None:
        beyond = beyond | ((F.col(time) == updated_after) & (F.col(id) > after_id))
    return settled(df, now_ms, time).where(beyond).orderBy(time, id).limit(min(limit, MAX_LIMIT))


def next_cursor(page: DataFrame, time: str = "last_reported", id: str = "export_id") -> DataFrame:
    """Q3: one row with the last place of the page; no row if the page is empty."""
    last = page.agg(F.max(F.struct(F.col(time).alias("t"), F.col(id).alias("i"))).alias("c"))
    return last.where("c IS NOT NULL").select(F.col("c.t").alias("updated_after"), F.col("c.i").alias("after_id"))


def export_pages(df: DataFrame, now_ms: int, limit: int = DEFAULT_LIMIT, time: str = "last_reported", id: str = "export_id") -> DataFrame:
    """Q4: all pages of a full walk at once: page and position for every settled fact."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    limit = min(limit, MAX_LIMIT)
    numbered = with_ordered_index(settled(df, now_ms, time), [time, id], "_i")
    return numbered.withColumns({"page": F.floor(F.col("_i") / limit), "position": F.col("_i") % limit}).drop("_i")


def public_columns(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Q2: the public columns under their public names, in this order."""
    return df.select(*[F.col(c).alias(n) for c, n in renames.items()])


def known_ids(df: DataFrame, col: str) -> DataFrame:
    """Q5: distinct values, sorted as text."""
    return df.select(col).distinct().orderBy(F.col(col).cast("string"))


def known_prefixes(df: DataFrame, col: str, n: int = 8) -> DataFrame:
    """Q6: a prefix for each distinct value; equal prefixes of different values both stay."""
    return df.select(col).distinct().select(quest_prefix(F.col(col), n).alias("prefix"))


def dataset_counts(tables: dict[str, DataFrame], names: Iterable[str]) -> DataFrame:
    """Q7: rows of each name in the list; 0 where there is no table. Counts come from file footers."""
    names = list(names)
    spark = next(iter(tables.values())).sparkSession
    counts = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).withColumn("dataset", F.lit(k)) for k, df in tables.items()])
    wanted = spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("dataset"))
    return wanted.join(counts, "dataset", "left").select("dataset", F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)).alias("count"))


def month_counts(df: DataFrame, ts: str, dataset: str | None = None) -> DataFrame:
    """Rows per dataset and Japan-time month."""
    name = F.col(dataset) if dataset else F.lit("all")
    return df.groupBy(name.alias("dataset"), jst_month(F.col(ts)).alias("dump_month")).agg(F.count("*").alias("count"))


def reconcile(manifest: DataFrame, files: DataFrame, key: str = "dataset", columns: tuple[str, ...] = ("object_key", "row_count", "bytes", "sha256")) -> DataFrame:
    """Q9: what differs: (key, problem); no row if both agree. A key may occur once on each side."""
    doubled = [
        df.groupBy(key).count().where("count > 1").select(key, F.lit(f"duplicate in {side}").alias("problem"))
        for side, df in (("manifest", manifest), ("files", files))
    ]
    both = manifest.alias("m").join(files.alias("f"), F.col(f"m.{key}") == F.col(f"f.{key}"), "full_outer")
    problem = F.when(F.col(f"f.{key}").isNull(), F.lit("missing file")).when(F.col(f"m.{key}").isNull(), F.lit("not in manifest"))
    for c in columns:
        problem = problem.when(~F.col(f"m.{c}").eqNullSafe(F.col(f"f.{c}")), F.lit(f"{c} differs"))
    found = both.select(F.coalesce(F.col(f"m.{key}"), F.col(f"f.{key}")).alias(key), problem.alias("problem")).where("problem IS NOT NULL")
    return reduce(DataFrame.unionByName, [found, *doubled])
