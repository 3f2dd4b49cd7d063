"""Observation tables as month-partitioned Parquet: append, read a month, find and repair misplaced rows.

What belongs to a table, ``root/dataset``, is what its commit log says (see commits.py); every change here is one commit,
and every read is of one version. The month is that of Japan time."""

from __future__ import annotations

import uuid
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import jst_month, month_bounds, month_bounds_columns
from ..schemas import KINDS, observation_fields
from .commits import MONTH, Conflict, Version, commit, filesystem, is_plain, month_of, names, version


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = filesystem(spark, path)
    return fs.exists(p)


def schema_of(dataset: str) -> str:
    """DDL of an observation table."""
    columns = [f"`{c}` {KINDS[kind]}" for c, (_, kind) in observation_fields(dataset).items()]
    return ", ".join(["id bigint", "ingested_at timestamp", *columns, "dump_month string"])


def write_units(df: DataFrame, top: str, max_records: int = 5_000_000) -> list[str]:
    """Writes rows with dump_month beside the table, and returns the units that a commit can add."""
    folder = f"_data/commit={uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", max_records).partitionBy("dump_month").parquet(f"{top}/{folder}")
    return [f"{folder}/{n}" for n in names(df.sparkSession, f"{top}/{folder}") if n.startswith(MONTH)]


def append_observations(
    df: DataFrame, root: str, dataset: str, max_records: int = 5_000_000, writer: str | None = None, batch: int | None = None
) -> int | None:
    """Every row is appended, none merged; returns the version. Rows are dealt out by month and evenly, so that the
    month in which everything arrives has as many writers as it needs, and a month of few rows one file.

    With a writer, its batches have ascending numbers, and one that was appended before is not appended again (None)."""
    spark, top = df.sparkSession, f"{root}/{dataset}"
    if writer is not None and version(spark, top).done.get(writer, -1) >= batch:
        return None
    out = df.withColumn("dump_month", jst_month(F.col("ingested_at"))).hint("rebalance", "dump_month")
    return commit(spark, top, write_units(out, top, max_records), writer=writer, batch=batch)


def read_units(spark: SparkSession, top: str, units: set[str]) -> DataFrame | None:
    """The rows of these units, None without any; others are not opened."""
    parts = []
    for base, some in ((top, [u for u in units if is_plain(u)]), (f"{top}/_data", [u for u in units if not is_plain(u)])):
        if some:
            df = spark.read.option("basePath", base).parquet(*[f"{top}/{u}" for u in sorted(some)])
            parts.append(df.drop("commit") if base != top else df)
    typed = [df.withColumn("dump_month", F.col("dump_month").cast("string")) for df in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), typed) if typed else None


def read_dataset(spark: SparkSession, root: str, dataset: str, schema: str | None = None, number: int | None = None) -> DataFrame:
    """All months of the latest version (or that of a number); empty, with the declared columns, if there is nothing."""
    found = read_units(spark, f"{root}/{dataset}", version(spark, f"{root}/{dataset}", number).units)
    return _declared(spark, found, dataset, schema)


def _declared(spark: SparkSession, found: DataFrame | None, dataset: str, schema: str | None) -> DataFrame:
    if found is None:
        return spark.createDataFrame([], schema or schema_of(dataset))
    if schema is None:
        return found
    fields = spark.createDataFrame([], schema).schema.fields
    return found.select(*[(F.col(f.name) if f.name in found.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def read_month(spark: SparkSession, root: str, dataset: str, month: str, schema: str | None = None, at: Version | None = None) -> DataFrame:
    """S3: one month's partition, the only one that is read; at: of this version."""
    month_bounds(month)
    top = f"{root}/{dataset}"
    units = (at or version(spark, top)).of_month(month)
    return _declared(spark, read_units(spark, top, units), dataset, schema)


def misplaced_rows(df: DataFrame, month: str | None = None, ts: str = "ingested_at", stored: str = "dump_month") -> DataFrame:
    """M1: rows that belong to the month (any month without one) but lie in another partition."""
    true = jst_month(F.col(ts))
    found = ~true.eqNullSafe(F.col(stored))
    return df.where(found & (true == month) if month else found)


def misplaced_counts(tables: dict[str, DataFrame], month: str) -> DataFrame:
    """M1 over datasets: (dataset, misplaced) where there are any."""
    counts = [misplaced_rows(df, month).agg(F.count("*").alias("misplaced")).withColumn("dataset", F.lit(k)) for k, df in tables.items()]
    return reduce(DataFrame.unionByName, counts).where("misplaced > 0").select("dataset", "misplaced")


def check_month_bounds(df: DataFrame, ts: str = "ingested_at", stored: str = "dump_month") -> DataFrame:
    """M3: (dump_month, first, last, within) per partition."""
    bounds = df.groupBy(stored).agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    lower, upper = month_bounds_columns(F.col(stored))
    return bounds.withColumn("within", F.coalesce((F.col("first") >= lower) & (F.col("last") < upper), F.lit(False)))


def repair_month(spark: SparkSession, root: str, dataset: str, month: str, ts: str = "ingested_at") -> int:
    """M2: moves the month's misplaced rows into its partition and returns how many; a second run moves none.

    The partitions that have them are written anew, checked, and exchanged in one commit. What is appended meanwhile is
    kept; if somebody else exchanged the same units meanwhile, the repair starts over."""
    top = f"{root}/{dataset}"
    while True:
        units = version(spark, top).units
        table = read_units(spark, top, units)
        if table is None:
            return 0
        wrong = misplaced_rows(table, month, ts)
        per_month = {r.dump_month: r.n for r in wrong.groupBy("dump_month").agg(F.count("*").alias("n")).collect()}  # months: few
        if not per_month:
            return 0
        old = {u for u in units if month_of(u) in per_month or (None in per_month and month_of(u).startswith("__HIVE"))}
        parts, true = read_units(spark, top, old), jst_month(F.col(ts))
        fixed = parts.withColumn("dump_month", F.when(true == month, F.lit(month)).otherwise(F.col("dump_month")))
        new = write_units(fixed.hint("rebalance", "dump_month"), top)
        built = read_units(spark, top, set(new))
        if built.count() != parts.count() or not misplaced_rows(built, month, ts).isEmpty():
            raise RuntimeError(f"repair of {dataset} {month} lost or left rows")
        try:
            commit(spark, top, new, sorted(old))
            return sum(per_month.values())
        except Conflict:
            continue


def drop_month(spark: SparkSession, root: str, dataset: str, month: str, at: Version | None = None) -> bool:
    """Removes the month's units, those of a version if one is given; rows that came later then stay. vacuum() frees the disk."""
    month_bounds(month)
    top = f"{root}/{dataset}"
    units = (at or version(spark, top)).of_month(month)
    return bool(units) and commit(spark, top, [], sorted(units)) is not None


def is_closed(month: str, now: datetime) -> bool:
    """M4: whether the month has ended in Japan; now is UTC without zone."""
    return now >= month_bounds(month)[1]
