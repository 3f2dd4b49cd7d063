"""Facts with ids that live on: folded batches are kept as layers, merged on reading, numbered once and for all.

A store has layers of several tables below ``_data`` and versions below ``_log``; a version is one small file that names
each table's layers in order, the next free id and the last batch of each writer. It is put in place by a rename that
fails if somebody else was first, so layers, ids and the batch's number count together or not at all; what a broken-off
write left is nobody's. Then ids are drawn again from the new version: a number that was seen is never given twice.

Envelopes are read and validated once for all tables. A batch writes its own fold only. To know which keys are new it reads the stored keys of the hash buckets that it
touches, and no other column. Ids ascend over all tables together, in the order in which facts were first reported
within a batch, and every fact of a later batch has a higher one. A table with more than max_layers layers is merged
into one, which is the only time that stored rows are written again.

Defined results: an empty batch counts as done and adds no layer; a replayed one does nothing; a table that no batch has
filled reads as None."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import export_id
from ..operators import folds
from ..operators.exports import with_ordered_index
from ..operators.ingest import FACT_JOBS, State, fact_records
from ..storage import written
from .commits import filesystem, names, put, read_text

BUCKETS, MAX_LAYERS = 64, 8


@dataclass
class Version:
    number: int = 0
    next_id: int = 1
    buckets: int = BUCKETS
    layers: dict[str, list[str]] = field(default_factory=dict)  # table -> folders, the oldest first
    done: dict[str, int] = field(default_factory=dict)  # writer -> its last batch


def latest(spark: SparkSession, root: str) -> Version:
    numbers = [int(n[:-5]) for n in names(spark, f"{root}/_log") if n.endswith(".json") and n[:-5].isdigit()]
    return Version(**json.loads(read_text(spark, f"{root}/_log/{max(numbers):010}.json"))) if numbers else Version()


def _commit(spark: SparkSession, root: str, version: Version) -> bool:
    return put(spark, f"{root}/_log/{version.number:010}.json", json.dumps(vars(version)))


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


def _write_layer(df: DataFrame, root: str, table: str) -> str:
    folder = f"{table}/{uuid.uuid4().hex}"
    df.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{root}/_data/{folder}")
    return folder


def _layers(spark: SparkSession, root: str, folders: list[str]) -> DataFrame:
    """Rows of these layers with the layer's place."""
    parts = [spark.read.parquet(f"{root}/_data/{f}").withColumn("_layer", F.lit(k)) for k, f in enumerate(folders)]
    return reduce(DataFrame.unionByName, parts)


def _merged(spark: SparkSession, root: str, folders: list[str], job: State) -> DataFrame:
    if len(folders) == 1:
        return _layers(spark, root, folders).drop("_layer", "bucket")
    return folds.merge_layers(_layers(spark, root, folders), job.keys, {"id": "max", **job.spec}, "_layer")


def read_facts(spark: SparkSession, root: str, table: str, jobs: dict[str, State] = FACT_JOBS) -> DataFrame | None:
    """The table as of the latest version: id, export_id, and the fact."""
    folders = latest(spark, root).layers.get(table)
    return _merged(spark, root, folders, jobs[table]).withColumn("export_id", export_id(F.col("id"))) if folders else None


def apply_facts(
    batch: DataFrame, number: int, root: str, writer: str = "batch", jobs: dict[str, State] = FACT_JOBS, max_layers: int = MAX_LAYERS
) -> int | None:
    """Folds a batch of envelopes into all tables as one version and returns its number; None for a replayed batch.

    A writer's batches have ascending numbers. jobs: from fact_records to folds with a column ``born``, the place of a
    key's first report in the batch, by which new facts are numbered."""
    spark, folded = batch.sparkSession, {}
    while True:
        now = latest(spark, root)
        if now.done.get(writer, -1) >= number:
            return None
        if not folded:
            records = written(fact_records(batch)[0], "records")
            folded = {t: written(job.folded(records).withColumn("bucket", _bucket(job.keys, now.buckets)), "fold") for t, job in jobs.items()}
        births, layers, touched = [], {t: list(f) for t, f in now.layers.items()}, {}
        for place, (table, job) in enumerate(jobs.items()):
            new, touched[table] = folded[table], [r.bucket for r in folded[table].select("bucket").distinct().collect()]
            if touched[table] and now.layers.get(table):
                old = _layers(spark, root, now.layers[table]).where(F.col("bucket").isin(touched[table]) & F.col("id").isNotNull())
                new = new.join(old.select(*job.keys), job.keys, "left_anti")
            births.append(new.select(F.struct(F.col("born"), F.lit(place).alias("table"), F.to_json(F.struct(*job.keys)).alias("key")).alias("at")))
        numbered = written(with_ordered_index(reduce(DataFrame.unionByName, births), ["at"], "id", now.next_id), "ids")
        for place, (table, job) in enumerate(jobs.items()):
            if touched[table]:
                ids = numbered.where(F.col("at.table") == place).select(F.col("at.key").alias("_key"), F.col("id").cast("long").alias("id"))
                layer = folded[table].withColumn("_key", F.to_json(F.struct(*job.keys))).join(ids, "_key", "left").drop("_key", "born")
                layers.setdefault(table, []).append(_write_layer(layer, root, table))
        version = Version(now.number + 1, now.next_id + numbered.count(), now.buckets, layers, now.done | {writer: number})
        if _commit(spark, root, version):
            for table in jobs:
                compact(spark, root, table, jobs, max_layers)
            return version.number


def compact(spark: SparkSession, root: str, table: str, jobs: dict[str, State] = FACT_JOBS, max_layers: int = 1) -> int | None:
    """Merges a table of more than max_layers layers into one; the version, or None if there was nothing to do.

    Layers that others add meanwhile stay on top."""
    now = latest(spark, root)
    old = now.layers.get(table, [])
    if len(old) <= max_layers:
        return None
    merged = _merged(spark, root, old, jobs[table])
    folder = _write_layer(merged.withColumn("bucket", _bucket(jobs[table].keys, now.buckets)), root, table)
    while now.layers.get(table, [])[: len(old)] == old:
        layers = now.layers | {table: [folder, *now.layers[table][len(old) :]]}
        if _commit(spark, root, Version(now.number + 1, now.next_id, now.buckets, layers, now.done)):
            return now.number + 1
        now = latest(spark, root)
    return None  # another merge was first


def vacuum(spark: SparkSession, root: str, keep: timedelta = timedelta(days=7), now: datetime | None = None) -> int:
    """Deletes layers that the latest version does not have and that are older than keep; returns how many."""
    live = {f for folders in latest(spark, root).layers.values() for f in folders}
    limit, count = ((now or datetime.now(timezone.utc)) - keep).timestamp() * 1000, 0
    for table in names(spark, f"{root}/_data"):
        for folder in names(spark, f"{root}/_data/{table}"):
            fs, p = filesystem(spark, f"{root}/_data/{table}/{folder}")
            if f"{table}/{folder}" not in live and fs.getFileStatus(p).getModificationTime() < limit:
                if not fs.delete(p, True):
                    raise RuntimeError(f"cannot delete {p}")
                count += 1
    return count
