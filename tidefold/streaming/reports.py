"""Streams of reports: append, fold into state, settle, count by Japan-time day, split off late rows.

State lives in versioned folders of a root: ``state-00000007`` holds the whole state after batch 7, and the
folder with the highest complete number counts. A replayed batch finds its version written and does nothing."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.calendar import japan, jst_month
from ..operators import ingest
from ..schemas import OBSERVATIONS
from ..sources.commits import read_text
from ..sources.facts import apply_facts
from ..sources.observations import append_observations, exists, filesystem


def stream_observations(stream: DataFrame, root: str, dataset: str, checkpoint: str, **options) -> StreamingQuery:
    """Every arriving row to its month, exactly once: a batch is one commit in the table's log, under the query's
    own id, so a replayed batch adds nothing. Batch appends, repairs and drops go through the same log."""

    def append(batch: DataFrame, batch_id: int) -> None:
        append_observations(batch, root, dataset, writer=query_id(batch.sparkSession, checkpoint), batch=batch_id)

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return writer.trigger(**(options or {"availableNow": True})).start()


def latest_version(spark: SparkSession, root: str) -> int | None:
    if not exists(spark, root):
        return None
    fs, p = filesystem(spark, root)
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    done = [int(n.removeprefix("state-")) for n in names if n.startswith("state-") and exists(spark, f"{root}/{n}/_SUCCESS")]
    return max(done, default=None)


def read_state(spark: SparkSession, root: str) -> DataFrame | None:
    version = latest_version(spark, root)
    return None if version is None else spark.read.parquet(f"{root}/state-{version:08}")


def apply_batch(batch: DataFrame, batch_id: int, fold: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame, DataFrame], DataFrame], root: str, keep: int = 2) -> None:
    """Folds a batch and merges it with the state before it; idempotent by batch_id."""
    spark = batch.sparkSession
    version = latest_version(spark, root)
    if version is not None and version >= batch_id:
        return
    folded = fold(batch)
    new = folded if version is None else merge(spark.read.parquet(f"{root}/state-{version:08}"), folded)
    new.write.mode("overwrite").parquet(f"{root}/state-{batch_id:08}")
    fs, p = filesystem(spark, root)
    old = sorted(f.getPath().getName() for f in fs.listStatus(p) if f.getPath().getName().startswith("state-"))
    for name in old[:-keep]:
        fs.delete(filesystem(spark, f"{root}/{name}")[1], True)


def stream_state(
    stream: DataFrame, fold: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame, DataFrame], DataFrame], root: str, checkpoint: str, **options
) -> StreamingQuery:
    """A state that every batch is folded into; fold and merge are those of the batch operators."""
    writer = stream.writeStream.foreachBatch(lambda batch, batch_id: apply_batch(batch, batch_id, fold, merge, root))
    return writer.option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """A streaming query's own id, which is kept with its checkpoint."""
    return json.loads(read_text(spark, f"{checkpoint}/metadata").splitlines()[-1])["id"]


def stream_facts(stream: DataFrame, root: str, checkpoint: str, **options) -> StreamingQuery:
    """Envelopes to the fact store, a version for each batch; a replayed batch adds nothing and numbers nothing."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        apply_facts(batch, batch_id, root, writer=query_id(batch.sparkSession, checkpoint))

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(**(options or {"availableNow": True})).start()


def settled_facts(stream: DataFrame, time: str = "last_reported_ts", key: tuple[str, ...] = ("export_id",), delay: str = "30 seconds") -> DataFrame:
    """Each version of a fact (key and time) once; the watermark bounds what is remembered to the settling time."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([*key, time])


def jst_day_counts(df: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """T4: rows per Japan-time day and keys; batch or stream (then days come out once the watermark has passed them)."""
    timed = df.withColumn(ts, F.col(ts).cast("timestamp"))
    if df.isStreaming:
        timed = timed.withWatermark(ts, late)
    day = F.window(ts, "1 day", "1 day", "15 hours")
    counted = timed.groupBy(day.alias("w"), *keys).agg(F.count("*").alias("count"))
    return counted.select(F.date_format(japan(F.col("w.start")), "yyyy-MM-dd").alias("day"), *keys, "count")


def split_late(df: DataFrame, published: list[str], ts: str = "ingested_at") -> tuple[DataFrame, DataFrame]:
    """T5: (rows of open months, rows of months that are published already). published: a name per month."""
    late = jst_month(F.col(ts)).isin(published) if published else F.lit(False)
    return df.where(~late), df.where(late)


def ingest_batch(envelopes: DataFrame, batch_id: int, root: str) -> None:
    """W1, W2 as a batch: observations are appended to ``root/observations``, states become version batch_id, and facts
    a layer of the store ``root/facts``, numbered for export.

    All are idempotent by batch_id."""
    for dataset in OBSERVATIONS:
        append_observations(ingest.observations_of(envelopes, dataset)[0], f"{root}/observations", dataset, writer="ingest_batch", batch=batch_id)
    for name, job in ingest.STATE_JOBS.items():
        if name not in ingest.FACT_JOBS:
            apply_batch(envelopes, batch_id, job.folded, job.merged, f"{root}/states/{name}")
    apply_facts(envelopes, batch_id, f"{root}/facts", writer="ingest_batch")


def stream_reports(stream: DataFrame, root: str, checkpoint: str, **options) -> list[StreamingQuery]:
    """W1, W2 as streams: one query for each dataset, and one for all facts, with a checkpoint of its own, each exactly
    once and restarted by itself. Envelopes stored by kind are pruned to each query's kind."""
    queries = [
        stream_observations(ingest.observations_of(stream, d)[0], f"{root}/observations", d, f"{checkpoint}/{d}", **options) for d in OBSERVATIONS
    ]
    queries.append(stream_facts(stream, f"{root}/facts", f"{checkpoint}/facts", **options))
    for name, job in ingest.STATE_JOBS.items():
        if name not in ingest.FACT_JOBS:
            queries.append(stream_state(stream, job.folded, job.merged, f"{root}/states/{name}", f"{checkpoint}/{name}", **options))
    return queries
