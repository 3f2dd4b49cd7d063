from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidefold.operators import folds
from tidefold.sources import observations
from tidefold.streaming import reports

SCHEMA = "id long, ingested_at timestamp, user long, kind string, value long"


def rows(n, first=0):
    return [(k, datetime(2024, 1, 31, 14, 0) + timedelta(minutes=7 * k), k % 5, "ab"[k % 2], k * 37 % 11) for k in range(first, first + n)]


@pytest.fixture
def stream(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame(rows(20, 20 * k), SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


def fold(df):
    return folds.accumulate_facts(df.withColumn("kinds", F.array("kind")), ["user"], ["kind"], "value", "id", ["kinds"], ["ingested_at", "id"])


def merge(old, new):
    spec = {"kind": "first", "first_client_observed_at": "min", "last_client_observed_at": "max", "first_reported": "first", "last_reported": "max", "count": "sum", "kinds": "union"}
    return folds.merge_state(old, new, ["user"], spec)


def test_state_equals_batch_and_replays_do_nothing(spark, stream, tmp_path):
    root = f"{tmp_path}/state"
    reports.stream_state(stream, fold, merge, root, f"{tmp_path}/ckpt").awaitTermination()
    whole = fold(spark.createDataFrame(rows(60), SCHEMA))
    key = lambda df: sorted(str(r.asDict(True)) for r in df.select(sorted(df.columns)).collect())
    assert key(reports.read_state(spark, root)) == key(whole)
    reports.apply_batch(spark.createDataFrame(rows(5), SCHEMA), 2, fold, merge, root)
    assert key(reports.read_state(spark, root)) == key(whole)


def test_observations_go_to_their_months_once(spark, stream, tmp_path):
    for _ in range(2):
        reports.stream_observations(stream, f"{tmp_path}/root", "x", f"{tmp_path}/ckpt").awaitTermination()
    got = observations.read_dataset(spark, f"{tmp_path}/root", "x").groupBy("dump_month").count().collect()
    want = {}
    for r in rows(60):
        month = f"{r[1] + timedelta(hours=9):%Y-%m}"
        want[month] = want.get(month, 0) + 1
    assert {str(r.dump_month): r["count"] for r in got} == want and len(want) == 2


def test_days_batch_and_stream(spark, stream, tmp_path):
    batch = {(r.day, r.kind): r["count"] for r in reports.jst_day_counts(spark.createDataFrame(rows(60), SCHEMA), "ingested_at", ["kind"]).collect()}
    want = {}
    for r in rows(60):
        k = f"{r[1] + timedelta(hours=9):%Y-%m-%d}", r[3]
        want[k] = want.get(k, 0) + 1
    assert batch == want
    out = reports.jst_day_counts(stream, "ingested_at", ["kind"]).writeStream.format("memory").queryName("days").outputMode("append")
    out.option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start().awaitTermination()
    got = {(r.day, r.kind): r["count"] for r in spark.table("days").collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_settled_and_late(spark, stream, tmp_path):
    facts = stream.select(F.col("user").alias("export_id"), F.col("ingested_at").alias("last_reported_ts"))
    twice = facts.unionByName(facts)
    q = reports.settled_facts(twice).writeStream.format("memory").queryName("settled").outputMode("append")
    q.option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("settled").count() == 60
    open_, late = reports.split_late(spark.createDataFrame(rows(60), SCHEMA), ["2024-01"])
    assert late.count() + open_.count() == 60 and late.count() == 9
    assert reports.split_late(open_, [])[1].isEmpty()


def test_all_datasets_from_a_stream_of_envelopes(spark, tmp_path):
    """A query for each dataset; a second start with the same checkpoints adds nothing."""
    schema = "id long, ingested_at timestamp, data string, x_reporter string, user_agent string, kind string"
    at = datetime(2024, 1, 31, 16)
    ranks = [(i, at, f'{{"teitokuId":"t","mapareaId":1,"rank":{i}}}', None, "agent", "select_rank") for i in (1, 2)]
    others = [(3, at, '{"itemId":5}', "", "agent", "create_item"), (4, at, '{"itemId":"x"}', None, None, "create_item"), (5, at, None, None, None, None)]
    spark.createDataFrame(ranks + others, schema).write.partitionBy("kind").parquet(str(tmp_path / "in"))
    root = str(tmp_path / "out")
    for _ in range(2):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        for query in reports.stream_reports(stream, root, str(tmp_path / "checkpoint")):
            query.awaitTermination()
    state = reports.read_state(spark, f"{root}/states/selectRankStates")
    assert [(r.teitoku_id, r["rank"], r.origin) for r in state.collect()] == [("t", 2, "agent")]
    items = observations.read_dataset(spark, f"{root}/observations", "createItemObservations")
    assert [(r.id, r.item_id, r.origin, r.dump_month) for r in items.collect()] == [(3, 5, "agent", "2024-02")]
    assert reports.read_state(spark, f"{root}/states/questDefinitions") is None or reports.read_state(spark, f"{root}/states/questDefinitions").isEmpty()
