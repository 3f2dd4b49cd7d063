"""Validation is the dearest step: results that are read several times read what it wrote."""

import pytest
from pyspark.sql import functions as F

from tidefold.operators import improvement, ingest, normalize


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def envelopes(spark, kind):
    rows = [(1, "2024-01-05 00:00:00", kind, "{}", "r", "a"), (2, "2024-01-06 00:00:00", kind, "no JSON", "r", "a")]
    df = spark.createDataFrame(rows, "id long, ingested_at string, kind string, data string, x_reporter string, user_agent string")
    return df.withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))


def test_records_of_all_routes_are_validated_once(spark):
    parsed = normalize.parse_reports(envelopes(spark, "item_improvement").withColumn("received_ms", F.lit(0).cast("long")))[0]
    for side in improvement.improvement_records(parsed):
        assert "variant_get" not in plan(side)


@pytest.mark.parametrize("rows", [ingest.quest_rows, ingest.reward_rows, ingest.enemy_rows, lambda df: ingest.fact_rows(df, 1)])
def test_rows_of_folds_that_read_them_again_are_written(spark, rows):
    kind = {ingest.quest_rows: "quest", ingest.reward_rows: "quest_reward", ingest.enemy_rows: "enemy_info"}.get(rows, "item_improvement")
    taken, rejected = rows(envelopes(spark, kind))
    assert "variant_get" not in plan(taken) and taken.count() == 0
    assert sorted(r.id for r in rejected.select("id").collect()) == [1, 2]
