from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidefold.sources import commits, dump, observations
from tidefold.streaming import reports

NIGHT = "nightContactObservations"


def contacts(spark, ids, at=datetime(2026, 6, 10)):
    df = spark.createDataFrame([(i, at) for i in ids], "id long, ingested_at timestamp")
    return df.selectExpr("*", "1 AS fleet_type", "2 AS ship_id", "3 AS ship_lv", "4 AS item_id", "5 AS item_lv", "true AS contact")


def ids(spark, root, **kwargs):
    return sorted(r.id for r in observations.read_dataset(spark, root, NIGHT, **kwargs).collect())


def test_stream_append_repair_publish_clean_and_read_on(spark, tmp_path):
    root, out, top = f"{tmp_path}/root", f"{tmp_path}/out", f"{tmp_path}/root/{NIGHT}"
    contacts(spark, range(5)).coalesce(1).write.parquet(f"{tmp_path}/in/a")

    def run():
        source = spark.readStream.schema(contacts(spark, [1]).schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        reports.stream_observations(source, root, NIGHT, f"{tmp_path}/ckpt").awaitTermination()

    run()
    observations.append_observations(contacts(spark, range(5, 10)), root, NIGHT)
    assert ids(spark, root) == list(range(10))
    wrong = contacts(spark, [10, 11]).withColumn("dump_month", F.lit("2026-08"))
    commits.commit(spark, top, observations.write_units(wrong, top))
    contacts(spark, [12], datetime(2026, 7, 5)).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    run()
    assert observations.repair_month(spark, root, NIGHT, "2026-06") == 2
    assert sorted(r.id for r in observations.read_month(spark, root, NIGHT, "2026-06").collect()) == list(range(12))
    files = dump.publish_month(spark, root, out, "2026-06", datetime(2026, 7, 1)).collect()
    assert {r.dataset: r.row_count for r in files}[NIGHT] == 12
    before = commits.version(spark, top).number
    assert dump.cleanup_month(spark, root, out, "2026-06", datetime(2026, 7, 9)) == 1
    assert ids(spark, root) == [12] and ids(spark, root, number=before) == list(range(13))
    run()
    observations.append_observations(contacts(spark, [13], datetime(2026, 7, 6)), root, NIGHT)
    assert ids(spark, root) == [12, 13]
    assert commits.vacuum(spark, top) == 0
    assert commits.vacuum(spark, top, timedelta(0), datetime(2100, 1, 1)) > 0
    assert ids(spark, root) == [12, 13]


def test_replayed_batches_add_nothing_and_rows_appended_meanwhile_stay(spark, tmp_path, monkeypatch):
    root, top = f"{tmp_path}/root", f"{tmp_path}/root/{NIGHT}"
    assert observations.append_observations(contacts(spark, [1]), root, NIGHT, writer="w", batch=0) == 1
    assert observations.append_observations(contacts(spark, [1]), root, NIGHT, writer="w", batch=0) is None
    assert observations.append_observations(contacts(spark, [2]), root, NIGHT, writer="other", batch=0) == 2
    commits.commit(spark, top, observations.write_units(contacts(spark, [3]).withColumn("dump_month", F.lit("2026-08")), top))
    real = observations.write_units

    def meanwhile(df, where, *rest):  # somebody appends to the month that is being repaired
        monkeypatch.undo()
        commits.commit(spark, top, real(contacts(spark, [4], datetime(2026, 8, 9)).withColumn("dump_month", F.lit("2026-08")), top))
        return real(df, where, *rest)

    monkeypatch.setattr(observations, "write_units", meanwhile)
    assert observations.repair_month(spark, root, NIGHT, "2026-06") == 1
    assert ids(spark, root) == [1, 2, 3, 4]
    old = commits.version(spark, top)
    assert observations.drop_month(spark, root, NIGHT, "2026-06", old)
    with pytest.raises(commits.Conflict):
        observations.drop_month(spark, root, NIGHT, "2026-06", old)
    assert not observations.drop_month(spark, root, NIGHT, "2026-06") and ids(spark, root) == [4]


def test_versions_are_whole_and_in_order(spark, tmp_path):
    top = f"file://{tmp_path}/t"
    for k in range(23):
        assert commits.commit(spark, top, [f"_data/commit={k}/dump_month=2026-06"], [f"_data/commit={k - 1}/dump_month=2026-06"] if k % 2 else [], "w", k) == k + 1
    assert sorted(n for n in commits.names(spark, f"{top}/_commits") if n.endswith(".summary")) == ["0000000010.summary", "0000000020.summary"]
    assert commits.version(spark, top).units == {f"_data/commit={k}/dump_month=2026-06" for k in (*range(1, 22, 2), 22)}
    assert commits.version(spark, top, 3).units == {f"_data/commit={k}/dump_month=2026-06" for k in (1, 2)}
    assert commits.version(spark, top).done == {"w": 22}
    assert not commits.put(spark, f"{top}/_commits/0000000023.json", "{}")
    assert commits.version(spark, f"file://{tmp_path}/nothing").units == set()


def test_an_unreadable_manifest_is_an_error(spark, tmp_path):
    (tmp_path / "out/2026-06").mkdir(parents=True)
    (tmp_path / "out/2026-06/manifest.json").write_text("")
    with pytest.raises(RuntimeError, match="no manifest"):
        dump.publish_month(spark, f"{tmp_path}/root", f"{tmp_path}/out", "2026-06", datetime(2026, 7, 1))
