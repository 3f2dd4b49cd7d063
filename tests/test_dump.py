import gzip
import hashlib
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidefold.functions import calendar
from tidefold.schemas import DATASETS, OBSERVATIONS, observation_fields
from tidefold.sources import dump, observations

CI = "nightBattleCiObservations"


def month_rows(spark):
    rows = [(3, datetime(2026, 6, 30, 14, 59, 59), 9), (1, datetime(2026, 5, 31, 15, 0, 0), 7), (2, datetime(2026, 6, 30, 15, 0, 0), 8)]
    df = spark.createDataFrame(rows, "id long, ingested_at timestamp, fleet_type int")
    return df.selectExpr("*", "CAST(NULL AS INT) AS ship_id", "1 AS ship_lv", "2 AS item_id", "3 AS item_lv", "id > 1 AS contact")


@pytest.fixture
def stored(spark, tmp_path):
    root = str(tmp_path / "root")
    observations.append_observations(month_rows(spark), root, "nightContactObservations")
    return root


def test_months():
    assert calendar.adjacent_months(datetime(2026, 7, 31, 14, 59, 59, 999000)) == ("2026-06", "2026-08")
    assert calendar.adjacent_months(datetime(2026, 7, 31, 15)) == ("2026-07", "2026-09")
    assert calendar.month_bounds("2026-01") == (datetime(2025, 12, 31, 15), datetime(2026, 1, 31, 15))
    assert calendar.month_bounds("2028-03") == (datetime(2028, 2, 29, 15), datetime(2028, 3, 31, 15))
    assert calendar.month_bounds("2026-12")[1] == datetime(2026, 12, 31, 15)
    for bad in ("2026-13", "2026-1", "26-01", "2026-07-01", "", " 2026-07"):
        with pytest.raises(ValueError):
            calendar.month_bounds(bad)


def test_registry():
    assert len(DATASETS) == 18 and len(OBSERVATIONS) == 9
    assert list(observation_fields(CI))[:2] == ["ship_id", "ci"] and observation_fields(CI)["ci"][0] == "CI"
    assert dump.object_key("2026-06", CI) == f"2026-06/{CI}.jsonl.gz" and dump.object_key("2026-06") == "2026-06/manifest.json"


def test_append_and_read_month(spark, stored):
    read = lambda m: sorted(r.id for r in observations.read_month(spark, stored, "nightContactObservations", m).collect())
    assert read("2026-06") == [1, 3] and read("2026-07") == [2] and read("2026-05") == []
    assert observations.read_month(spark, stored, CI, "2026-06").count() == 0
    assert all(r.within for r in observations.check_month_bounds(observations.read_dataset(spark, stored, "nightContactObservations")).collect())


def test_serialized_lines(spark):
    df = spark.createDataFrame([(7, datetime(2024, 1, 15, 3, 4, 5, 6789), 'q"é\n', '{"b":[3,1],"a":{"z":null,"y":1}}', [1, None], 1.5, None)], "id long, ingested_at timestamp, s string, j string, a array<int>, d double, t long")
    fields = {"s": ("S", "string"), "j": ("j", "json"), "a": ("a", "integerArray"), "d": ("d", "number"), "t": ("time", "safeInteger")}
    line = dump.serialize(df, fields).first().line
    assert line == '{"observationId":"7","ingestedAt":"2024-01-15T03:04:05.006Z","S":"q\\"é\\n","j":{"a":{"y":1,"z":null},"b":[3,1]},"a":[1,null],"d":1.5,"time":null}'
    for bad in ({"d": F.lit(float("nan"))}, {"d": F.lit(float("inf"))}, {"id": F.lit(-1)}, {"j": F.lit("{")}):
        with pytest.raises(Exception, match="not publishable"):
            dump.serialize(df.withColumns(bad), fields).collect()


def test_publish_twice_verify_and_clean(spark, stored, tmp_path):
    out, now = str(tmp_path / "out"), datetime(2026, 7, 1, 0, 0, 0)
    with pytest.raises(ValueError):
        dump.publish_month(spark, stored, out, "2026-07", now)
    first = sorted(map(tuple, dump.publish_month(spark, stored, out, "2026-06", now).collect()))
    assert len(first) == 9 and {r[1]: r[3] for r in first}["nightContactObservations"] == 2
    assert sorted(map(tuple, dump.publish_month(spark, stored, out, "2026-06", datetime(2026, 8, 1)).collect())) == first
    folder = tmp_path / "out" / dump.object_key("2026-06", "nightContactObservations")
    text = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(folder.glob("*.gz"))).decode()
    assert [json.loads(x)["observationId"] for x in text.splitlines()] == ["1", "3"] and text.endswith("}\n")
    back = dump.read_dump(spark, str(folder), "nightContactObservations").orderBy("id").collect()
    assert [(r.id, r.fleet_type, r.ship_id, r.contact) for r in back] == [(1, 7, None, False), (3, 9, None, True)]

    (tmp_path / "out/2026-06/manifest.json").rename(tmp_path / "m")  # a run that broke off before its commit
    again = sorted(map(tuple, dump.publish_month(spark, stored, out, "2026-06", now).collect()))
    assert again == first and (tmp_path / "out/2026-06/manifest.json").read_text() == (tmp_path / "m").read_text()

    manifests = dump.read_manifests(spark, out)
    assert dump.cleanup_candidates(manifests, datetime(2026, 7, 7, 23, 59)).count() == 0
    assert dump.cleanup_candidates(manifests, datetime(2026, 7, 8)).count() == 1
    with pytest.raises(ValueError):
        dump.cleanup_month(spark, stored, out, "2026-06", datetime(2026, 7, 2))
    part = next(folder.glob("*.gz"))
    good = part.read_bytes()
    part.write_bytes(good + b"x")
    for crc in folder.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(RuntimeError):
        dump.cleanup_month(spark, stored, out, "2026-06", datetime(2026, 7, 8))
    part.write_bytes(good)
    assert dump.cleanup_month(spark, stored, out, "2026-06", datetime(2026, 7, 8)) == 1
    assert dump.cleanup_month(spark, stored, out, "2026-06", datetime(2026, 7, 8)) == 0
    assert [r.id for r in observations.read_dataset(spark, stored, "nightContactObservations").collect()] == [2]


def test_repair_moves_misplaced_rows_once(spark, stored, tmp_path):
    wrong = month_rows(spark).where("id = 3").withColumn("id", F.lit(30).cast("long"))
    wrong.write.mode("append").parquet(f"{stored}/nightContactObservations/dump_month=2026-08")
    table = observations.read_dataset(spark, stored, "nightContactObservations")
    assert [r.misplaced for r in observations.misplaced_counts({"x": table}, "2026-06").collect()] == [1]
    with pytest.raises(RuntimeError):
        dump.publish_month(spark, stored, str(tmp_path / "out"), "2026-06", datetime(2026, 7, 1))
    assert observations.repair_month(spark, stored, "nightContactObservations", "2026-06") == 1
    assert observations.repair_month(spark, stored, "nightContactObservations", "2026-06") == 0
    assert sorted(r.id for r in observations.read_month(spark, stored, "nightContactObservations", "2026-06").collect()) == [1, 3, 30]
    assert observations.misplaced_rows(observations.read_dataset(spark, stored, "nightContactObservations")).isEmpty()


def test_manifests_are_judged(spark):
    files = [{"dataset": d, "object_key": dump.object_key("2026-06", d), "row_count": 0, "bytes": 20, "sha256": "a" * 64} for d in OBSERVATIONS]
    good = dump.build_manifest(files, "2026-06", datetime(2026, 7, 1))
    m = json.loads(good)
    bad = [m | {"schemaVersion": 2}, m | {"timezone": "UTC"}, m | {"files": m["files"][:8]}, m | {"files": m["files"][::-1]}, m | {"publishedAt": "now"}, {"x": 1},
           m | {"files": [f | {"rowCount": "01"} for f in m["files"]]}, m | {"files": [f | {"sha256": "A" * 64} for f in m["files"]]}]
    df = spark.createDataFrame([(good,), ("{",), *((json.dumps(b),) for b in bad)], "value string")
    ok, wrong = dump.parse_manifest(df)
    assert ok.count() == 1 and wrong.count() == len(bad) + 1
    for broken in (files[:8], [*files, files[0]], [f | {"object_key": "x"} for f in files]):
        with pytest.raises(ValueError):
            dump.build_manifest(broken, "2026-06", datetime(2026, 7, 1))


def rows_of(spark, n=500):
    df = spark.range(n).withColumn("ingested_at", F.expr("timestamp'2026-06-01 00:00:00' + make_dt_interval(0, 0, 0, (id * 37) % 500)"))
    return df.withColumn("line", F.concat(F.lit('{"n":'), F.col("id").cast("string"), F.lit("}")))


def test_parts_do_not_depend_on_the_cluster(spark, tmp_path):
    """The same rows, dealt otherwise and under another number of shuffle partitions, give the same bytes."""
    digests = []
    for partitions in (3, 11):
        kept = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        try:
            path = f"file://{tmp_path}/{partitions}"
            assert dump.write_dump(dump.dump_rows(rows_of(spark).repartition(partitions), 120), path) == 500
            digests.append(dump.folder_digest(spark, path))
            names = [r.name for r in dump.file_digests(spark, path).orderBy("name").collect()]
            assert names == [f"part-{k:05}.jsonl.gz" for k in range(5)]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert digests[0] == digests[1]
    dump.publish_immutable(spark, f"file://{tmp_path}/3", f"file://{tmp_path}/goal")
    dump.publish_immutable(spark, f"file://{tmp_path}/11", f"file://{tmp_path}/goal")


def test_parts_are_bounded_by_bytes(spark):
    lines = rows_of(spark, 100).withColumn("line", F.repeat(F.lit("x"), 1000))
    assert dump.part_rows(lines, 2_000_000, 10_000) == 10 and dump.part_rows(lines, 7) == 7
    assert dump.part_rows(lines.limit(0)) == dump.ROWS_PER_PART


def test_digests_are_those_of_the_files(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    dump.write_dump(dump.dump_rows(rows_of(spark), 300), path)
    got = {r.name: (r.bytes, r.sha256) for r in dump.file_digests(spark, path).collect()}
    want = {f.name: (f.stat().st_size, hashlib.sha256(f.read_bytes()).hexdigest()) for f in (tmp_path / "d").glob("*.gz")}
    assert got == want and len(want) == 2


@pytest.mark.parametrize("before", [True, False])
def test_a_repair_that_crashed_is_repeated(spark, tmp_path, before, monkeypatch):
    """Whether it breaks off before or after its commit, no row is lost, and the next repair finishes it."""
    root = f"file://{tmp_path}/r"
    df = rows_of(spark, 40).select("id", "ingested_at", F.when(F.col("id") % 4 == 0, "2026-05").otherwise("2026-06").alias("dump_month"))
    df.write.partitionBy("dump_month").parquet(f"{root}/d")
    real = observations.commit

    def broken(*args, **kwargs):
        if not before:
            real(*args, **kwargs)
        raise OSError("crash")

    monkeypatch.setattr(observations, "commit", broken)
    with pytest.raises(OSError):
        observations.repair_month(spark, root, "d", "2026-06")
    monkeypatch.undo()
    assert observations.read_dataset(spark, root, "d").count() == 40
    assert observations.repair_month(spark, root, "d", "2026-06") == (10 if before else 0)
    table = observations.read_dataset(spark, root, "d")
    assert table.count() == 40 and {r[0] for r in table.select("dump_month").distinct().collect()} == {"2026-06"}
