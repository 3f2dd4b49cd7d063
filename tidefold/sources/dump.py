"""Monthly publication: canonical JSON Lines, digests, manifest, immutable publish, retention.

A dataset of a month is a folder of ordered parts ``month/dataset.jsonl.gz/part-00000.jsonl.gz`` ..., written by the
executors; read one after the other they are the month in the order of (ingested_at, id), and one gzip stream. Where a
part ends depends on the rows alone, so that a month exported again, on whatever cluster, has the same bytes. The
manifest is written last and is the commit point: a month is published if it is there. Its digest of a dataset is the
SHA-256 over the parts' own digests, a line for each."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import is_month, iso_millis, month_bounds
from ..functions.keys import decimal_text
from ..operators.exports import reconcile, with_ordered_index
from ..schemas import JSON_KINDS, OBSERVATIONS, observation_fields
from ..storage import new_folder, written
from .commits import put, read_text, version
from .observations import drop_month, exists, filesystem, is_closed, misplaced_counts, read_dataset, read_month

RETENTION = timedelta(hours=168)
SUFFIX, ROWS_PER_PART, BYTES_PER_PART = "jsonl.gz", 2_000_000, 512 << 20
TIMEZONE = "Asia/Tokyo"
MANIFEST = "schemaVersion int, dumpMonth string, timezone string, publishedAt string, files array<struct<dataset:string,objectKey:string,rowCount:string,compressedBytes:string,sha256:string>>"


def object_key(month: str, dataset: str | None = None) -> str:
    """S6"""
    month_bounds(month)
    if dataset is not None and dataset not in OBSERVATIONS:
        raise ValueError(f"unknown dataset {dataset!r}")
    return f"{month}/{dataset}.{SUFFIX}" if dataset else f"{month}/manifest.json"


def serialize(df: DataFrame, fields: dict[str, tuple[str, str]], id: str = "id", ts: str = "ingested_at", ahead: tuple[str, str] = ("observationId", "ingestedAt")) -> DataFrame:
    """M6, M7: df with line, one JSON object with all keys in their order; a number that is not finite fails the job.

    fields: column -> (public name, kind); JSON texts are put in as canonical JSON."""
    bad = F.lit(False)
    members = [(ahead[0], F.to_json(F.array(decimal_text(F.col(id))))), (ahead[1], F.to_json(F.array(iso_millis(F.col(ts)))))]
    for column, (name, kind) in fields.items():
        c = F.col(column)
        if kind == "number":
            bad = bad | (F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
        if kind == "numberArray":
            bad = bad | F.coalesce(F.exists(c, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf")))), F.lit(False))
        if kind in JSON_KINDS:
            text = F.to_json(F.try_parse_json(c))
            bad = bad | (c.isNotNull() & text.isNull())
            members.append((name, F.concat(F.lit("["), F.coalesce(text, F.lit("null")), F.lit("]"))))
        else:
            members.append((name, F.to_json(F.array(c), {"ignoreNullFields": "false"})))
    # Each value is written as a list of one, so that nulls and strings come out as JSON; the brackets are cut off.
    inner = [F.concat(F.lit(json.dumps(n) + ":"), F.regexp_replace(v, r"(?s)\A\[|\]\z", "")) for n, v in members]
    line = F.concat(F.lit("{"), F.concat_ws(",", *inner), F.lit("}"))
    checked = F.when(F.coalesce(bad, F.lit(False)) | decimal_text(F.col(id)).isNull(), F.raise_error(F.concat(F.lit("not publishable: id "), F.coalesce(F.col(id).cast("string"), F.lit("null"))))).otherwise(line)
    return df.withColumn("line", checked)


def dump_rows(df: DataFrame, rows_per_part: int = ROWS_PER_PART, ts: str = "ingested_at", id: str = "id") -> DataFrame:
    """M5: rows with place, dense in the order of (ingested_at, id), and part; each part sorted, and in one partition."""
    placed = with_ordered_index(df, [ts, id], "place")
    parts = placed.withColumn("part", F.floor(F.col("place") / rows_per_part).cast("int"))
    return parts.repartition("part").sortWithinPartitions("part", "place")


def part_rows(lines: DataFrame, most: int = ROWS_PER_PART, most_bytes: int = BYTES_PER_PART) -> int:
    """Rows for each part, so that a mean part has at most most_bytes of lines."""
    rows, size = lines.agg(F.count("line"), F.sum(F.octet_length("line"))).first()
    return max(1, min(most, most_bytes * rows // size if size else most))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """M9: (name, bytes, sha256) of the files of a folder; parts are kept well below 2 GB."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{SUFFIX}").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def folder_digest(spark: SparkSession, path: str) -> tuple[int, str]:
    """Bytes of all parts, and the SHA-256 over their digests in order."""
    parts = file_digests(spark, path).orderBy("name").collect()  # a row per part
    return sum(p["bytes"] for p in parts), hashlib.sha256("".join(p.sha256 + "\n" for p in parts).encode()).hexdigest()


def write_dump(df: DataFrame, path: str) -> int:
    """Rows with line, place and part, as a file for each part, in order; returns how many rows were written."""
    spark = df.sparkSession
    seen = Observation()
    counted = df.select("part", "line").observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.option("compression", "gzip").option("maxRecordsPerFile", 0).partitionBy("part").text(path)
    fs, folder = filesystem(spark, path)
    parts = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part=")]
    for part in parts:  # a folder with one file for each part
        (file,) = [f.getPath() for f in fs.listStatus(part) if f.getPath().getName().startswith("part-")]
        fs.rename(file, filesystem(spark, f"{path}/part-{int(part.getName()[5:]):05}.{SUFFIX}")[1])
        fs.delete(part, True)
    if not parts:
        fs.create(filesystem(spark, f"{path}/part-00000.{SUFFIX}")[1], True).close()
    return seen.get["rows"]


def read_dump(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """A published dataset, parsed back to the columns of its table."""
    from ..schemas import KINDS

    fields = observation_fields(dataset)
    members = ["observationId string", "ingestedAt timestamp", *(f"`{n}` {KINDS[k]}" for n, k in fields.values())]
    df = spark.read.schema(", ".join(members)).option("pathGlobFilter", f"*.{SUFFIX}").json(path)
    columns = [F.col(n).alias(c) for c, (n, _) in fields.items()]
    return df.select(F.col("observationId").cast("long").alias("id"), F.col("ingestedAt").alias("ingested_at"), *columns)


def publish_immutable(spark: SparkSession, staged: str, target: str) -> None:
    """Moves a folder to its place; what is there already must be the same."""
    fs, goal = filesystem(spark, target)
    if not fs.exists(goal):
        fs.mkdirs(goal.getParent())
        if fs.rename(filesystem(spark, staged)[1], goal):
            return
    if folder_digest(spark, staged) != folder_digest(spark, target):
        raise RuntimeError(f"{target} exists and differs")


def build_manifest(files: list[dict], month: str, published_at: datetime) -> str:
    """Files have dataset, object_key, row_count, bytes, sha256; exactly the published datasets."""
    by_name = {f["dataset"]: f for f in files}
    if len(by_name) != len(files) or set(by_name) != set(OBSERVATIONS):
        raise ValueError("a manifest has each observation dataset once")
    entries = []
    for name in OBSERVATIONS:
        f = by_name[name]
        if f["object_key"] != object_key(month, name) or f["row_count"] < 0 or f["bytes"] < 0 or len(f["sha256"]) != 64:
            raise ValueError(f"bad entry of {name}")
        entries.append({"dataset": name, "objectKey": f["object_key"], "rowCount": str(f["row_count"]), "compressedBytes": str(f["bytes"]), "sha256": f["sha256"]})
    at = published_at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{published_at.microsecond // 1000:03}Z"
    return json.dumps({"schemaVersion": 1, "dumpMonth": month, "timezone": TIMEZONE, "publishedAt": at, "files": entries}, separators=(",", ":"))


def manifest_problem(m: Column) -> Column:
    """The first thing that is wrong with a parsed manifest, null if nothing."""
    names = F.transform(m["files"], lambda f: f["dataset"])
    entry_ok = F.forall(
        m["files"],
        lambda f: f["rowCount"].rlike(r"\A(0|[1-9][0-9]*)\z") & f["compressedBytes"].rlike(r"\A(0|[1-9][0-9]*)\z") & f["sha256"].rlike(r"\A[0-9a-f]{64}\z")
        & (f["objectKey"] == F.concat(m["dumpMonth"], F.lit("/"), f["dataset"], F.lit(f".{SUFFIX}"))),
    )
    return (
        F.when(m.isNull() | m["files"].isNull(), "not a manifest")
        .when(~F.coalesce(m["schemaVersion"] == 1, F.lit(False)), "schemaVersion must be 1")
        .when(~F.coalesce(m["timezone"] == TIMEZONE, F.lit(False)), f"timezone must be {TIMEZONE}")
        .when(~F.coalesce(is_month(m["dumpMonth"]), F.lit(False)), "dumpMonth must be a month")
        .when(~F.coalesce(m["publishedAt"].rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z\z"), F.lit(False)), "publishedAt must be an instant")
        .when(~names.eqNullSafe(F.array(*map(F.lit, OBSERVATIONS))), "files must be the datasets in order")
        .when(~F.coalesce(entry_ok, F.lit(False)), "bad file entry")
    )


def parse_manifest(df: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """(dump_month, published_at, files) of valid manifests, and (text, problem) of the others."""
    judged = df.withColumn("_m", F.from_json(text, MANIFEST)).withColumn("problem", manifest_problem(F.col("_m")))
    good = judged.where("problem IS NULL").select(
        F.col("_m.dumpMonth").alias("dump_month"), F.to_timestamp("_m.publishedAt").alias("published_at"), F.col("_m.files").alias("files")
    )
    return good, judged.where("problem IS NOT NULL").select(text, "problem")


def manifest_files(manifests: DataFrame) -> DataFrame:
    """(dump_month, dataset, object_key, row_count, bytes, sha256)"""
    each = manifests.select("dump_month", F.explode("files").alias("f"))
    return each.select(
        "dump_month", F.col("f.dataset").alias("dataset"), F.col("f.objectKey").alias("object_key"), F.col("f.rowCount").cast("long").alias("row_count"),
        F.col("f.compressedBytes").cast("long").alias("bytes"), F.col("f.sha256").alias("sha256"),
    )


def read_manifests(spark: SparkSession, out: str) -> DataFrame:
    """All valid manifests below the publication folder."""
    if not exists(spark, out):
        return spark.createDataFrame([], "dump_month string, published_at timestamp, files array<struct<dataset:string,objectKey:string,rowCount:string,compressedBytes:string,sha256:string>>")
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "manifest.json").text(out, wholetext=True)
    return parse_manifest(text)[0]


def export_month(spark: SparkSession, root: str, staged: str, dataset: str, month: str) -> dict:
    """M5-M9 for one dataset: ordered lines in staged, with exact counts."""
    rows = read_month(spark, root, dataset, month)
    lines = written(serialize(rows, observation_fields(dataset)).select("ingested_at", "id", "line"), "dump-lines")
    wrote, there = write_dump(dump_rows(lines, part_rows(lines)), staged), rows.count()
    if wrote != there:
        raise RuntimeError(f"{dataset} {month}: wrote {wrote} of {there} rows")
    size, sha = folder_digest(spark, staged)
    return {"dataset": dataset, "object_key": object_key(month, dataset), "row_count": wrote, "bytes": size, "sha256": sha}


def publish_month(spark: SparkSession, root: str, out: str, month: str, now: datetime) -> DataFrame:
    """The month's manifest entries; published before, they are returned as they are.

    The instant of the first attempt is reserved, so that a run that broke off and is tried again gives the same bytes."""
    manifest = f"{out}/{object_key(month)}"
    if not exists(spark, manifest):
        if not is_closed(month, now):
            raise ValueError(f"{month} has not ended in Japan")
        stray = misplaced_counts({d: read_dataset(spark, root, d) for d in OBSERVATIONS}, month).collect()
        if stray:
            raise RuntimeError(f"misplaced rows: {[tuple(r) for r in stray]}")
        files, staged = [], new_folder(spark, "publish")
        for dataset in OBSERVATIONS:
            files.append(export_month(spark, root, f"{staged}/{dataset}", dataset, month))
            publish_immutable(spark, f"{staged}/{dataset}", f"{out}/{object_key(month, dataset)}")
        reserved = f"{out}/{month}/published-at"
        put(spark, reserved, now.isoformat())
        text = build_manifest(files, month, datetime.fromisoformat(read_text(spark, reserved)))
        if not put(spark, manifest, text) and read_text(spark, manifest) != text:
            raise RuntimeError(f"{manifest} exists and differs")
    said = read_manifests(spark, out).where(F.col("dump_month") == month)
    if said.isEmpty():
        raise RuntimeError(f"{manifest} is there and is no manifest")
    return manifest_files(said)


def cleanup_candidates(manifests: DataFrame, now: datetime) -> DataFrame:
    """Months whose retention is over, the longest over first."""
    eligible = F.col("published_at") + F.expr(f"INTERVAL {int(RETENTION.total_seconds() // 3600)} HOURS")
    due = manifests.withColumn("eligible_at", eligible).where(F.col("eligible_at") <= F.lit(now))
    return due.orderBy("eligible_at", "dump_month").select("dump_month", "published_at", "eligible_at")


def cleanup_month(spark: SparkSession, root: str, out: str, month: str, now: datetime) -> int:
    """Verifies every published byte again, then drops the month's partitions; returns how many there were.

    Nothing is dropped unless everything agrees; a month that is gone already is no error."""
    manifests = read_manifests(spark, out).where(F.col("dump_month") == month)
    if cleanup_candidates(manifests, now).isEmpty():
        raise ValueError(f"{month} is not published or its retention is not over")
    said = manifest_files(manifests)
    found = []
    for dataset in OBSERVATIONS:
        path = f"{out}/{object_key(month, dataset)}"
        if exists(spark, path):
            size, sha = folder_digest(spark, path)
            found.append((dataset, object_key(month, dataset), size, sha))
    files = spark.createDataFrame(found, "dataset string, object_key string, bytes bigint, sha256 string")
    problems = reconcile(said, files, columns=("object_key", "bytes", "sha256")).collect()
    if problems:
        raise RuntimeError(f"{month}: {[tuple(p) for p in problems]}")
    kept = {r.dataset: r.row_count for r in said.collect()}
    at = {dataset: version(spark, f"{root}/{dataset}") for dataset in OBSERVATIONS}
    for dataset in OBSERVATIONS:
        there = read_month(spark, root, dataset, month, at=at[dataset]).count()
        if there not in (0, kept[dataset]):
            raise RuntimeError(f"{dataset} {month}: {there} rows, {kept[dataset]} published")
    return sum(drop_month(spark, root, dataset, month, at[dataset]) for dataset in OBSERVATIONS)
