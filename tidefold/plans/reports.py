"""More registered queries: validation of every kind of field, lists and records of reports, publication and streams.

Events are written as JSON reports whose fields are right, lenient or wrong by the event's number, so that SQL can say
what has to come out."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar, keys
from ..operators import exports, improvement, ingest, normalize
from ..schemas import OBSERVATIONS, REPORTS, Field
from ..sources import dump, facts, observations
from ..storage import new_folder, read_table
from ..streaming import reports as streams
from .catalog import EVENTS, INGESTED, as_reports, ingested_orders, query

KINDS = {
    "number": Field("number"), "safe": Field("safeInteger"), "flag": Field("boolean"), "label": Field("string"), "nested": Field("nestedIntegerArray"),
    "numbers": Field("numberArray"), "raw": Field("json"), "list": Field("jsonArray"), "need": Field("integer", True),
}


def text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def one_of(number: Column, *forms) -> Column:
    """The form at number modulo their count; None leaves the field out."""
    out = F.lit(None).cast("string")
    for k, form in enumerate(forms):
        if form is not None:
            out = F.when(number % len(forms) == k, F.lit(form) if isinstance(form, str) else form).otherwise(out)
    return out


def reports_of(df: DataFrame, *members: Column) -> DataFrame:
    data = F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))
    return normalize.parse_reports(df.withColumn("data", data))[0]


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN user_id + 0.5 WHEN 1 THEN 31 WHEN 2 THEN 1 END::DOUBLE AS number,
    CASE event_id % 3 WHEN 0 THEN (event_id + 1) * 1000 WHEN 1 THEN event_id END AS safe, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS flag,
    CASE event_id % 4 WHEN 0 THEN '12' WHEN 1 THEN 'true' WHEN 2 THEN 'x' || event_type ELSE '1e+21' END AS label,
    CASE event_id % 3 WHEN 0 THEN '[[' || user_id || ',2],[3]]' WHEN 2 THEN '[]' END AS nested,
    CASE event_id % 2 WHEN 0 THEN '[1.5,2.0]' ELSE '[7.25]' END AS numbers, CASE event_id % 2 WHEN 0 THEN '{"a":' || user_id || ',"b":[2,1]}' END AS raw,
    CASE event_id % 3 WHEN 0 THEN '["x"]' WHEN 1 THEN '[1,{"a":null,"z":1}]' ELSE '[]' END AS list, 5 AS need FROM events"""
)
def normalize_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of field in its lenient forms."""
    e, user = F.col("event_id"), F.col("user_id")
    df = reports_of(
        read_table(spark, sf_dir, "events"),
        one_of(e, text('"number":', user, ".5"), '"number":" 0x1F "', '"number":true', '"number":""'),
        one_of(e, text('"safe":', e + 1, "000"), text('"safe":"', e, '"'), '"safe":null'),
        one_of(e, '"flag":"yes"', '"flag":0', '"flag":false', '"flag":""', None),
        one_of(e, '"label":12.0', '"label":true', text('"label":"x', F.col("event_type"), '"'), '"label":1e21'),
        one_of(e, text('"nested":[[', user, ',"2"],3]'), '"nested":null', None),
        one_of(e, '"numbers":[1.5,"2"]', '"numbers":7.25'),
        one_of(e, text('"raw":{"b":[2,1],"a":', user, "}"), '"raw":null'),
        one_of(e, '"list":"x"', '"list":[1,{"z":1,"a":null}]', None),
        F.lit('"need":"5"'),
    )
    accepted, _ = normalize.normalize(df, KINDS)
    return accepted.select("event_id", "number", "safe", "flag", "label", F.to_json("nested").alias("nested"), F.to_json("numbers").alias("numbers"), "raw", "list", "need")


@query(
    """WITH b AS (SELECT event_id, event_id % 7 AS f FROM events),
    i AS (SELECT event_id, 0 AS o, CASE f WHEN 0 THEN 'number' WHEN 1 THEN 'safe' WHEN 2 THEN 'flag' WHEN 3 THEN 'label' WHEN 4 THEN 'nested.1.1' ELSE 'numbers.1' END AS path,
        CASE WHEN f IN (1, 4) THEN 'out_of_range' ELSE 'invalid_type' END AS code,
        CASE f WHEN 1 THEN 'non-negative safe integer' WHEN 2 THEN 'boolean' WHEN 3 THEN 'string' WHEN 4 THEN 'signed 32-bit integer' ELSE 'finite number' END AS expected_type,
        CASE f WHEN 1 THEN 'number' WHEN 2 THEN 'array' WHEN 3 THEN 'object' WHEN 4 THEN 'number' ELSE 'string' END AS received_type,
        CASE f WHEN 0 THEN 'abc' WHEN 1 THEN '-1' WHEN 4 THEN '2147483648' WHEN 5 THEN 'z' END AS invalid_value, CASE f WHEN 2 THEN 3 WHEN 3 THEN 2 END AS received_size
      FROM b WHERE f < 6 UNION ALL
      SELECT event_id, 1, 'need', 'required', 'integer', 'undefined', NULL, NULL FROM b WHERE event_id % 2 = 0)
    SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY o) - 1 AS INT) AS place, path, code, expected_type, received_type, invalid_value, received_size FROM i"""
)
def issue_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the log says of each bad field, and of a missing one that is required."""
    e = F.col("event_id")
    df = reports_of(
        read_table(spark, sf_dir, "events"),
        one_of(e, '"number":"abc"', '"safe":-1', '"flag":[1,2,3]', '"label":{"a":1,"b":2}', '"nested":[[1],[2,2147483648]]', '"numbers":[1,"z"]', '"raw":1'),
        one_of(e, None, '"need":1'),
    )
    _, rejected = normalize.normalize(df, KINDS)
    return rejected.select("event_id", F.posexplode("issues").alias("place", "i")).select("event_id", "place", "i.*")


@query(
    f"""WITH {EVENTS} SELECT event_id, CASE WHEN event_id % 3 <> 0 AND coalesce(CASE WHEN event_id % 5 <> 0 THEN k END, 0) < 73 THEN '{{}}' ELSE props END AS snapshot FROM ev"""
)
def snapshot_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    df = as_reports(read_table(spark, sf_dir, "events")).withColumns({"map_id": F.when(e % 5 != 0, F.col("k")), "has_map_id": e % 3 != 0, "snapshot": F.col("props")})
    return normalize.clear_early_snapshot(df, snapshot="snapshot").select("event_id", "snapshot")


@query(
    """WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 <> 0 THEN l_linenumber - 3 END AS stage FROM lineitem)
    SELECT * FROM s WHERE stage IS DISTINCT FROM -1"""
)
def noop_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_linenumber") - 3).alias("stage"))
    return normalize.drop_noop_stage(df)


@query(
    """SELECT event_id, CAST(user_id AS INT) AS ship_id, 7 AS lv, 40 AS los_max, CASE event_id % 4 WHEN 0 THEN 'Client 1.0' WHEN 3 THEN event_type END AS origin FROM events"""
)
def report_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that are renamed, and the reporter's name from its header."""
    e = F.col("event_id")
    members = ['"lv":7', '"los":9', '"los_max":"40"', '"asw":1', '"asw_max":2', '"evasion":3', '"evasion_max":4']
    df = reports_of(read_table(spark, sf_dir, "events"), text('"id":', F.col("user_id")), *map(F.lit, members))
    accepted, _ = normalize.normalize(df, REPORTS["ship_stat"], report="ship_stat")
    header = one_of(e, "  Client 1.0 ", "9bad", "a" * 81, F.col("event_type"))
    return accepted.select("event_id", "ship_id", "lv", "los_max", keys.reporter_origin(header).alias("origin"))


@query(
    """SELECT event_id, CAST(p AS INT) AS position, CAST(user_id + p AS INT) AS quest_id, event_type AS title, NULL AS message FROM events, (VALUES (0), (1)) AS v(p) WHERE event_id % 5 > 2
    UNION ALL SELECT event_id, NULL, NULL, NULL, CASE event_id % 5 WHEN 0 THEN 'quests: expected array' WHEN 1 THEN 'quests.1: expected object'
      ELSE 'quests.1.title: expected string' END FROM events WHERE event_id % 5 <= 2"""
)
def quest_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of quests, of which every fifth is no list, or has a second element that is no object or lacks its title."""
    quest = lambda k, title: text('{"questId":', F.col("user_id") + k, *title, ',"detail":"d","category":2}')
    titled = (',"title":"', F.col("event_type"), '"')
    two = lambda second: text('"quests":[', quest(0, titled), ",", second, "]")
    member = one_of(F.col("event_id"), '"quests":3', two(F.lit("4")), two(quest(1, ())), two(quest(1, titled)), two(quest(1, titled)))
    taken, rejected = improvement.record_list(reports_of(read_table(spark, sf_dir, "events"), member), REPORTS["quest"], keep=("event_id",))
    none = F.lit(None)
    return taken.select("event_id", "position", "quest_id", "title", none.cast("string").alias("message")).unionByName(
        rejected.select("event_id", none.cast("int").alias("position"), none.cast("int").alias("quest_id"), none.cast("string").alias("title"), "message")
    )


@query(
    f"""WITH {EVENTS}, d AS (SELECT *, dayofweek(ts + INTERVAL 9 HOUR) AS day FROM ev)
    SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'detail' ELSE 'execution' END AS route,
    CASE event_id % 2 WHEN 0 THEN 'v1|cost|' || (user_id + 1) || '|5|6|1|' || day || '|0|10|20|30|40|3|4|5|6|' || (user_id + 1) || ':3|65:1,' || (k + 100) || ':2|0'
      ELSE 'v1|update|' || (user_id + 1) || '|5|6|' || day || '|0|701|0' END AS key,
    CASE WHEN user_id + 1 < 7 THEN (user_id + 1) || ',7' WHEN user_id + 1 = 7 THEN '7' ELSE '7,' || (user_id + 1) END AS flagships FROM d"""
)
def improvement_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of costs and of upgrades: their keys with items summed by id, and the union of flagships."""
    df = as_reports(read_table(spark, sf_dir, "events")).withColumn("received_ms", F.col("ms")).withColumn("x_reporter", F.lit("client"))
    user, e = F.col("user_id") + 1, F.col("event_id")
    common = text('"schemaVersion":1,"clientObservedAt":', F.col("ms"), ',"recipeId":', user, ',"itemId":5,"day":', calendar.jst_weekday(F.col("ms")))
    more = text('"observedSecondShipId":0,"itemLevel":6,"observedFlagshipId":', user, ',"observedFlagshipIds":[7,', user, "]")
    costs = '"stage":1,"fuel":10,"ammo":20,"steel":30,"bauxite":40,"buildkit":3,"remodelkit":4,"certainBuildkit":5,"certainRemodelkit":6'
    slots = text('"reqSlotItems":[{"id":', user, ',"count":2},{"id":', user, ',"count":1},{"id":0,"count":0}]')
    uses = text('"reqUseItems":[{"id":', F.col("k") + 100, ',"count":2},{"id":"65","count":1}]')
    detail = F.concat_ws(",", F.lit('"source":"detail"'), F.lit(costs), slots, uses)
    execution = F.lit('"source":"execution","upgradeObserved":true,"upgradeToItemId":701,"upgradeToItemLevel":0')
    parsed = reports_of(df, common, more, F.when(e % 2 == 0, detail).otherwise(execution))
    _, detailed, executed, _ = improvement.improvement_records(parsed, keep=("event_id",))
    sides = [d.select("event_id", F.lit(r).alias("route"), "key", F.array_join("observed_flagship_ids", ",").alias("flagships")) for r, d in (("detail", detailed), ("execution", executed))]
    return sides[0].unionByName(sides[1])


@query(
    f"""WITH {INGESTED} SELECT o_orderkey, strftime(strptime(month || '-01', '%Y-%m-%d') - INTERVAL 1 MONTH, '%Y-%m') AS before,
    strftime(strptime(month || '-01', '%Y-%m-%d') + INTERVAL 1 MONTH, '%Y-%m') AS after FROM od"""
)
def adjacent_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = calendar.adjacent_month_columns(F.col("ingested_at").cast("timestamp"))
    return ingested_orders(spark, sf_dir).select("o_orderkey", before.alias("before"), after.alias("after"))


NIGHT, MONTH = "nightContactObservations", "1996-02"


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as observations of a dataset."""
    return ingested_orders(spark, sf_dir).select(
        F.col("o_orderkey").alias("id"), F.col("ingested_at").cast("timestamp").alias("ingested_at"), (F.col("o_orderkey") % 3).cast("int").alias("fleet_type"),
        F.lit(2).alias("ship_id"), F.lit(3).alias("ship_lv"), F.lit(4).alias("item_id"), F.when(F.col("o_orderkey") % 7 != 0, 5).alias("item_lv"),
        (F.col("o_orderkey") % 2 == 0).alias("contact"), "dump_month",
    )


def published(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """(table folder, publication folder) after one month was published."""
    root, out = new_folder(spark, "observations"), new_folder(spark, "published")
    observations.append_observations(contacts(spark, sf_dir).drop("dump_month"), root, NIGHT)
    dump.publish_month(spark, root, out, MONTH, datetime(2024, 1, 1))
    return root, out


@query(
    f"""WITH {INGESTED} SELECT '{{"observationId":"' || o_orderkey || '","ingestedAt":"' || strftime(ingested_at, '%Y-%m-%dT%H:%M:%S.%gZ') || '","fleetType":' || (o_orderkey % 3) ||
    ',"shipId":2,"shipLv":3,"itemId":4,"itemLv":' || CASE WHEN o_orderkey % 7 <> 0 THEN '5' ELSE 'null' END || ',"contact":' || (o_orderkey % 2 = 0) || '}}' AS line,
    'part-00000.jsonl.gz' AS file, row_number() OVER (ORDER BY ingested_at, o_orderkey) - 1 AS place FROM od WHERE month = '{MONTH}'"""
)
def published_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a published month as they lie in the file."""
    _, out = published(spark, sf_dir)
    lines = spark.read.text(f"{out}/{dump.object_key(MONTH, NIGHT)}").select(F.col("value").alias("line"), "_metadata.file_name")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # a gzip file is one partition
    return lines.select("line", F.col("file_name").alias("file"), place.alias("place"))


@query(
    f"""WITH {INGESTED} SELECT o_orderkey AS id, ingested_at, CAST(o_orderkey % 3 AS INT) AS fleet_type, 2 AS ship_id, 3 AS ship_lv, 4 AS item_id,
    CASE WHEN o_orderkey % 7 <> 0 THEN 5 END AS item_lv, o_orderkey % 2 = 0 AS contact FROM od WHERE month = '{MONTH}'"""
)
def published_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published month, parsed back to its table."""
    _, out = published(spark, sf_dir)
    rows = dump.read_dump(spark, f"{out}/{dump.object_key(MONTH, NIGHT)}", NIGHT)
    return rows.withColumn("ingested_at", F.col("ingested_at").cast("timestamp_ntz"))


@query(f"WITH {INGESTED} SELECT month AS dump_month, count(*) AS count FROM od WHERE month <> '{MONTH}' GROUP BY ALL")
def cleanup_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a table once a published month's retention is over and its bytes agree."""
    root, out = published(spark, sf_dir)
    dump.cleanup_month(spark, root, out, MONTH, datetime(2024, 1, 9))
    return observations.read_dataset(spark, root, NIGHT).groupBy("dump_month").agg(F.count("*").alias("count"))


@query(f"WITH {INGESTED} SELECT CASE WHEN month = '{MONTH}' THEN month ELSE dump_month END AS dump_month, count(*) AS count, sum(o_orderkey)::BIGINT AS ids FROM od GROUP BY 1")
def repair_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table stored by months that know nothing of Japan, after one month's rows were moved into it."""
    root = new_folder(spark, "observations")
    contacts(spark, sf_dir).write.partitionBy("dump_month").parquet(f"{root}/{NIGHT}")
    observations.repair_month(spark, root, NIGHT, MONTH)
    table = observations.read_dataset(spark, root, NIGHT)
    return table.groupBy("dump_month").agg(F.count("*").alias("count"), F.sum("id").alias("ids"))


@query(
    f"""WITH {INGESTED}, m AS (SELECT month, count(*) AS n, CAST(substr(month, 6, 2) AS INT) AS k FROM od GROUP BY ALL)
    SELECT month, CASE k WHEN 1 THEN 'schemaVersion must be 1' WHEN 2 THEN 'timezone must be Asia/Tokyo' WHEN 3 THEN 'dumpMonth must be a month'
      WHEN 4 THEN 'publishedAt must be an instant' WHEN 5 THEN 'files must be the datasets in order' WHEN 6 THEN 'bad file entry' END AS problem,
    CASE WHEN k > 6 THEN 9 * n END AS rows FROM m"""
)
def manifest_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for each month of orders; the first six months of a year each have something wrong."""
    months = ingested_orders(spark, sf_dir).withColumn("month", calendar.jst_month(F.col("ingested_at").cast("timestamp"))).groupBy("month").agg(F.count("*").alias("n"))
    k = F.substring("month", 6, 2).cast("int")

    def entry(d: str):
        rows = F.when(k == 6, text("0", F.col("n"))).otherwise(F.col("n").cast("string"))
        return F.struct(
            F.lit(d).alias("dataset"), text(F.col("month"), f"/{d}.jsonl.gz").alias("objectKey"), rows.alias("rowCount"), F.lit("10").alias("compressedBytes"),
            F.sha2(text(d, F.col("month")), 256).alias("sha256"),
        )

    files = F.array(*map(entry, OBSERVATIONS))
    manifest = F.struct(
        F.when(k == 1, 2).otherwise(1).alias("schemaVersion"), F.when(k == 3, "x").otherwise(F.col("month")).alias("dumpMonth"),
        F.when(k == 2, "UTC").otherwise("Asia/Tokyo").alias("timezone"), F.when(k == 4, "2024-01-01").otherwise("2024-01-01T00:00:00.000Z").alias("publishedAt"),
        F.when(k == 5, F.reverse(files)).otherwise(files).alias("files"), F.col("month").alias("of"),
    )
    good, bad = dump.parse_manifest(months.select(F.to_json(manifest).alias("value")))
    rows = dump.manifest_files(good).groupBy(F.col("dump_month").alias("month")).agg(F.lit(None).cast("string").alias("problem"), F.sum("row_count").alias("rows"))
    return rows.unionByName(bad.select(F.get_json_object("value", "$.of").alias("month"), "problem", F.lit(None).cast("long").alias("rows")))


@query(
    f"""WITH {INGESTED}, m AS (SELECT month AS dump_month, max(ingested_at) + INTERVAL 3 DAY AS published_at FROM od GROUP BY ALL)
    SELECT *, published_at + INTERVAL 168 HOUR AS eligible_at FROM m WHERE published_at + INTERVAL 168 HOUR <= TIMESTAMP '1996-08-07 00:00:00'"""
)
def cleanup_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months whose retention was over at some time; published three days after their last order."""
    at = F.col("ingested_at").cast("timestamp")
    months = ingested_orders(spark, sf_dir).groupBy(calendar.jst_month(at).alias("dump_month")).agg((F.max(at) + F.expr("INTERVAL 3 DAYS")).alias("published_at"))
    out = dump.cleanup_candidates(months, datetime(1996, 8, 7))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("published_at", "eligible_at")})


def orders_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read_table(spark, sf_dir, "orders").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)


@query(f"WITH {INGESTED} SELECT month AS dump_month, count(*) AS count, sum(o_orderkey)::BIGINT AS ids FROM od GROUP BY ALL")
def stream_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a stream, every row appended to its month."""
    at = (F.col("o_orderdate") + F.make_dt_interval(hours=F.col("o_orderkey") % 24)).cast("timestamp")
    rows = orders_stream(spark, sf_dir).select(F.col("o_orderkey").alias("id"), at.alias("ingested_at"))
    root = new_folder(spark, "observations")
    streams.stream_observations(rows, root, NIGHT, new_folder(spark, "checkpoint")).awaitTermination()
    return observations.read_dataset(spark, root, NIGHT).groupBy("dump_month").agg(F.count("*").alias("count"), F.sum("id").alias("ids"))


@query("SELECT o_custkey, count(DISTINCT o_orderdate) AS versions FROM orders GROUP BY ALL")
def settled_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as versions of facts, each day's version once, from a stream that has every row twice."""
    twice = orders_stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out, folder = streams.settled_facts(twice, "o_orderdate", ("o_custkey",), "4000 days"), new_folder(spark, "facts")
    writer = out.writeStream.format("parquet").option("path", folder).option("checkpointLocation", new_folder(spark, "checkpoint")).trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.parquet(folder).groupBy("o_custkey").agg(F.count("*").alias("versions"))


OBSERVED = list(OBSERVATIONS.values())
STATE_KINDS = ["select_rank", "remodel_recipe", "ship_stat", "enemy_info", "quest", "quest_reward", "item_improvement"]


def envelopes(spark: SparkSession, sf_dir: str, kinds: list[str]) -> DataFrame:
    """Events as reports of the kinds in turn, stored by kind. One body serves all: undeclared fields are dropped.
    Every eleventh has a wrong field, every thirteenth is no JSON; every seventh has another reporter."""
    df = as_reports(read_table(spark, sf_dir, "events"))
    e, k, user = F.col("event_id"), F.col("k"), F.col("user_id")
    quest = text('"questId":', user, ',"title":"', F.col("event_type"), '","detail":"d","category":', k % 2)
    members = [
        text('"teitokuId":"u', user, '","teitokuLv":', F.when(e % 11 == 0, '"x"').otherwise(e.cast("string")), ',"mapareaId":', k % 3, ',"rank":', e % 5),
        text('"itemId":5,"mapId":', k, ',"ownedShipSnapshot":{"a":1},"poiVersion":"', F.when(k % 2 == 0, "8.0.0").otherwise("7.0.0"), '"'),
        text('"recipeId":', user + 1, ',"stage":', k % 3 - 1, ',"day":', calendar.jst_weekday(F.col("ms")), ',"secretary":2'),
        F.when(e % 3 == 0, text('"fuel":', e)).when(e % 3 == 1, F.lit('"fuel":null')),
        text('"id":', user, ',"lv":1,"los":2,"los_max":3,"asw":4,"asw_max":5,"evasion":6,"evasion_max":', k % 2),
        *[F.lit(f'"{n}{i}":[1]') for n in ("ships", "levels", "hp") for i in (1, 2) if (n, i) != ("ships", 1)],
        *[F.lit(f'"{n}{i}":[[1,2]]') for n in ("stats", "equips") for i in (1, 2)],
        text('"ships1":[', user, '],"planes":3,"bombersMin":', k),
        F.when(k == 0, F.lit('"bombersMax":null')).when(k % 2 == 0, text('"bombersMax":', k)),
        quest, text('"selections":[1,', k % 2, '],"bounsCount":1,"quests":[{', quest, "}]"),
        text('"schemaVersion":1,"source":"list","observedSecondShipId":0,"observedFlagshipId":', k + 1, ',"clientObservedAt":', F.col("ms")),
    ]
    body = F.when(e % 13 == 0, "{").otherwise(F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}")))
    reporter = F.when(e % 7 == 0, "Other 1.0.0").otherwise(F.concat(F.lit("Reporter 4."), (k % 2).cast("string"), F.lit(".0")))
    kind = F.get(F.array(*map(F.lit, kinds)), (e % len(kinds)).cast("int"))
    out = df.select(e.alias("id"), F.col("ts").cast("timestamp").alias("ingested_at"), kind.alias("kind"), body.alias("data"), reporter.alias("x_reporter"), F.lit("agent").alias("user_agent"))
    folder = new_folder(spark, "envelopes")
    out.write.partitionBy("kind").parquet(folder)
    return spark.read.schema(out.schema).parquet(folder)


def kind_sql(kinds: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(kinds))
    return f"""{EVENTS}, env AS (SELECT *, CASE event_id % {len(kinds)} {cases} END AS kind,
    CASE WHEN event_id % 7 = 0 THEN 'Other 1.0.0' ELSE 'Reporter 4.' || k % 2 || '.0' END AS origin, event_id % 11 = 0 AS wrong FROM ev),
    good AS (SELECT * FROM env WHERE event_id % 13 <> 0)"""


@query(
    f"""WITH {kind_sql(OBSERVED)}, t AS (SELECT * FROM good WHERE NOT (wrong AND kind IN ('create_ship', 'create_item', 'remodel_item', 'drop_ship', 'pass_event'))
      AND (kind <> 'aaci' OR k % 2 = 0 AND origin LIKE 'Reporter %')),
    d AS (SELECT CASE kind {" ".join(f"WHEN '{k}' THEN '{d}'" for d, k in OBSERVATIONS.items())} END AS dataset, * FROM t)
    SELECT dataset, strftime(ts + INTERVAL 9 HOUR, '%Y-%m') AS dump_month, count(*) AS count, sum(event_id)::BIGINT AS ids,
    CASE WHEN kind = 'drop_ship' THEN count(*) FILTER (k < 73) WHEN kind NOT IN ('remodel_item', 'night_contact') THEN count(*) FILTER (origin LIKE 'Reporter %') END AS marked
    FROM d GROUP BY dataset, dump_month, kind"""
)
def ingest_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of nine kinds as nine streams into nine tables; marked counts emptied snapshots, else own reporters."""
    reports, root = envelopes(spark, sf_dir, OBSERVED), new_folder(spark, "ingested")
    stream = spark.readStream.schema(reports.schema).parquet(reports.inputFiles()[0].rsplit("/kind=", 1)[0])
    checkpoint = new_folder(spark, "checkpoint")
    for dataset in OBSERVATIONS:
        rows = ingest.observations_of(stream, dataset)[0]
        streams.stream_observations(rows, root, dataset, f"{checkpoint}/{dataset}").awaitTermination()
    parts = []
    for dataset in OBSERVATIONS:
        table = observations.read_dataset(spark, root, dataset)
        mark = F.lit(None).cast("long")
        if "origin" in table.columns:
            mark = F.count_if(F.col("origin").startswith("Reporter "))
        if dataset == "dropShipObservations":
            mark = F.count_if(F.col("owned_ship_snapshot") == "{}")
        parts.append(table.groupBy(F.lit(dataset).alias("dataset"), "dump_month").agg(F.count("*").alias("count"), F.sum("id").alias("ids"), mark.alias("marked")))
    return reduce(DataFrame.unionByName, parts)


@query(
    f"""WITH {kind_sql(OBSERVED[:1] + STATE_KINDS)}
    SELECT event_id AS id, kind, CASE WHEN event_id % 13 = 0 THEN 'data must be valid JSON' ELSE 'teitokuLv: expected signed 32-bit integer' END AS message
    FROM env WHERE event_id % 13 = 0 OR wrong AND kind IN ('create_ship', 'select_rank')"""
)
def ingest_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the jobs reject of reports of one observation's kind and of all kinds of states."""
    kinds = OBSERVED[:1] + STATE_KINDS
    return ingest.rejected_reports(envelopes(spark, sf_dir, kinds), tuple(kinds)).select("id", "kind", "message")


STATE_DIGESTS = {
    "selectRankStates": (("teitoku_id", "maparea_id"), None, ("teitoku_lv", "rank", "origin")),
    "recipeAggregates": (("recipe_id", "stage", "day"), "count", ("fuel", "origin", "last_reported")),
    "shipStatAggregates": (("ship_id", "evasion_max"), "count", ("last_timestamp",)),
    "enemyInfoAggregates": (("ships1",), "count", ("bombers_min", "bombers_max")),
    "questDefinitions": (("quest_id", "title", "category"), None, ("key", "origin")),
    "questRewardDefinitions": (("quest_id", "title", "selections"), None, ("key", "category", "origin")),
    "itemImprovementAvailabilityFacts": (("key",), "count", ("first_reported", "last_reported", "observed_flagship_ids", "sources")),
}


@query(
    f"""WITH {kind_sql(STATE_KINDS)}, o AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS nth, dayofweek(ts + INTERVAL 9 HOUR) AS day FROM good),
    s AS (SELECT 'selectRankStates' AS dataset, 'u' || user_id || '|' || k % 3 AS key, NULL::BIGINT AS count,
        arg_max(event_id || '|' || event_id % 5 || '|' || origin, nth) AS value FROM o WHERE kind = 'select_rank' AND NOT wrong GROUP BY user_id, k % 3),
    r AS (SELECT 'recipeAggregates', (user_id + 1) || '|' || (k % 3 - 1) || '|' || day, count(*),
        coalesce(arg_max(CASE event_id % 3 WHEN 0 THEN event_id || '' ELSE '-' END, nth) FILTER (event_id % 3 < 2), '-') || '|' || arg_max(origin, nth) || '|' || max(ms)
        FROM o WHERE kind = 'remodel_recipe' AND k % 3 > 0 GROUP BY user_id, k % 3, day),
    p AS (SELECT 'shipStatAggregates', user_id || '|' || k % 2, count(*), max(ms) || '' FROM o WHERE kind = 'ship_stat' GROUP BY user_id, k % 2),
    z AS (SELECT *, max(CASE WHEN k = 0 THEN nth END) OVER (PARTITION BY user_id) AS reset FROM o WHERE kind = 'enemy_info'),
    n AS (SELECT 'enemyInfoAggregates', '[' || user_id || ']', count(*), max(k) || '|' || coalesce(min(k) FILTER (k > 0 AND k % 2 = 0 AND nth > coalesce(reset, 0)) || '', '-')
        FROM z GROUP BY user_id),
    q AS (SELECT 'questDefinitions', user_id || '|' || event_type || '|' || k % 2, NULL, md5(event_type || 'd') || '|' || arg_min(origin, nth)
        FROM o WHERE kind = 'quest' GROUP BY user_id, event_type, k % 2),
    w AS (SELECT 'questRewardDefinitions', user_id || '|' || event_type || '|[1,' || k % 2 || ']', NULL, md5(event_type || 'd') || '|' || k % 2 || '|' || arg_min(origin, nth)
        FROM o WHERE kind = 'quest_reward' GROUP BY user_id, event_type, k % 2),
    f AS (SELECT user_id, day, k, min(nth) AS nth, count(*) AS n, min(ms) AS lo, max(ms) AS hi FROM o WHERE kind = 'item_improvement' GROUP BY ALL),
    i AS (SELECT 'itemImprovementAvailabilityFacts', 'v1|availability|' || (user_id + 1) || '|5|' || day || '|0', sum(n)::BIGINT,
        min(lo) || '|' || max(hi) || '|[' || string_agg(k + 1, ',' ORDER BY nth) || ']|["list"]' FROM f GROUP BY user_id, day)
    FROM s UNION ALL FROM r UNION ALL FROM p UNION ALL FROM n UNION ALL FROM q UNION ALL FROM w UNION ALL FROM i"""
)
def ingest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of seven kinds folded into states in two batches, the second merged with what the first left."""
    reports, root = envelopes(spark, sf_dir, STATE_KINDS), new_folder(spark, "states")
    cut = F.lit("2024-01-12").cast("timestamp")
    parts = []
    for name, (key, count, values) in STATE_DIGESTS.items():
        job = ingest.STATE_JOBS[name]
        for batch_id, batch in enumerate([reports.where(F.col("ingested_at") < cut), reports.where(F.col("ingested_at") >= cut)]):
            streams.apply_batch(batch, batch_id, job.folded, job.merged, f"{root}/{name}")
        state = streams.read_state(spark, f"{root}/{name}")
        arrays = {f.name for f in state.schema if f.dataType.typeName() == "array"}
        line = lambda names: F.concat_ws("|", *[F.coalesce(F.to_json(c) if c in arrays else F.col(c).cast("string"), F.lit("-")) for c in names])  # noqa: B023, E731
        parts.append(state.select(F.lit(name).alias("dataset"), line(key).alias("key"), (F.col(count) if count else F.lit(None).cast("long")).alias("count"), line(values).alias("value")))
    return reduce(DataFrame.unionByName, parts)


EXPORT_NOW = 1_706_000_000_000
FACT_SOURCES = ("list", "detail", "execution")
MATERIAL_TEXT = ",".join(f'"{name}":{n}' for n, name in enumerate(("fuel", "ammo", "steel", "bauxite", "buildkit", "remodelkit", "certainBuildkit", "certainRemodelkit"), 1))


@query(
    f"""WITH {EVENTS}, r AS (SELECT *, (ts < TIMESTAMP '2024-01-12')::INT AS batch, k % 3 AS route, CASE k % 3
      WHEN 0 THEN 'v1|availability|' || (user_id + 1) || '|5|' || dayofweek(ts + INTERVAL 9 HOUR) || '|0'
      WHEN 1 THEN 'v1|cost|' || (user_id + 1) || '|5|9|2|' || dayofweek(ts + INTERVAL 9 HOUR) || '|0|1|2|3|4|5|6|7|8|317:3|-|0'
      ELSE 'v1|update|' || (user_id + 1) || '|5|9|' || dayofweek(ts + INTERVAL 9 HOUR) || '|0|7|1' END AS key FROM ev WHERE event_id % 13 <> 0),
    f AS (SELECT route, key, count(*) AS count, max(ms) AS last_reported, min({{'b': batch, 't': ts, 'e': event_id}}) AS born,
      '[' || array_to_string(list_sort(list(DISTINCT k + 1)), ',') || ']' AS flagships FROM r GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (ORDER BY born) AS id FROM f),
    p AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY last_reported, id) - 1 AS place FROM n WHERE last_reported <= {EXPORT_NOW} - 30000)
    SELECT CASE route {" ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(ingest.FACTS))} END AS dataset, key, count, last_reported, flagships,
    lpad(printf('%x', id), 24, '0') AS export_id, place // 50 AS page, place % 50 AS position FROM p"""
)
def ingest_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of three routes, the later half as the first batch, folded into the fact store, and all pages of a walk.

    Batches are sent twice. Facts of the second batch have higher ids, whatever their time; known ones keep theirs."""
    df = as_reports(read_table(spark, sf_dir, "events"))
    e, k = F.col("event_id"), F.col("k")
    members = [
        text('"schemaVersion":1,"recipeId":', F.col("user_id") + 1, ',"itemId":5,"itemLevel":9,"stage":2,"day":', calendar.jst_weekday(F.col("ms"))),
        text('"observedSecondShipId":0,"upgradeObserved":true,"upgradeToItemId":7,"upgradeToItemLevel":1,"clientObservedAt":', F.col("ms")),
        F.lit(MATERIAL_TEXT + ',"reqSlotItems":[{"id":317,"count":3}],"reqUseItems":[]'),
        text('"observedFlagshipId":', k + 1, ',"source":"', one_of(k, *FACT_SOURCES), '"'),
    ]
    body = F.when(e % 13 == 0, "{").otherwise(F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}")))
    reports = df.select(
        e.alias("id"), F.col("ts").cast("timestamp").alias("ingested_at"), F.lit("item_improvement").alias("kind"), body.alias("data"),
        F.lit(None).cast("string").alias("x_reporter"), F.lit("agent").alias("user_agent"),
    )
    root, early = new_folder(spark, "facts"), F.col("ingested_at") < F.lit("2024-01-12").cast("timestamp")
    for number in (0, 0, 1, 0, 1):
        facts.apply_facts(reports.where(early if number else ~early), number, root, max_layers=1 + number)
    parts = []
    for name in ingest.FACTS:
        pages = exports.export_pages(facts.read_facts(spark, root, name), EXPORT_NOW, 50)
        flagships = F.to_json(F.array_sort("observed_flagship_ids")).alias("flagships")
        parts.append(pages.select(F.lit(name).alias("dataset"), "key", "count", "last_reported", flagships, "export_id", "page", "position"))
    return reduce(DataFrame.unionByName, parts)
