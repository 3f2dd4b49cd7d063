"""The registered queries over the driver's tables, and the same in SQL.

Each query applies one operator to a whole table; the mapping of its columns to reports is in the query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar, keys
from ..operators import exports, folds
from ..storage import read_table

NOW_MS = 1_706_000_000_000  # 2024-01-23T08:53:20Z, inside the month of events
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict:
    from . import reports  # noqa: F401  its queries register themselves

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reports: k from props, ms from ts."""
    return as_reports(read_table(spark, sf_dir, "events"))


def as_reports(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "k": F.get_json_object("props", "$.k").cast("int"),
            "ms": F.unix_millis(F.col("ts").cast("timestamp")),
            "element": F.array("event_type"),
        }
    )


EVENTS = "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, epoch_us(ts) // 1000 AS ms FROM events)"
ORDER = ["ts", "event_id"]


@query(
    """SELECT user_id, event_type, value, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
    ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"""
)
def latest_state(spark, sf_dir):
    return folds.latest_state(read_table(spark, sf_dir, "events"), ["user_id", "event_type"], ["value", "props"], ORDER)


def patched(df: DataFrame) -> DataFrame:
    """k as a field that every third report leaves out and every seventh sets to null."""
    return df.withColumns({"has_k": F.col("k") % 3 != 0, "k": F.when(F.col("k") % 7 != 0, F.col("k"))})


PATCH_SQL = f"""WITH {EVENTS}, p AS (SELECT *, k % 3 <> 0 AS has_k, CASE WHEN k % 7 <> 0 THEN k END AS v FROM ev),
last AS (SELECT user_id, event_type, v FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
  ORDER BY ts DESC, event_id DESC) AS n FROM p WHERE has_k) WHERE n = 1),
per AS (SELECT user_id, event_type, max(ms) AS last_reported, count(*) AS count, bool_or(has_k) AS has_k FROM p GROUP BY ALL)
SELECT per.user_id, per.event_type, v AS k, has_k, last_reported, count FROM per LEFT JOIN last USING (user_id, event_type)"""


@query(PATCH_SQL)
def patch_state(spark, sf_dir):
    df = patched(events(spark, sf_dir))
    return folds.patch_state(df, ["user_id", "event_type"], ["k"], ORDER, {"k": "has_k"}, "ms")


@query(
    """SELECT l_returnflag, l_linestatus, l_linenumber, l_discount, l_tax, count(*) AS count, max(l_shipdate) AS last_timestamp
    FROM lineitem GROUP BY ALL"""
)
def count_state(spark, sf_dir):
    key = ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax"]
    return folds.count_state(read_table(spark, sf_dir, "lineitem"), key, "l_shipdate")


def ranged(df: DataFrame) -> DataFrame:
    """k as an upper bound: absent in every fifth report, null in every eleventh."""
    return df.withColumns({"low": F.col("k"), "has_high": F.col("k") % 5 != 0, "high": F.when(F.col("k") % 11 != 0, F.col("k"))})


RANGE_SQL = f"""WITH {EVENTS}, r AS (SELECT *, k % 5 <> 0 AS has_high, CASE WHEN k % 11 <> 0 THEN k END AS h,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS o FROM ev),
z AS (SELECT user_id, event_type, max(o) AS reset FROM r WHERE has_high AND h IS NULL GROUP BY ALL)
SELECT r.user_id, r.event_type, max(k) AS low, min(CASE WHEN has_high AND (reset IS NULL OR o > reset) THEN h END) AS high,
  coalesce(bool_or(has_high AND h IS NULL), false) AS has_null, count(*) AS count
FROM r LEFT JOIN z USING (user_id, event_type) GROUP BY r.user_id, r.event_type"""


@query(RANGE_SQL)
def range_state(spark, sf_dir):
    return folds.range_state(ranged(events(spark, sf_dir)), ["user_id", "event_type"], "low", "high", "has_high", ORDER)


@query(
    """SELECT key, doc_id, source, n_chars FROM (SELECT *, md5(lang || text) AS key, row_number() OVER
    (PARTITION BY md5(lang || text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1"""
)
def first_definition(spark, sf_dir):
    df = read_table(spark, sf_dir, "documents").withColumn("key", keys.definition_key(F.col("lang"), F.col("text")))
    return folds.first_definition(df, ["key"], ["doc_id", "source", "n_chars"], ["doc_id"])


@query(
    """SELECT event_id, event_type, user_id FROM (SELECT *, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)
    AS f FROM events) WHERE f <> event_type"""
)
def identity_collisions(spark, sf_dir):
    """Users as hashes that should stand for one event type: rows that differ from the user's first."""
    return folds.collisions(read_table(spark, sf_dir, "events"), ["user_id"], ["event_type"], ORDER)[1].select("event_id", "event_type", "user_id")


@query(
    """WITH o AS (SELECT o_custkey, min(o_orderkey) AS id, list(o_orderpriority ORDER BY o_orderkey) AS a FROM orders GROUP BY ALL)
    SELECT array_to_string(a, ',') AS selections, min(id) AS id, arg_min(o_custkey, id) AS o_custkey FROM o GROUP BY 1"""
)
def first_by_array_key(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.min("o_orderkey").alias("id"), F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("a")
    )
    keyed = orders.withColumn("selections", F.transform("a", lambda x: x["o_orderpriority"])).withColumn("first_id", F.col("id"))
    out = folds.first_definition(keyed, ["selections"], ["first_id", "o_custkey"], ["id"])
    return out.select(F.array_join("selections", ",").alias("selections"), F.col("first_id").alias("id"), "o_custkey")


def facts_of(df: DataFrame) -> DataFrame:
    return folds.accumulate_facts(df, ["user_id"], ["event_type"], "ms", "ms", ["element"], ORDER)


FACTS = f"""{EVENTS}, el AS (SELECT user_id, event_type, min(struct_pack(ts := ts, id := event_id)) AS f FROM ev GROUP BY ALL),
els AS (SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS elements FROM el GROUP BY ALL),
facts AS (SELECT user_id, arg_min(event_type, struct_pack(ts := ts, id := event_id)) AS event_type, min(ms) AS first_client_observed_at,
  max(ms) AS last_client_observed_at, min(ms) AS first_reported, max(ms) AS last_reported, count(*) AS count FROM ev GROUP BY user_id)"""


@query(f"WITH {FACTS} SELECT facts.*, elements FROM facts JOIN els USING (user_id)")
def accumulate_facts(spark, sf_dir):
    out = facts_of(events(spark, sf_dir))
    return out.withColumn("elements", F.array_join("element", ",")).drop("element")


@query(f"WITH {FACTS} SELECT user_id, elements FROM els")
def ordered_set_union(spark, sf_dir):
    out = folds.ordered_set_union(events(spark, sf_dir), ["user_id"], "element", ORDER)
    return out.select("user_id", F.array_join("element", ",").alias("elements"))


def two_batches(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    return df.where(F.col("ts") < cut), df.where(F.col("ts") >= cut)


@query(f"WITH {FACTS} SELECT facts.*, elements FROM facts JOIN els USING (user_id)")
def merge_facts(spark, sf_dir):
    old, batch = map(facts_of, two_batches(events(spark, sf_dir)))
    spec = {
        "event_type": "first", "first_client_observed_at": "min", "last_client_observed_at": "max", "first_reported": "first",
        "last_reported": "max", "count": "sum", "element": "union",
    }
    merged = folds.merge_state(old, batch, ["user_id"], spec)
    return merged.withColumn("elements", F.array_join("element", ",")).drop("element")


@query(PATCH_SQL)
def merge_patches(spark, sf_dir):
    key = ["user_id", "event_type"]
    fold = [folds.patch_state(patched(x), key, ["k"], ORDER, {"k": "has_k"}, "ms") for x in two_batches(events(spark, sf_dir))]
    return folds.merge_state(*fold, key, {"k": "patch", "has_k": "any", "last_reported": "max", "count": "sum"})


@query(RANGE_SQL)
def merge_ranges(spark, sf_dir):
    key = ["user_id", "event_type"]
    fold = [folds.range_state(ranged(x), key, "low", "high", "has_high", ORDER) for x in two_batches(events(spark, sf_dir))]
    return folds.merge_state(*fold, key, {"low": "max", "high": "reset", "has_null": "any", "count": "sum"})


@query("SELECT doc_id, n > 1 AS deleted FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents)")
def dedupe_by_key(spark, sf_dir):
    df = read_table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("key"))
    kept, deleted = folds.dedupe_by_key(df, "key", "doc_id")
    return kept.select("doc_id", F.lit(False).alias("deleted")).unionByName(deleted.select("doc_id", F.lit(True).alias("deleted")))


def exported_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts per user and event type, last report cut to the day so that times tie, with cursor ids."""
    df = events(spark, sf_dir).withColumn("day_ms", F.floor(F.col("ms") / 86_400_000) * 86_400_000)
    facts = df.groupBy("user_id", "event_type").agg(F.min("ms").alias("first_reported"), F.max("day_ms").alias("last_reported"), F.count("*").alias("count"))
    return exports.assign_export_ids(facts, ["first_reported", "user_id", "event_type"])


EXPORTED = f"""{EVENTS}, f AS (SELECT user_id, event_type, min(ms) AS first_reported, max(ms // 86400000 * 86400000) AS last_reported,
  count(*) AS count FROM ev GROUP BY ALL),
facts AS (SELECT *, row_number() OVER (ORDER BY first_reported, user_id, event_type) AS id,
  lpad(lower(to_hex(row_number() OVER (ORDER BY first_reported, user_id, event_type))), 24, '0') AS export_id FROM f),
settled AS (SELECT * FROM facts WHERE last_reported <= {NOW_MS} - 30000)"""
PUBLIC = {"export_id": "_id", "user_id": "userId", "event_type": "eventType", "first_reported": "firstReported", "last_reported": "lastReported", "count": "count"}
PUBLIC_SQL = "export_id AS _id, user_id AS \"userId\", event_type AS \"eventType\", first_reported AS \"firstReported\", last_reported AS \"lastReported\", count"


@query(f"WITH {EXPORTED} SELECT {PUBLIC_SQL} FROM settled WHERE last_reported > 0 ORDER BY last_reported, export_id LIMIT 500")
def export_page(spark, sf_dir):
    return exports.public_columns(exports.export_page(exported_facts(spark, sf_dir), NOW_MS), PUBLIC)


@query(
    f"""WITH {EXPORTED}, c AS (SELECT max(struct_pack(t := last_reported, i := export_id)) AS c FROM
    (SELECT * FROM settled ORDER BY last_reported, export_id LIMIT 20))
    SELECT {PUBLIC_SQL} FROM settled, c WHERE last_reported > c.t OR (last_reported = c.t AND export_id > c.i)
    ORDER BY last_reported, export_id LIMIT 20"""
)
def export_second_page(spark, sf_dir):
    facts = exported_facts(spark, sf_dir)
    cursor = exports.next_cursor(exports.export_page(facts, NOW_MS, limit=20)).first()
    page = exports.export_page(facts, NOW_MS, cursor.updated_after, cursor.after_id, 20) if cursor else facts.limit(0)
    return exports.public_columns(page, PUBLIC)


@query(
    f"""WITH {EXPORTED} SELECT export_id, (row_number() OVER (ORDER BY last_reported, export_id) - 1) // 50 AS page,
    (row_number() OVER (ORDER BY last_reported, export_id) - 1) % 50 AS position FROM settled"""
)
def export_pages(spark, sf_dir):
    return exports.export_pages(exported_facts(spark, sf_dir), NOW_MS, 50).select("export_id", "page", "position")


@query(
    f"""WITH {EXPORTED}, c AS (SELECT max(struct_pack(t := last_reported, i := export_id)) AS c FROM
    (SELECT * FROM settled ORDER BY last_reported, export_id LIMIT 50)) SELECT c.t AS updated_after, c.i AS after_id FROM c"""
)
def next_cursor(spark, sf_dir):
    return exports.next_cursor(exports.export_page(exported_facts(spark, sf_dir), NOW_MS, limit=50))


@query("SELECT o_custkey, row_number() OVER (ORDER BY CAST(o_custkey AS VARCHAR)) - 1 AS rank FROM (SELECT DISTINCT o_custkey FROM orders)")
def known_ids(spark, sf_dir):
    ids = exports.known_ids(read_table(spark, sf_dir, "orders"), "o_custkey").withColumn("text", F.col("o_custkey").cast("string"))
    return exports.with_ordered_index(ids, ["text"], "rank").select("o_custkey", "rank")


@query("SELECT substr(k, 1, 2) AS prefix FROM (SELECT DISTINCT md5(text) AS k FROM documents)")
def known_prefixes(spark, sf_dir):
    return exports.known_prefixes(read_table(spark, sf_dir, "documents").select(F.md5("text").alias("k")), "k", 2)


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" UNION ALL ".join([f"SELECT '{t}' AS dataset, count(*) AS count FROM {t}" for t in TABLES] + ["SELECT 'missing', 0"]))
def dataset_counts(spark, sf_dir):
    return exports.dataset_counts({t: read_table(spark, sf_dir, t) for t in TABLES}, [*TABLES, "missing"])


def ingested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as observations: hours of the day from the key; a stored month that knows nothing of Japan."""
    df = read_table(spark, sf_dir, "orders").withColumn("ingested_at", F.col("o_orderdate") + F.make_dt_interval(hours=F.col("o_orderkey") % 24))
    return df.withColumn("dump_month", F.date_format("ingested_at", "yyyy-MM"))


INGESTED = """o AS (SELECT *, o_orderdate + to_hours(o_orderkey % 24) AS ingested_at FROM orders),
od AS (SELECT *, strftime(ingested_at, '%Y-%m') AS dump_month, strftime(ingested_at + INTERVAL 9 HOUR, '%Y-%m') AS month FROM o)"""


@query(f"WITH {INGESTED} SELECT o_orderstatus AS dataset, month AS dump_month, count(*) AS count FROM od GROUP BY ALL")
def month_counts(spark, sf_dir):
    return exports.month_counts(ingested_orders(spark, sf_dir), "ingested_at", "o_orderstatus")


@query(
    f"""WITH {INGESTED} SELECT o_orderkey, month, strptime(month || '-01', '%Y-%m-%d') - INTERVAL 9 HOUR AS lower,
    strptime(month || '-01', '%Y-%m-%d') + INTERVAL 1 MONTH - INTERVAL 9 HOUR AS upper FROM od"""
)
def month_bounds(spark, sf_dir):
    month = calendar.jst_month(F.col("ingested_at"))
    lower, upper = calendar.month_bounds_columns(F.col("month"))
    df = ingested_orders(spark, sf_dir).select("o_orderkey", month.alias("month"))
    return df.withColumns({"lower": lower.cast("timestamp_ntz"), "upper": upper.cast("timestamp_ntz")})


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, CAST(dayofweek(ts + INTERVAL 9 HOUR) AS INT) AS weekday FROM events")
def iso_millis(spark, sf_dir):
    df = events(spark, sf_dir)
    return df.select("event_id", calendar.iso_millis(F.col("ts")).alias("iso"), calendar.jst_weekday(F.col("ms")).alias("weekday"))


@query(
    """WITH a AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS p,
    list(CAST(l_quantity AS INT) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT l_orderkey, sha256('[[' || array_to_string(p, ',') || '],[' || array_to_string(q, ',') || '],' || n || ']') AS hash FROM a"""
)
def identity_hash(spark, sf_dir):
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    df = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("a"), F.count("*").alias("n"))
    parts = F.transform("a", lambda x: x["l_partkey"]), F.transform("a", lambda x: x["l_quantity"].cast("int"))
    return df.select("l_orderkey", keys.identity_hash(*parts, scalars=(F.col("n"),)).alias("hash"))


@query(
    """WITH i AS (SELECT l_orderkey, l_partkey AS id, CAST(sum(l_linenumber) AS BIGINT) AS n FROM lineitem GROUP BY ALL),
    t AS (SELECT l_orderkey, string_agg(id || ':' || n, ',' ORDER BY id) AS items FROM i GROUP BY ALL)
    SELECT l_orderkey, 'v1|cost|' || l_orderkey || '|700|6|1|6|0|1|2|3|4|5|6|7|8|' || items || '|-|0' AS cost_key,
    'v1|availability|' || l_orderkey || '|700|6|0' AS availability_key, 'v1|update|' || l_orderkey || '|700|10|6|102|701|0' AS update_key FROM t"""
)
def improvement_keys(spark, sf_dir):
    """Line items of an order as the items that a recipe needs."""
    from ..operators import improvement

    df = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.struct(F.col("l_partkey").alias("id"), F.col("l_linenumber").cast("long").alias("count"))).alias("raw")
    )
    n = [F.lit(k) for k in range(1, 9)]
    o, item, zero = F.col("l_orderkey"), F.lit(700), F.lit(0)
    items = improvement.summed_items(F.col("raw"))
    none = F.array().cast("array<struct<id:bigint,count:bigint>>")
    return df.select(
        "l_orderkey",
        keys.cost_key(o, item, F.lit(6), F.lit(1), F.lit(6), zero, n, items, none, zero).alias("cost_key"),
        keys.availability_key(o, item, F.lit(6), zero).alias("availability_key"),
        keys.update_key(o, item, F.lit(10), F.lit(6), F.lit(102), F.lit(701), zero).alias("update_key"),
    )


@query(
    """WITH v AS (SELECT event_id, (event_id % 9) || '.' || (event_id % 11) || '.' || (event_id % 4) AS version,
      CASE WHEN event_id % 3 = 0 THEN 'Reporter ' || (event_id % 5) || '.6.0' WHEN event_id % 3 = 1 THEN 'Reporter x' ELSE 'other/1.2.3' END AS origin FROM events),
    s AS (SELECT *, event_id % 9 AS a, event_id % 11 AS b, event_id % 4 AS c, event_id % 5 AS r FROM v)
    SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 'rejected' WHEN (a > 7 OR (a = 7 AND b > 9) OR (a = 7 AND b = 9 AND c > 1))
      AND event_id % 3 = 0 AND r >= 3 THEN 'stored' ELSE 'ignored' END AS outcome FROM s"""
)
def semver_gate(spark, sf_dir):
    from ..operators import normalize

    e = F.col("event_id")
    text = lambda x: x.cast("string")
    df = read_table(spark, sf_dir, "events").select(
        "event_id", F.concat_ws(".", text(e % 9), text(e % 11), text(e % 4)).alias("version"),
        F.when(e % 3 == 0, F.concat(F.lit("Reporter "), text(e % 5), F.lit(".6.0"))).when(e % 3 == 1, "Reporter x").otherwise("other/1.2.3").alias("origin"),
    )
    return df.select("event_id", normalize.semver_outcome(F.col("version"), F.col("origin")).alias("outcome"))


@query(
    """WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN upper(substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 24))
      WHEN o_orderkey % 3 = 1 THEN substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 12) ELSE o_orderpriority END AS cursor FROM orders)
    SELECT o_orderkey, CASE WHEN length(cursor) = 24 AND o_orderkey % 3 = 0 THEN lower(cursor) WHEN length(cursor) = 12 THEN lower(hex(cursor)) END AS canonical FROM c"""
)
def cursor_canonical(spark, sf_dir):
    k = F.col("o_orderkey")
    digest = F.md5(k.cast("string"))
    cursor = F.when(k % 3 == 0, F.upper(F.substring(digest, 1, 24))).when(k % 3 == 1, F.substring(digest, 1, 12)).otherwise(F.col("o_orderpriority"))
    return read_table(spark, sf_dir, "orders").select("o_orderkey", keys.canonical_cursor(cursor).alias("canonical"))


@query(
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type WHEN event_id % 4 = 1 THEN '' WHEN event_id % 8 = 2 THEN 'agent'
    WHEN event_id % 8 = 6 THEN 'header' ELSE '' END AS origin FROM events"""
)
def origin_default(spark, sf_dir):
    e = F.col("event_id")
    own = F.when(e % 4 == 0, F.col("event_type")).when(e % 4 == 1, "")
    header = F.when(e % 8 == 6, "header").when(e % 8 == 2, "")
    agent = F.when(e % 4 == 2, "agent")
    return read_table(spark, sf_dir, "events").select("event_id", keys.origin_of(own, header, agent).alias("origin"))


@query(
    f"""WITH {INGESTED}, m AS (SELECT month AS dataset, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS b FROM od GROUP BY ALL)
    SELECT dataset, CASE WHEN CAST(substr(dataset, 6, 2) AS INT) = 1 THEN 'missing file' WHEN CAST(substr(dataset, 6, 2) AS INT) = 2 THEN 'not in manifest'
    ELSE 'row_count differs' END AS problem FROM m WHERE CAST(substr(dataset, 6, 2) AS INT) <= 3"""
)
def manifest_reconcile(spark, sf_dir):
    """Month counts as files, with planted differences: Januaries lack a file, Februaries an entry, Marches miscount."""
    counts = exports.month_counts(ingested_orders(spark, sf_dir), "ingested_at").select(F.col("dump_month").alias("dataset"), F.col("count").alias("row_count"))
    number = F.substring("dataset", 6, 2).cast("int")
    manifest = counts.where(number != 2).withColumn("row_count", F.col("row_count") + F.when(number == 3, 1).otherwise(0))
    return exports.reconcile(manifest, counts.where(number != 1), columns=("row_count",))


MISPLACED = f"WITH {INGESTED} SELECT o_orderkey, dump_month, month FROM od WHERE dump_month <> month"


@query(MISPLACED)
def misplaced_rows(spark, sf_dir):
    from ..sources.observations import misplaced_rows as misplaced

    out = misplaced(ingested_orders(spark, sf_dir))
    return out.select("o_orderkey", "dump_month", calendar.jst_month(F.col("ingested_at")).alias("month"))


@query(
    f"""WITH {INGESTED} SELECT dump_month, min(ingested_at) AS first, max(ingested_at) AS last,
    min(ingested_at) >= strptime(dump_month || '-01', '%Y-%m-%d') - INTERVAL 9 HOUR AND
    max(ingested_at) < strptime(dump_month || '-01', '%Y-%m-%d') + INTERVAL 1 MONTH - INTERVAL 9 HOUR AS within FROM od GROUP BY dump_month"""
)
def check_month_bounds(spark, sf_dir):
    from ..sources.observations import check_month_bounds as check

    return check(ingested_orders(spark, sf_dir))


@query(
    """SELECT event_id, '{"observationId":"' || event_id || '","ingestedAt":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') || '","userId":' || user_id ||
    ',"eventType":"' || event_type || '","props":' || CAST(json(props) AS VARCHAR) || ',"note":null}' AS line FROM events"""
)
def serialize(spark, sf_dir):
    from ..sources.dump import serialize as lines

    df = read_table(spark, sf_dir, "events").withColumn("note", F.lit(None).cast("string"))
    fields = {"user_id": ("userId", "integer"), "event_type": ("eventType", "string"), "props": ("props", "json"), "note": ("note", "string")}
    return lines(df, fields, "event_id", "ts").select("event_id", "line")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS place, CAST((row_number() OVER (ORDER BY ts, event_id) - 1) // 700 AS INT) AS part FROM events")
def dump_order(spark, sf_dir):
    from ..sources.dump import dump_rows

    return dump_rows(read_table(spark, sf_dir, "events").select("event_id", "ts"), 700, "ts", "event_id").select("event_id", "place", "part")


@query(
    """SELECT event_id, '{"a":' || CAST(json(props) AS VARCHAR) || ',"b":[2,1],"z":"' || event_type || '"}' AS canonical,
    md5(CAST(json(props) AS VARCHAR)) AS digest FROM events"""
)
def canonical_json(spark, sf_dir):
    text = F.concat(F.lit('{ "z" : "'), F.col("event_type"), F.lit('", "b": [2, 1], "a": '), F.col("props"), F.lit("}"))
    df = read_table(spark, sf_dir, "events")
    return df.select("event_id", keys.canonical_json(text).alias("canonical"), F.md5(keys.canonical_json(F.col("props"))).alias("digest"))


@query("SELECT strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, event_type, count(*) AS count FROM events GROUP BY ALL")
def jst_day_counts(spark, sf_dir):
    from ..streaming.reports import jst_day_counts as days

    return days(read_table(spark, sf_dir, "events"), "ts", ["event_type"])


@query(f"WITH {INGESTED} SELECT month IN ('1996-02', '1997-07') AS late, count(*) AS count FROM od GROUP BY ALL")
def split_late(spark, sf_dir):
    from ..streaming.reports import split_late as split

    sides = split(ingested_orders(spark, sf_dir), ["1996-02", "1997-07"])
    counts = [side.groupBy(F.lit(late).alias("late")).agg(F.count("*").alias("count")) for late, side in zip((False, True), sides)]
    return counts[0].unionByName(counts[1])


def raw_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON reports with fields that are missing, null, lenient and wrong."""
    e, user = F.col("event_id"), F.col("user_id").cast("string")
    number = (
        F.when(e % 6 == 0, F.concat(F.lit('"count":'), user))
        .when(e % 6 == 1, F.concat(F.lit('"count":" '), user, F.lit(' "')))
        .when(e % 6 == 2, '"count":1.5')
        .when(e % 6 == 3, '"count":null')
        .when(e % 6 == 5, '"count":true')
    )
    label = F.when(e % 7 == 0, '"label":{"a":1}').otherwise(F.concat(F.lit('"label":"'), F.col("event_type"), F.lit('"')))
    ids = F.when(e % 4 == 1, '"ids":null').when(e % 4 == 2, '"ids":[1,"2",null]').when(e % 4 == 3, '"ids":5')
    data = F.concat(F.lit("{"), F.concat_ws(",", number, label, ids, F.lit('"unknown":1')), F.lit("}"))
    return read_table(spark, sf_dir, "events").select("event_id", data.alias("data"))


def normalized(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from ..operators.normalize import normalize, parse_reports
    from ..schemas import Field

    schema = {"count": Field("integer", True), "label": Field("string"), "ids": Field("integerArray")}
    return normalize(parse_reports(raw_reports(spark, sf_dir))[0], schema)


@query(
    """SELECT event_id, CASE WHEN event_id % 6 = 5 THEN 1 ELSE user_id END AS count, event_type AS label,
    CASE event_id % 4 WHEN 0 THEN '[]' WHEN 2 THEN '[1,2,null]' WHEN 3 THEN '[5]' END AS ids
    FROM events WHERE event_id % 6 IN (0, 1, 5) AND event_id % 7 <> 0"""
)
def normalize_accept(spark, sf_dir):
    return normalized(spark, sf_dir)[0].select("event_id", "count", "label", F.to_json("ids").alias("ids"))


@query(
    """SELECT event_id, CASE WHEN event_id % 6 = 2 THEN 'count: expected signed 32-bit integer' WHEN event_id % 6 IN (3, 4) THEN 'count: expected integer'
    ELSE 'label: expected string' END AS message, CAST(event_id % 6 IN (2, 3, 4) AS INT) + CAST(event_id % 7 = 0 AS INT) AS n_issues
    FROM events WHERE event_id % 6 IN (2, 3, 4) OR event_id % 7 = 0"""
)
def normalize_reject(spark, sf_dir):
    return normalized(spark, sf_dir)[1].select("event_id", "message", F.size("issues").alias("n_issues"))


@query(
    """WITH r AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, CASE WHEN event_id % 5 = 0 THEN (dayofweek(ts + INTERVAL 9 HOUR) + 1) % 7
      ELSE dayofweek(ts + INTERVAL 9 HOUR) END AS day, user_id FROM events)
    SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN 'v1|availability|' || (user_id + 1) || '|' || (event_id % 50 + 1) || '|' || day || '|0' END AS key,
    CASE WHEN event_id % 5 = 0 THEN 'day: does not match clientObservedAt JST day' END AS message FROM r"""
)
def improvement_records(spark, sf_dir):
    """Events as improvement reports; every fifth names a wrong weekday and is rejected."""
    from ..operators.improvement import improvement_records as records
    from ..operators.normalize import parse_reports

    df = events(spark, sf_dir)
    e, day = F.col("event_id"), calendar.jst_weekday(F.col("ms"))
    one = F.struct(
        F.lit("list").alias("source"), F.lit(1).alias("schemaVersion"), F.col("ms").alias("clientObservedAt"), (F.col("user_id") + 1).alias("recipeId"),
        (e % 50 + 1).cast("string").alias("itemId"), F.when(e % 5 == 0, (day + 1) % 7).otherwise(day).alias("day"), F.lit(0).alias("observedSecondShipId"),
    )
    raw = df.select("event_id", F.col("ms").alias("received_ms"), F.lit("client").alias("x_reporter"), F.to_json(F.struct(F.array(one).alias("records"))).alias("data"))
    listed, _, _, rejected = records(parse_reports(raw)[0], keep=("event_id",))
    none = F.lit(None).cast("string")
    return listed.select("event_id", "key", none.alias("message")).unionByName(rejected.select("event_id", none.alias("key"), "message"))


@query(f"WITH {FACTS} SELECT facts.*, elements FROM facts JOIN els USING (user_id)")
def stream_facts(spark, sf_dir):
    """The fold of accumulate_facts as a stream over the table's files, one batch after the other."""
    from ..storage import new_folder
    from ..streaming.reports import read_state, stream_state

    table = read_table(spark, sf_dir, "events")
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    spec = {
        "event_type": "first", "first_client_observed_at": "min", "last_client_observed_at": "max", "first_reported": "first",
        "last_reported": "max", "count": "sum", "element": "union",
    }

    def fold(batch):
        return facts_of(as_reports(batch))

    root = new_folder(spark, "facts")
    stream_state(stream, fold, lambda old, new: folds.merge_state(old, new, ["user_id"], spec), root, new_folder(spark, "facts-checkpoint")).awaitTermination()
    return read_state(spark, root).withColumn("elements", F.array_join("element", ",")).drop("element")


@query(
    f"""WITH {INGESTED} SELECT 'nightContactObservations' AS dataset, '1996-02/nightContactObservations.jsonl.gz' AS object_key,
    count(*) AS row_count FROM od WHERE month = '1996-02'"""
)
def publish_month(spark, sf_dir):
    """Orders appended as observations, then one month published; its manifest entry."""
    from datetime import datetime

    from ..sources import dump, observations
    from ..storage import new_folder

    df = ingested_orders(spark, sf_dir).select(
        F.col("o_orderkey").alias("id"), F.col("ingested_at").cast("timestamp").alias("ingested_at"), F.lit(1).alias("fleet_type"), F.lit(2).alias("ship_id"),
        F.lit(3).alias("ship_lv"), F.lit(4).alias("item_id"), F.lit(5).alias("item_lv"), (F.col("o_orderkey") % 2 == 0).alias("contact"),
    )
    root = new_folder(spark, "observations")
    observations.append_observations(df, root, "nightContactObservations")
    entries = dump.publish_month(spark, root, new_folder(spark, "published"), "1996-02", datetime(2024, 1, 1))
    return entries.where("dataset = 'nightContactObservations'").select("dataset", "object_key", "row_count")
