"""Item-improvement records: batches of up to 100 records in a report, validated as a whole before anything is exploded,
so one bad record rejects its report without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import casting, keys
from ..functions.calendar import jst_weekday, near_jst_midnight
from ..schemas import column_of

MAX_BATCH = 100
#: The earliest observation (2013-04-23T00:00Z) and the clock skew that is tolerated, in milliseconds.
EARLIEST_MS, SKEW_MS = 1_366_675_200_000, 600_000
WHOLE = r"\A-?[0-9]+\z"
COMMON = {"schemaVersion": 1, "recipeId": 1, "itemId": 1, "observedSecondShipId": 0}
LEVELS = {
    "list": {},
    "detail": dict.fromkeys("itemLevel stage fuel ammo steel bauxite buildkit remodelkit certainBuildkit certainRemodelkit".split(), 0),
    "execution": {"itemLevel": 0, "upgradeToItemId": 1, "upgradeToItemLevel": 0},
}
ITEMS = "array<struct<id:bigint,count:bigint>>"
NUMBERS = COMMON | LEVELS["detail"] | LEVELS["execution"]
#: Members of a record with the types that they have if they are sent as what they are.
TYPES = {"source": "string", **dict.fromkeys(NUMBERS, "bigint"), **dict.fromkeys("day clientObservedAt observedFlagshipId changeFlag".split(), "bigint")}
TYPES |= {"observedFlagshipIds": "array<bigint>", "upgradeObserved": "boolean"} | dict.fromkeys(("reqSlotItems", "reqUseItems"), "array<struct<count:bigint,id:bigint>>")
MEMBERS = ["source", *NUMBERS, *"day clientObservedAt observedFlagshipId observedFlagshipIds reqSlotItems reqUseItems changeFlag upgradeObserved".split()]


def strict_whole(v: Column, least: int = -casting.SAFE, most: int = casting.SAFE) -> Column:
    """A whole number, a text of digits or a boolean, as BIGINT; null for anything else and beyond the bounds."""

    def of(kind):
        text = casting.let(casting.get(v, "string"), lambda t: F.when(t.rlike(WHOLE), t.try_cast("double")))
        number = F.when(kind == "number", casting.get(v, "double")).when(kind == "string", text)
        number = number.when(kind == "boolean", casting.get(v, "boolean").cast("int").cast("double"))
        return casting.let(number, lambda n: F.when(n.between(least, most) & (n == F.floor(n)), n.cast("long")))

    return F.when(v.isNotNull(), casting.let(casting.type_of(v), of))


def int32(v: Column, least: int = -2147483648) -> Column:
    return strict_whole(v, least, 2147483647)


def summed_items(items: Column) -> Column:
    """P24, the sum: counts of one id added up, by id; pairs of two zeros are no items."""

    def of(real):
        ids = F.array_sort(F.array_distinct(F.transform(real, lambda x: x["id"])))
        count = lambda i: F.aggregate(F.filter(real, lambda x: x["id"] == i), F.lit(0).cast("long"), lambda acc, x: acc + x["count"])
        return F.transform(ids, lambda i: F.struct(i.alias("id"), count(i).alias("count")))

    return casting.let(F.filter(items, lambda x: ~((x["id"] == 0) & (x["count"] == 0))), of)


def pairs_of(v: Column) -> Column:
    """The pairs (id, count) of a list as whole numbers; null if it is no list."""
    return F.transform(casting.get(v, "array<struct<id:variant,count:variant>>"), lambda e: F.struct(int32(e["id"]).alias("id"), int32(e["count"]).alias("count")))


def required_items(pairs: Column) -> Column:
    """Struct (items, at, bad): at is the place of the first bad pair, null if there is none."""

    def judged(raw):
        bad = F.filter(
            F.transform(raw, lambda x, k: F.struct(k.alias("k"), (x["id"].isNull() | x["count"].isNull()).alias("type"), x["id"].alias("id"), x["count"].alias("count"))),
            lambda x: x["type"] | (~((x["id"] == 0) & (x["count"] == 0)) & ((x["id"] <= 0) | (x["count"] <= 0))),
        )
        return casting.let(
            F.get(bad, F.lit(0)),
            lambda b: F.struct(F.when(b.isNull(), summed_items(raw)).alias("items"), b["k"].alias("at"), (b.isNotNull() & b["type"]).alias("wrong_type")),
        )

    none = F.struct(F.lit(None).cast(ITEMS).alias("items"), F.lit(-1).alias("at"), F.lit(True).alias("wrong_type"))
    return F.when(pairs.isNotNull(), judged(pairs)).otherwise(none)  # null: no list


def flagship_ids(one: Column, many: Column) -> Column:
    """P25: the union of an id and a list, distinct and ascending."""
    return F.sort_array(F.array_distinct(F.array_compact(F.concat(F.array(one), F.coalesce(many, F.array().cast("array<bigint>"))))))


def plausible_time(ms: Column, received: Column) -> Column:
    """P22"""
    return ms.between(F.lit(EARLIEST_MS), received + SKEW_MS)


def day_problem(day: Column, observed: Column, received: Column) -> Column:
    """What is wrong with the weekday, null if nothing."""
    off = (day != jst_weekday(received)) & ~near_jst_midnight(observed) & ~near_jst_midnight(received)
    return F.when(day != jst_weekday(observed), "day: does not match clientObservedAt JST day").when(off, "day: does not match serverReceivedAt JST day")


def record_of(r: Column, received: Column) -> Column:
    """A record's fields with problem, the first thing that is wrong with it."""

    def of(members):
        plain = casting.let(casting.as_printed(members, TYPES), lambda cast: F.when(cast.isNotNull(), _plain_fields(members, cast)))
        return _record_of(F.coalesce(plain, _fields(members)), received)

    return casting.let(casting.parts(r, MEMBERS), of)


def _plain_fields(members: Column, cast: Column) -> Column:
    """What _fields makes of a record whose members have the types of TYPES already."""
    whole = lambda n, least=-2147483648, most=2147483647: F.when(n.between(least, most), n)
    pairs = lambda items: F.transform(items, lambda e: F.struct(whole(e["id"]).alias("id"), whole(e["count"]).alias("count")))
    return F.struct(
        cast["source"].alias("source"),
        *[whole(cast[n], least).alias(n) for n, least in NUMBERS.items()],
        whole(cast["day"], 0).alias("day"),
        whole(cast["clientObservedAt"], -casting.SAFE, casting.SAFE).alias("clientObservedAt"),
        whole(cast["observedFlagshipId"], 1).alias("one"),
        F.transform(cast["observedFlagshipIds"], lambda e: whole(e, 1)).alias("many"),
        members["observedFlagshipId"].isNotNull().alias("has_one"),
        members["observedFlagshipIds"].isNotNull().alias("has_many"),
        pairs(cast["reqSlotItems"]).alias("slots"),
        pairs(cast["reqUseItems"]).alias("uses"),
        members["reqSlotItems"].isNotNull().alias("has_slots"),
        members["reqUseItems"].isNotNull().alias("has_uses"),
        F.when(members["changeFlag"].isNull(), F.lit(0).cast("long")).otherwise(whole(cast["changeFlag"])).alias("changeFlag"),
        F.coalesce(cast["upgradeObserved"], F.lit(False)).alias("upgradeObserved"),
    )


def _fields(members: Column) -> Column:
    part = lambda name: members[name]
    source = casting.get(part("source"), "string")
    ids = F.transform(casting.get(part("observedFlagshipIds"), "array<variant>"), lambda e: int32(e, 1))
    return F.struct(
        F.when(casting.type_of(part("source")) == "string", source).alias("source"),
        *[int32(part(n), least).alias(n) for n, least in NUMBERS.items()],
        int32(part("day"), 0).alias("day"),
        strict_whole(part("clientObservedAt")).alias("clientObservedAt"),
        int32(part("observedFlagshipId"), 1).alias("one"),
        ids.alias("many"),
        part("observedFlagshipId").isNotNull().alias("has_one"),
        part("observedFlagshipIds").isNotNull().alias("has_many"),
        pairs_of(part("reqSlotItems")).alias("slots"),
        pairs_of(part("reqUseItems")).alias("uses"),
        part("reqSlotItems").isNotNull().alias("has_slots"),
        part("reqUseItems").isNotNull().alias("has_uses"),
        F.when(part("changeFlag").isNull(), F.lit(0).cast("long")).otherwise(int32(part("changeFlag"))).alias("changeFlag"),
        F.coalesce((casting.type_of(part("upgradeObserved")) == "boolean") & casting.get(part("upgradeObserved"), "boolean"), F.lit(False)).alias("upgradeObserved"),
    )


def _record_of(fields: Column, received: Column) -> Column:
    def judged(x, slots, uses):
        detail, execution = x["source"] == "detail", x["source"] == "execution"
        number = lambda n, least: F.when(x[n].isNull(), f"{n}: must be a {'positive' if least else 'non-negative'} integer")
        levels = lambda side: F.coalesce(*[number(n, least) for n, least in LEVELS[side].items()])
        wrong = [F.when(~F.coalesce(x["source"].isin("list", "detail", "execution"), F.lit(False)), "source: must be list, detail or execution")]
        wrong += [number(n, least) for n, least in COMMON.items()]
        wrong.append(F.when(x["day"].isNull() | (x["day"] > 6), "day: must be between 0 and 6"))
        wrong.append(F.when(x["clientObservedAt"].isNull() | ~plausible_time(x["clientObservedAt"], received), "clientObservedAt: is not a plausible timestamp"))
        wrong.append(F.when(x["has_one"] & x["one"].isNull(), "observedFlagshipId: must be a positive integer"))
        wrong.append(F.when(x["has_many"] & (x["many"].isNull() | F.exists(x["many"], lambda i: i.isNull())), "observedFlagshipIds: must be positive integers"))
        wrong += [F.when(detail, levels("detail")), F.when(execution, levels("execution"))]
        wrong.append(F.when(execution & ~x["upgradeObserved"], "upgradeObserved: must be true"))
        for name, items, has in (("reqSlotItems", slots, "has_slots"), ("reqUseItems", uses, "has_uses")):
            used = detail | ((x["source"] == "list") & x[has])
            problem = F.when(items["at"] < 0, f"{name}: must be a list").otherwise(
                F.concat(F.lit(f"{name}."), items["at"].cast("string"), F.when(items["wrong_type"], ": must have whole id and count").otherwise(": must contain positive id and count"))
            )
            wrong.append(F.when(used & items["at"].isNotNull(), problem))
        wrong.append(F.when(detail & x["changeFlag"].isNull(), "changeFlag: must be an integer"))
        wrong = F.coalesce(*wrong, day_problem(x["day"], x["clientObservedAt"], received))
        return F.struct(
            wrong.alias("problem"), x["source"].alias("source"), x["schemaVersion"].alias("schema_version"), x["clientObservedAt"].alias("client_observed_at"),
            x["recipeId"].alias("recipe_id"), x["itemId"].alias("item_id"), x["day"].alias("day"), x["observedSecondShipId"].alias("observed_second_ship_id"),
            flagship_ids(x["one"], x["many"]).alias("observed_flagship_ids"),
            *[x[n].alias("".join(f"_{c.lower()}" if c.isupper() else c for c in n)) for n in (LEVELS["detail"] | LEVELS["execution"])],
            slots["items"].alias("req_slot_items"), uses["items"].alias("req_use_items"), x["changeFlag"].alias("change_flag"),
            x["upgradeObserved"].alias("upgrade_observed"),
        )

    def with_items(x):
        items = F.struct(required_items(x["slots"]).alias("slots"), required_items(x["uses"]).alias("uses"))
        return casting.let(items, lambda y: judged(x, y["slots"], y["uses"]))

    return casting.let(fields, with_items)


SHARED = ["key", "source", "schema_version", "client_observed_at", "recipe_id", "item_id", "day", "observed_second_ship_id", "observed_flagship_ids"]
MATERIALS = ["fuel", "ammo", "steel", "bauxite", "buildkit", "remodelkit", "certain_buildkit", "certain_remodelkit"]


def valid_records(
    df: DataFrame, v: str = "v", received_ms: str = "received_ms", x_reporter: str = "x_reporter", max_batch: int = MAX_BATCH, keep: tuple[str, ...] = ("id", "ingested_at"),
    once: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(a row for each record of all routes, rejected). A report has a list ``records`` or is one
    record itself; its place in the report is ``position``. once: see normalize.stored()."""
    from .normalize import computed, stored

    def judged_batch(batch):
        shape = F.when(batch.isNull(), "records: must be a list").when(F.size(batch) > max_batch, f"records: must have at most {max_batch} elements")
        parsed = F.when(shape.isNull(), F.transform(batch, lambda r: record_of(r, F.col(received_ms))))

        def whole(records):
            bad = F.get(F.filter(F.transform(records, lambda r, k: F.struct(r["problem"].alias("p"), k.alias("k"))), lambda b: b["p"].isNotNull()), F.lit(0))
            return F.struct(F.coalesce(shape, bad["p"]).alias("_message"), records.alias("_records"))

        return casting.let(parsed, whole)

    listed = casting.let(
        casting.get(F.col(v), "variant", "$.records"), lambda r: F.when(r.isNull(), F.array(F.col(v))).otherwise(casting.get(r, "array<variant>"))
    )
    judged = computed(df, casting.let(listed, judged_batch), "_message", "_records")
    if once:
        judged = stored(judged.select(*dict.fromkeys([*keep, received_ms, x_reporter]), "_message", "_records"))
    rejected = judged.where("_message IS NOT NULL").select(*keep, F.col("_message").alias("message"))
    good = judged.where("_message IS NULL").select(*keep, received_ms, keys.reporter_origin(F.col(x_reporter)).alias("origin"), F.posexplode("_records").alias("position", "r"))
    return good.select(*keep, F.col(received_ms).alias("reported_at"), "origin", "position", "r.*").drop("problem"), rejected


def routed(records: DataFrame, keep: tuple[str, ...] = ("id", "ingested_at")) -> list[DataFrame]:
    """Valid records as (listed, detailed, executed), each with its key and its columns."""
    recipe, item, day, second, level = (F.col(c) for c in ("recipe_id", "item_id", "day", "observed_second_ship_id", "item_level"))
    key = {
        "list": keys.availability_key(recipe, item, day, second),
        "detail": keys.cost_key(recipe, item, level, F.col("stage"), day, second, [F.col(c) for c in MATERIALS], F.col("req_slot_items"), F.col("req_use_items"), F.col("change_flag")),
        "execution": keys.update_key(recipe, item, level, day, second, F.col("upgrade_to_item_id"), F.col("upgrade_to_item_level")),
    }
    more = {
        "list": [],
        "detail": ["item_level", "stage", *MATERIALS, "req_slot_items", "req_use_items", "change_flag"],
        "execution": ["item_level", "upgrade_to_item_id", "upgrade_to_item_level", "upgrade_observed"],
    }
    common = [*keep, "position", "reported_at", "origin"]
    return [records.where(F.col("source") == s).withColumn("key", key[s]).select(*common, *SHARED, *more[s]) for s in ("list", "detail", "execution")]


def improvement_records(
    df: DataFrame, v: str = "v", received_ms: str = "received_ms", x_reporter: str = "x_reporter", max_batch: int = MAX_BATCH, keep: tuple[str, ...] = ("id", "ingested_at")
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(listed, detailed, executed, rejected)."""
    records, rejected = valid_records(df, v, received_ms, x_reporter, max_batch, keep, once=True)
    return (*routed(records, keep), rejected)


def record_list(
    df: DataFrame, schema: dict, v: str = "v", name: str = "quests", keep: tuple[str, ...] = ("id", "ingested_at"), data: str = "data", report: str = "",
    once: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """A report with a list of objects, all valid or none taken: (accepted rows with position, rejected).

    The list is judged as a whole before it is exploded, without a shuffle. Paths begin with ``name.position``. once:
    see normalize.stored()."""
    from .normalize import computed, has_infinite, judged_object, message_of, stored

    def judged(e, k, infinite):
        path = F.concat(F.lit(f"{name}."), k.cast("string"))

        def with_message(r):
            shape = F.when(casting.type_of(e) == "object", F.lit(None).cast("string")).otherwise(F.concat(path, F.lit(": expected object")))
            return F.struct(F.coalesce(shape, message_of(r["issues"])).alias("message"), r["_values"].alias("values"))

        return casting.let(judged_object(e, schema, infinite, path), with_message)

    def whole(each):
        bad = F.get(F.filter(F.transform(each, lambda x: x["message"]), lambda m: m.isNotNull()), F.lit(0))
        wrong = F.when(casting.type_of(casting.get(F.col(v), "variant", f"$.{name}")).eqNullSafe("array"), bad).otherwise(f"{name}: expected array")
        return F.struct(wrong.alias("_message"), each.alias("_list"))

    listed = F.transform(casting.get(F.col(v), "array<variant>", f"$.{name}"), casting.json_null)
    infinite = F.coalesce(has_infinite(F.col(data)), F.lit(False))
    out = computed(df, casting.let(F.transform(listed, lambda e, k: judged(e, k, infinite)), whole), "_message", "_list")
    if once:
        out = stored(out.select(*keep, "_message", "_list"))
    rejected = out.where("_message IS NOT NULL").select(*keep, F.col("_message").alias("message"))
    each = out.where("_message IS NULL").select(*keep, F.posexplode("_list").alias("position", "_r"))
    return each.select(*keep, "position", *[F.col(f"_r.values.value_{k}").alias(column_of(f, report)) for k, f in enumerate(schema)]), rejected
