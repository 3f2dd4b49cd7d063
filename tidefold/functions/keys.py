"""Identity keys, cursors and canonical texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _texts(*cols: Column) -> list[Column]:
    return [c.cast("string") for c in cols]


def availability_key(recipe: Column, item: Column, day: Column, second_ship: Column) -> Column:
    """K1"""
    return F.concat_ws("|", F.lit("v1"), F.lit("availability"), *_texts(recipe, item, day, second_ship))


def items_text(items: Column) -> Column:
    """id:count,... of an array of (id, count), or - if it is empty."""
    text = F.array_join(F.transform(items, lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["count"].cast("string"))), ",")
    return F.when(F.size(items) > 0, text).otherwise("-")


def cost_key(recipe, item, level, stage, day, second_ship, materials, slot_items, use_items, change_flag) -> Column:
    """K2; materials: fuel, ammo, steel, bauxite, buildkit, remodelkit, certain buildkit, certain remodelkit."""
    numbers = _texts(recipe, item, level, stage, day, second_ship, *materials)
    return F.concat_ws("|", F.lit("v1"), F.lit("cost"), *numbers, items_text(slot_items), items_text(use_items), change_flag.cast("string"))


def update_key(recipe, item, level, day, second_ship, to_item, to_level) -> Column:
    """K3"""
    return F.concat_ws("|", F.lit("v1"), F.lit("update"), *_texts(recipe, item, level, day, second_ship, to_item, to_level))


def definition_key(title: Column, detail: Column) -> Column:
    """K4: MD5 of the two texts, one after the other."""
    return F.md5(F.concat(title, detail))


def json_array(value: Column) -> Column:
    return F.coalesce(F.to_json(value), F.lit("null"))


def identity_hash(*cols: Column, scalars: tuple[Column, ...] = ()) -> Column:
    """K5: SHA-256 of the compact JSON list of arrays, then scalars; order counts."""
    parts = [json_array(c) for c in cols] + [F.coalesce(c.cast("string"), F.lit("null")) for c in scalars]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256)


def export_id(number: Column) -> Column:
    """K6: 24 hexadecimal digits."""
    return F.lower(F.lpad(F.hex(number), 24, "0"))


def canonical_cursor(text: Column) -> Column:
    """K7: 24 hexadecimal digits in lower case; 12 characters up to U+00FF give their bytes; else null."""
    narrow = text.rlike(r"(?s)\A[\x00-\xff]{12}\z")
    return F.when(text.rlike(r"\A[0-9a-fA-F]{24}\z"), F.lower(text)).when(narrow, F.lower(F.hex(F.encode(F.when(narrow, text), "ISO-8859-1"))))


def quest_prefix(key: Column, n: int = 8) -> Column:
    """K8"""
    return F.substring(key, 1, n)


def canonical_json(text: Column) -> Column:
    """K9: keys sorted on every level as text, arrays as they are, compact; null for what is no JSON."""
    return F.to_json(F.try_parse_json(text))


def decimal_text(number: Column) -> Column:
    """A whole number that is not negative, without leading zeros; else null. Takes numbers and texts."""
    text = number.cast("string")
    return F.when(text.rlike(r"\A(0|[1-9][0-9]*)\z"), text)


def origin_of(origin: Column, x_reporter: Column, user_agent: Column) -> Column:
    """What the report says, even an empty text; else the first header that is not empty; else empty."""
    return F.coalesce(origin, F.nullif(x_reporter, F.lit("")), F.nullif(user_agent, F.lit("")), F.lit(""))


def reporter_origin(x_reporter: Column) -> Column:
    """The trimmed header if it looks like a reporter's name, else null."""
    name = F.trim(x_reporter)
    return F.when(name.rlike(r"\A[A-Za-z][A-Za-z0-9 _./+-]{0,79}\z"), name)


VERSION = r"\A\s*[v=]*\s*(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(?:-((?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*)(?:\.(?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*))*))?(?:\+[0-9A-Za-z.-]+)?\s*\z"


def semver(text: Column) -> Column:
    """(major, minor, patch, release) that orders as versions do up to prereleases among themselves, which are
    lower than their release; null if it is no semantic version, as are texts of over 256 characters and numbers that
    a script's whole numbers do not reach."""
    part = lambda k: F.regexp_extract(text, VERSION, k)
    number = lambda k: F.when(F.length(part(k)) <= 16, part(k).try_cast("long"))
    numbers = [number(k).alias(n) for k, n in ((1, "major"), (2, "minor"), (3, "patch"))]
    fits = F.lit(True)
    for k in (1, 2, 3):
        fits = fits & F.coalesce(number(k) <= 9_007_199_254_740_991, F.lit(False))
    return F.when((F.length(text) <= 256) & text.rlike(VERSION) & fits, F.struct(*numbers, F.when(part(4) == "", 1).otherwise(0).alias("release")))
