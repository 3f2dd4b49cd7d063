"""Keyed folds: what repeated reports of one identity leave behind.

Order is a list of columns, ``(ingested_at, id)`` for reports; it must be unique within a key. Folds are built from
aggregates that combine before the shuffle, so a key with very many reports costs each task one row. Three also join
their rows with one row a key: range_state (only keys that a null resets), collisions and dedupe_by_key. There a key
with very many rows is split by Spark's adaptive skew join, which duplicates the one row. Folds of two batches are
merged with merge_state; what a merge needs to know of a batch is part of its fold (``has_`` columns).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _order(order: list[str]) -> Column:
    return F.struct(*order)


def latest_state(df: DataFrame, keys: list[str], values: list[str], order: list[str]) -> DataFrame:
    """Per key the last report's values, nulls included."""
    last = F.max_by(F.struct(*values), _order(order)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{v}").alias(v) for v in values])


def patch_state(
    df: DataFrame, keys: list[str], fields: list[str], order: list[str], present: dict[str, str], time: str
) -> DataFrame:
    """Per key each field as of the last report in which it was present; has_<field> if there was one."""
    ord_ = _order(order)
    aggs = []
    for f in fields:
        here = F.col(present[f])
        aggs += [F.max_by(F.col(f), F.when(here, ord_)).alias(f), F.coalesce(F.max(here), F.lit(False)).alias(f"has_{f}")]
    last = F.max_by(F.col(time), ord_).alias("last_reported")
    return df.groupBy(*keys).agg(*aggs, last, F.count("*").alias("count"))


def count_state(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Reports per key, and the last time."""
    return df.groupBy(*keys).agg(F.count("*").alias("count"), F.max(time).alias("last_timestamp"))


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(Column.__and__, [left[k].eqNullSafe(right[k]) for k in keys])


def range_state(
    df: DataFrame, keys: list[str], low: str, high: str, has_high: str, order: list[str], carry: tuple[str, ...] = ()
) -> DataFrame:
    """U4: count, the largest low, and the least high since the last explicit null of high; has_null tells a merge
    that older values are void. carry: columns that are the same in all reports of a key.

    The fold depends on the order, but splits into two aggregates: the place of the last null, then the values after
    it."""
    ord_ = _order(order)
    null = F.col(has_high) & F.col(high).isNull()
    resets = df.groupBy(*keys).agg(F.max(F.when(null, ord_)).alias("_reset"))
    resets = resets.where(F.col("_reset").isNotNull()).select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], "_reset")
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)])
    after = F.col("_reset").isNull() | (ord_ > F.col("_reset"))
    return (
        df.join(resets, on, "left")
        .groupBy(*keys)
        .agg(
            F.max(low).alias(low),
            F.min(F.when(F.col(has_high) & after, F.col(high))).alias(high),
            F.coalesce(F.max(null), F.lit(False)).alias("has_null"),
            F.count("*").alias("count"),
            *([F.min_by(F.struct(*carry), ord_).alias("_first")] if carry else []),
        )
        .select(*keys, low, high, "has_null", "count", *[F.col(f"_first.{c}").alias(c) for c in carry])
    )


def collisions(df: DataFrame, keys: list[str], components: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that agree with the first row of their key in the components, rows that do not)."""
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*components), _order(order)).alias("_first"))
    first = first.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], "_first")
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)])
    judged = df.join(first, on).withColumn("_same", F.struct(*components).eqNullSafe(F.col("_first")))
    drop = ["_first", "_same", *[f"_{i}" for i in range(len(keys))]]
    return judged.where("_same").drop(*drop), judged.where("NOT _same").drop(*drop)


def first_definition(df: DataFrame, keys: list[str], values: list[str], order: list[str]) -> DataFrame:
    """Per key the first report's values. Keys may be arrays."""
    first = F.min_by(F.struct(*values), _order(order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_first.{v}").alias(v) for v in values])


def ordered_set_union(df: DataFrame, keys: list[str], array: str, order: list[str]) -> DataFrame:
    """Per key the distinct elements of the array column, in the order of their first appearance.

    Elements are reduced to their first appearance before they are gathered, so a list is as long as the set. Null
    elements do not count."""
    each = df.select(*keys, _order(order).alias("_o"), F.posexplode(array).alias("_p", "_e")).where("_e IS NOT NULL")
    first = each.groupBy(*keys, "_e").agg(F.min(F.struct("_o", "_p")).alias("_at"))
    gathered = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_e"))).alias("_all"))
    return gathered.select(*keys, F.transform("_all", lambda x: x["_e"]).alias(array))


def ordered_set_unions(df: DataFrame, keys: list[str], arrays: list[str], order: list[str]) -> DataFrame:
    """U9 for several array columns, in one pass over the rows; empty where a key has no element of a column."""
    types = [df.schema[a].dataType.elementType for a in arrays]

    def numbered(k, a):
        def element(x, p):
            return F.struct(F.lit(k).alias("s"), p.alias("p"), *[(x if i == k else F.lit(None)).cast(t).alias(f"e{i}") for i, t in enumerate(types)])

        return F.coalesce(F.transform(a, element), F.array())

    there = [numbered(k, a) for k, a in enumerate(arrays)]
    each = df.select(*keys, _order(order).alias("_o"), F.explode(F.concat(*there)).alias("_x")).select(*keys, "_o", "_x.*")
    elements = [f"e{i}" for i in range(len(arrays))]
    each = each.where(reduce(Column.__or__, [F.col(e).isNotNull() for e in elements]))
    first = each.groupBy(*keys, "s", *elements).agg(F.min(F.struct("_o", "p")).alias("_at"))
    gathered = first.groupBy(*keys).agg(*[F.collect_list(F.when(F.col("s") == i, F.struct("_at", e))).alias(e) for i, e in enumerate(elements)])
    return gathered.select(*keys, *[F.sort_array(e)[e].alias(a) for e, a in zip(elements, arrays)])


def accumulate_facts(
    df: DataFrame, keys: list[str], stable: list[str], observed_at: str, reported_at: str, sets: list[str], order: list[str],
    born: str | None = None,
) -> DataFrame:
    """U8: per key the first report's stable fields, bounds of the observation time, first and last report, count, and
    the ordered unions of the array columns in sets. born: name of a column for the first report's place, if wanted."""
    ord_ = _order(order)
    first = F.struct(*[F.col(c).alias(f"_{k}") for k, c in enumerate([*stable, reported_at])])
    facts = df.groupBy(*keys).agg(
        F.min_by(first, ord_).alias("_first"),
        F.min(observed_at).alias("first_client_observed_at"),
        F.max(observed_at).alias("last_client_observed_at"),
        F.max(reported_at).alias("last_reported"),
        F.count("*").alias("count"),
        *([F.min(ord_).alias(born)] if born else []),
    )
    facts = facts.select(
        *keys, *[F.col(f"_first._{k}").alias(c) for k, c in enumerate(stable)], "first_client_observed_at", "last_client_observed_at",
        F.col(f"_first._{len(stable)}").alias("first_reported"), "last_reported", "count", *([born] if born else []),
    )
    if not sets:
        return facts
    unions = ordered_set_unions(df, keys, sets, order).select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], *sets)
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)])
    empty = {name: F.array().cast(df.schema[name].dataType) for name in sets}
    return facts.join(unions, on, "left").withColumns({name: F.coalesce(name, empty[name]) for name in sets}).drop(*[f"_{i}" for i in range(len(keys))])


#: What merge_state can do with a column of the old state and of the batch's fold.
RULES = ("last", "first", "sum", "min", "max", "union")


def merge_state(old: DataFrame, batch: DataFrame, keys: list[str], spec: dict[str, str]) -> DataFrame:
    """The batch's fold on top of the stored rows.

    spec: column -> last (the batch's value if it has the key), first, sum, min, max, union (ordered, of arrays),
    patch (the batch's value if its has_<column> is true), reset (the least of both, of the batch alone if its has_null
    is true). has_ columns of both sides are kept as "any of both"."""
    left, right = old.alias("o"), batch.alias("b")
    on = reduce(Column.__and__, [F.col(f"o.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    left = left.withColumn("_in_old", F.lit(True))
    right = right.withColumn("_in_batch", F.lit(True))
    joined = left.alias("o").join(right.alias("b"), on, "full_outer")
    known, new = F.col("o._in_old").isNotNull(), F.col("b._in_batch").isNotNull()
    out = [F.when(known, F.col(f"o.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in keys]
    for name, rule in spec.items():
        o, b = F.col(f"o.{name}"), F.col(f"b.{name}")
        value = {
            "last": lambda: F.when(new, b).otherwise(o),
            "first": lambda: F.when(known, o).otherwise(b),
            "sum": lambda: F.coalesce(o, F.lit(0)) + F.coalesce(b, F.lit(0)),
            "min": lambda: F.least(o, b),
            "max": lambda: F.greatest(o, b),
            "union": lambda: F.when(known & new, F.concat(o, F.array_except(b, o))).when(known, o).otherwise(b),
            "patch": lambda: F.when(F.col(f"b.has_{name}"), b).otherwise(o),
            "reset": lambda: F.when(F.col("b.has_null"), b).otherwise(F.least(o, b)),
            "any": lambda: F.coalesce(o, F.lit(False)) | F.coalesce(b, F.lit(False)),
        }[rule]()
        out.append(value.alias(name))
    return joined.select(*out)


def merge_layers(df: DataFrame, keys: list[str], spec: dict[str, str], layer: str) -> DataFrame:
    """U10 for many folds at once: rows of several batches' folds, numbered by layer, to one row a key.

    Rules as in merge_state but for reset, which needs the layers one after another. A key has at most a row a layer, so
    the lists of a union are bounded by the number of layers."""

    def union(name: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct(F.col(layer), F.col(name))))
        return F.array_distinct(F.flatten(F.filter(F.transform(ordered, lambda x: x[name]), lambda a: a.isNotNull())))

    make = {
        "last": lambda c: F.max_by(c, layer), "first": lambda c: F.min_by(c, layer), "sum": F.sum, "min": F.min, "max": F.max, "union": union,
        "patch": lambda c: F.max_by(c, F.when(F.col(f"has_{c}"), F.col(layer))), "any": lambda c: F.coalesce(F.max(c), F.lit(False)),
    }
    if unknown := set(spec.values()) - set(make):
        raise ValueError(f"no rule for layers: {sorted(unknown)}")
    return df.groupBy(*keys).agg(*[make[rule](c).alias(c) for c, rule in spec.items()])


def dedupe_by_key(df: DataFrame, key: str, id: str) -> tuple[DataFrame, DataFrame]:
    """Of rows that share a key that is not null, the one with the smallest id stays: (kept, deleted)."""
    keyed = df.where(F.col(key).isNotNull())
    first = keyed.groupBy(F.col(key).alias("_key")).agg(F.min(id).alias("_first"))
    joined = keyed.join(first, F.col(key) == F.col("_key"))
    kept = joined.where(F.col(id).eqNullSafe(F.col("_first"))).drop("_key", "_first").unionByName(df.where(F.col(key).isNull()))
    return kept, joined.where(~F.col(id).eqNullSafe(F.col("_first"))).drop("_key", "_first")
