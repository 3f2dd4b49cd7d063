"""Folds against applying reports one by one, and against folding in two batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidefold.functions import keys
from tidefold.operators import exports, folds

SCHEMA = "id long, at timestamp, key string, f int, has_f boolean, low int, high int, has_high boolean, xs array<int>"
ORDER = ["at", "id"]


def reports(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        has_f, has_high = rng.random() < 0.6, rng.random() < 0.7
        f = rng.choice([None, 1, 2, 3]) if has_f else None
        high = rng.choice([None, 5, 6, 7, 8]) if has_high else None
        xs = [rng.choice([1, 2, 3, 4, None]) for _ in range(rng.randint(0, 3))]
        rows.append((k, datetime(2024, 1, 1) + timedelta(seconds=rng.randint(0, 40)), rng.choice(["a", "b", "c", None]), f, has_f, rng.choice([None, 1, 4, 9]), high, has_high, xs))
    rng.shuffle(rows)
    return rows


def one_by_one(rows):
    state = {}
    for k, at, key, f, has_f, low, high, has_high, xs in sorted(rows, key=lambda r: (r[1], r[0])):
        s = state.setdefault(key, {"f": None, "low": None, "high": None, "count": 0, "xs": [], "first": k})
        s["count"] += 1
        s["last"] = k
        if has_f:
            s["f"] = f
        if low is not None:
            s["low"] = low if s["low"] is None else max(s["low"], low)
        if has_high:
            s["high"] = None if high is None else high if s["high"] is None else min(s["high"], high)
        s["xs"] += [x for x in dict.fromkeys(xs) if x is not None and x not in s["xs"]]
    return state


def folded(df):
    patch = folds.patch_state(df, ["key"], ["f"], ORDER, {"f": "has_f"}, "id")
    ranged = folds.range_state(df, ["key"], "low", "high", "has_high", ORDER)
    union = folds.ordered_set_union(df, ["key"], "xs", ORDER)
    return patch, ranged, union


def check(state, patch, ranged, union):
    assert {r["key"]: (r.f, r["count"]) for r in patch.collect()} == {k: (s["f"], s["count"]) for k, s in state.items()}
    assert {r["key"]: (r.low, r.high) for r in ranged.collect()} == {k: (s["low"], s["high"]) for k, s in state.items()}
    assert {r["key"]: r.xs for r in union.collect()} == {k: s["xs"] for k, s in state.items() if s["xs"]}


@pytest.mark.parametrize("seed", [1, 2])
def test_folds_equal_one_by_one_whole_and_in_batches(spark, seed):
    rows = reports(seed)
    state, df = one_by_one(rows), spark.createDataFrame(rows, SCHEMA)
    check(state, *folded(df))
    cut = datetime(2024, 1, 1, 0, 0, 17)
    (p1, r1, u1), (p2, r2, u2) = folded(df.where(F.col("at") < cut)), folded(df.where(F.col("at") >= cut))
    check(
        state,
        folds.merge_state(p1, p2, ["key"], {"f": "patch", "has_f": "any", "last_reported": "max", "count": "sum"}),
        folds.merge_state(r1, r2, ["key"], {"low": "max", "high": "reset", "has_null": "any", "count": "sum"}),
        folds.merge_state(u1, u2, ["key"], {"xs": "union"}),
    )
    latest = folds.latest_state(df, ["key"], ["id", "f"], ORDER)
    assert {r["key"]: r.id for r in latest.collect()} == {k: s["last"] for k, s in state.items()}
    first = folds.first_definition(df, ["key"], ["id"], ORDER)
    assert {r["key"]: r.id for r in first.collect()} == {k: s["first"] for k, s in state.items()}


def test_golden_bombers_and_definitions(spark):
    rows = [("k", 1, None, None, False), ("k", 2, 5, 10, True), ("k", 3, None, None, True), ("m", 1, 5, 10, True), ("m", 2, 7, 8, True)]
    df = spark.createDataFrame(rows, "key string, id int, low int, high int, has boolean")
    out = {r["key"]: (r.low, r.high, r["count"]) for r in folds.range_state(df, ["key"], "low", "high", "has", ["id"]).collect()}
    assert out == {"k": (5, None, 3), "m": (7, 8, 2)}
    texts = spark.createDataFrame([("Test quest", "Test details"), ("Reward quest", "Reward details")], "t string, d string")
    got = [r[0] for r in texts.select(keys.definition_key(F.col("t"), F.col("d"))).collect()]
    assert got == ["8b6799d18daec4c67b34b883f9cfc2d0", "12bd88872bd8320b5900b36276e8050e"]
    same, other = folds.collisions(spark.createDataFrame([(1, "h", "ab", "c"), (2, "h", "a", "bc"), (3, "h", "ab", "c")], "id int, key string, t string, d string"), ["key"], ["t", "d"], ["id"])
    assert sorted(r.id for r in same.collect()) == [1, 3] and [r.id for r in other.collect()] == [2]


def test_dedupe(spark):
    df = spark.createDataFrame([(1, "duplicate"), (2, "duplicate"), (3, None), (4, None)], "id int, key string")
    kept, deleted = folds.dedupe_by_key(df, "key", "id")
    assert sorted(r.id for r in kept.collect()) == [1, 3, 4] and [r.id for r in deleted.collect()] == [2]


def test_pages_of_ties_and_cursors(spark):
    df = exports.assign_export_ids(spark.createDataFrame([(k, 1000) for k in range(3)], "k int, last_reported long"), ["k"])
    page = lambda *a: [r.export_id for r in exports.export_page(df, 100_000, *a, limit=2).collect()]
    ids = [f"{k:024x}" for k in (1, 2, 3)]
    assert page() == ids[:2] and page(1000, ids[1]) == ids[2:] and page(1000, ids[2]) == []
    assert exports.next_cursor(exports.export_page(df, 100_000, 1000, ids[2])).count() == 0
    assert exports.export_page(df, 30_999).count() == 0 and exports.export_page(df, 31_000).count() == 3
    assert exports.export_page(df.unionAll(df), 100_000, limit=5000).count() == 6
    with pytest.raises(ValueError):
        exports.export_page(df, 1, limit=0)
    walk = exports.export_pages(df, 100_000, 2).orderBy("page", "position").collect()
    assert [(r.page, r.position, r.export_id) for r in walk] == [(0, 0, ids[0]), (0, 1, ids[1]), (1, 0, ids[2])]
    cursors = {"abcdefghijkl": "6162636465666768696a6b6c", "ABCDEF0123456789abcdef01": "abcdef0123456789abcdef01", "äbcdefghijkl": "e462636465666768696a6b6c", "あbcdefghijkl": None, "abc": None}
    got = spark.createDataFrame([(c,) for c in cursors], "c string").select("c", keys.canonical_cursor(F.col("c")).alias("k")).collect()
    assert {r.c: r.k for r in got} == cursors


def test_known_ids_and_reconcile(spark):
    df = spark.createDataFrame([(2,), (10,), (1,), (2,)], "q int")
    assert [r.q for r in exports.known_ids(df, "q").collect()] == [1, 10, 2]
    assert sorted(r.prefix for r in exports.known_prefixes(spark.createDataFrame([("abcdefgh1",), ("abcdefgh2",)], "k string"), "k").collect()) == ["abcdefgh"] * 2
    cols = "dataset string, object_key string, row_count long, bytes long, sha256 string"
    one = spark.createDataFrame([("a", "k", 1, 2, "s"), ("b", "k", 1, 2, "s")], cols)
    two = spark.createDataFrame([("a", "k", 1, 3, "s"), ("c", "k", 1, 2, "s"), ("c", "k", 1, 2, "s")], cols)
    assert exports.reconcile(one, one).count() == 0
    assert sorted(tuple(r) for r in exports.reconcile(one, two).distinct().collect()) == [("a", "bytes differs"), ("b", "missing file"), ("c", "duplicate in files"), ("c", "not in manifest")]
