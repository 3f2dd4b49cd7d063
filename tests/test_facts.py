import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidefold.operators import folds
from tidefold.operators.ingest import FACTS
from tidefold.sources import facts
from tidefold.storage import new_folder
from tidefold.streaming import reports

SCHEMA = "id long, ingested_at timestamp, kind string, data string, x_reporter string, user_agent string"
AT = 1_762_920_000_000  # 2025-11-12T04:00Z, a Wednesday in Japan
BASE = {"schemaVersion": 1, "clientObservedAt": AT, "itemId": 412, "day": 3, "observedSecondShipId": 0}
MORE = {
    "list": {},
    "detail": {"itemLevel": 9, "stage": 2, "fuel": 1, "ammo": 1, "steel": 1, "bauxite": 0, "buildkit": 1, "remodelkit": 1, "certainBuildkit": 1, "certainRemodelkit": 1,
               "reqSlotItems": [], "reqUseItems": []},
    "execution": {"itemLevel": 10, "upgradeObserved": True, "upgradeToItemId": 933, "upgradeToItemLevel": 4},
}


def rows(*records, first=0):
    """(source, recipe, flagship) of each record, one report a second."""
    at = datetime(2025, 11, 12, 4, 0, 1)
    body = lambda s, r, f: json.dumps(BASE | MORE[s] | {"source": s, "recipeId": r, "observedFlagshipId": f})
    return [(first + k, at + timedelta(seconds=first + k), "item_improvement", body(*r), None, "agent") for k, r in enumerate(records)]


def envelopes(spark, *records, first=0):
    folder = new_folder(spark, "envelopes")
    spark.createDataFrame(rows(*records, first=first), SCHEMA).coalesce(1).write.parquet(folder)
    return spark.read.schema(SCHEMA).parquet(folder)


def stored(spark, root):
    out = {}
    for table in FACTS:
        df = facts.read_facts(spark, root, table)
        for r in df.collect() if df is not None else []:
            assert r.export_id == f"{r.id:024x}"
            out[r.key.split("|")[1][0], r.recipe_id] = r.id, r["count"], r.observed_flagship_ids
    return out


FIRST = ("execution", 1, 7), ("list", 1, 9), ("list", 2, 3), ("list", 1, 4), ("detail", 1, 5)
SECOND = ("detail", 1, 6), ("list", 3, 1), ("list", 2, 3), ("execution", 2, 2), ("list", 1, 2), ("list", 1, 9)
BOTH = {("u", 1): (1, 1, [7]), ("a", 1): (2, 4, [9, 4, 2]), ("a", 2): (3, 2, [3]), ("c", 1): (4, 2, [5, 6]), ("a", 3): (5, 1, [1]), ("u", 2): (6, 1, [2])}


def test_ids_live_on_over_batches_replays_and_merges(spark):
    root = new_folder(spark, "facts")
    assert stored(spark, root) == {}
    assert facts.apply_facts(envelopes(spark, *FIRST), 0, root) == 1
    before = stored(spark, root)
    assert before == {("u", 1): (1, 1, [7]), ("a", 1): (2, 2, [9, 4]), ("a", 2): (3, 1, [3]), ("c", 1): (4, 1, [5])}
    assert facts.apply_facts(envelopes(spark, *FIRST), 0, root) is None and stored(spark, root) == before
    assert facts.apply_facts(envelopes(spark, *SECOND, first=50), 1, root) == 2
    assert stored(spark, root) == BOTH
    assert facts.apply_facts(envelopes(spark), 2, root) == 3 and stored(spark, root) == BOTH
    for table in FACTS:
        assert facts.compact(spark, root, table) is not None and facts.compact(spark, root, table) is None
    assert stored(spark, root) == BOTH and all(len(f) == 1 for f in facts.latest(spark, root).layers.values())
    assert facts.vacuum(spark, root) == 0
    assert facts.vacuum(spark, root, timedelta(0), datetime.now(timezone.utc) + timedelta(hours=1)) == 6
    assert stored(spark, root) == BOTH
    facts.apply_facts(envelopes(spark, ("list", 4, 1), first=90), 7, root, max_layers=1)
    assert stored(spark, root) == BOTH | {("a", 4): (7, 1, [1])} and len(facts.latest(spark, root).layers[FACTS[0]]) == 1


def test_a_broken_off_batch_counts_for_nothing_and_is_numbered_again(spark, monkeypatch):
    root = new_folder(spark, "facts")
    facts.apply_facts(envelopes(spark, *FIRST), 0, root)
    before = stored(spark, root)
    with monkeypatch.context() as m:
        m.setattr(facts, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            facts.apply_facts(envelopes(spark, *SECOND, first=50), 1, root)
    assert stored(spark, root) == before
    facts.apply_facts(envelopes(spark, *SECOND, first=50), 1, root)
    assert stored(spark, root) == BOTH


def test_two_writers_never_share_a_number(spark, monkeypatch):
    """The other writer's version comes between drawing and committing: all is drawn again."""
    root, commit = new_folder(spark, "facts"), facts._commit

    def slow(*args):
        monkeypatch.setattr(facts, "_commit", commit)
        facts.apply_facts(envelopes(spark, ("list", 1, 9), ("list", 8, 8)), 0, root, writer="other")
        return commit(*args)

    monkeypatch.setattr(facts, "_commit", slow)
    facts.apply_facts(envelopes(spark, *FIRST, first=50), 0, root, writer="slow")
    got = stored(spark, root)
    assert {k: v[0] for k, v in got.items()} == {("a", 1): 1, ("a", 8): 2, ("u", 1): 3, ("a", 2): 4, ("c", 1): 5}
    assert got["a", 1] == (1, 3, [9, 4])


def test_a_batch_writes_its_own_rows_only(spark):
    """A small batch on a store of 3000 facts adds a layer of its own size; stored files are as they were."""
    root = new_folder(spark, "facts")
    facts.apply_facts(envelopes(spark, *[("list", r, 1) for r in range(1, 3001)]), 0, root)
    facts.apply_facts(envelopes(spark, ("list", 5, 2), ("list", 9999, 2), first=5000), 1, root)
    first, second = facts.latest(spark, root).layers[FACTS[0]]
    assert spark.read.parquet(f"{root}/_data/{first}").count() == 3000 and spark.read.parquet(f"{root}/_data/{second}").count() == 2
    got = stored(spark, root)
    assert len(got) == 3001 and got["a", 5] == (5, 2, [1, 2]) and got["a", 9999] == (3001, 1, [2])


def test_stream_restarts_add_nothing(spark, tmp_path):
    root = f"{tmp_path}/facts"
    for k, part in enumerate((FIRST, SECOND)):
        spark.createDataFrame(rows(*part, first=50 * k), SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        for _ in range(2):
            stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
            reports.stream_facts(stream, root, f"{tmp_path}/checkpoint").awaitTermination()
    assert stored(spark, root) == BOTH


def test_layers_merge_as_states_do(spark):
    """One pass over many layers gives what merging one after another gives, for every rule that layers have."""
    spec = {"v_last": "last", "v_first": "first", "n": "sum", "lo": "min", "hi": "max", "s": "union", "p": "patch", "has_p": "any"}
    schema = "k long, v_last string, v_first string, n long, lo long, hi long, s array<long>, p string, has_p boolean, layer int"
    data = [(k, f"l{k}{i}" if i % 3 else None, f"f{i}" if i else None, i, i * 7 % 5, i * 3 % 5, [i % 3, k + 3], f"p{i}" if i % 2 else None, (i + k) % 3 == 0, i)
            for i in range(5) for k in range(4) if (i * k) % 4 != 3]
    df = spark.createDataFrame(data, schema)
    want = df.where("layer = 0").drop("layer")
    for i in range(1, 5):
        want = folds.merge_state(want, df.where(F.col("layer") == i).drop("layer"), ["k"], spec)
    lines = lambda d: sorted(str(r) for r in d.select("k", *spec).collect())
    patched = lambda d: d.withColumn("p", F.when(F.col("has_p"), F.col("p")))
    assert lines(patched(folds.merge_layers(df, ["k"], spec, "layer"))) == lines(patched(want))
    with pytest.raises(ValueError, match="reset"):
        folds.merge_layers(df, ["k"], {"n": "reset"}, "layer")
