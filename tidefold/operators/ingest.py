"""From envelopes to tables: reports of all kinds are validated, observations appended, states folded and merged.

An envelope is (id, ingested_at, kind, data, x_reporter, user_agent); kind names a schema of ``REPORTS``, or is
``quest`` (a list) or ``item_improvement`` (a batch of records). Every job reads only its own kind, so envelopes that
are stored by kind are read once for each dataset that the kind fills. Envelopes of other kinds are nobody's.

Validation has no shuffle. Reports of states whose fold reads them several times are validated once and written. A state costs the shuffles of its fold, whose aggregates combine first, and one join with
the stored rows. A null kind, empty envelopes and batches without a kind leave the tables as they are."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import casting, keys
from ..schemas import OBSERVATIONS, REPORTS, column_of, observation_fields
from . import folds, improvement, normalize

ORDER = ["ingested_at", "id"]
KEEP = ("id", "ingested_at")
RECIPE_KEY = ["recipe_id", "item_id", "stage", "day", "secretary"]
SHIP_KEY = [column_of(f, "ship_stat") for f in REPORTS["ship_stat"]]
RECIPE_PATCH = [f for f in REPORTS["remodel_recipe"] if column_of(f) not in RECIPE_KEY]
ENEMY = [f for f in REPORTS["enemy_info"] if not f.startswith("bombers")]
#: Fields of a report whose absence differs from null.
PRESENCE = {"drop_ship": ("mapId",), "remodel_recipe": tuple(RECIPE_PATCH), "enemy_info": ("bombersMax",)}


def _rejections(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*KEEP, "message") for p in parts])


def valid_reports(df: DataFrame, kind: str, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """Reports of a kind with their columns, and the rejected with id, ingested_at and message. Origins are filled in,
    early snapshots emptied; reports that are accepted but not stored are in neither. once: see normalize.stored()."""
    parsed, broken = normalize.parse_reports(df.where(F.col("kind") == kind))
    taken, bad = normalize.normalize(parsed, REPORTS[kind], report=kind, presence=PRESENCE.get(kind, ()), once=once)
    # an absent origin is filled in before validation, so it is always present
    if "origin" in REPORTS[kind]:
        taken = normalize.with_origin(taken)
        if "origin" in PRESENCE.get(kind, ()):
            taken = taken.withColumn("has_origin", F.lit(True))
    if kind == "drop_ship":
        taken = normalize.clear_early_snapshot(taken)
    if kind == "remodel_recipe":
        taken = normalize.drop_noop_stage(taken)
    if kind == "aaci":
        taken, _, old = normalize.semver_gate(taken)
        bad = bad.select(*KEEP, "message").unionByName(old.select(*KEEP, F.lit("poiVersion: expected semantic version").alias("message")))
    return taken, _rejections(broken, bad)


def observations_of(df: DataFrame, dataset: str) -> tuple[DataFrame, DataFrame]:
    """(rows of an observation dataset, rejected); works on streams as well."""
    taken, rejected = valid_reports(df, OBSERVATIONS[dataset])
    return taken.select(*KEEP, *observation_fields(dataset)), rejected


def quest_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row for each quest of a list, with its key."""
    parsed, broken = normalize.parse_reports(df.where(F.col("kind") == "quest"))
    said = F.when(casting.type_of(casting.get(F.col("v"), "variant", "$.origin")) == "string", casting.get(F.col("v"), "string", "$.origin"))
    parsed = normalize.with_origin(parsed.withColumn("origin", said))
    taken, bad = improvement.record_list(parsed, REPORTS["quest"], keep=(*KEEP, "origin"), report="quest", once=True)
    return taken.withColumn("key", keys.definition_key(F.col("title"), F.col("detail"))), _rejections(broken, bad)


def reward_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    taken, rejected = valid_reports(df, "quest_reward", once=True)
    return taken.withColumn("key", keys.definition_key(F.col("title"), F.col("detail"))), rejected


def enemy_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    taken, rejected = valid_reports(df, "enemy_info", once=True)
    hashed = keys.identity_hash(*[F.col(column_of(f)) for f in ENEMY if f != "planes"], scalars=(F.col("planes"),))
    return taken.withColumn("identity_hash", hashed), rejected


def fact_records(df: DataFrame, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records of item improvement of all routes. once: see normalize.stored()."""
    parsed, broken = normalize.parse_reports(df.where(F.col("kind") == "item_improvement"))
    records, rejected = improvement.valid_records(parsed.withColumn("received_ms", F.unix_millis("ingested_at")), keep=KEEP, once=once)
    return records, _rejections(broken, rejected)


def routed_rows(records: DataFrame, route: int) -> DataFrame:
    """Records of one route (0 listed, 1 detailed, 2 executed), with their sets of one element."""
    rows = improvement.routed(records, KEEP)[route]
    return rows.withColumns({"sources": F.array("source"), "origins": F.array("origin")}).drop("source", "origin")


def fact_rows(df: DataFrame, route: int) -> tuple[DataFrame, DataFrame]:
    records, rejected = fact_records(df, once=True)
    return routed_rows(records, route), rejected


def separated(rows: DataFrame, key: list[str], components: list[str], order: list[str], what: str) -> tuple[DataFrame, DataFrame]:
    """Rows that agree with the first of their key, and the others as rejections."""
    same, other = folds.collisions(rows, key, components, order)
    return same, other.select(*KEEP, F.lit(f"{what} identity collision: retained components do not match").alias("message"))


@dataclass(frozen=True)
class State:
    """rows: envelopes to (rows, rejected); fold: rows to one row a key; spec: how a fold joins the stored rows."""

    keys: list[str]
    rows: Callable[[DataFrame], tuple[DataFrame, DataFrame]]
    fold: Callable[[DataFrame], DataFrame]
    spec: dict[str, str]
    components: tuple[str, ...] = ()
    order: tuple[str, ...] = tuple(ORDER)

    def judged(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows that the fold takes, rejected). Of a key whose components differ the first row's are kept."""
        rows, rejected = self.rows(df)
        if not self.components:
            return rows, rejected
        same, other = separated(rows, self.keys, list(self.components), list(self.order), self.keys[0])
        return same, rejected.unionByName(other)

    def folded(self, df: DataFrame) -> DataFrame:
        return self.fold(self.judged(df)[0])

    def merged(self, old: DataFrame, batch: DataFrame) -> DataFrame:
        return folds.merge_state(old, batch, self.keys, self.spec)


def _latest() -> State:
    key, values = ["teitoku_id", "maparea_id"], ["teitoku_lv", "rank", "origin"]
    return State(key, lambda df: valid_reports(df, "select_rank"), lambda r: folds.latest_state(r, key, values, ORDER), dict.fromkeys(values, "last"))


def _recipes() -> State:
    columns = [column_of(f) for f in RECIPE_PATCH]
    present = {c: f"has_{c}" for c in columns}

    def fold(rows):
        return folds.patch_state(rows.withColumn("at", F.unix_millis("ingested_at")), RECIPE_KEY, columns, ORDER, present, "at")

    spec = dict.fromkeys(columns, "patch") | dict.fromkeys(present.values(), "any") | {"count": "sum", "last_reported": "max"}
    return State(RECIPE_KEY, lambda df: valid_reports(df, "remodel_recipe"), fold, spec)


def _ships() -> State:
    def fold(rows):
        return folds.count_state(rows.withColumn("at", F.unix_millis("ingested_at")), SHIP_KEY, "at")

    return State(SHIP_KEY, lambda df: valid_reports(df, "ship_stat"), fold, {"count": "sum", "last_timestamp": "max"})


def _enemies() -> State:
    carry = tuple(column_of(f) for f in ENEMY)

    def fold(rows):
        return folds.range_state(rows, ["identity_hash"], "bombers_min", "bombers_max", "has_bombers_max", ORDER, carry)

    spec = dict.fromkeys(carry, "first") | {"bombers_min": "max", "bombers_max": "reset", "has_null": "any", "count": "sum"}
    return State(["identity_hash"], enemy_rows, fold, spec, carry)


def _definitions(key: list[str], rows, values: list[str], order: list[str]) -> State:
    return State(key, rows, lambda r: folds.first_definition(r, key, values, order), dict.fromkeys(values, "first"), ("title", "detail"), tuple(order))


def _facts(route: int, rows: Callable[[DataFrame], tuple[DataFrame, DataFrame | None]] | None = None, born: str | None = None) -> State:
    sets, order = ["sources", "origins", "observed_flagship_ids"], [*ORDER, "position"]
    bounds = {"first_client_observed_at": "min", "last_client_observed_at": "max", "first_reported": "first", "last_reported": "max", "count": "sum"}
    detail = ["item_level", "stage", *improvement.MATERIALS, "req_slot_items", "req_use_items", "change_flag"]
    more = ([], detail, ["item_level", "upgrade_to_item_id", "upgrade_to_item_level", "upgrade_observed"])[route]
    stable = ["schema_version", "recipe_id", "item_id", "day", "observed_second_ship_id", *more]

    def fold(rows):
        return folds.accumulate_facts(rows, ["key"], stable, "client_observed_at", "reported_at", sets, order, born)

    return State(["key"], rows or (lambda df: fact_rows(df, route)), fold, dict.fromkeys(stable, "first") | bounds | dict.fromkeys(sets, "union"), order=tuple(order))


STATE_JOBS = {
    "selectRankStates": _latest(),
    "recipeAggregates": _recipes(),
    "shipStatAggregates": _ships(),
    "enemyInfoAggregates": _enemies(),
    "questDefinitions": _definitions(["key", "quest_id", "category"], quest_rows, ["title", "detail", "type", "origin"], [*ORDER, "position"]),
    "questRewardDefinitions": _definitions(
        ["key", "quest_id", "selections", "bonus_count"], reward_rows, ["title", "detail", "category", "type", "origin", "material", "bonus"], ORDER
    ),
    "itemImprovementAvailabilityFacts": _facts(0),
    "itemImprovementCostFacts": _facts(1),
    "itemImprovementUpdateFacts": _facts(2),
}


#: The tables of sources/facts.py: their rows come from fact_records, validated and written once for all three, and
#: folds keep the place of a fact's first report, by which it is numbered.
FACTS = ["itemImprovementAvailabilityFacts", "itemImprovementCostFacts", "itemImprovementUpdateFacts"]
FACT_JOBS = {name: _facts(k, lambda records, k=k: (routed_rows(records, k), None), "born") for k, name in enumerate(FACTS)}

#: The state whose job judges each kind of report; the three of facts reject the same.
JUDGES = {
    "select_rank": "selectRankStates", "remodel_recipe": "recipeAggregates", "ship_stat": "shipStatAggregates", "enemy_info": "enemyInfoAggregates",
    "quest": "questDefinitions", "quest_reward": "questRewardDefinitions", "item_improvement": "itemImprovementAvailabilityFacts",
}


def rejected_reports(df: DataFrame, kinds: tuple[str, ...] = (*OBSERVATIONS.values(), *JUDGES)) -> DataFrame:
    """(id, ingested_at, kind, message) of the envelopes of these kinds that a job rejects."""
    dataset = {report: d for d, report in OBSERVATIONS.items()}
    each = {k: observations_of(df, dataset[k])[1] if k in dataset else STATE_JOBS[JUDGES[k]].judged(df)[1] for k in kinds}
    return reduce(DataFrame.unionByName, [r.select(*KEEP, F.lit(k).alias("kind"), "message") for k, r in each.items()])
