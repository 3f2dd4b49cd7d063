"""Declared report schemas, datasets and their columns: fixed values that outputs must carry."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Field:
    kind: str
    required: bool = False


def _fields(text: str) -> dict[str, Field]:
    """name:kind pairs; a trailing ! marks a required field."""
    out = {}
    for item in text.split():
        name, kind = item.split(":")
        out[name] = Field(kind.rstrip("!"), kind.endswith("!"))
    return out


#: Spark type of each kind.
KINDS = {
    "boolean": "boolean", "integer": "int", "integerArray": "array<int>", "json": "string", "jsonArray": "string",
    "nestedIntegerArray": "array<array<int>>", "number": "double", "numberArray": "array<double>", "safeInteger": "bigint", "string": "string",
}

#: Payload fields in the order in which they are validated.
REPORTS = {
    "create_ship": _fields("items:integerArray kdockId:integer secretary:integer shipId:integer highspeed:integer teitokuLv:integer largeFlag:boolean origin:string"),
    "create_item": _fields("items:integerArray secretary:integer itemId:integer teitokuLv:integer successful:boolean origin:string"),
    "remodel_item": _fields(
        "successful:boolean itemId:integer itemLevel:integer flagshipId:integer flagshipLevel:integer flagshipCond:integer "
        "consortId:integer consortLevel:integer consortCond:integer teitokuLv:integer certain:boolean"
    ),
    "drop_ship": _fields(
        "shipId:integer itemId:integer mapId:integer quest:string cellId:integer enemy:string rank:string isBoss:boolean teitokuLv:integer mapLv:integer "
        "enemyShips1:integerArray enemyShips2:integerArray enemyFormation:integer baseExp:integer teitokuId:string ownedShipSnapshot:json origin:string"
    ),
    "select_rank": _fields("teitokuId:string! teitokuLv:integer mapareaId:integer! rank:integer origin:string"),
    "pass_event": _fields("teitokuId:string teitokuLv:integer mapId:integer mapLv:integer rewards:jsonArray origin:string"),
    "battle_api": _fields("origin:string path:string data:json"),
    "night_contact": _fields("fleetType:integer shipId:integer shipLv:integer itemId:integer itemLv:integer contact:boolean"),
    "aaci": _fields(
        "poiVersion:string! available:integerArray triggered:integer items:integerArray improvement:integerArray rawLuck:integer rawTaiku:integer "
        "lv:integer hpPercent:number pos:integer origin:string"
    ),
    "remodel_recipe": _fields(
        "recipeId:integer! itemId:integer! stage:integer! day:integer! secretary:integer! fuel:integer ammo:integer steel:integer bauxite:integer "
        "reqItemId:integer reqItemCount:integer buildkit:integer remodelkit:integer certainBuildkit:integer certainRemodelkit:integer "
        "upgradeToItemId:integer upgradeToItemLevel:integer key:string origin:string"
    ),
    "night_battle_ci": _fields(
        "shipId:integer CI:string type:string lv:integer rawLuck:integer pos:integer status:string items:integerArray improvement:integerArray "
        "searchLight:boolean flare:integer defenseId:integer defenseTypeId:integer ciType:integer display:integerArray hitType:integerArray "
        "damage:numberArray damageTotal:number time:safeInteger origin:string"
    ),
    "ship_stat": _fields("id:integer! lv:integer! los:integer! los_max:integer! asw:integer! asw_max:integer! evasion:integer! evasion_max:integer!"),
    "enemy_info": _fields(
        "ships1:integerArray! levels1:integerArray! hp1:integerArray! stats1:nestedIntegerArray! equips1:nestedIntegerArray! "
        "ships2:integerArray! levels2:integerArray! hp2:integerArray! stats2:nestedIntegerArray! equips2:nestedIntegerArray! "
        "planes:integer! bombersMin:integer bombersMax:integer"
    ),
    "quest": _fields("questId:integer! title:string! detail:string! category:integer! type:integer"),
    "quest_reward": _fields(
        "questId:integer! title:string! detail:string! category:integer type:integer origin:string selections:integerArray! material:integerArray "
        "bonus:jsonArray bounsCount:integer!"
    ),
}

#: Names that do not follow from the field's own: field -> column.
RENAMED = {"CI": "ci", "bounsCount": "bonus_count"}
RENAMED_IN = {"ship_stat": {"id": "ship_id"}}


def column_of(field: str, report: str = "") -> str:
    """The column of a payload field."""
    known = RENAMED_IN.get(report, {}).get(field) or RENAMED.get(field)
    return known or "".join(f"_{c.lower()}" if c.isupper() else c for c in field)


#: Observation datasets in publication order, with the report that fills them.
OBSERVATIONS = {
    "createShipObservations": "create_ship",
    "createItemObservations": "create_item",
    "remodelItemObservations": "remodel_item",
    "dropShipObservations": "drop_ship",
    "passEventObservations": "pass_event",
    "battleApiObservations": "battle_api",
    "nightContactObservations": "night_contact",
    "aaciObservations": "aaci",
    "nightBattleCiObservations": "night_battle_ci",
}
STATES = (
    "selectRankStates", "recipeAggregates", "shipStatAggregates", "enemyInfoAggregates", "questDefinitions", "questRewardDefinitions",
    "itemImprovementAvailabilityFacts", "itemImprovementCostFacts", "itemImprovementUpdateFacts",
)
DATASETS = (*OBSERVATIONS, *STATES)
#: Columns that hold JSON text.
JSON_KINDS = ("json", "jsonArray")


def observation_fields(dataset: str) -> dict[str, tuple[str, str]]:
    """Column -> (public name, kind), in the order of the published records."""
    report = OBSERVATIONS[dataset]
    return {column_of(f, report): (f, field.kind) for f, field in REPORTS[report].items()}
