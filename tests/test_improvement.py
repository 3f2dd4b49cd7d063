import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidefold.operators import folds
from tidefold.operators.improvement import improvement_records, record_list
from tidefold.operators.normalize import parse_reports
from tidefold.schemas import REPORTS

AT = 1_762_920_000_000  # 2025-11-12T04:00Z, a Wednesday in Japan
BASE = {"schemaVersion": 1, "clientObservedAt": AT, "recipeId": 58, "itemId": 412, "day": 3, "observedSecondShipId": 0}
DETAIL = BASE | {"source": "detail", "itemLevel": 9, "stage": 2, "fuel": 130, "ammo": 95, "steel": 70, "bauxite": 0, "buildkit": 7, "remodelkit": 8, "certainBuildkit": 12, "certainRemodelkit": 14,
                 "reqSlotItems": [{"id": 317, "count": 3}], "reqUseItems": [{"id": 71, "count": 2}]}
EXECUTION = BASE | {"source": "execution", "itemLevel": 10, "upgradeObserved": True, "upgradeToItemId": 933, "upgradeToItemLevel": 4, "observedSecondShipId": 26}


def run(spark, reports, received=AT + 1000, reporter="client"):
    rows = [(k, datetime(2025, 11, 12, 4, 0, k), json.dumps(r), reporter, received) for k, r in enumerate(reports)]
    df = spark.createDataFrame(rows, "id long, ingested_at timestamp, data string, x_reporter string, received_ms long")
    out = improvement_records(parse_reports(df)[0])
    return [sorted((r.asDict(True) for r in d.collect()), key=lambda r: (r["id"], r.get("position", 0))) for d in out]


def test_keys_and_routing(spark):
    many = DETAIL | {"reqSlotItems": [{"id": 317, "count": 3}, {"id": 317, "count": 5}, {"id": 0, "count": 0}], "reqUseItems": [{"id": 80, "count": 4}, {"id": "71", "count": 2}],
                     "observedFlagshipId": 44, "observedFlagshipIds": [59, 44]}
    listed, detailed, executed, rejected = run(spark, [BASE | {"source": "list"}, DETAIL, {"records": [many, EXECUTION]}])
    assert [r["key"] for r in listed] == ["v1|availability|58|412|3|0"]
    assert [r["key"] for r in detailed] == [
        "v1|cost|58|412|9|2|3|0|130|95|70|0|7|8|12|14|317:3|71:2|0", "v1|cost|58|412|9|2|3|0|130|95|70|0|7|8|12|14|317:8|71:2,80:4|0"]
    assert detailed[1]["observed_flagship_ids"] == [44, 59] and detailed[0]["observed_flagship_ids"] == []
    assert [r["key"] for r in executed] == ["v1|update|58|412|10|3|26|933|4"] and executed[0]["position"] == 1 and rejected == []
    assert listed[0]["origin"] == "client"


@pytest.fixture(scope="module")
def rejections(spark):
    cases = {
        "reqUseItems.0: must contain positive id and count": DETAIL | {"reqUseItems": [{"id": 71, "count": 0}]},
        "records: must have at most 100 elements": {"records": [BASE | {"source": "list"}] * 101},
        "day: does not match clientObservedAt JST day": BASE | {"source": "list", "day": 5},
        "clientObservedAt: is not a plausible timestamp": BASE | {"source": "list", "clientObservedAt": AT + 700_000},
        "source: must be list, detail or execution": BASE,
        "recipeId: must be a positive integer": BASE | {"source": "list", "recipeId": 0},
        "upgradeObserved: must be true": EXECUTION | {"upgradeObserved": False},
        "observedFlagshipId: must be a positive integer": BASE | {"source": "list", "observedFlagshipId": None},
        "itemLevel: must be a non-negative integer": DETAIL | {"itemLevel": "1.0"},
        "reqSlotItems: must be a list": {"records": [DETAIL, {k: v for k, v in DETAIL.items() if k != "reqSlotItems"}]},
    }
    return cases, run(spark, list(cases.values()))


def test_rejections_are_whole_reports(rejections):
    cases, (listed, detailed, executed, rejected) = rejections
    assert [r["message"] for r in rejected] == list(cases) and not listed and not detailed and not executed


def test_accumulated_facts(spark):
    reports = [BASE | {"source": "list", "clientObservedAt": AT + d, "observedFlagshipIds": [f]} for d, f in ((0, 640), (2000, 655), (1000, 640))]
    rows = [(k, datetime(2025, 11, 12, 4, 0, k), json.dumps(r), o, AT + 5000 + k) for k, (r, o) in enumerate(zip(reports, "ABA"))]
    df = spark.createDataFrame(rows, "id long, ingested_at timestamp, data string, x_reporter string, received_ms long")
    listed = improvement_records(parse_reports(df)[0])[0].withColumns({"sources": F.array("source"), "origins": F.array("origin")})
    fact = folds.accumulate_facts(listed, ["key"], ["recipe_id"], "client_observed_at", "reported_at", ["observed_flagship_ids", "sources", "origins"], ["ingested_at", "id", "position"]).first()
    assert (fact.first_client_observed_at, fact.last_client_observed_at, fact["count"]) == (AT, AT + 2000, 3)
    assert (fact.observed_flagship_ids, fact.sources, fact.origins) == ([640, 655], ["list"], ["A", "B"])


def test_lists_of_quests(spark):
    quest = {"questId": 1, "title": "Test quest", "detail": "Test details", "category": 2}
    reports = [{"quests": [quest, quest | {"questId": 2}]}, {"quests": [quest, quest | {"title": None}]}, {"quests": 3}, {"quests": [quest, 4]}, {}]
    df = spark.createDataFrame([(k, datetime(2026, 1, 1), json.dumps(r)) for k, r in enumerate(reports)], "id long, ingested_at timestamp, data string")
    taken, rejected = record_list(parse_reports(df)[0], REPORTS["quest"])
    assert sorted((r.id, r.position, r.quest_id) for r in taken.collect()) == [(0, 0, 1), (0, 1, 2)]
    got = {r.id: r.message for r in rejected.collect()}
    assert got == {1: "quests.1.title: expected string", 2: "quests: expected array", 3: "quests.1: expected object", 4: "quests: expected array"}
