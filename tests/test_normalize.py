import json

import pytest
from pyspark.sql import functions as F

from tidefold.functions import casting
from tidefold.operators import normalize as N
from tidefold.schemas import Field

SCHEMA = {"count": Field("integer", True), "enabled": Field("boolean"), "ids": Field("integerArray"), "label": Field("string"), "timestamp": Field("safeInteger", True)}


def split(spark, payloads, schema=SCHEMA, **k):
    texts = [p if isinstance(p, str) else json.dumps(p) for p in payloads]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, data string")
    ok, bad = N.parse_reports(df)
    accepted, rejected = N.normalize(ok, schema, **k)
    return {r.id: r for r in accepted.collect()}, {r.id: r for r in rejected.collect()}, {r.id: r.message for r in bad.collect()}


def test_golden_casts(spark):
    ok, bad, _ = split(spark, [
        {"count": "42", "enabled": "yes", "ids": "7", "label": True, "timestamp": "1700000000000", "unknown": "x"},
        {"count": True, "enabled": "", "ids": None, "label": "", "timestamp": 0},
        {"count": 1, "timestamp": 1},
        {"count": 1.5, "timestamp": 1},
        {"count": 2147483648, "timestamp": 1},
        {"timestamp": 1},
        {"count": 1, "timestamp": 2**53},
        {"count": 1, "timestamp": -1},
        {"count": None, "timestamp": 1},
        {"count": 1, "timestamp": 1, "ids": [1, "2", None, "", 2147483648]},
        {"count": 1, "timestamp": 1, "ids": [1, "2", None, ""]},
    ])
    row = lambda k: (ok[k]["count"], ok[k].enabled, ok[k].ids, ok[k].label, ok[k].timestamp)
    assert row(0) == (42, True, [7], "true", 1700000000000)
    assert row(1) == (1, None, None, "", 0)
    assert row(2) == (1, None, [], None, 1)
    assert ok[10].ids == [1, 2, None, None]
    first = {k: (r.issues[0].path, r.issues[0].code) for k, r in bad.items()}
    assert first == {3: ("count", "invalid_type"), 4: ("count", "out_of_range"), 5: ("count", "required"), 6: ("timestamp", "out_of_range"), 7: ("timestamp", "out_of_range"), 8: ("count", "required"), 9: ("ids.4", "out_of_range")}
    assert bad[3].message == "count: expected signed 32-bit integer" and bad[5].message == "count: expected integer"
    assert bad[9].message == "ids.4: expected signed 32-bit integer" and bad[9].issues[0].invalid_value == "2147483648"
    assert bad[5].issues[0].received_type == "undefined" and bad[8].issues[0].received_type == "null"


def test_issue_log(spark):
    schema = {f"f{k}": Field("boolean") for k in range(25)} | {"s": Field("integer"), "o": Field("integer"), "a": Field("string")}
    ok, bad, _ = split(spark, [{f"f{k}": 5 for k in range(25)}, {"s": "x" * 300, "o": {"a": 1, "b": 2}, "a": [1, 2, 3]}], schema)
    assert not ok and len(bad[0].issues) == 20
    s, o, a = bad[1].issues
    assert len(s.invalid_value) == 256 and (o.received_type, o.received_size, o.invalid_value) == ("object", 2, None) and (a.received_type, a.received_size) == ("array", 3)


def test_bad_bodies(spark):
    _, _, bad = split(spark, ["{", "[1]", "3", '"{\\"count\\":1}"', "null", '"[1]"'], {"count": Field("integer")})
    assert bad == {0: "data must be valid JSON", 1: "data must be a JSON object", 2: "data must be a JSON object", 4: "data must be a JSON object", 5: "data must be a JSON object"}


def test_nested_and_json(spark):
    schema = {"n": Field("nestedIntegerArray"), "j": Field("json"), "l": Field("jsonArray"), "d": Field("numberArray")}
    ok, bad, _ = split(spark, [
        {"n": [[1, "2"], 3, None], "j": {"b": 1, "a": [True, None]}, "l": {"x": 1}, "d": [0.5, "1e3"]}, {"n": [[1, 2], [3, "x"]]}, {}, {"j": None, "l": None},
        '{"j": {"x": 1e999}}', '{"j": {"x": "1e999"}}', '{"l": ["Infinity"]}', '{"d": 1e999}',
    ], schema)
    assert ok[0].n == [[1, 2], [3], None] and ok[0].j == '{"a":[true,null],"b":1}' and ok[0].l == '[{"x":1}]' and ok[0].d == [0.5, 1000.0]
    assert bad[1].message == "n.1.1: expected signed 32-bit integer" and bad[1].issues[0].invalid_value == "x"
    assert (ok[2].n, ok[2].j, ok[2].l, ok[2].d) == ([], None, "[]", []) and (ok[3].j, ok[3].l) == (None, None)
    assert bad[4].message == "j: expected finite JSON value" and 5 in ok and 6 in ok and bad[7].issues[0].path == "d.0"


@pytest.mark.parametrize(
    "text, value",
    [('"12"', 12), ('" 0x1F "', 31), ('"0b11"', 3), ('"0o17"', 15), ('"   "', 0), ('"1d"', None), ('"NaN"', None), ('"Infinity"', None), ('".5"', 0.5), ('"5."', 5), ('"1e400"', None), ("true", 1), ("[]", None), ('"1_0"', None), ('"-0x1"', None), ('"+7"', 7)],
)
def test_numbers_in_text(spark, text, value):
    v = F.parse_json(F.lit(text))
    assert spark.range(1).select(casting.number_of(v).alias("n")).first().n == value


def test_numbers_as_text(spark):
    cases = {"1.0": "1", "1e21": "1e+21", "1.5": "1.5", "-0.25": "-0.25", "123456789012": "123456789012", "1e3": "1000", "1.25e-7": "1.25e-7", "0.000125": "0.000125", "12345678.5": "12345678.5", "1e-5": "0.00001"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.s for r in df.select("t", casting.number_text(F.parse_json("t")).alias("s")).collect()} == cases


def test_presence_and_snapshot(spark):
    schema = {"mapId": Field("integer"), "ownedShipSnapshot": Field("json")}
    ok, _, _ = split(spark, [{"mapId": m, "ownedShipSnapshot": {"1": 2}} for m in (72, 73, None)] + [{"ownedShipSnapshot": {"1": 2}}], schema, presence=("mapId",))
    df = spark.createDataFrame(list(ok.values()), "id long, data string, map_id int, owned_ship_snapshot string, has_map_id boolean")
    got = {r.id: r.owned_ship_snapshot for r in N.clear_early_snapshot(df).collect()}
    assert got == {0: "{}", 1: '{"1":2}', 2: "{}", 3: '{"1":2}'}


def test_version_gate(spark):
    rows = [("7.9.2", "Reporter 3.6.0"), ("7.9.1", "Reporter 3.6.0"), ("8.0.0", "other/10.3.99"), ("8.0.0", "Reporter 3.5.9"), ("not-semver", "Reporter 3.6.0"), ("8.0.0", "Reporter not-semver"), ("v8.0.0", "Reporter 3.6.0"), ("7.9.1-beta", "Reporter 3.6.0"), ("8.0.0", "Reporter 3.6.0-beta.1"), ("8.0", "x"), ("01.0.0", "x"), ("8.0.0", None),
            ("1.99999999999999999999999.0", "x"), ("9007199254740993.0.0", "x"), ("9007199254740991.0.0", "x"), ("1.0.0-" + "a" * 251, "x"), ("1.0.0-" + "a" * 250, "x")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, poi_version string, origin string")
    parts = [sorted(r.id for r in d.collect()) for d in N.semver_gate(df)]
    assert parts == [[0, 6], [1, 2, 3, 7, 8, 11, 14, 16], [4, 5, 9, 10, 12, 13, 15]]
