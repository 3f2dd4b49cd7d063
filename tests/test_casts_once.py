"""What the casts of a row look at, and how often."""

from pyspark.sql import functions as F

from tidefold.functions import casting
from tidefold.operators import folds


def test_a_text_is_not_cast_as_number(spark):
    texts = ["null", "true", "1.5", "12", '"7"', '"x"', "[1]", '{"a":1}']
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.parse_json("t").alias("v"))
    got = {r.t: tuple(r.s) for r in df.select("t", casting.scanned(F.col("v"), lambda s: s).alias("s")).collect()}
    assert got['"7"'] == ("string", "7", None) and got["true"] == ("boolean", "true", None) and got["12"] == ("number", None, 12.0)
    assert got["[1]"] == ("array", None, None) and got['{"a":1}'] == ("object", None, None) and got["null"] == ("null", None, None)


def test_members_of_an_object_in_one_pass(spark):
    texts = ['{"a":null,"B":1,"x y":[1]}', "[1]", '"s"', "null", '{"A":2,"b":{"a":3}}', "{}"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.parse_json("t").alias("v"))
    for names in (["a", "B", "x y"], ["a", "A", "b", "B"]):
        members = df.select("v", casting.parts(F.col("v"), names).alias("p"))
        if len(names) == 3:
            pairs = [F.to_json(F.col("p")[n]).eqNullSafe(F.to_json(casting.get(F.col("v"), "variant", f"$['{n}']"))) for n in names]
            assert all(all(r) for r in members.select(*pairs).collect())
        else:
            assert members.select("p.*").count() == len(texts)


def test_what_prints_the_same_is_taken_as_it_stands(spark):
    texts = ['{"a":1,"b":"x","c":[1,2]}', '{"a":"1"}', '{"a":1.5}', '{"b":1}', '{"c":3}', '{"a":null,"b":"n"}', "{}", '{"a":true}', '{"a":99999999999}', '{"c":[null]}', '{"c":["1"]}']
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.parse_json("t").alias("v"))
    types = {"a": "int", "b": "string", "c": "array<int>"}
    read = casting.let(casting.parts(F.col("v"), list(types)), lambda m: casting.as_printed(m, types))
    got = {r.t: r.s and tuple(r.s) for r in df.select("t", read.alias("s")).collect()}
    plain = {texts[0]: (1, "x", [1, 2]), texts[5]: (None, "n", None), "{}": (None, None, None), texts[9]: (None, None, [None])}
    assert got == {t: plain.get(t) for t in texts}


def test_facts_take_their_sets_from_one_pass(spark):
    rows = [("k", 1, 10, ["b", "a"], [3]), ("k", 0, 20, ["a", None], None), ("z", 2, 5, [], [1, 1])]
    df = spark.createDataFrame(rows, "key string, id long, at long, names array<string>, numbers array<long>")
    out = folds.accumulate_facts(df, ["key"], ["at"], "at", "at", ["names", "numbers"], ["id"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    got = {r.key: (r.at, r["count"], r.names, r.numbers) for r in out.collect()}
    assert got == {"k": (20, 2, ["a", "b"], [3]), "z": (5, 1, [], [1])}
