"""Validation of report payloads: declared fields are cast, everything else is dropped, and a report with any bad field
is rejected with the list of what is wrong. All of it is column expressions on one parsed VARIANT, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import casting
from ..functions.keys import origin_of, semver
from ..schemas import KINDS, Field, column_of
from ..storage import written

MAX_ISSUES, MAX_VALUE = 20, 256
#: Fixed values of the version gate.
AFTER_VERSION, FROM_REPORTER, REPORTER = "7.9.1", "3.6.0", "Reporter "
#: A number in JSON that may not fit a double: three digits of exponent, or very many digits.
HUGE = r"-?[0-9]+(?:\.[0-9]+)?[eE]\+?[0-9]{3,}|-?[0-9]{309,}(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"

#: Kinds whose values are mostly sent as what they are, with the type of the plain cast.
PLAIN = {
    "integer": "int", "safeInteger": "bigint", "boolean": "boolean", "string": "string", "integerArray": "array<int>", "nestedIntegerArray": "array<array<int>>",
}
ARRAYS = ("integerArray", "numberArray", "nestedIntegerArray")
ISSUE = "struct<path:string,code:string,expected_type:string,received_type:string,invalid_value:string,received_size:int>"


def parse_reports(df: DataFrame, data: str = "data") -> tuple[DataFrame, DataFrame]:
    """(reports with the object as VARIANT v, rejected with a message). data is a JSON object, or a JSON text of
    one. Of repeated keys the last counts if spark.sql.variant.allowDuplicateKeys is true; else they reject."""
    def opening(text):  # tells what a JSON text holds, without a look at all of it
        return F.substring(F.ltrim(text, F.lit(" \t\r\n")), 1, 1)

    def judged(text):
        def of(v):
            message = F.when(v.isNull(), "data must be valid JSON").when(opening(text) != "{", "data must be a JSON object")
            return F.struct(v.alias("v"), message.alias("message"))

        return casting.let(F.try_parse_json(text), of)

    unpacked = F.when(opening(F.col(data)) == '"', casting.get(F.try_parse_json(data), "string")).otherwise(F.col(data))
    once = casting.let(unpacked, judged)
    out = computed(df, once, "v", "message")
    return out.where("message IS NULL").drop("message"), out.where("message IS NOT NULL").drop("v")


def computed(df: DataFrame, struct: Column, *names: str) -> DataFrame:
    """df with the fields of a struct, which are called names, as columns, computed once for each row: as rows of a
    generator, so that a filter on one of them does not compute it again below. Columns of df with these names are
    replaced. (Names are given, as asking the struct for them would analyse a large expression once more.)"""
    return df.select(*[c for c in df.columns if c not in names], F.inline(F.array(struct)))


def stored(judged: DataFrame) -> DataFrame:
    """Judged rows for results that are read more than once: validation is the dearest step, so they are written, and
    all that follows reads them. A stream, which is read once, stays as it is."""
    return judged if judged.isStreaming else written(judged, "judged")


def has_infinite(text: Column) -> Column:
    """Whether a JSON text has a number that no double holds; texts inside are not looked at."""
    bare = F.regexp_replace(text, r'"(?:\\.|[^"\\])*"', '""')
    huge = F.regexp_extract_all(bare, F.lit(HUGE), F.lit(0))
    return F.exists(huge, lambda x: F.abs(x.try_cast("double")) == F.lit(float("inf")))


def part_of(v: Column, at: Column) -> Column:
    """The element of an array that at (``.0`` or ``.2.1``) names."""
    first = F.regexp_extract(at, r"\A\.([0-9]+)", 1).try_cast("int")
    second = F.regexp_extract(at, r"\A\.[0-9]+\.([0-9]+)\z", 1).try_cast("int")
    outer = casting.let(casting.elements(v), lambda e: F.when(first.isNull(), v).otherwise(F.get(e, first)))
    return casting.let(outer, lambda o: F.when(second.isNull(), o).otherwise(casting.let(casting.elements(o), lambda e: F.get(e, second))))


def issue_of(path: Column, code: Column, expected: Column, v: Column) -> Column:
    """One entry of the issue log."""

    def entry(s):
        size = F.coalesce(F.size(casting.get(v, "array<variant>")), F.size(casting.get(v, "map<string,variant>")))
        return F.struct(
            path.alias("path"), code.alias("code"), expected.alias("expected_type"), F.coalesce(s["kind"], F.lit("undefined")).alias("received_type"),
            F.substring(casting.scalar_text(s), 1, MAX_VALUE).alias("invalid_value"),
            F.when(s["kind"].isin("array", "object"), size).cast("int").alias("received_size"),
        ).cast(ISSUE)

    return casting.scanned(v, entry)


def default_of(kind: str) -> Column:
    """The value of a field that is absent."""
    return (F.array() if KINDS[kind].startswith("array") else F.lit("[]") if kind == "jsonArray" else F.lit(None)).cast(KINDS[kind])


def kind_results(members: Column, names: list[str], kind: str, infinite: Column) -> Column:
    """For the fields of one kind, an array of (v, value, present, code, at): one cast expression for all of them."""
    type, default = KINDS[kind], default_of(kind)

    def judged(x):
        def of(c):
            code = c["code"]
            if kind in ("json", "jsonArray"):
                code = F.when(F.coalesce(c["value"].rlike(r'"-?Infinity"'), F.lit(False)) & infinite, "invalid_type")
            return F.struct(x["v"].alias("v"), c["value"].cast(type).alias("value"), F.lit(True).alias("present"), code.alias("code"), c["at"].alias("at"))

        gone = F.struct(x["v"].alias("v"), default.alias("value"), F.lit(False).alias("present"), F.lit(None).cast("string").alias("code"), F.lit("").alias("at"))
        return F.when(x["v"].isNull(), gone).otherwise(casting.let(casting.cast_field(x["v"], kind), of))

    fields = F.array(*[F.struct(members[n].alias("v")) for n in names])
    return F.transform(fields, judged)


def judged_object(v: Column, schema: dict[str, Field], infinite: Column, prefix: Column | None = None) -> Column:
    """P3-P12 for one object: struct (issues, _values, _has), a value and a presence for each field of the schema.

    An object whose fields are what they are declared to be is taken as it stands; only others need every cast."""
    by_kind: dict[str, list[str]] = {}
    for f, field in schema.items():
        by_kind.setdefault(field.kind, []).append(f)
    plain = {f: PLAIN[field.kind] for f, field in schema.items() if field.kind in PLAIN}

    def issue(m):
        seen = F.when(m["array"] & (m["at"] != ""), part_of(m["v"], m["at"])).otherwise(m["v"])
        return casting.let(seen, lambda y: issue_of(F.concat(m["path"], m["at"]), m["code"], m["expected"], y))

    def judged(r):
        of = {f: F.get(r[k], F.lit(i)) for k, names in by_kind.items() for i, f in enumerate(names)}
        marks = []
        for f, field in schema.items():
            missing = of[f]["code"].isNull() & of[f]["value"].isNull() if field.required else F.lit(False)
            marks.append(
                F.struct(
                    (F.lit(f) if prefix is None else F.concat(prefix, F.lit(f".{f}"))).alias("path"), F.when(missing, "required").otherwise(of[f]["code"]).alias("code"),
                    F.when(missing, "").otherwise(of[f]["at"]).alias("at"), F.when(missing, field.kind).otherwise(casting.EXPECTED[field.kind]).alias("expected"),
                    of[f]["v"].alias("v"), F.lit(field.kind in ARRAYS).alias("array"),
                )
            )
        bad = F.slice(F.filter(F.array(*marks), lambda m: m["code"].isNotNull()), 1, MAX_ISSUES)
        values = [of[f]["value"].alias(f"value_{k}") for k, f in enumerate(schema)]
        has = [of[f]["present"].alias(f"has_{k}") for k, f in enumerate(schema)]
        return F.struct(F.transform(bad, issue).alias("issues"), F.struct(*values).alias("_values"), F.struct(*has).alias("_has"))

    def as_it_stands(members, x):
        cast, rest = x["cast"], {f: F.get(x[k], F.lit(i)) for k, names in by_kind.items() if k not in PLAIN for i, f in enumerate(names)}
        ok, values = cast.isNotNull(), []
        for f, field in schema.items():
            value = rest[f]["value"] if f in rest else cast[f]
            if f in rest:
                ok = ok & rest[f]["code"].isNull()
            elif field.kind in ARRAYS:
                value = F.when(members[f].isNull(), default_of(field.kind)).otherwise(value)
            if field.kind == "safeInteger":
                ok = ok & F.coalesce(value.between(0, casting.SAFE), F.lit(True))
            if field.required:
                ok = ok & value.isNotNull()
            values.append(value.alias(f"value_{len(values)}"))
        has = [members[f].isNotNull().alias(f"has_{k}") for k, f in enumerate(schema)]
        return F.when(ok, F.struct(F.array().cast(f"array<{ISSUE}>").alias("issues"), F.struct(*values).alias("_values"), F.struct(*has).alias("_has")))

    def by_kinds(members):
        results = {k: kind_results(members, names, k, infinite).alias(k) for k, names in by_kind.items()}
        full = casting.let(F.struct(*results.values()), judged)
        quick = F.struct(casting.as_printed(members, plain).alias("cast"), *[r for k, r in results.items() if k not in PLAIN])
        return F.coalesce(casting.let(quick, lambda x: as_it_stands(members, x)), full) if plain and len({f.lower() for f in plain}) == len(plain) else full

    return casting.let(casting.parts(v, list(schema)), by_kinds)


def message_of(issues: Column) -> Column:
    """The first issue as a message; null if there is none."""
    first = F.get(issues, F.lit(0))
    return F.concat(first["path"], F.lit(": expected "), first["expected_type"])


def normalize(
    df: DataFrame, schema: dict[str, Field], v: str = "v", data: str = "data", prefix: str = "", report: str = "", presence: tuple[str, ...] = (),
    once: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(accepted with a column per declared field, rejected with issues and message).

    presence: fields that get a companion has_<column>, true if the report had them. data: the raw text, looked at
    for numbers that are not finite. once: see stored()."""
    infinite = F.coalesce(has_infinite(F.col(data)), F.lit(False))  # looked at only where a value prints as infinite
    out = computed(df, judged_object(F.col(v), schema, infinite, F.lit(prefix) if prefix else None), "issues", "_values", "_has")
    if once:
        out = stored(out.drop(v))
    taken = [column_of(f, report) for f in schema]
    keep = [c for c in df.columns if c not in (v, "issues", *taken)]
    values = [F.col(f"_values.value_{k}").alias(c) for k, c in enumerate(taken)]
    has = [F.col(f"_has.has_{k}").alias(f"has_{column_of(f, report)}") for k, f in enumerate(schema) if f in presence]
    accepted = out.where(F.size("issues") == 0).select(*keep, *values, *has)
    rejected = out.where(F.size("issues") > 0)
    return accepted, rejected.select(*[c for c in df.columns if c not in (v, "issues", "message")], "issues", message_of(F.col("issues")).alias("message"))


def with_origin(df: DataFrame, origin: str = "origin", x_reporter: str = "x_reporter", user_agent: str = "user_agent") -> DataFrame:
    """P2"""
    return df.withColumn(origin, origin_of(F.col(origin), F.col(x_reporter), F.col(user_agent)))


def clear_early_snapshot(df: DataFrame, map_id: str = "map_id", has_map_id: str = "has_map_id", snapshot: str = "owned_ship_snapshot", limit: int = 73) -> DataFrame:
    """Below map limit the snapshot is emptied; a null map counts as 0, an absent one as none."""
    early = F.col(has_map_id) & (F.coalesce(F.col(map_id), F.lit(0)) < limit)
    return df.withColumn(snapshot, F.when(early, F.lit("{}")).otherwise(F.col(snapshot)))


def semver_outcome(version: Column, origin: Column) -> Column:
    """Stored, ignored (accepted, but too old or of another reporter) or rejected (no version where one must be)."""
    own, reporter = semver(version), semver(F.substr(origin, F.lit(len(REPORTER) + 1)))
    is_reporter = F.coalesce(origin.startswith(REPORTER), F.lit(False))
    bad = own.isNull() | (is_reporter & reporter.isNull())
    new = (own > semver(F.lit(AFTER_VERSION))) & is_reporter & (reporter >= semver(F.lit(FROM_REPORTER)))
    return F.when(bad, "rejected").when(new, "stored").otherwise("ignored")


def semver_gate(df: DataFrame, version: str = "poi_version", origin: str = "origin") -> tuple[DataFrame, DataFrame, DataFrame]:
    judged = df.withColumn("_outcome", semver_outcome(F.col(version), F.col(origin)))
    return tuple(judged.where(F.col("_outcome") == k).drop("_outcome") for k in ("stored", "ignored", "rejected"))


def drop_noop_stage(df: DataFrame, stage: str = "stage") -> DataFrame:
    """Stage -1 is accepted, but not stored; no stage at all is."""
    return df.where(~F.col(stage).eqNullSafe(-1))
