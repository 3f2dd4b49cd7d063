"""Casts of JSON values as a lenient service would make them, in column expressions over VARIANT.

A cast gives a struct (value, code, at): code is null if it worked, else invalid_type or out_of_range; at is the place
of the first bad element of an array (``.0``, ``.2.1``), empty for a scalar. Three states are told apart: SQL NULL of
the variant (absent), JSON null, and a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A decimal number as text, and the forms with a base.
DECIMAL = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
BASES = ((16, r"\A0[xX][0-9a-fA-F]+\z"), (8, r"\A0[oO][0-7]+\z"), (2, r"\A0[bB][01]+\z"))
EDGES = r"\A[\s\x{A0}\x{FEFF}\p{Zs}\x{2028}\x{2029}]+|[\s\x{A0}\x{FEFF}\p{Zs}\x{2028}\x{2029}]+\z"
SAFE = 9_007_199_254_740_991


def let(value: Column, use) -> Column:
    """use(value), with value computed once for each row. (Of an array's elements element_at remembers the type; get
    would ask the whole expression for it in every row.)"""
    return F.try_element_at(F.transform(F.array(value), use), F.lit(1))


TYPES = {"VOI": "null", "BOO": "boolean", "STR": "string", "ARR": "array", "OBJ": "object"}


def type_of(v: Column) -> Column:
    """null, boolean, number, string, array or object; SQL NULL for what is absent."""
    names = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    known = F.try_element_at(names, F.substring(F.schema_of_variant(v), 1, 3))
    return F.when(v.isNotNull(), F.coalesce(known, F.lit("number")))


def get(v: Column, type: str, path: str = "$") -> Column:
    return F.try_variant_get(v, path, type)


def parts(v: Column, names: list[str]) -> Column:
    """A struct with these members of an object, as VARIANT, found in one pass over it."""
    if len({n.lower() for n in names}) < len(names):  # a struct cannot tell such fields apart
        return F.struct(*[get(v, "variant", f"$['{n}']").alias(n) for n in names])
    return get(v, f"struct<{','.join(f'`{n}`:variant' for n in names)}>")


def as_printed(members: Column, types: dict[str, str]) -> Column:
    """A struct of these members of an object, read with these types from what they print as; null if one of them does
    not print the same again. A member that does has the type already, and needs no lenient cast, which costs far more.
    JSON null is null. (A VARIANT prints an object's keys in order, so types must name them in order.)"""
    schema = f"struct<{','.join(f'`{n}`:{t}' for n, t in types.items())}>"

    def checked(x):
        bare = F.struct(*[F.when(~F.is_variant_null(members[n]), members[n]).alias(n) for n in types])
        same = (x["printed"] == x["given"]) | (x["given"].contains(":null") & (x["printed"] == F.to_json(bare)))
        return F.when(same, x["read"])

    def read(given):
        return let(F.from_json(given, schema), lambda c: let(F.struct(c.alias("read"), F.to_json(c).alias("printed"), given.alias("given")), checked))

    return let(F.to_json(F.struct(*[members[n].alias(n) for n in types])), read)


def scanned(v: Column, use) -> Column:
    """use(s) with s = (kind, text, number) of a value, looked up once: text of texts and booleans, number of numbers.
    Nothing is cast in vain: a text that is no number would cost an exception in every row."""

    def of(kind):
        text, number = F.when(kind.isin("string", "boolean"), get(v, "string")), F.when(kind == "number", get(v, "double"))
        return F.struct(kind.alias("kind"), text.alias("text"), number.alias("number"))

    return let(let(type_of(v), of), use)


def result(value: Column, code: Column, at: Column | None = None) -> Column:
    return F.struct(value.alias("value"), code.cast("string").alias("code"), (at if at is not None else F.lit("")).alias("at"))


def text_number(s: Column) -> Column:
    """A number in text: edges trimmed, blank is 0, decimal or with a base; null for anything else or if not finite."""

    def parsed(bare):
        out = F.when(bare == "", F.lit(0.0)).when(bare.rlike(DECIMAL), finite(bare.try_cast("double")))
        for base, pattern in BASES:
            out = out.when(bare.rlike(pattern), F.conv(F.substring(bare, 3, 400), base, 10).try_cast("double"))
        return out

    return let(F.regexp_replace(s, EDGES, ""), parsed)


def finite(x: Column) -> Column:
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def scanned_number(s: Column) -> Column:
    return (
        F.when(s["kind"] == "number", finite(s["number"]))
        .when(s["kind"] == "boolean", (s["text"] == "true").cast("int").cast("double"))
        .when(s["kind"] == "string", text_number(s["text"]))
    )


def number_of(v: Column) -> Column:
    """P3's value, null if there is none."""
    return scanned(v, scanned_number)


def nothing(s: Column) -> Column:
    """JSON null or an empty text."""
    return (s["kind"] == "null") | ((s["kind"] == "string") & (s["text"] == ""))


def _numeric(v: Column, type: str, code) -> Column:
    none = result(F.lit(None).cast(type), F.lit(None))

    def judged(n):
        return let(code(n), lambda c: result(F.when(c.isNull(), n).cast(type), c))

    return scanned(v, lambda s: F.when(nothing(s), none).otherwise(let(scanned_number(s), judged)))


def cast_number(v: Column) -> Column:
    return _numeric(v, "double", lambda n: F.when(n.isNull(), "invalid_type"))


def cast_integer(v: Column) -> Column:
    """P4"""
    return _numeric(v, "int", lambda n: F.when(n.isNull() | (n != F.floor(n)), "invalid_type").when((n < -2147483648) | (n > 2147483647), "out_of_range"))


def cast_safe_integer(v: Column) -> Column:
    """P5"""
    return _numeric(v, "long", lambda n: F.when(n.isNull(), "invalid_type").when((n != F.floor(n)) | (n < 0) | (n > SAFE), "out_of_range"))


def cast_boolean(v: Column) -> Column:
    """P6"""

    def judged(s):
        text, number = F.when(s["kind"] == "string", s["text"]), F.when(s["kind"] == "number", s["number"])
        value = (
            F.when(s["kind"] == "boolean", s["text"] == "true")
            .when((number == 0) | text.isin("0", "false", "no"), False)
            .when((number == 1) | text.isin("1", "true", "yes"), True)
        )
        return let(value, lambda x: result(x, F.when(~nothing(s) & x.isNull(), "invalid_type")))

    return scanned(v, judged)


def scanned_number_text(s: Column) -> Column:
    """A number as a script prints it: whole numbers without a point, exponents beyond 21 digits and below 1e-6."""

    def printed(x):
        n, t = x["n"], x["t"]
        mantissa, exponent = F.regexp_extract(t, r"\A(-?[0-9.]+?)(?:\.0)?(?:E|\z)", 1), F.regexp_extract(t, r"E(-?[0-9]+)\z", 1)
        scaled = F.concat(mantissa, F.lit("e"), F.when(exponent.startswith("-"), "").otherwise("+"), exponent)
        digits = F.regexp_replace(mantissa, "[.-]", "")
        small = F.concat(F.when(n < 0, "-").otherwise(""), F.lit("0."), F.repeat(F.lit("0"), F.abs(exponent.try_cast("int")) - 1), digits)
        large = F.regexp_replace(n.cast("decimal(38,10)").cast("string"), r"0+\z", "")
        return (
            F.when((n == F.floor(n)) & (F.abs(n) < 1e21), n.cast("decimal(38,0)").cast("string"))
            .when(~t.contains("E"), t)
            .when((F.abs(n) >= 1e21) | (F.abs(n) < 1e-6), scaled)
            .when(F.abs(n) < 1, small)
            .otherwise(large)
        )

    return let(F.struct(s["number"].alias("n"), s["number"].cast("string").alias("t")), printed)


def number_text(v: Column) -> Column:
    return scanned(v, scanned_number_text)


def scalar_text(s: Column) -> Column:
    return F.when(s["kind"].isin("string", "boolean"), s["text"]).when(s["kind"] == "number", scanned_number_text(s))


def cast_string(v: Column) -> Column:
    """P7"""
    return scanned(v, lambda s: result(scalar_text(s), F.when(s["kind"].isin("array", "object"), "invalid_type")))


def elements(v: Column) -> Column:
    """The elements of an array; a scalar or object is its own only one."""
    return F.when(type_of(v) == "array", get(v, "array<variant>")).otherwise(F.array(v))


def json_null(v: Column) -> Column:
    """Elements that are JSON null may come as SQL NULL from an array."""
    return F.coalesce(v, F.parse_json(F.lit("null")))


def cast_array(v: Column, one, type: str) -> Column:
    none = result(F.lit(None).cast(f"array<{type}>"), F.lit(None))

    def gathered(cast):
        bad = F.filter(
            F.transform(cast, lambda c, k: F.struct(c["code"].alias("code"), F.concat(F.lit("."), k.cast("string"), c["at"]).alias("at"))),
            lambda b: b["code"].isNotNull(),
        )
        values = F.transform(cast, lambda c: c["value"])
        return let(F.get(bad, F.lit(0)), lambda b: result(F.when(b.isNull(), values), b["code"], F.coalesce(b["at"], F.lit(""))))

    return F.when(type_of(v) == "null", none).otherwise(let(F.transform(elements(v), lambda e: one(json_null(e))), gathered))


def cast_json(v: Column, array: bool) -> Column:
    """P10: canonical JSON text; a scalar becomes a list if array."""

    def shaped(x):
        listed = F.when(x["kind"] == "array", x["json"]).otherwise(F.concat(F.lit("["), x["json"], F.lit("]"))) if array else x["json"]
        return result(F.when(x["kind"] != "null", listed), F.lit(None))

    return let(F.struct(type_of(v).alias("kind"), F.to_json(v).alias("json")), shaped)


def cast_field(v: Column, kind: str) -> Column:
    """A field that is there, by its declared kind."""
    return {
        "number": lambda: cast_number(v),
        "integer": lambda: cast_integer(v),
        "safeInteger": lambda: cast_safe_integer(v),
        "boolean": lambda: cast_boolean(v),
        "string": lambda: cast_string(v),
        "integerArray": lambda: cast_array(v, cast_integer, "int"),
        "numberArray": lambda: cast_array(v, cast_number, "double"),
        "nestedIntegerArray": lambda: cast_array(v, lambda e: cast_array(e, cast_integer, "int"), "array<int>"),
        "json": lambda: cast_json(v, False),
        "jsonArray": lambda: cast_json(v, True),
    }[kind]()


#: What each kind says it expected.
EXPECTED = {
    "number": "finite number", "numberArray": "finite number", "integer": "signed 32-bit integer", "integerArray": "signed 32-bit integer",
    "nestedIntegerArray": "signed 32-bit integer", "safeInteger": "non-negative safe integer", "boolean": "boolean", "string": "string",
    "json": "finite JSON value", "jsonArray": "finite JSON value",
}
