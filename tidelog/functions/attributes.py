"""Attribute maps: scalar text and canonical JSON of a flat VARIANT object."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Largest integer up to which every integer is exact as a double.
_EXACT_INTEGER = 9_007_199_254_740_992
# Kinds whose text is always canonical; a double holds any 15 digits exactly.
_PLAIN_KINDS = r"^(STRING|BOOLEAN|DECIMAL\((\d|1[0-5]),\d+\))$"
# In the schema text of an object: a value of any other kind than those and integers.
_OTHER_KINDS = r": (?!STRING|BOOLEAN|BIGINT|DECIMAL\((\d|1[0-5]),)"
# In JSON text: digits enough for an integer that a double may not hold.
_LONG_INTEGER = r"\d{16}"


# What looks a field up by name, and a step that makes further fields of those there are.
Fields = Callable[[str], Column]
Stage = Callable[[Fields], dict[str, Column]]


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def number_text(number: Column) -> Column:
    """Plain decimal text of a double: fewest digits that read back as the same
    double, no exponent, no trailing zeros, no ``-0``.

    Java's own text of a double may carry a digit too many, and rounding that
    text once more may miss; hence the tries with 15 and 16 digits, the latter
    also cut off, before all 17.
    """
    full = F.format_string("%.16e", number)
    tries = F.array(
        F.format_string("%.14e", number), F.format_string("%.15e", number),
        F.regexp_replace(full, r"\de", "e"), full,
    )
    fits = F.filter(tries, lambda text: text.try_cast("double") == number)
    return F.when(number == 0, F.lit("0")).otherwise(bind(F.try_element_at(fits, F.lit(1)), _without_exponent))


def _without_exponent(text: Column) -> Column:
    form = r"^(-?)(\d)\.(\d+)e([+-]\d+)$"
    sign, first, rest = (F.regexp_extract(text, form, part) for part in (1, 2, 3))
    exponent = F.regexp_extract(text, form, 4).try_cast("int")
    digits = F.concat(first, F.rtrim(rest, F.lit("0")))

    def place_point(parts: Column) -> Column:
        digits, whole = parts["digits"], parts["exponent"] + 1
        large = F.when(
            F.length(digits) > whole,
            F.concat_ws(
                ".", F.substring(digits, F.lit(1), whole),
                F.substring(digits, whole + 1, F.length(digits)),
            ),
        ).otherwise(F.rpad(digits, whole, F.lit("0")))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -whole), digits)
        return F.when(whole <= 0, small).otherwise(large)

    parts = F.struct(digits.alias("digits"), exponent.alias("exponent"))
    return F.concat(sign, bind(parts, place_point))


def scalar_text(value: Column) -> Column:
    """Text of a VARIANT scalar the way a JSON ``->>`` lookup shows it."""
    number = F.try_variant_get(value, "$", "double")
    return F.when(is_plain(value), value.cast("string")).otherwise(bind(number, number_text))


def is_plain(value: Column) -> Column:
    """Whether the text Spark gives a VARIANT scalar is the canonical text already.

    That is so for strings, booleans, and numbers whose digits a double holds.
    """
    kind = F.schema_of_variant(value)
    integer = F.try_variant_get(value, "$", "long")
    return kind.rlike(_PLAIN_KINDS) | (
        (kind == "BIGINT") & integer.between(-_EXACT_INTEGER, _EXACT_INTEGER)
    )


def is_scalar(value: Column) -> Column:
    """Whether a VARIANT is a string, number or boolean."""
    kind = F.schema_of_variant(value)
    return kind.isin("STRING", "BIGINT", "DOUBLE", "FLOAT", "BOOLEAN") | kind.startswith("DECIMAL")


def object_members(json_text: Column) -> Column:
    """JSON text of an object to MAP<STRING, VARIANT>; NULL where it is none."""
    return F.try_parse_json(json_text).try_cast("map<string,variant>")


def shape_stages(value: str) -> list[Stage]:
    """Steps that give ``is_object`` and ``is_flat`` of a VARIANT, and helpers for its texts.

    Objects whose schema shows plain kinds only (``_simple``) are flat; the others are
    looked at value by value.
    """

    def kinds(get: Fields) -> dict[str, Column]:
        return {"_kinds": F.schema_of_variant(get(value))}

    def shape(get: Fields) -> dict[str, Column]:
        is_object = F.coalesce(get("_kinds").startswith("OBJECT"), F.lit(False))
        return {"is_object": is_object, "_simple": F.coalesce(is_object & ~get("_kinds").rlike(_OTHER_KINDS), F.lit(False))}

    def flat(get: Fields) -> dict[str, Column]:
        members = F.when(get("is_object") & ~get("_simple"), get(value).try_cast("map<string,variant>"))
        scalars = F.forall(F.map_values(members), is_scalar)
        return {"is_flat": get("_simple") | F.coalesce(scalars, F.lit(False))}

    return [kinds, shape, flat]


def text_stages(value: str) -> list[Stage]:
    """Steps from ``is_flat`` and ``_simple`` to ``attributes`` and ``attr_text``.

    ``attributes`` is canonical JSON, with numbers written like their text, and
    ``attr_text`` the map of scalar texts; both are NULL unless the object is
    flat. Objects whose schema and JSON text show nothing that needs rewriting
    take two casts; only the others are rewritten value by value.
    """

    def json(get: Fields) -> dict[str, Column]:
        return {"_json": F.when(get("_simple"), F.to_json(get(value)))}

    def members(get: Fields) -> dict[str, Column]:
        plain = F.coalesce(~get("_json").rlike(_LONG_INTEGER), F.lit(False))
        return {"_plain": plain, "_members": F.when(get("is_flat") & ~plain, get(value).try_cast("map<string,variant>"))}

    def texts(get: Fields) -> dict[str, Column]:
        json_text = F.when(get("_plain"), get("_json")).when(get("is_flat"), _rewritten_json(get("_members")))
        values = F.when(get("_plain"), get(value).try_cast("map<string,string>")).when(
            get("is_flat"), F.transform_values(get("_members"), lambda _, v: scalar_text(v))
        )
        return {"attributes": json_text, "attr_text": values}

    return [json, members, texts]


def in_columns(rows: DataFrame, stages: list[Stage]) -> DataFrame:
    """The fields that the stages add, as columns."""
    for stage in stages:
        rows = rows.withColumns(stage(F.col))
    return rows


def with_attributes(rows: DataFrame, value: str) -> DataFrame:
    """Adds ``is_object``, ``is_flat``, ``attributes`` and ``attr_text`` for a VARIANT column."""
    found = in_columns(rows, [*shape_stages(value), *text_stages(value)])
    return found.drop("_kinds", "_simple", "_json", "_plain", "_members")


def staged(items: Column, names: list[str], stages: list[Stage]) -> tuple[Column, list[str]]:
    """An array of structs with the fields that the stages add, and their names.

    A stage sees the fields of the ones before as values, so each is computed once.
    """
    for stage in stages:
        items, names = _one_stage(items, names, stage)
    return items, names


def _one_stage(items: Column, names: list[str], stage: Stage) -> tuple[Column, list[str]]:
    added: list[str] = []

    def more(item: Column) -> Column:
        fields = stage(lambda name: item[name])
        added[:] = list(fields)
        kept = [item[name].alias(name) for name in names if name not in fields]
        return F.struct(*kept, *(column.alias(name) for name, column in fields.items()))

    items = F.transform(items, more)
    return items, [*(name for name in names if name not in added), *added]


def canonical_attributes(logs: DataFrame) -> DataFrame:
    """``attributes`` as canonical JSON, and ``attr_text`` beside it; NULL becomes ``{}``.

    Text that is not a flat JSON object stays as it is and has no attribute texts.
    """
    given = F.coalesce(F.col("attributes"), F.lit("{}"))
    parsed = logs.withColumn("_given", given).withColumn("_object", F.try_parse_json("_given"))
    read = with_attributes(parsed, "_object")
    return read.withColumn("attributes", F.coalesce("attributes", "_given")).drop(
        "_given", "_object", "is_object", "is_flat"
    )


def _rewritten_json(members: Column) -> Column:
    pairs = F.transform(
        F.map_entries(members),
        lambda e: F.concat(
            _quoted(e["key"]),
            F.lit(":"),
            F.when(
                F.schema_of_variant(e["value"]) == "STRING", _quoted(e["value"].cast("string"))
            ).otherwise(scalar_text(e["value"])),
        ),
    )
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def _quoted(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)
