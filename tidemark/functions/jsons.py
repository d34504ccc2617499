"""JSON columns: equality that tells types apart, fields, and text forms."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _form(value) -> str:
    """A text that two JSON values share if and only if they are equal: numbers keep whether they were written whole."""
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    if isinstance(value, int):
        return f"i{value}"
    if isinstance(value, float):
        return f"f{value!r}"
    if isinstance(value, str):
        return f"s{value}"
    if isinstance(value, list):
        return "[" + ",".join(map(_form, value)) + "]"
    return "{" + ",".join(f"{json.dumps(k)}:{_form(v)}" for k, v in sorted(value.items())) + "}"


def kind(value: Column) -> Column:
    """object, array, string, long, double, boolean or null: the JSON type of a VARIANT; long is a number without fraction
    or exponent as parsed."""
    schema = F.schema_of_variant(value)
    return (
        F.when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema == "STRING", "string")
        .when(schema == "BIGINT", "long")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema == "VOID", "null")
        .otherwise("double")
    )


def matches(column: Column, wanted: dict | str | None) -> Column:
    """Whether a JSON text column has every field of ``wanted`` with an equal value.

    None filters nothing; a ``wanted`` that is no object matches nothing; {} matches objects.  Equality is that of JSON
    values: "1", 1 and 1.0 differ, objects compare without regard to order, a null matches a null that is there, never
    a missing field.  A column value that isn't an object, or no JSON, matches nothing.
    """
    if wanted is None:
        return F.lit(True)
    if isinstance(wanted, str):
        wanted = json.loads(wanted)
    if not isinstance(wanted, dict):
        return F.lit(False)
    parsed = F.try_parse_json(column)
    ok = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    for key, value in wanted.items():
        ok = ok & _field_equals(column, parsed, key, value)
    return ok


def path(key: str) -> str:
    quoted = key.replace("\\", "\\\\").replace("'", "\\'")
    return f"$['{quoted}']"


def _field_equals(column: Column, parsed: Column, key: str, value) -> Column:
    field = F.try_variant_get(parsed, path(key), "variant")
    text = F.get_json_object(column, path(key))
    schema = F.schema_of_variant(field)
    false = F.lit(False)
    if value is None:
        same = schema == "VOID"
    elif isinstance(value, bool):
        same = (schema == "BOOLEAN") & (F.try_variant_get(parsed, path(key), "boolean") == value)
    elif isinstance(value, int):
        same = (schema == "BIGINT") & ~text.rlike("[.eE]") & (F.try_variant_get(parsed, path(key), "bigint") == value)
    elif isinstance(value, float):
        number = schema.isin("DOUBLE", "FLOAT", "BIGINT") | schema.startswith("DECIMAL")
        same = number & text.rlike("[.eE]") & (text.try_cast("double") == value)
    elif isinstance(value, str):
        same = (schema == "STRING") & (F.try_variant_get(parsed, path(key), "string") == value)
    else:
        # nested values: their canonical texts (keys sorted); numbers in them compare as numbers
        same = F.to_json(field) == F.to_json(F.parse_json(F.lit(json.dumps(value))))
    return F.coalesce(same, false)


def string_fields(frame: DataFrame, column: str, *keep: str) -> DataFrame:
    """``keep``, key and value of each top-level field of a JSON object that is a string."""
    parsed = F.try_parse_json(F.col(column))
    objects = frame.select(*keep, parsed.alias("__parsed")).where(F.schema_of_variant(F.col("__parsed")).startswith("OBJECT"))
    names = "".join(f"`{k}`, " for k in keep)
    exploded = frame.sparkSession.sql(f"SELECT {names}key, value FROM {{objects}}, LATERAL variant_explode(__parsed)", objects=objects)
    return exploded.where(F.schema_of_variant("value") == "STRING").select(*keep, "key", F.expr("variant_get(value, '$', 'string')").alias("value"))


def base64_plain(value: Column, url_safe: bool = False) -> Column:
    """Base64 without padding, on one line; with ``url_safe``, - and _ in place of + and /."""
    # the built-in function may break lines
    plain = F.rtrim(F.translate(F.base64(value), "\r\n", ""), F.lit("="))
    return F.translate(plain, "+/", "-_") if url_safe else plain


def json_rows(frame: DataFrame) -> DataFrame:
    """Each row as a JSON object by column name (column ``row``); doubles that aren't finite are null, binary is base64
    without padding.  Of columns with the same name, the last one counts."""
    plain = frame.toDF(*[f"c{i}" for i in range(len(frame.columns))])
    fields: dict[str, Column] = {}
    for i, (name, type_) in enumerate(frame.dtypes):
        c = F.col(f"c{i}")
        if type_ in ("double", "float"):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
        elif type_ == "binary":
            c = base64_plain(c)
        fields[name] = c.alias(name)
    return plain.select(F.to_json(F.struct(*fields.values()), {"ignoreNullFields": "false"}).alias("row"))
