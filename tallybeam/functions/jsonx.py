"""JSON helpers: strict parsing, scalar-only extraction, tolerant casts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spark's reader is more lenient than the JSON standard by default.
STRICT_OPTIONS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def text_struct(keys) -> T.StructType:
    """A parse schema with every key read as text; nested objects keep their JSON text."""
    return T.StructType([T.StructField(k, T.StringType()) for k in keys])


def strict_object(value: Column, fields: T.StructType, kinds: T.StructType) -> tuple[Column, Column]:
    """Two parses that together accept exactly one JSON object and nothing around it.

    Spark's parser stops at the end of the first value, so text after it goes unseen. Parsing
    ``[value]`` exposes everything but text that closes the array early, and parsing
    ``{"m":value,"z":1}`` exposes everything but text that closes the object early; no text can
    do both. The first parse yields the fields, the second tells objects from scalars (``kinds``
    holds one struct per key).
    """
    items = F.from_json(F.concat(F.lit("["), value, F.lit("]")), T.ArrayType(fields), STRICT_OPTIONS)
    shape = T.StructType([T.StructField("m", kinds), T.StructField("z", T.IntegerType())])
    probe = F.from_json(F.concat(F.lit('{"m":'), value, F.lit(',"z":1}')), shape, STRICT_OPTIONS)
    return items, probe


def _member(key: str) -> str:
    """A path to a top-level key that may contain dots."""
    return f"$['{key}']"


def variant_kind(json_text: Column, path: str) -> Column:
    """Type name of the value at ``path``: STRING, BIGINT, OBJECT<..>, ARRAY<..> and so on."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(json_text), path, "variant"))


def scalar_only(text: Column, json_text: Column, path: str) -> Column:
    """Keep ``text`` unless it is the JSON text of an object or array.

    A string may itself hold JSON, so text that looks like an object is checked against the
    parsed value; other rows, NULLs among them, never pay for that second parse.
    """
    nested = text.startswith("{") | text.startswith("[")
    return F.when(text.isNull() | ~nested, text).when(variant_kind(json_text, path) == "STRING", text)


def json_scalar(json_text: Column, path: str) -> Column:
    """Text of the scalar at ``path``; NULL for objects, arrays, JSON null and bad JSON."""
    return scalar_only(F.get_json_object(json_text, path), json_text, path)


def key_scalar(parsed: Column, json_text: Column, key: str) -> Column:
    """Like :func:`json_scalar` for a top-level key already read by ``from_json``.

    Text that looks like an object may be a string that holds JSON. In compact JSON the sign after the key tells: inside a
    string a quote is escaped, so ``"key":"`` and ``"key":{`` stand in the text as keys only. Where just one of them is
    there, it decides; only rows with both (a deeper object has the key too) or none (spaces) are parsed once more.
    """
    text = parsed.getField(key)
    nested = text.startswith("{") | text.startswith("[")
    as_string = json_text.contains(f'"{key}":"')
    as_nested = json_text.contains(f'"{key}":{{') | json_text.contains(f'"{key}":[')
    return (
        F.when(text.isNull() | ~nested, text)
        .when(as_string & ~as_nested, text)
        .when(as_nested & ~as_string, F.lit(None).cast("string"))
        .when(variant_kind(json_text, _member(key)) == "STRING", text)
    )


def as_bigint(text: Column) -> Column:
    """Integer from JSON scalar text. ``7.0`` and ``1e3`` are whole numbers in JSON, so they count."""
    number = text.try_cast("double")
    whole = F.when(number == F.floor(number), number.try_cast("bigint"))
    return F.coalesce(text.try_cast("bigint"), F.when(text.isNotNull(), whole))


def as_double(text: Column) -> Column:
    return text.try_cast("double")


def as_boolean(text: Column) -> Column:
    lowered = F.lower(text)
    return F.when(lowered == "true", F.lit(True)).when(lowered == "false", F.lit(False))


def json_quote(text: Column) -> Column:
    """A string as a JSON string literal."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - F.lit(2))


def with_payload_keys(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Add one text column per payload key, all from a single parse of the payload."""
    parsed = df.withColumn("_payload", F.from_json("jsonPayload_json", text_struct(keys.values()), STRICT_OPTIONS))
    picked = {
        name: key_scalar(F.col("_payload"), F.col("jsonPayload_json"), key) for name, key in keys.items()
    }
    return parsed.withColumns(picked).drop("_payload")
