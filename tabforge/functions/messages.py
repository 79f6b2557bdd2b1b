"""JSON message decoding as column expressions, the same in batch and stream.

A message becomes one of three kinds: ``object`` (its fields are columns),
``value`` (any other JSON) or ``raw`` (text that is not JSON).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def message_text(c: Column, data_type: T.DataType) -> Column:
    """Message payload as valid text, from text or bytes."""
    return F.make_valid_utf8(c.cast("string")) if isinstance(data_type, T.BinaryType) else c


def with_json(df: DataFrame, text: Column, out: str = "__json") -> DataFrame:
    """Add the text as ``__text`` and its variant, null unless all of it is one JSON value.

    Spark's parser stops after the first value.  The text is therefore parsed
    as the first item of a two-item array whose second item is the text's own
    hash: anything left over breaks the array or displaces the hash.  Steps
    that are used twice are columns of their own, so each runs once per row.

    Of repeated keys the last counts.  Spark has that as a setting of the session, which is set here.
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", True)
    mark = F.xxhash64("__text")
    pair = F.try_parse_json(F.concat(F.lit("["), "__text", F.lit(","), F.col("__mark").cast("string"), F.lit("]")))
    whole = F.try_variant_get("__pair", "$[1]", "bigint") == F.col("__mark")
    return (
        df.withColumn("__text", text).withColumn("__mark", mark).withColumn("__pair", pair)
        .withColumn(out, F.when(whole, F.try_variant_get("__pair", "$[0]", "variant")))
        .drop("__mark", "__pair")
    )


def leading_char(text: Column) -> Column:
    """First character after JSON white space."""
    return F.substring(F.ltrim(text, F.lit(" \t\n\r")), 1, 1)


def _value_text(v: Column, text: Column | None = None) -> Column:
    """JSON text of a variant; a bare string is unquoted and JSON null is null.

    ``text`` is the message itself: a bare number keeps all digits that it has there.
    """
    if text is not None:
        bare = F.trim(text, F.lit(" \t\n\r"))
        return F.when(bare.rlike("^-?[0-9]+$"), bare).otherwise(_value_text(v))
    return F.when(~F.is_variant_null(v),
                  F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))


def parse_messages(df: DataFrame, column: str, fields: Mapping[str, str], *,
                   prefix: str = "") -> DataFrame:
    """Replace a message column by ``kind``, the declared fields, ``value`` and ``raw``.

    ``fields`` maps JSON keys to Spark types; a missing or ill-typed key is null.
    A null message keeps kind ``raw`` with null text; JSON ``null`` is a value.
    """
    text = message_text(F.col(column), df.schema[column].dataType)
    decoded = with_json(df, text).withColumn("__head", leading_char(F.col("__text")))
    kind = _kind(F.col("__json"), F.col("__head"))
    obj = F.when(F.col("kind") == "object", F.col("__json"))
    out = decoded.withColumn("kind", kind)
    keep = [c for c in df.columns if c != column]
    return out.select(
        *keep,
        "kind",
        *[F.try_variant_get(obj, _key_path(k), t).alias(prefix + k) for k, t in fields.items()],
        F.when(F.col("kind") == "value", _value_text(F.col("__json"), F.col("__text"))).alias("value"),
        F.when(F.col("kind") == "raw", F.col("__text")).alias("raw"),
    )


def _kind(parsed: Column, head: Column) -> Column:
    return F.when(parsed.isNull(), "raw").when(head == "{", "object").otherwise("value")


def _key_path(key: str) -> str:
    """Path of a top-level key; a variant path has no escapes, only two quotes."""
    if "'" not in key:
        return f"$['{key}']"
    if '"' not in key:
        return f'$["{key}"]'
    raise ValueError(f"key {key!r} holds both kinds of quotes")


def explode_messages(df: DataFrame, column: str, fields: Mapping[str, str]) -> DataFrame:
    """One row per record: a JSON list yields its items, all else one row.

    ``position`` is the item's place in its list, 0 for single records.  An
    empty list yields no row.
    """
    text = message_text(F.col(column), df.schema[column].dataType)
    keep = [c for c in df.columns if c != column]
    is_list = leading_char(F.col("__text")) == "["
    decoded = with_json(df, text).withColumn(
        "__items", F.when(is_list, F.try_variant_get("__json", "$", "array<variant>")))
    single = F.array(F.col("__json"))
    items = F.when(F.col("__items").isNotNull(), F.col("__items")).otherwise(single)
    rows = decoded.select(*keep, "__text", "__json", F.posexplode(items).alias("position", "__item"))
    is_object = F.schema_of_variant("__item").startswith("OBJECT")
    kind = (F.when(F.col("__json").isNull(), "raw").when(is_object, "object").otherwise("value"))
    rows = rows.withColumn("kind", kind)
    obj = F.when(F.col("kind") == "object", F.col("__item"))
    return rows.select(
        *keep, "position", "kind",
        *[F.try_variant_get(obj, _key_path(k), t).alias(k) for k, t in fields.items()],
        F.when(F.col("kind") == "value", _value_text(F.col("__item"))).alias("value"),
        F.when(F.col("kind") == "raw", F.col("__text")).alias("raw"),
    )


def extract_records(df: DataFrame, column: str, fields: Mapping[str, str],
                    records_path: str = "") -> DataFrame:
    """Rows of an API payload.

    A list yields its items.  An object that has the top-level key
    ``records_path`` yields that key's list, or its value as a single record.
    Any other payload is itself the record.
    """
    text = message_text(F.col(column), df.schema[column].dataType)
    keep = [c for c in df.columns if c != column]
    payload = with_json(df, text).withColumn("__head", leading_char(F.col("__text")))
    whole = F.try_variant_get("__json", "$", "array<variant>")
    if records_path:
        inner = F.try_variant_get(F.col("__json"), _key_path(records_path), "variant")
        has_inner = (F.col("__head") == "{") & inner.isNotNull()
        nested = F.coalesce(F.try_variant_get(inner, "$", "array<variant>"), F.array(inner))
    else:
        has_inner, nested = F.lit(False), F.lit(None).cast("array<variant>")
    items = (F.when(F.col("__head") == "[", whole).when(has_inner, nested)
             .otherwise(F.array(F.col("__json"))))
    rows = payload.select(*keep, F.posexplode(items).alias("position", "__item"))
    return rows.select(
        *keep, "position",
        *[F.try_variant_get("__item", _key_path(k), t).alias(k) for k, t in fields.items()],
    )
