"""Standardisation of nested payloads: expressions that are made by walking a schema, so that they stay column expressions
whatever structs, arrays and maps a record has."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text

# Keys whose values are addresses or ids, and keys that belong to a person.
ADDRESS_KEYS, ADDRESS_ENDING = ("images", "externalids"), "url"
PERSONAL_KEYS = ("licenseNo", "licenseExpiresAt")

Leaf = Callable[[Column], Column]


def is_address(key: str) -> bool:
    return key.lower() in ADDRESS_KEYS or key.lower().endswith(ADDRESS_ENDING)


def walk(kind: T.DataType, value: Column, leaf: Leaf, key: str = "") -> Column:
    """The same value with ``leaf`` applied to every string in it, but for those under the key of an address."""
    if isinstance(kind, T.StringType):
        return value if is_address(key) else leaf(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: walk(kind.elementType, x, leaf, key))
    if isinstance(kind, T.StructType):
        fields = [walk(f.dataType, value[f.name], leaf, f.name).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if isinstance(kind, T.MapType):
        if is_address(key):
            return value
        address = lambda k: F.lower(k).isin(*ADDRESS_KEYS) | F.endswith(F.lower(k), F.lit(ADDRESS_ENDING))
        return F.transform_values(value, lambda k, v: F.when(address(k.cast("string")), v).otherwise(walk(kind.valueType, v, leaf)))
    return value


def compacted(kind: T.DataType, value: Column) -> Column:
    """The value without what is missing: strings are trimmed, and empty strings, arrays, structs and maps become null.

    Elements and entries that become null are left out of arrays and maps.
    """
    if isinstance(kind, T.StringType):
        return text.non_empty(value)
    if isinstance(kind, T.ArrayType):
        kept = F.filter(F.transform(value, lambda x: compacted(kind.elementType, x)), lambda x: x.isNotNull())
        return F.when(F.size(kept) > 0, kept)
    if isinstance(kind, T.MapType):
        kept = F.map_filter(F.transform_values(value, lambda _, v: compacted(kind.valueType, v)), lambda _, v: v.isNotNull())
        return F.when(F.size(kept) > 0, kept)
    if isinstance(kind, T.StructType):
        fields = [compacted(f.dataType, value[f.name]).alias(f.name) for f in kind.fields]
        some = F.coalesce(*(F.when(f.isNotNull(), F.lit(True)) for f in fields), F.lit(False)) if fields else F.lit(False)
        return F.when(some, F.struct(*fields))
    return value


def canonical(kind: T.DataType, value: Column) -> Column:
    """The text under which values are compared for agreement: JSON of nested ones, else without white space in lower case; null is empty."""
    nested = isinstance(kind, (T.ArrayType, T.StructType, T.MapType))
    shown = F.to_json(value) if nested else text.canon(value if isinstance(kind, T.StringType) else value.cast("string"))
    return F.coalesce(shown, F.lit(""))


def redacted(records: DataFrame) -> DataFrame:
    """Records without personal data, at any depth, and compacted.

    Mobile numbers and free mail leave every text; a phone loses its mobile numbers and an email of a free host goes; fields
    that belong to a person are dropped. Addresses and ids stay as they are. Columns that are no text stay.
    """
    kept = []
    for f in records.schema.fields:
        if f.name in PERSONAL_KEYS:
            continue
        value = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType) and f.name in ("phone", "email"):
            value = text.redact_phone(value) if f.name == "phone" else text.redact_email(value)
        else:
            value = walk(f.dataType, value, text.redact_text, f.name)
        kept.append(value.alias(f.name))
    clean = records.select(*kept)
    return clean.select(*(compacted(f.dataType, F.col(f"`{f.name}`")).alias(f.name) for f in clean.schema.fields))
