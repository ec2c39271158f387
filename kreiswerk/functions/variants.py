"""Strict reading of JSON values held in VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_string(value: Column, path: str) -> Column:
    """Text at ``path``; null unless the JSON value there is a string."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(value, path, "string"))


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def is_array(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))


def has_field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant").isNotNull()
