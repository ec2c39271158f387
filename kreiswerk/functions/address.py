"""Postal codes, street addresses, geocoder queries and attendance."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import (
    ATTENDANCE_BY_EVENT_TYPE,
    ATTENDANCE_BY_MODE,
    GERMAN_STATES,
    GERMANY_NAME,
    STREET_TOKENS,
)
from .text import blank_to_null, col, fold, fold_constant, java_quote


def extract_plz(c: Column | str) -> Column:
    """First run of exactly five digits."""
    return F.nullif(F.regexp_extract(col(c), r"(?<!\p{Nd})\p{Nd}{5}(?!\p{Nd})", 0), F.lit(""))


def looks_like_street(address: Column | str) -> Column:
    """Holds a digit or a German street word."""
    address = col(address)
    words = "|".join(java_quote(fold_constant(t)) for t in STREET_TOKENS)
    return F.coalesce(address.rlike(r"[\p{Nd}&&[\x{0}-\x{FFFF}]]") | fold(address).rlike(words), F.lit(False))


def geocode_query(address: Column | str, postal_code: Column | str, city: Column | str) -> Column:
    """Text sent to the address geocoder: address, postal code and city, country."""
    town = F.concat_ws(" ", blank_to_null(postal_code), blank_to_null(city))
    return F.concat_ws(", ", col(address), F.nullif(town, F.lit("")), F.lit(GERMANY_NAME))


def geocode_key(address: Column | str, postal_code: Column | str, city: Column | str) -> Column:
    """Cache key of a geocoder query."""
    return fold(geocode_query(address, postal_code, city))


def geocode_precision(street: Column | str, house_number: Column | str) -> Column:
    """Address with a house number, Street with only a street, else null."""
    filled = lambda c: F.coalesce(col(c), F.lit("")) != ""
    return F.when(filled(house_number), F.lit("Address")).when(filled(street), F.lit("Street"))


def assemble_address(*parts: Column | str) -> Column:
    """Non-blank parts joined by a comma; null when all are blank."""
    return F.nullif(F.concat_ws(", ", *[blank_to_null(p) for p in parts]), F.lit(""))


def attendance_from_mode(mode: Column | str) -> Column:
    return _mapped(mode, ATTENDANCE_BY_MODE)


def attendance_from_type(event_type: Column | str) -> Column:
    return _mapped(event_type, ATTENDANCE_BY_EVENT_TYPE)


def state_code(admin1: Column | str) -> Column:
    """Two-letter German state of a GeoNames division code, empty when unknown."""
    return F.coalesce(_mapped(admin1, GERMAN_STATES), F.lit(""))


def _mapped(c: Column | str, mapping: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())])
    return F.element_at(pairs, col(c))
