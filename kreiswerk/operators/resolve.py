"""Geo cascade: explicit coordinates, geocoder cache, postal code, place name, unresolved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import extract_plz
from ..sources.events import EVENT_KEY
from ..sources.geocode import lookup_cached
from .gazetteer import match_names
from .joins import key_counts, lookup_join, salted_join

# The texts the gazetteer looks at, null written as empty. match_names searches them in this order.
_TEXTS = ["_city", "_address", "_plz_text"]


def resolve_locations(
    raw: DataFrame,
    keys: DataFrame,
    postal: DataFrame,
    geocode_cache: DataFrame | None = None,
    spread_by: Sequence[str] = tuple(EVENT_KEY),
) -> DataFrame:
    """Add ``matched_place, location_status, location_precision`` and the resolved ``lat, lon``.

    ``keys`` and ``postal`` come from ``place_keys`` and ``postal_lookup``. The gazetteer is asked
    once per distinct combination of texts, and the answers are joined back with the frequent
    combinations split, since one venue or city may hold a large share of the events. Events that
    nothing resolves stay, marked as unresolved.
    """
    explicit = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    texts = raw.withColumns(
        {
            "_city": _text("city", explicit),
            "_address": _text("venue_address", explicit),
            "_plz_text": _text("postal_code", explicit),
        }
    )
    if geocode_cache is not None:
        texts = lookup_cached(texts, geocode_cache, list(spread_by))
    else:
        texts = texts.withColumn("cached", F.lit(None).cast("struct<found:boolean,lat:double,lon:double,precision:string>"))

    counts = key_counts(raw.select(*[_text(c, explicit).alias(t) for c, t in zip(("city", "venue_address", "postal_code"), _TEXTS)]), _TEXTS)
    answers = gazetteer_answers(counts.select(*_TEXTS), keys, postal)
    joined = salted_join(texts, answers, _TEXTS, "left", spread_by, counts=counts)

    place, cached = F.col("_place"), F.col("cached")
    hit = F.coalesce(cached["found"], F.lit(False))
    pick = lambda own, geocoded, listed: F.when(explicit, own).when(hit, geocoded).otherwise(listed)
    resolved = explicit | hit | place.isNotNull()
    precision = pick(
        F.lit("Address"), cached["precision"], F.when(place.isNotNull(), F.lit("City")).otherwise(F.lit("None"))
    )
    return joined.select(
        *[c for c in raw.columns if c not in ("lat", "lon")],
        pick(F.col("city"), F.col("city"), place["matched_place"]).alias("matched_place"),
        pick(F.col("lat"), cached["lat"], place["lat"]).alias("lat"),
        pick(F.col("lon"), cached["lon"], place["lon"]).alias("lon"),
        F.when(resolved, F.lit("Resolved")).otherwise(F.lit("Unresolved")).alias("location_status"),
        precision.alias("location_precision"),
    )


def gazetteer_answers(texts: DataFrame, keys: DataFrame, postal: DataFrame) -> DataFrame:
    """``_place`` (matched place, latitude, longitude) for distinct texts; misses are left out.

    The postal code comes from the postal field or, when that holds none, from the address. An
    unknown code is not retried from the other field: the names decide then, city before address.
    """
    plz = F.coalesce(extract_plz("_plz_text"), extract_plz("_address"))
    by_plz = postal.select("plz", F.struct("matched_place", "lat", "lon").alias("_by_plz"))
    coded = lookup_join(texts.withColumn("plz", plz), by_plz, ["plz"], "left", spread_by=_TEXTS)
    unmatched = coded.filter("_by_plz is null").select(*_TEXTS)
    names = match_names(unmatched, keys, _TEXTS[:2], carry=_TEXTS[2:])
    by_name = names.select(*_TEXTS, F.struct("matched_place", "lat", "lon").alias("_place"))
    known = coded.filter("_by_plz is not null").select(*_TEXTS, F.col("_by_plz").alias("_place"))
    return known.unionByName(by_name)


def _text(name: str, explicit: Column) -> Column:
    """The text, or empty for events that bring their coordinates and need no lookup."""
    return F.when(explicit, F.lit("")).otherwise(F.coalesce(F.col(name), F.lit("")))
