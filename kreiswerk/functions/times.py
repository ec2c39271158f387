"""Instants, local days and zones. The session zone must be UTC (see ``session.prepare``)."""

from __future__ import annotations

import zoneinfo
from datetime import datetime, timezone
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .fixed_values import DESKTOP_ZONES
from .text import col, fold

@lru_cache(maxsize=1)
def known_zones() -> tuple[str, ...]:
    """Zone ids of the zone database that the JVM of the session can read as well."""
    jvm = SparkSession.active()._jvm
    readable = set(jvm.java.lang.String.join(" ", jvm.java.time.ZoneId.getAvailableZoneIds()).split(" "))
    listed = zoneinfo.available_timezones() or readable
    return tuple(sorted(z for z in listed if z in readable))


def safe_zone(zone: Column | str) -> Column:
    """The zone id if it is a known one, else UTC."""
    zone = col(zone)
    usual = zone.isin("Europe/Berlin", "UTC")
    known = F.array_contains(F.split(F.lit(" ".join(known_zones())), " "), zone)
    return F.when(usual, zone).when(known, zone).otherwise(F.lit("UTC"))


def zone_id(name: Column | str) -> Column:
    """The id behind a zone name of a desktop calendar; any other name stays."""
    name = col(name)
    ids = F.create_map(*[F.lit(text) for pair in DESKTOP_ZONES.items() for text in pair])
    return F.when(name.endswith(" Time") | name.endswith(")"), F.coalesce(F.try_element_at(ids, name), name)).otherwise(name)


def default_zone(zone: Column | str) -> Column:
    """Stored zone of an event: UTC when the source names none."""
    return F.coalesce(F.nullif(col(zone), F.lit("")), F.lit("UTC"))


def local_date(start: Column | str, zone: Column | str) -> Column:
    """Calendar day of an instant in the given zone."""
    return F.to_date(F.from_utc_timestamp(col(start), safe_zone(zone)))


def parse_instant(text: Column | str) -> Column:
    """ISO date-time with offset to an instant; null when it cannot be read."""
    return F.try_to_timestamp(F.trim(col(text)))


def instant(value: datetime | str) -> Column:
    """Literal instant; a value without offset counts as UTC."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    value = value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value.astimezone(timezone.utc)
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f+00:00")).cast("timestamp")


def not_ended(start: Column | str, end: Column | str, now: datetime | str) -> Column:
    """Keep events whose end, or start when there is no end, is not before ``now``."""
    return F.coalesce(col(end), col(start)) >= instant(now)


def dedupe_key(title: Column | str, start: Column | str, zone: Column | str, city: Column | str) -> Column:
    """Folded title, local day and folded city."""
    return F.concat_ws(
        "|",
        fold(title),
        F.date_format(local_date(start, zone), "yyyy-MM-dd"),
        F.coalesce(fold(city), F.lit("")),
    )
