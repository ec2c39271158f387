"""Shape of the event tables and the adapters that fill them."""

from __future__ import annotations

from pyspark.sql import DataFrame

# What every adapter delivers.
RAW_SCHEMA = (
    "source_id string, source_event_id string, title string, description string, start_utc timestamp, "
    "end_utc timestamp, time_zone_id string, venue_name string, venue_address string, city string, "
    "postal_code string, lat double, lon double, attendance_hint string, url string, feed_pos bigint"
)

# The same as fields of a struct.
RAW_FIELDS = RAW_SCHEMA.replace(" ", ": ").replace(",:", ",")

# What the store keeps.
EVENT_SCHEMA = (
    "id string, source_id string, source_event_id string, title string, description string, "
    "start_utc timestamp, end_utc timestamp, time_zone_id string, venue_name string, venue_address string, "
    "city string, postal_code string, lat double, lon double, location_status string, "
    "location_precision string, attendance string, url string, tags array<string>, "
    "first_seen_utc timestamp, last_seen_utc timestamp, dedupe_key string"
)


def names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


RAW_COLUMNS = names(RAW_SCHEMA)
EVENT_COLUMNS = names(EVENT_SCHEMA)
EVENT_KEY = ["source_id", "source_event_id"]


def raw_events(df: DataFrame) -> DataFrame:
    return df.select(*RAW_COLUMNS)
