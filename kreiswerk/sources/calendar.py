"""Calendar feeds: entries of an iCalendar text and their occurrences."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, let
from ..functions.times import instant, safe_zone, zone_id
from ..functions.urls import occurrence_id
from ..operators.joins import lookup_join
from ..operators.recurrence import occurrence_starts, rule_problem
from ..operators.rows import computed
from ..session import write_through

_STAMP = r"^([0-9]{8})(?:T([0-9]{6})(Z)?)?"
_LINE = r'(?s)^[A-Za-z0-9-]+((?:;(?:"[^"]*"|[^":])*)?):(.*)$'
_PROPERTIES = ("UID", "SUMMARY", "DESCRIPTION", "LOCATION", "URL", "GEO", "DTSTART", "DTEND", "DURATION", "RRULE", "RECURRENCE-ID")
_REPEATED = ("RDATE", "EXDATE")


def calendar_entries(feeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """VEVENTs with a UID and a start, and the feeds that are no calendar.

    ``feeds`` has ``source_id, url, body``. Dates and times stay in the wall clock of the entry;
    ``zone`` is null for floating times and whole days, which count as UTC. ``replaces`` is the start
    of the occurrence an entry stands for, null for most.
    """
    text = F.regexp_replace(F.regexp_replace("body", "\r\n?", "\n"), "\n[ \t]", "")
    unfolded = feeds.select("source_id", F.col("url").alias("feed_url"), text.alias("text"))
    calendar = F.coalesce(F.col("text").rlike(r"(?i)BEGIN:VCALENDAR"), F.lit(False))
    errors = unfolded.filter(~calendar).select(
        "source_id", F.col("feed_url").alias("url"), F.lit("feed is empty or not a calendar").alias("error")
    )

    found = F.regexp_extract_all("text", F.lit(r"(?is)BEGIN:VEVENT\n(.*?)END:VEVENT"), F.lit(1))
    blocks = F.when(F.col("text").rlike(r"(?i)BEGIN:VCALENDAR"), found)
    block = F.regexp_replace(F.col("block"), r"(?is)BEGIN:(VALARM|X-[A-Z0-9-]+)\n.*?END:\1", "")
    entries = (
        computed(unfolded, "source_id", "feed_url", blocks.alias("blocks"))
        .select("source_id", "feed_url", F.posexplode("blocks").alias("feed_pos", "block"))
        .select("source_id", "feed_url", "feed_pos", F.split(block, "\n").alias("lines"))
        .withColumn("names", F.transform("lines", _property_name))
        .select("source_id", "feed_url", "feed_pos", *map(_first_line, _PROPERTIES), *map(_all_lines, _REPEATED))
    )
    start, end, replaced = _stamp("DTSTART"), _stamp("DTEND"), _stamp("RECURRENCE-ID")
    replaced_zone = safe_zone(F.coalesce(replaced["zone"], start["zone"]))
    columns = [
        "source_id",
        "feed_url",
        F.col("feed_pos").cast("bigint").alias("feed_pos"),
        _value("UID").alias("uid"),
        _text("SUMMARY").alias("summary"),
        _text("DESCRIPTION").alias("description"),
        _text("LOCATION").alias("location"),
        _value("URL").alias("entry_url"),
        F.try_element_at(F.split(_value("GEO"), ";"), F.lit(1)).try_cast("double").alias("lat"),
        F.try_element_at(F.split(_value("GEO"), ";"), F.lit(2)).try_cast("double").alias("lon"),
        start["wall"].alias("start_wall"),
        start["zone"].alias("zone"),
        start["whole_day"].alias("whole_day"),
        end["wall"].alias("end_wall"),
        end["zone"].alias("end_zone"),
        _duration(_value("DURATION")).alias("duration"),
        F.upper(_value("RRULE")).alias("rule"),
        _stamps("RDATE", start["zone"]).alias("extra"),
        _stamps("EXDATE", start["zone"]).alias("excluded"),
        F.when(F.col("RECURRENCE-ID").isNotNull(), _to_instant(replaced["wall"], replaced_zone)).alias("replaces"),
    ]
    return computed(entries, *columns).filter("uid is not null and start_wall is not null"), errors


def extract_calendar_events(
    feeds: DataFrame, now: datetime | str, months: int = 12, overrides: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Like :func:`calendar_events`, with feeds and entries that failed in one table."""
    events, errors, unsupported = calendar_events(feeds, now, months, overrides)
    return events, errors.unionByName(unsupported)


def calendar_events(
    feeds: DataFrame, now: datetime | str, months: int = 12, overrides: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Occurrences that are not over at ``now`` and start within ``months``, feeds that are no calendar,
    and entries whose rule is not supported; the latter leave the other entries of their feed alone.

    A recurring entry is expanded in its own wall clock, so it keeps its local hour across a change
    of daylight saving time. Entries with a rule outside the supported subset are reported.

    An entry with RECURRENCE-ID adds its occurrence. With ``overrides`` it also takes the place of the
    one its feed's entries of the same UID have at that instant, wherever it moved to; several such
    entries for one instant all stay.
    """
    entries, errors = calendar_entries(feeds)
    if overrides:
        entries = write_through(entries, "calendar-entries")
    problem = rule_problem("rule")
    unsupported = entries.withColumn("problem", problem).filter("problem is not null").select(
        "source_id",
        F.col("feed_url").alias("url"),
        F.concat(F.lit("entry "), "uid", F.lit(": "), "problem").alias("error"),
    )
    until = F.add_months(instant(now).cast("date"), months)
    starts = F.when(problem.isNull(), occurrence_starts("start_wall", "rule", "zone", "extra", "excluded", until))
    zone, end_zone = safe_zone("zone"), safe_zone("end_zone")
    first_start, first_end = _to_instant("start_wall", zone), _to_instant("end_wall", end_zone)
    length = (
        F.when(F.col("end_wall").isNotNull(), F.unix_micros(first_end) - F.unix_micros(first_start))
        .when(F.col("duration").isNotNull(), F.col("duration") * 1_000_000)
        .when(F.col("whole_day"), F.lit(86_400_000_000))
        .otherwise(F.lit(0))
    )
    occurrences = (
        computed(entries, "*", length.alias("length"), starts.alias("starts"))
        .withColumn("occurrence", F.explode("starts"))
        .withColumn("start_utc", _to_instant("occurrence", zone))
        .withColumn("end_utc", F.timestamp_micros(F.unix_micros("start_utc") + F.col("length")))
    )
    window_end = instant(now) + F.make_interval(months=F.lit(months))
    if overrides:
        moved = entries.filter("replaces is not null").withColumnRenamed("replaces", "_at")
        by_instant = occurrences.withColumn("_at", F.when(F.col("replaces").isNull(), F.col("start_utc")))
        on = ["source_id", "feed_url", "uid", "_at"]
        occurrences = lookup_join(by_instant, moved.select(*on).distinct(), on, "left_anti", ["feed_pos", "start_utc"])
    kept = occurrences.filter((F.col("end_utc") >= instant(now)) & (F.col("start_utc") < window_end))
    none = F.lit(None).cast("string")
    events = kept.select(
        "source_id",
        occurrence_id("uid", "start_utc").alias("source_event_id"),
        F.coalesce("summary", F.lit("")).alias("title"),
        "description",
        "start_utc",
        "end_utc",
        F.col("zone").alias("time_zone_id"),
        none.alias("venue_name"),
        F.col("location").alias("venue_address"),
        none.alias("city"),
        none.alias("postal_code"),
        "lat",
        "lon",
        none.alias("attendance_hint"),
        F.coalesce("entry_url", "feed_url").alias("url"),
        "feed_pos",
        F.col("feed_url").alias("page_url"),
    )
    return events, errors, unsupported


# --- properties of one entry -----------------------------------------------------------------


def _property_name(line: Column) -> Column:
    return F.upper(F.substring_index(F.substring_index(line, ":", 1), ";", 1))


def _first_line(name: str) -> Column:
    """First line of a property, null when the entry has none."""
    at = F.nullif(F.array_position("names", name), F.lit(0)) - 1
    return F.get("lines", at.cast("int")).alias(name)


def _all_lines(name: str) -> Column:
    """All lines of a property that may repeat."""
    found = F.filter("lines", lambda line: _property_name(line) == name)
    return F.when(F.array_contains("names", name), found).otherwise(F.array().cast("array<string>")).alias(name)


def _line(name: str, group: int) -> Column:
    return F.regexp_extract(name, _LINE, group)


def _value(name: str) -> Column:
    return F.nullif(F.trim(_line(name, 2)), F.lit(""))


def _text(name: str) -> Column:
    """Text value with its escapes resolved."""

    def unescaped(value: Column) -> Column:
        plain = F.transform(
            F.split(value, r"\\\\"),
            lambda part: F.regexp_replace(F.regexp_replace(part, r"\\[nN]", "\n"), r"\\([,;:\"])", "$1"),
        )
        return F.when(value.contains("\\"), F.array_join(plain, "\\")).otherwise(value)

    return let(_line(name, 2), unescaped)


def _stamp(name: str) -> Column:
    """Wall-clock time, zone and whole-day flag of a date or date-time property."""
    zone = F.regexp_extract(_line(name, 1), r'(?i);TZID="?([^";:]+)"?', 1)
    return let(
        F.struct(_line(name, 2).alias("value"), zone.alias("zone")),
        lambda v: F.struct(
            _wall(v["value"]).alias("wall"),
            F.when(F.regexp_extract(v["value"], _STAMP, 3) == "Z", F.lit("UTC"))
            .otherwise(zone_id(F.nullif(v["zone"], F.lit(""))))
            .alias("zone"),
            (~v["value"].contains("T")).alias("whole_day"),
        ),
    )


def _wall(value: Column) -> Column:
    digits = F.regexp_extract(value, _STAMP, 1)
    clock = F.rpad(F.regexp_extract(value, _STAMP, 2), 6, "0")
    return F.try_to_timestamp(F.concat(digits, clock), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def _stamps(name: str, zone: Column) -> Column:
    """Times of all lines of a list property, in the wall clock of the entry's ``zone``.

    A value in UTC or with a zone of its own is an instant; others are wall-clock times already.
    """
    entry_zone = F.coalesce(zone, F.lit("UTC"))

    def stamp(value: Column, tzid: Column) -> Column:
        own = F.when(value.rlike("^[0-9]{8}T[0-9]{6}Z"), F.lit("UTC")).when(tzid != "", safe_zone(zone_id(tzid)))
        moved = F.from_utc_timestamp(F.to_utc_timestamp(_wall(value).cast("timestamp"), own), entry_zone)
        return F.when(own.isNull(), _wall(value)).otherwise(moved.cast("timestamp_ntz"))

    def stamps(line: Column) -> Column:
        tzid = F.regexp_extract(F.regexp_extract(line, _LINE, 1), r'(?i);TZID="?([^";:]+)', 1)
        return F.transform(F.split(F.regexp_extract(line, _LINE, 2), ","), lambda value: stamp(value, tzid))

    return F.array_compact(F.flatten(F.transform(name, stamps)))


def _duration(value: Column) -> Column:
    """Seconds of an iCalendar duration."""
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(value, rf"([0-9]+){unit}", 1), F.lit("")).cast("bigint"), F.lit(0))
    return F.when(
        value.rlike(r"^\+?P"),
        part("W") * 604_800 + part("D") * 86_400 + part("H") * 3600 + part("M") * 60 + part("S"),
    )


def _to_instant(wall: Column | str, zone: Column) -> Column:
    return F.to_utc_timestamp(col(wall).cast("timestamp"), zone)
