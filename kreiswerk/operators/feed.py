"""Calendar feeds rendered from search results."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col
from ..functions.times import instant
from ..functions.urls import absolute_or_null, feed_uid, utc_stamp

_EOL = "\r\n"


def feed_name(lat: Column, lon: Column, radius_km: Column, label: str = "Events") -> Column:
    """Calendar name: label, radius and centre, without trailing zeros."""
    short = lambda c, digits: F.regexp_replace(F.format_string(f"%.{digits}f", c), r"\.?0+$", "")
    return F.concat(
        F.lit(f"{label} — "), short(radius_km, 1), F.lit(" km around "), short(lat, 3), F.lit(","), short(lon, 3)
    )


def feed_entry(domain: str, stamp: datetime | str) -> Column:
    """VEVENT text of an event row."""
    lines = [
        F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:"), feed_uid("dedupe_key", domain)),
        F.concat(F.lit("DTSTAMP:"), utc_stamp(instant(stamp))),
        F.concat(F.lit("DTSTART:"), utc_stamp("start_utc")),
        F.concat(F.lit("DTEND:"), utc_stamp("end_utc")),
        F.concat(F.lit("SUMMARY:"), _escaped("title")),
        F.concat(F.lit("DESCRIPTION:"), _escaped("description")),
        F.concat(F.lit("LOCATION:"), _escaped(F.coalesce("venue_name", "city"))),
        F.concat(F.lit("URL:"), absolute_or_null("url")),
        F.lit("END:VEVENT"),
    ]
    return F.concat_ws(_EOL, *[_folded(line) for line in lines])


def render_feeds(
    page: DataFrame, searches: DataFrame, stamp: datetime | str, domain: str = "events.invalid", label: str = "Events"
) -> DataFrame:
    """``search_id, feed`` for every saved search, empty calendars included.

    ``page`` comes from ``first_matches``, which bounds the entries of one feed by the page size.
    """
    entries = (
        page.select("search_id", "position", feed_entry(domain, stamp).alias("entry"))
        .groupBy("search_id")
        .agg(F.array_sort(F.collect_list(F.struct("position", "entry"))).alias("e"))
    )
    head = F.concat_ws(
        _EOL,
        F.lit("BEGIN:VCALENDAR"),
        F.lit("VERSION:2.0"),
        F.lit("PRODID:-//kreiswerk//EN"),
        F.lit("METHOD:PUBLISH"),
        _folded(F.concat(F.lit("X-WR-CALNAME:"), _escaped(feed_name(F.col("lat"), F.col("lon"), F.col("radius_km"), label)))),
    )
    joined = searches.select("search_id", head.alias("head")).join(entries, "search_id", "left")
    body = F.concat_ws(_EOL, F.col("head"), F.col("e.entry"), F.lit("END:VCALENDAR"), F.lit(""))
    return joined.select("search_id", body.alias("feed"))


def _escaped(text: Column | str) -> Column:
    """Text value with backslash, separators and line breaks escaped."""
    return F.regexp_replace(F.regexp_replace(col(text), r"([\\;,])", r"\\$1"), "\r\n|\r|\n", r"\\n")


def _folded(line: Column) -> Column:
    """Content line cut so that no piece exceeds 75 bytes; a character takes four at most."""
    cut = lambda n: F.regexp_replace(line, f"(.{{{n}}})(?=.)", f"$1{_EOL} ")
    return F.when(F.octet_length(line) <= 75, line).when(line.rlike(r"[^\x00-\x7F]"), cut(18)).otherwise(cut(74))
