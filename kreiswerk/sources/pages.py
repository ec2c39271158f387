"""Events embedded in HTML pages: page-state JSON and schema.org JSON-LD."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import assemble_address, attendance_from_mode, attendance_from_type
from ..functions.text import blank_to_null, let
from ..functions.times import parse_instant
from ..functions.urls import path_tail
from ..functions.variants import has_field, is_array, is_object, strict_string
from ..operators.rows import computed
from .events import RAW_FIELDS

# Comments are matched as well, so that a script tag quoted inside one is passed over.
_SCRIPTS = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>"
_ID = r"""(?is)(?:^|\s)id\s*=\s*["']?__NEXT_DATA__["']?(?:\s|$)"""
_TYPE = r"""(?is)(?:^|\s)type\s*=\s*["']?{}["']?(?:\s|$)"""
_STATE_SCHEMA = "props struct<pageProps:struct<__APOLLO_STATE__:map<string,variant>>>"
_KEY = "Event:"


def first_script(html: Column, *attributes: str) -> Column:
    """Text of the first script element whose attributes match all patterns; null when none does."""
    scripts = F.filter(F.regexp_extract_all(html, F.lit(_SCRIPTS), F.lit(0)), lambda e: ~e.startswith("<!--"))

    def wanted(script: Column) -> Column:
        tag = F.substring_index(F.substring(script, len("<script") + 1, 2**31 - 1), ">", 1)
        test = tag.rlike(attributes[0])
        for pattern in attributes[1:]:
            test = test & tag.rlike(pattern)
        return test

    def text(script: Column) -> Column:
        start = F.instr(script, ">") + 1
        stop = F.length(script) - F.length(F.substring_index(script, "<", -1))  # where the closing tag starts
        return script.substr(start, stop - start)

    return let(F.get(F.filter(scripts, wanted), F.lit(0)), text)


# --- page state ----------------------------------------------------------------------------


def state_script(body: Column) -> Column:
    """Text of the page-state script; null when the page has none."""
    return F.when(
        body.contains("__NEXT_DATA__"), first_script(body, _ID, _TYPE.format("application/json"))
    )


def entity_map(script: Column) -> Column:
    """Flat map of entities in a page-state script; null when there is none."""
    return F.from_json(script, _STATE_SCHEMA)["props"]["pageProps"]["__APOLLO_STATE__"]


def state_rows(pages: DataFrame) -> DataFrame:
    """``pages`` (``source_id, url, body`` and more) without the body, with their ``rows`` and ``error``.

    Reads pages that embed a flat map of entities in ``__NEXT_DATA__``; each is read once. ``error`` names
    what failed: no script, unreadable JSON or no entity map. A page whose map holds no event is a success
    without rows. Venues are looked up in the map of the same page, so nothing is shuffled.
    """
    others = [c for c in pages.columns if c != "body"]
    scripts = computed(pages, *others, state_script(F.col("body")).alias("_script"))
    state = computed(scripts, *others, "_script", entity_map(F.col("_script")).alias("_state"))
    message = (
        F.when(F.col("_script").isNull(), F.lit("no __NEXT_DATA__ script found"))
        .when(F.try_parse_json("_script").isNull(), F.lit("__NEXT_DATA__ is not valid JSON"))
        .otherwise(F.lit("__NEXT_DATA__ has no props.pageProps.__APOLLO_STATE__"))
    )
    entries = F.transform(
        F.map_entries("_state"), lambda e, i: F.struct(i.alias("pos"), e["key"].alias("key"), e["value"].alias("item"))
    )
    placed = F.transform(
        F.filter(entries, lambda e: e["key"].startswith(_KEY)),
        lambda e: e.withField("venue", F.try_element_at(F.col("_state"), strict_string(e["item"], "$.venue.__ref"))),
    )
    rows = F.filter(F.transform(placed, _state_event), lambda row: row["start_utc"].isNotNull())
    none = F.array().cast(f"array<struct<{RAW_FIELDS}>>")
    error = F.when(F.col("_state").isNull(), message)
    return computed(state, *others, F.coalesce(rows, none).alias("rows"), error.alias("error"))


def _state_event(entry: Column) -> Column:
    item, venue = entry["item"], entry["venue"]
    columns = {
        "source_id": F.col("source_id"),
        "source_event_id": F.substring(entry["key"], len(_KEY) + 1, 2**31 - 1),
        "title": F.coalesce(strict_string(item, "$.title"), F.lit("")),
        "description": strict_string(item, "$.description"),
        "start_utc": parse_instant(strict_string(item, "$.dateTime")),
        "end_utc": parse_instant(strict_string(item, "$.endTime")),
        "time_zone_id": F.lit(None).cast("string"),
        "venue_name": strict_string(venue, "$.name"),
        "venue_address": strict_string(venue, "$.address"),
        "city": strict_string(venue, "$.city"),
        "postal_code": F.lit(None).cast("string"),
        "lat": F.lit(None).cast("double"),
        "lon": F.lit(None).cast("double"),
        "attendance_hint": attendance_from_type(strict_string(item, "$.eventType")),
        "url": F.coalesce(strict_string(item, "$.eventUrl"), F.col("url")),
        "feed_pos": entry["pos"].cast("bigint"),
    }
    return F.struct(*[value.alias(name) for name, value in columns.items()])


def extract_state_events(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of pages that embed a map of entities, and the pages that failed, see ``state_rows``.

    ``pages`` has ``source_id, url, body``.
    """
    parsed = state_rows(pages.select("source_id", "url", "body"))
    events = parsed.select(F.col("url").alias("page_url"), F.explode("rows").alias("row"))
    return events.select("row.*", "page_url"), parsed.filter("error is not null").select("source_id", "url", "error")


# One row per page, for callers that keep what they parsed.
extract_state_events.page_rows = state_rows


# --- JSON-LD -------------------------------------------------------------------------------


def extract_jsonld_events(pages: DataFrame, zone: str = "Europe/Berlin") -> DataFrame:
    """Events of pages with one schema.org Event in a JSON-LD script.

    Pages without the script, with unreadable JSON, without a name or a readable start are left
    out; that is not a failure of the source. ``zone`` is the zone of the pages, which give only
    numeric offsets.
    """
    script = F.when(
        F.col("body").contains("ld+json"), first_script(F.col("body"), _TYPE.format(r"application/ld\+json"))
    )
    root, spot = F.col("root"), F.col("spot")
    roots = computed(pages, "source_id", "url", F.try_parse_json(script).alias("root"))
    parsed = computed(roots.filter("root is not null"), "source_id", "url", "root", _place(root).alias("spot"))
    street, locality, plz = (
        strict_string(spot, f"$.address.{name}") for name in ("streetAddress", "addressLocality", "postalCode")
    )
    columns = [
        "source_id",
        path_tail("url").alias("source_event_id"),
        blank_to_null(strict_string(root, "$.name")).alias("title"),
        strict_string(root, "$.description").alias("description"),
        parse_instant(strict_string(root, "$.startDate")).alias("start_utc"),
        parse_instant(strict_string(root, "$.endDate")).alias("end_utc"),
        F.lit(zone).alias("time_zone_id"),
        strict_string(spot, "$.name").alias("venue_name"),
        assemble_address(street, plz, locality).alias("venue_address"),
        locality.alias("city"),
        plz.alias("postal_code"),
        F.lit(None).cast("double").alias("lat"),
        F.lit(None).cast("double").alias("lon"),
        attendance_from_mode(strict_string(root, "$.eventAttendanceMode")).alias("attendance_hint"),
        "url",
        F.lit(0).cast("bigint").alias("feed_pos"),
        F.col("url").alias("page_url"),
    ]
    return computed(parsed, *columns).filter("title is not null and start_utc is not null")


def _place(root: Column) -> Column:
    """The location object with an address, or the first such entry of a location list."""
    location = F.try_variant_get(root, "$.location", "variant")
    entries = F.when(is_array(location), F.try_variant_get(location, "$", "array<variant>")).when(
        is_object(location), F.array(location)
    )
    return F.get(F.filter(entries, lambda e: is_object(e) & has_field(e, "address")), F.lit(0))
