"""Queries over radius search, saved searches, feeds, gazetteer and the geo cascade."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.address import extract_plz
from ..functions.text import fold, fold_constant
from ..functions.urls import event_id
from ..operators import feed, radius_join as rj, saved_pages, search
from ..operators.gazetteer import (
    build_places, build_postal, longest_key_words, match_names, place_keys, postal_lookup, search_places,
)
from ..operators.joins import lookup_join
from ..operators.resolve import resolve_locations
from ..session import new_folder, write_through
from ..sources import gazetteer_files as files
from ..sources import geocode
from .catalog import distance_sql, fold_sql, joined, plz_sql, query, time_sql, time_text, tokens_sql
from .fixtures import table, view

CENTER = (48.6483, 9.4513)

# Raw events as stored ones: rows with coordinates are resolved, tags follow the event type.
_STORED = """
stored AS (SELECT sha256(source_id || '#' || source_event_id) AS id, *, CASE WHEN lat IS NULL THEN 'Unresolved' ELSE 'Resolved' END AS location_status,
       coalesce(attendance_hint, 'InPerson') AS attendance, [split_part(title, ' ', 1), 'Größe'] AS tags FROM fx_raw_event)
"""


def stored_events(spark: SparkSession, sf: str) -> DataFrame:
    raw = view(spark, sf, "fx_raw_event")
    return raw.withColumns(
        {
            "id": event_id("source_id", "source_event_id"),
            "location_status": F.when(F.col("lat").isNull(), "Unresolved").otherwise("Resolved"),
            "location_precision": F.lit("Address"),
            "attendance": F.coalesce("attendance_hint", F.lit("InPerson")),
            "tags": F.array(F.substring_index("title", " ", 1), F.lit("Größe")),
        }
    )


def _circle_sql(lat: float, lon: float, radius: float) -> str:
    box = geo.bounding_box(lat, lon, radius)
    return (
        f"location_status = 'Resolved' AND lat BETWEEN {box.min_lat!r} AND {box.max_lat!r} AND lon BETWEEN {box.min_lon!r} AND {box.max_lon!r}"
        f" AND {distance_sql(f'{lat}', f'{lon}', 'lat', 'lon')} <= {radius}"
    )


# --- one centre ------------------------------------------------------------------------------


@query(
    f""", {_STORED} SELECT id, title, {time_sql('start_utc')} AS start_utc, city, url,
  round({distance_sql(str(CENTER[0]), str(CENTER[1]), 'lat', 'lon')}, 6) AS distance_km
FROM stored WHERE {_circle_sql(*CENTER, 75.0)} ORDER BY start_utc, id LIMIT 100 OFFSET 5""",
    "fx_raw_event",
)
def radius_search(spark: SparkSession, sf: str) -> DataFrame:
    request = search.EventQuery(*CENTER, 75.0, limit=100, offset=5)
    page, _ = search.search_events(stored_events(spark, sf), request)
    return page.select("id", "title", time_text("start_utc").alias("start_utc"), "city", "url", F.round("distance_km", 6).alias("distance_km"))


@query(f", {_STORED} SELECT count(*) AS total_count FROM stored WHERE {_circle_sql(*CENTER, 75.0)}", "fx_raw_event")
def radius_total(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_events(stored_events(spark, sf), search.EventQuery(*CENTER, 75.0))[1]


@query(
    f""", {_STORED} SELECT id FROM stored WHERE {_circle_sql(*CENTER, 500.0)} AND start_utc >= TIMESTAMP '2024-01-05' AND start_utc <= TIMESTAMP '2024-01-20'
AND attendance = 'InPerson' AND list_has_any(tags, ['click', 'view'])""",
    "fx_raw_event",
)
def search_filters(spark: SparkSession, sf: str) -> DataFrame:
    request = search.EventQuery(
        *CENTER, 500.0, datetime(2024, 1, 5), datetime(2024, 1, 20), tags=["click", "view"], attendance="inperson"
    )
    return search.matching(stored_events(spark, sf), request).select("id")


@query(
    f""", {_STORED} SELECT id FROM stored WHERE {_circle_sql(*CENTER, 400.0)} AND (contains({fold_sql('title')}, 'koel') OR contains({fold_sql("coalesce(description, '')")}, 'koel')
  OR contains({fold_sql("coalesce(venue_name, '')")}, 'koel') OR contains({fold_sql("coalesce(city, '')")}, 'koel') OR contains({fold_sql("array_to_string(tags, '|')")}, 'koel'))""",
    "fx_raw_event",
)
def text_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.matching(stored_events(spark, sf), search.EventQuery(*CENTER, 400.0, text="  KÖL ")).select("id")


@query(f"SELECT doc_id FROM documents WHERE contains({fold_sql('text')}, 'etion qu')")
def document_search(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter(fold("text").contains(fold_constant("Étion Qu"))).select("doc_id")


@query(
    f""", {_STORED} SELECT id, source_id, title, {time_sql('start_utc')} AS start_utc, venue_name, venue_address, city, postal_code, attendance, url
FROM stored WHERE location_status = 'Unresolved'""",
    "fx_raw_event",
)
def unresolved_events(spark: SparkSession, sf: str) -> DataFrame:
    events = stored_events(spark, sf).withColumn("last_seen_utc", F.col("start_utc"))
    return search.unresolved(events).withColumn("start_utc", time_text("start_utc"))


_BOX = "degrees(radius_km / 6371.0088)"


@query(
    f"""SELECT search_id, round(greatest(lat - {_BOX}, -90), 6) AS min_lat, round(least(lat + {_BOX}, 90), 6) AS max_lat,
  round(lon - degrees(radius_km / (6371.0088 * cos(radians(lat)))), 6) AS min_lon,
  round(lon + degrees(asin(sin(radius_km / 6371.0088) / cos(radians(lat)))), 6) AS max_lon_exact,
  round({distance_sql(str(CENTER[0]), str(CENTER[1]), 'lat', 'lon')}, 6) AS distance_km FROM fx_saved_search""",
    "fx_saved_search",
)
def search_boxes(spark: SparkSession, sf: str) -> DataFrame:
    boxed = view(spark, sf, "fx_saved_search").withColumns(
        {
            "box": geo.bounding_box_columns("lat", "lon", "radius_km"),
            "exact": geo.bounding_box_columns("lat", "lon", "radius_km", exact=True),
        }
    )
    distance = geo.haversine_km(F.lit(CENTER[0]), F.lit(CENTER[1]), F.col("lat"), F.col("lon"))
    six = lambda c, name: F.round(c, 6).alias(name)
    return boxed.select(
        "search_id", six("box.min_lat", "min_lat"), six("box.max_lat", "max_lat"), six("box.min_lon", "min_lon"),
        six("exact.max_lon", "max_lon_exact"), six(distance, "distance_km"),
    )


@query("""
SELECT c_custkey AS search_id, unnest(list_filter([CASE WHEN c_acctbal / 50 NOT BETWEEN -90 AND 90 THEN 'lat' END, CASE WHEN c_nationkey * 9 > 180 THEN 'lon' END,
  CASE WHEN c_custkey % 520 = 0 OR c_custkey % 520 > 500 THEN 'radius_km' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'attendance' END], lambda x: x IS NOT NULL)) AS field
FROM customer""")
def saved_search_problems(spark: SparkSession, sf: str) -> DataFrame:
    requests = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("search_id"),
        (F.col("c_acctbal") / 50).alias("lat"),
        (F.col("c_nationkey") * 9).cast("double").alias("lon"),
        (F.col("c_custkey") % 520).cast("double").alias("radius_km"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "somewhere").when(F.col("c_mktsegment") == "BUILDING", "ONLINE").alias("attendance"),
    )
    return rj.search_problems(requests)


# --- many centres ----------------------------------------------------------------------------

_PAIRS = f"""
, {_STORED}, pairs AS (SELECT search_id, id, dedupe_key, title, description, venue_name, city, url, start_utc, end_utc, s.lat AS clat, s.lon AS clon, radius_km,
  {distance_sql('s.lat', 's.lon', 'e.lat', 'e.lon')} AS distance_km
FROM fx_saved_search s JOIN (SELECT *, title || '|' || id AS dedupe_key FROM stored) e ON e.location_status = 'Resolved'
  AND e.lat BETWEEN s.lat - {_BOX} AND s.lat + {_BOX}
  AND e.lon BETWEEN s.lon - degrees(radius_km / (6371.0088 * cos(radians(s.lat)))) AND s.lon + degrees(radius_km / (6371.0088 * cos(radians(s.lat))))
WHERE {distance_sql('s.lat', 's.lon', 'e.lat', 'e.lon')} <= radius_km
  AND (s.attendance IS NULL OR lower(e.attendance) = lower(s.attendance))
  AND (s.text IS NULL OR contains({fold_sql("concat_ws(chr(1), e.title, coalesce(e.description, ''), coalesce(e.venue_name, ''), coalesce(e.city, ''), array_to_string(e.tags, chr(1)))")}, {fold_sql('s.text')})))
"""


@query(_PAIRS + "SELECT search_id, id, round(distance_km, 6) AS distance_km FROM pairs", "fx_raw_event fx_saved_search")
def radius_join(spark: SparkSession, sf: str) -> DataFrame:
    events = stored_events(spark, sf).withColumn("search_text", search.search_text())
    events = events.select("id", "lat", "lon", "location_status", "attendance", "search_text")
    found = rj.radius_join(events, view(spark, sf, "fx_saved_search"), digits=6)
    return found.select("search_id", "id", "distance_km")


@query(
    _PAIRS + """SELECT search_id, id, position FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY start_utc, id) AS position FROM pairs)
WHERE position BETWEEN 3 AND 12""",
    "fx_raw_event fx_saved_search",
)
def saved_search_pages(spark: SparkSession, sf: str) -> DataFrame:
    page = rj.first_matches(stored_events(spark, sf), view(spark, sf, "fx_saved_search"), limit=10, offset=2)
    return page.select("search_id", "id", "position")


@query(
    _PAIRS + """SELECT search_id, id, position FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY start_utc, id) AS position FROM pairs)
WHERE position <= 6""",
    "fx_raw_event fx_saved_search",
)
def saved_search_pages_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of a first pass brought up to date with a second: events came, went and moved, searches changed."""
    now, searches = write_through(stored_events(spark, sf), "events"), view(spark, sf, "fx_saved_search")
    n = F.xxhash64("id") % 40
    moved = F.when(n == 1, F.timestamp_add("DAY", F.lit(-200), F.col("start_utc"))).otherwise(F.col("start_utc"))
    gone = now.filter(n == 3).withColumn("id", F.concat("id", F.lit("-gone")))
    past = write_through(now.filter(n != 2).withColumn("start_utc", moved).unionByName(gone), "events-before")
    known = searches.filter("search_id % 11 <> 4").withColumn("radius_km", F.col("radius_km") + (F.col("search_id") % 13 == 5).cast("int") * 7)
    kept = write_through(rj.page_ids(past, known, limit=6), "kept-pages")
    changed = now.filter(n.isin(1, 2)).select("id").unionByName(gone.select("id"))
    return saved_pages.refreshed_pages(kept, now, changed, searches, known, limit=6).select("search_id", "id", "position")


def _line_sql(line: str) -> str:
    """Content line folded after 74 and after 148 ASCII characters or 18 others."""
    return f"""CASE WHEN strlen({line}) <= 75 THEN {line} ELSE regexp_replace(regexp_replace({line}, CASE WHEN regexp_matches({line}, '[^\\x00-\\x7F]') THEN '(.{{18}})' ELSE '(.{{74}})' END, '\\1' || chr(13) || chr(10) || ' ', 'g'), '\r\n $', '') END"""


def _short_sql(value: str, digits: int) -> str:
    return f"regexp_replace(printf('%.{digits}f', {value}), '\\.?0+$', '')"


_EOL = "chr(13) || chr(10)"
_STAMP = "'%Y%m%dT%H%M%SZ'"
_ESCAPE = "regexp_replace({0}, '([,;\\\\])', '\\\\\\1', 'g')"


@query(
    _PAIRS
    + f""", entries AS (SELECT search_id, position, 'BEGIN:VEVENT' || {_EOL} || {_line_sql("'UID:' || upper(sha256(dedupe_key)) || '@events.invalid'")} || {_EOL}
  || 'DTSTAMP:20240101T000000Z' || {_EOL} || 'DTSTART:' || strftime(start_utc, {_STAMP}) || {_EOL} || coalesce('DTEND:' || strftime(end_utc, {_STAMP}) || {_EOL}, '')
  || {_line_sql("'SUMMARY:' || " + _ESCAPE.format('title'))} || {_EOL}
  || coalesce({_line_sql("'DESCRIPTION:' || " + _ESCAPE.format('description'))} || {_EOL}, '')
  || coalesce({_line_sql("'LOCATION:' || coalesce(venue_name, city)")} || {_EOL}, '') || 'URL:' || url || {_EOL} || 'END:VEVENT' || {_EOL} AS entry
  FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY start_utc, id) AS position FROM pairs) WHERE position <= 5)
SELECT s.search_id, 'BEGIN:VCALENDAR' || {_EOL} || 'VERSION:2.0' || {_EOL} || 'PRODID:-//kreiswerk//EN' || {_EOL} || 'METHOD:PUBLISH' || {_EOL}
  || 'X-WR-CALNAME:Events — ' || {_short_sql('radius_km', 1)} || ' km around ' || {_short_sql('lat', 3)} || '\\,' || {_short_sql('lon', 3)} || {_EOL}
  || coalesce(e.body, '') || 'END:VCALENDAR' || {_EOL} AS feed
FROM fx_saved_search s LEFT JOIN (SELECT search_id, string_agg(entry, '' ORDER BY position) AS body FROM entries GROUP BY search_id) e USING (search_id)""",
    "fx_raw_event fx_saved_search",
)
def saved_search_feeds(spark: SparkSession, sf: str) -> DataFrame:
    events = stored_events(spark, sf).withColumn("dedupe_key", F.concat_ws("|", "title", "id"))
    searches = view(spark, sf, "fx_saved_search")
    return feed.render_feeds(rj.first_matches(events, searches, limit=5), searches, "2024-01-01")


# --- gazetteer -------------------------------------------------------------------------------


def places(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_place").withColumn("aliases", F.array("alias"))


def postal(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_place").select("plz", "name", "admin1", "lat", "lon", "line_no")


_KEYS = f"""
keys AS (SELECT phrase, name AS matched_place, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY population DESC, line_no) AS rn
  FROM (SELECT {fold_sql('name')} AS phrase, * FROM fx_place UNION ALL SELECT {fold_sql('alias')} AS phrase, * FROM fx_place WHERE length({fold_sql('alias')}) >= 4)) WHERE rn = 1)
"""


@query(f", {_KEYS} SELECT phrase, matched_place, lat, lon FROM keys", "fx_place")
def gazetteer_keys(spark: SparkSession, sf: str) -> DataFrame:
    return place_keys(places(spark, sf))


@query(f", {_KEYS} SELECT max(greatest(len({tokens_sql('phrase')}), 1)) AS max_words FROM keys", "fx_place")
def gazetteer_longest_key(spark: SparkSession, sf: str) -> DataFrame:
    return longest_key_words(place_keys(places(spark, sf)))


@query(
    f"""SELECT source_event_id, plz, p.name AS matched_place FROM (SELECT source_event_id, coalesce({plz_sql('postal_code')}, {plz_sql('venue_address')}) AS plz FROM fx_raw_event) e
LEFT JOIN fx_place p USING (plz) WHERE plz IS NOT NULL""",
    "fx_place fx_raw_event",
)
def plz_lookup(spark: SparkSession, sf: str) -> DataFrame:
    coded = view(spark, sf, "fx_raw_event").select(
        "source_event_id", F.coalesce(extract_plz("postal_code"), extract_plz("venue_address")).alias("plz")
    )
    rows = coded.filter("plz is not null")
    return lookup_join(rows, postal_lookup(postal(spark, sf)), ["plz"], "left", ["source_event_id"]).select(
        "source_event_id", "plz", "matched_place"
    )


def _names_sql(rows: str, key: str, texts: list[str]) -> str:
    """Best phrase per row of the relation ``rows``; relations grams and best."""
    grams = " UNION ALL ".join(
        f"SELECT {key}, {prio} AS prio, {tokens_sql(fold_sql(c))} AS tokens FROM {rows} WHERE {c} IS NOT NULL" for prio, c in enumerate(texts)
    )
    return f"""
grams AS (SELECT {key}, prio, len, start, array_to_string(tokens[start + 1:start + len], ' ') AS phrase
  FROM (SELECT {key}, prio, tokens, len, unnest(range(0, len(tokens) - len + 1)) AS start
    FROM (SELECT {key}, prio, tokens, unnest(range(1, least(len(tokens), 2) + 1)) AS len FROM ({grams})))),
best AS (SELECT * FROM (SELECT g.{key}, matched_place, k.lat, k.lon, row_number() OVER (PARTITION BY g.{key} ORDER BY prio, len DESC, start) AS rn
  FROM grams g JOIN keys k USING (phrase)) WHERE rn = 1)
"""


@query(
    f", {_KEYS}, texts AS (SELECT DISTINCT city, venue_address, coalesce(city, '') || '|' || coalesce(venue_address, '') AS k FROM fx_raw_event), {_names_sql('texts', 'k', ['city', 'venue_address'])}"
    "SELECT city, venue_address, matched_place, lat, lon FROM texts JOIN best USING (k)",
    "fx_place fx_raw_event",
)
def name_lookup(spark: SparkSession, sf: str) -> DataFrame:
    texts = view(spark, sf, "fx_raw_event").select("city", "venue_address").distinct()
    return match_names(texts, place_keys(places(spark, sf)), ["city", "venue_address"])


_ELIGIBLE = f"""(lat IS NULL OR lon IS NULL) AND coalesce(attendance_hint, '') <> 'Online' AND venue_address IS NOT NULL
  AND (regexp_matches(venue_address, '[0-9]') OR regexp_matches({fold_sql('venue_address')}, 'strasse|str[.]|weg|allee|platz|gasse|ring|damm'))"""
_QUERY = "concat_ws(', ', venue_address, nullif(concat_ws(' ', postal_code, city), ''), 'Deutschland')"


def cascade_sql(cached: bool, rows: str = "fx_raw_event", final: str | None = None) -> str:
    """The cascade over a relation; as a named relation with all columns when ``final`` is given."""
    cache = f"""
cache AS (SELECT query, n % 3 <> 0 AS found, 50.0 + (n % 7) AS clat, 9.0 + (n % 5) AS clon, CASE WHEN n % 2 = 0 THEN 'Address' ELSE 'Street' END AS cprecision
  FROM (SELECT query, length(query) AS n FROM (SELECT DISTINCT {fold_sql(_QUERY)} AS query FROM fx_raw_event WHERE {_ELIGIBLE}) WHERE length(query) % 2 = 0)),"""
    empty = "cache AS (SELECT '' AS query, false AS found, 0.0 AS clat, 0.0 AS clon, '' AS cprecision WHERE false),"
    return f"""
, {_KEYS}, {cache if cached else empty} asked AS (SELECT source_event_id AS id, CASE WHEN {_ELIGIBLE} THEN {fold_sql(_QUERY)} END AS query,
  coalesce({plz_sql('postal_code')}, {plz_sql('venue_address')}) AS plz, * FROM {rows}), {_names_sql('asked', 'id', ['city', 'venue_address'])}
{f', {final} AS (SELECT a.* EXCLUDE (lat, lon),' if final else 'SELECT a.id AS source_event_id,'}
  CASE WHEN a.lat IS NOT NULL THEN a.city WHEN c.found THEN a.city WHEN p.plz IS NOT NULL THEN p.name ELSE b.matched_place END AS matched_place,
  CASE WHEN a.lat IS NOT NULL THEN a.lat WHEN c.found THEN c.clat WHEN p.plz IS NOT NULL THEN p.lat ELSE b.lat END AS lat,
  CASE WHEN a.lat IS NOT NULL THEN a.lon WHEN c.found THEN c.clon WHEN p.plz IS NOT NULL THEN p.lon ELSE b.lon END AS lon,
  CASE WHEN a.lat IS NOT NULL OR c.found OR p.plz IS NOT NULL OR b.id IS NOT NULL THEN 'Resolved' ELSE 'Unresolved' END AS location_status,
  CASE WHEN a.lat IS NOT NULL THEN 'Address' WHEN c.found THEN c.cprecision WHEN p.plz IS NOT NULL OR b.id IS NOT NULL THEN 'City' ELSE 'None' END AS location_precision
FROM asked a LEFT JOIN cache c USING (query) LEFT JOIN fx_place p ON p.plz = a.plz LEFT JOIN best b ON b.id = a.id
{')' if final else ''}"""


_PLACED = ["source_event_id", "matched_place", "lat", "lon", "location_status", "location_precision"]


@query(cascade_sql(cached=False), "fx_place fx_raw_event")
def geo_cascade(spark: SparkSession, sf: str) -> DataFrame:
    raw = view(spark, sf, "fx_raw_event")
    return resolve_locations(raw, place_keys(places(spark, sf)), postal_lookup(postal(spark, sf))).select(*_PLACED)


def _cache(raw: DataFrame) -> DataFrame:
    n = F.length("query")
    known = geocode.geocode_requests(raw).filter(n % 2 == 0)
    return known.select(
        "query",
        (n % 3 != 0).alias("found"),
        (F.lit(50.0) + n % 7).alias("lat"),
        (F.lit(9.0) + n % 5).alias("lon"),
        F.when(n % 2 == 0, "Address").otherwise("Street").alias("precision"),
        F.lit("2024-01-01").cast("timestamp").alias("resolved_at"),
    )


@query(cascade_sql(cached=True), "fx_place fx_raw_event")
def geo_cascade_cached(spark: SparkSession, sf: str) -> DataFrame:
    raw = view(spark, sf, "fx_raw_event")
    keys, codes = place_keys(places(spark, sf)), postal_lookup(postal(spark, sf))
    return resolve_locations(raw, keys, codes, _cache(raw)).select(*_PLACED)


@query(
    f"""SELECT query, text, events FROM (SELECT {fold_sql(_QUERY)} AS query, min({_QUERY}) AS text, count(*) AS events FROM fx_raw_event WHERE {_ELIGIBLE} GROUP BY 1)
WHERE length(query) % 2 <> 0""",
    "fx_raw_event",
)
def pending_geocodes(spark: SparkSession, sf: str) -> DataFrame:
    raw = view(spark, sf, "fx_raw_event")
    return geocode.pending_geocodes(raw, _cache(raw))


_ANSWERS = """
read AS (SELECT query, event_id, event_id % 9 NOT IN (0, 3, 6, 8) AND CAST(event_id % 20 AS DOUBLE) BETWEEN 5.8 AND 15.1 AND 45 + event_id % 12 BETWEEN 47.2 AND 55.1 AS found,
  CAST(45 + event_id % 12 AS DOUBLE) AS lat, CAST(event_id % 20 AS DOUBLE) AS lon, CASE WHEN event_id % 9 = 2 THEN 'Street' ELSE 'Address' END AS precision
  FROM fx_answer WHERE event_id % 9 NOT IN (6, 7))
"""


@query(
    f", {_ANSWERS} SELECT query, found, CASE WHEN found THEN lat END AS lat, CASE WHEN found THEN lon END AS lon, CASE WHEN found THEN precision ELSE 'None' END AS precision FROM read",
    "fx_answer",
)
def geocode_answers(spark: SparkSession, sf: str) -> DataFrame:
    return geocode.read_answers(view(spark, sf, "fx_answer"))


@query(
    f""", {_ANSWERS}, fresh AS (SELECT query, found, CASE WHEN found THEN lat END AS lat, CASE WHEN found THEN precision ELSE 'None' END AS precision FROM read WHERE event_id % 2 = 0)
SELECT query, found, lat, precision FROM fresh
UNION ALL SELECT 'q' || event_id, false, NULL, 'None' FROM events WHERE event_id % 3 = 0 AND 'q' || event_id NOT IN (SELECT query FROM fresh)""",
    "fx_answer",
)
def geocode_cache_update(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "events").filter("event_id % 3 = 0").select(
        F.concat(F.lit("q"), "event_id").alias("query"), F.lit(False).alias("found"), F.lit(None).cast("double").alias("lat"),
        F.lit(None).cast("double").alias("lon"), F.lit("None").alias("precision"), F.lit("2024-01-01").cast("timestamp").alias("resolved_at"),
    )
    answers = view(spark, sf, "fx_answer").filter("event_id % 2 = 0")
    return geocode.apply_answers(old, answers, "2024-02-01").select("query", "found", "lat", "precision")


@query("SELECT name, admin1, population, lat, lon FROM fx_place WHERE contains(lower(name), 'town 1') ORDER BY population DESC, name, admin1 LIMIT 7", "fx_place")
def place_search(spark: SparkSession, sf: str) -> DataFrame:
    return search_places(places(spark, sf), "TOWN 1", 7)


@query("SELECT n, name, population FROM (SELECT 2 AS n, * FROM fx_place WHERE contains(lower(name), 'town 2') ORDER BY population DESC, name, admin1 LIMIT 4)", "fx_place")
def place_searches(spark: SparkSession, sf: str) -> DataFrame:
    """Blank texts and none find no place."""
    known, out = places(spark, sf), None
    for n, text in enumerate((None, "  ", " tówn 2".strip())):
        found = search_places(known, text, 4).select(F.lit(n).alias("n"), "name", "population")
        out = found if out is None else out.unionByName(found)
    return out


@query("SELECT name, alias AS aliases, admin1, population, lat, lon, plz FROM fx_place", "fx_place")
def gazetteer_written(spark: SparkSession, sf: str) -> DataFrame:
    """Places and postal codes written as files and read back."""
    known, codes = new_folder(spark, "places"), new_folder(spark, "postal")
    files.write_gazetteer(places(spark, sf), postal(spark, sf), known, codes)
    towns = files.parse_places(files.read_lines(spark, known)).withColumn("aliases", joined("aliases")).drop("line_no")
    return towns.join(files.parse_postal(files.read_lines(spark, codes)).select("name", "lat", "lon", "plz"), ["name", "lat", "lon"])


@query("SELECT name, alias || ',Ort' AS aliases, admin1, population, lat, lon, line_no FROM fx_place WHERE line_no % 5 <> 0", "fx_place")
def places_file(spark: SparkSession, sf: str) -> DataFrame:
    full = F.concat_ws(";", "name", F.concat("alias", F.lit("||Ort")), "admin1", "population", "lat", "lon")
    line = F.when(F.col("line_no") % 5 == 0, F.concat_ws(";", "name", "alias", "admin1")).otherwise(full)
    lines = view(spark, sf, "fx_place").select(line.alias("line"), "line_no")
    return files.parse_places(lines).withColumn("aliases", joined("aliases"))


@query(
    """SELECT plz, name AS matched_place, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY plz ORDER BY line_no) AS rn
FROM (SELECT cast(10000 + line_no // 3 AS varchar) AS plz, name, lat, lon, line_no FROM fx_place)) WHERE rn = 1""",
    "fx_place",
)
def postal_file(spark: SparkSession, sf: str) -> DataFrame:
    code = F.floor(F.col("line_no") / 3) + 10000
    lines = view(spark, sf, "fx_place").select(F.concat_ws(";", code, "name", "admin1", "lat", "lon").alias("line"), "line_no")
    return postal_lookup(files.parse_postal(lines))


_STATE = "coalesce(CASE WHEN n BETWEEN 1 AND 16 THEN string_split('BW,BY,HB,HH,HE,NI,NW,RP,SL,SH,BB,MV,SN,ST,TH,BE', ',')[n] END, '')"


@query(
    f"""
, dump AS (SELECT line_no, cast(f[1] AS bigint) AS id, f[2] AS name, f[3] AS ascii_name, string_split(f[4], ',') AS alts, f[5] AS lat, f[6] AS lon, cast(f[11] AS int) AS n,
    coalesce(cast(nullif(f[15], '') AS bigint), 0) AS population FROM (SELECT line_no, string_split(line, chr(9)) AS f FROM fx_dump) WHERE f[7] = 'P'),
german AS (SELECT cast(f[2] AS bigint) AS id, f[4] AS name, row_number() OVER (PARTITION BY f[2] ORDER BY CASE WHEN f[5] = '1' THEN 0 ELSE 1 END, CASE WHEN f[5] = '1' THEN -line_no ELSE line_no END) AS r
    FROM (SELECT line_no, string_split(line, chr(9)) AS f FROM fx_alternate) WHERE f[3] = 'de' AND f[4] <> ''),
named AS (SELECT d.*, coalesce(g.name, d.name) AS canonical FROM dump d LEFT JOIN german g ON g.id = d.id AND g.r = 1),
cand AS (SELECT n.line_no, canonical, g.name AS alias, 0 AS a, g.r AS b FROM named n JOIN german g USING (id) WHERE g.r > 1
    UNION ALL SELECT line_no, canonical, name, 2, 0 FROM named UNION ALL SELECT line_no, canonical, ascii_name, 2, 1 FROM named
    UNION ALL SELECT line_no, canonical, alt, 3, i FROM (SELECT line_no, canonical, unnest(alts) AS alt, unnest(range(len(alts))) AS i FROM named)
      WHERE {fold_sql('alt')} <> {fold_sql('canonical')} AND (contains({fold_sql('alt')}, {fold_sql('canonical')}) OR contains({fold_sql('canonical')}, {fold_sql('alt')}) OR left({fold_sql('alt')}, 4) = left({fold_sql('canonical')}, 4))),
uniq AS (SELECT *, row_number() OVER (PARTITION BY line_no, {fold_sql('alias')} ORDER BY a, b) AS rn FROM cand WHERE length(alias) >= 4 AND {fold_sql('alias')} <> {fold_sql('canonical')}),
top AS (SELECT *, row_number() OVER (PARTITION BY line_no ORDER BY a, b) AS k FROM uniq WHERE rn = 1),
aliases AS (SELECT line_no, string_agg(alias, '|' ORDER BY k) AS aliases FROM top WHERE k <= 5 GROUP BY line_no)
SELECT canonical AS name, coalesce(aliases, '') AS aliases, admin1, population, lat, lon FROM (
  SELECT *, row_number() OVER (PARTITION BY {fold_sql('canonical')}, admin1 ORDER BY population DESC, line_no) AS rn FROM (SELECT *, {_STATE} AS admin1 FROM named))
LEFT JOIN aliases USING (line_no) WHERE rn = 1""",
    "fx_dump fx_alternate",
)
def gazetteer_build(spark: SparkSession, sf: str) -> DataFrame:
    dump = files.parse_geonames(view(spark, sf, "fx_dump"))
    german = files.parse_alternate_names(view(spark, sf, "fx_alternate"))
    return build_places(dump, german).withColumn("aliases", F.array_join("aliases", "|")).drop("line_no")


@query(
    f"""SELECT plz, name, {_STATE} AS admin1, lat, lon FROM (SELECT f[2] AS plz, f[3] AS name, cast(f[5] AS int) AS n, f[10] AS lat, f[11] AS lon,
  row_number() OVER (PARTITION BY f[2] ORDER BY line_no) AS rn FROM (SELECT line_no, string_split(line, chr(9)) AS f FROM fx_postal_dump) WHERE len(f) >= 11 AND f[2] <> '') WHERE rn = 1""",
    "fx_postal_dump",
)
def postal_build(spark: SparkSession, sf: str) -> DataFrame:
    return build_postal(files.parse_geonames_postal(view(spark, sf, "fx_postal_dump"))).drop("line_no")
