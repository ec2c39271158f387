"""Queries over deduplication, the event store, source health and the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed_values import KEYWORD_TO_TAG
from ..functions.times import dedupe_key
from ..functions.urls import event_id
from ..operators import dedupe, health, store
from ..operators.gazetteer import place_keys, postal_lookup
from ..session import new_folder, write_through
from ..sources import registry as reg
from .catalog import fold_sql, joined, local_day_sql, query, time_sql, time_text
from .fixtures import table, view
from .ingest import normalize_events
from .search_queries import cascade_sql, places, postal
from .text_queries import clean_sql, tags_sql

_KEY = f"{fold_sql('title')} || '|' || cast({local_day_sql('start_utc', 'time_zone_id')} AS varchar) || '|' || coalesce({fold_sql('city')}, '')"
_EVENTS = f"""
stored AS (SELECT sha256(source_id || '#' || source_event_id) AS id, *, {_KEY} AS dedupe_key, cast(timestamp '2024-01-01' + interval 1 day * (feed_pos % 3) AS timestamp) AS seen FROM fx_raw_event)
"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Raw events as stored ones, seen on one of three days, without the geo cascade."""
    raw = view(spark, sf, "fx_raw_event")
    seen = F.timestamp_add("DAY", F.col("feed_pos") % 3, F.lit("2024-01-01").cast("timestamp"))
    return raw.withColumns(
        {
            "id": event_id("source_id", "source_event_id"),
            "location_status": F.when(F.col("lat").isNull(), "Unresolved").otherwise("Resolved"),
            "location_precision": F.when(F.col("lat").isNull(), "None").otherwise("Address"),
            "attendance": F.coalesce("attendance_hint", F.lit("InPerson")),
            "tags": F.array(F.lit("t")),
            "first_seen_utc": seen,
            "last_seen_utc": seen,
            "dedupe_key": dedupe_key("title", "start_utc", "time_zone_id", "city"),
        }
    )


# --- duplicates ------------------------------------------------------------------------------


@query(
    f""", {_EVENTS} SELECT id, dedupe_key FROM (SELECT *, row_number() OVER (PARTITION BY source_id, dedupe_key ORDER BY seen, feed_pos) AS rn FROM stored) WHERE rn = 1""",
    "fx_raw_event",
)
def dedupe_batch(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.dedupe_batch(events(spark, sf)).select("id", "dedupe_key")


@query(
    f""", {_EVENTS}, kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, dedupe_key ORDER BY seen, feed_pos) AS rn FROM (SELECT * REPLACE ('ev-' || (feed_pos % 400) AS source_event_id) FROM stored)) WHERE rn = 1)
SELECT source_id, source_event_id, count(*) - 1 AS dropped FROM kept GROUP BY ALL HAVING count(*) > 1""",
    "fx_raw_event",
)
def id_collisions(spark: SparkSession, sf: str) -> DataFrame:
    clashing = events(spark, sf).withColumn("source_event_id", F.concat(F.lit("ev-"), F.col("feed_pos") % 400))
    return dedupe.id_collisions(clashing)


@query(
    f""", {_EVENTS}, first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY seen, source_id, source_event_id) AS rn FROM stored) WHERE rn = 1)
SELECT f.dedupe_key, f.id, n.sources AS source_count, n.urls AS url_count FROM first f JOIN (SELECT dedupe_key, count(DISTINCT source_id) AS sources, count(DISTINCT url) AS urls FROM stored GROUP BY 1) n USING (dedupe_key)""",
    "fx_raw_event",
)
def merged_cards(spark: SparkSession, sf: str) -> DataFrame:
    cards, _ = dedupe.merge_duplicates(events(spark, sf))
    return cards.select("dedupe_key", "id", "source_count", "url_count")


@query(f", {_EVENTS} SELECT DISTINCT dedupe_key, url FROM stored", "fx_raw_event")
def merged_links(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.merge_duplicates(events(spark, sf))[1]


# --- store -----------------------------------------------------------------------------------

# Known: the events below two thirds of their source. Batch: the upper half, with a new title for some.
_OLD, _NEW = "feed_pos % 6 < 4", "feed_pos % 6 > 1"


@query(
    f""", {_EVENTS}, old AS (SELECT * FROM stored WHERE {_OLD}),
new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, dedupe_key ORDER BY seen, feed_pos) AS rn FROM (
  SELECT * REPLACE (CASE WHEN feed_pos % 6 = 2 THEN title || ' !' ELSE title END AS title) FROM stored WHERE {_NEW})) WHERE rn = 1)
SELECT coalesce(o.source_event_id, n.source_event_id) AS source_event_id, CASE WHEN n.id IS NULL THEN o.title ELSE n.title END AS title,
  {time_sql("coalesce(o.seen, timestamp '2024-03-01')")} AS first_seen, {time_sql("CASE WHEN n.id IS NULL THEN o.seen ELSE timestamp '2024-03-01' END")} AS last_seen
FROM old o FULL JOIN new n ON o.source_id = n.source_id AND o.source_event_id = n.source_event_id""",
    "fx_raw_event",
)
def upsert_result(spark: SparkSession, sf: str) -> DataFrame:
    every = events(spark, sf)
    batch = every.filter(_NEW).withColumn(
        "title", F.when(F.col("feed_pos") % 6 == 2, F.concat("title", F.lit(" !"))).otherwise(F.col("title"))
    )
    merged = store.upsert(every.filter(_OLD), batch, "2024-03-01")
    return merged.select(
        "source_event_id", "title", time_text("first_seen_utc").alias("first_seen"), time_text("last_seen_utc").alias("last_seen")
    )


@query(
    f""", {_EVENTS}, first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, dedupe_key ORDER BY seen, feed_pos) AS rn FROM stored WHERE {_OLD}) WHERE rn = 1),
second AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, dedupe_key ORDER BY seen, feed_pos) AS rn FROM stored WHERE {_NEW} AND source_id NOT IN (SELECT source_id FROM stored WHERE feed_pos % 1501 = 7)) WHERE rn = 1)
SELECT coalesce(o.id, n.id) AS id, cast(CASE WHEN o.id IS NULL THEN 2 ELSE 1 END AS integer) AS first_seen, cast(CASE WHEN n.id IS NULL THEN 1 ELSE 2 END AS integer) AS last_seen
FROM first o FULL JOIN second n ON o.id = n.id""",
    "fx_raw_event",
)
def store_after_two_merges(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches merged into a written store; sources that failed in the second keep their events."""
    every = write_through(events(spark, sf), "events")
    kept = store.EventStore(spark, new_folder(spark, "store"), buckets=8)
    kept.upsert_events(every.filter(_OLD), every.limit(0).selectExpr("source_id", "'' AS error"), "2024-02-01")
    kept.upsert_events(every.filter(_NEW), every.filter("feed_pos % 1501 = 7").selectExpr("source_id", "'' AS error"), "2024-03-01")
    month = lambda name: (F.month(name) - 1).cast("int")
    return kept.events.read().select("id", month("first_seen_utc").alias("first_seen"), month("last_seen_utc").alias("last_seen"))


@query(f", {_EVENTS} SELECT id FROM stored WHERE source_id NOT IN (SELECT source_id FROM stored WHERE feed_pos % 1501 = 7)", "fx_raw_event")
def successful_sources(spark: SparkSession, sf: str) -> DataFrame:
    every = events(spark, sf)
    return store.only_successful(every, every.filter("feed_pos % 1501 = 7")).select("id")


_TITLE, _TEXT = clean_sql("title"), clean_sql("description")


@query(
    f"""{cascade_sql(cached=False, rows=f"(SELECT * REPLACE ({_TITLE} AS title, {_TEXT} AS description) FROM fx_raw_event)", final="placed")}
SELECT sha256(source_id || '#' || source_event_id) AS id, title, description, coalesce(matched_place, city) AS city, lat, lon, location_status, location_precision,
  coalesce(attendance_hint, 'InPerson') AS attendance, coalesce(nullif(time_zone_id, ''), 'UTC') AS time_zone_id,
  array_to_string(list_sort(list_distinct(list_concat(['org'], list_filter(string_split({tags_sql('folded', KEYWORD_TO_TAG)}, ','), lambda x: x <> '')))), ',') AS tags,
  {fold_sql('title')} || '|' || cast({local_day_sql('start_utc', 'time_zone_id')} AS varchar) || '|' || coalesce({fold_sql('coalesce(matched_place, city)')}, '') AS dedupe_key
FROM (SELECT *, {fold_sql("title || ' ' || coalesce(description, '')")} AS folded FROM placed)""",
    "fx_place fx_raw_event",
)
def normalized_events(spark: SparkSession, sf: str) -> DataFrame:
    sources = view(spark, sf, "fx_registry").select("id").distinct().withColumn("tags", F.array(F.lit("org")))
    keys, codes = place_keys(places(spark, sf)), postal_lookup(postal(spark, sf))
    rows = normalize_events(view(spark, sf, "fx_raw_event"), sources, keys, codes, None, "2024-01-01")
    return rows.select(
        "id", "title", "description", "city", "lat", "lon", "location_status", "location_precision", "attendance",
        "time_zone_id", joined("tags").alias("tags"), "dedupe_key",
    )


# --- health ----------------------------------------------------------------------------------

_RUNS = """
runs AS (SELECT 'src' || (user_id % 20) AS source_id, ts AS run_utc, CASE WHEN event_id % 4 <> 0 THEN ts END AS success_utc,
  CASE WHEN event_id % 4 <> 0 THEN event_id % 50 ELSE 0 END AS event_count, CASE WHEN event_id % 4 = 0 THEN 'error ' || event_id END AS error FROM events WHERE user_id % 20 <> 3),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY run_utc DESC) AS rn FROM runs) WHERE rn = 1)
"""


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.col("event_id") % 4 != 0
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").filter("user_id % 20 <> 3").select(
        F.concat(F.lit("src"), F.col("user_id") % 20).alias("source_id"),
        ts.alias("run_utc"),
        F.when(ok, ts).alias("success_utc"),
        F.when(ok, F.col("event_id") % 50).otherwise(0).cast("int").alias("event_count"),
        F.when(~ok, F.concat(F.lit("error "), "event_id")).alias("error"),
    )


@query(
    f", {_RUNS} SELECT r.id, r.org, r.type, r.url, r.enabled, {time_sql('l.run_utc')} AS last_run_utc, {time_sql('l.success_utc')} AS last_success_utc, coalesce(event_count, 0) AS event_count, error AS last_error FROM fx_registry r LEFT JOIN latest l ON l.source_id = r.id",
    "fx_registry",
)
def source_health(spark: SparkSession, sf: str) -> DataFrame:
    report = health.source_report(view(spark, sf, "fx_registry"), health.latest_status(run_log(spark, sf)))
    return report.withColumns({"last_run_utc": time_text("last_run_utc"), "last_success_utc": time_text("last_success_utc")})


@query(
    f"WITH {_RUNS} SELECT source_id, {time_sql('max(success_utc)')} AS last_good_utc, arg_max(event_count, success_utc) AS last_good_count FROM runs WHERE success_utc IS NOT NULL GROUP BY 1"
)
def last_good_runs(spark: SparkSession, sf: str) -> DataFrame:
    return health.last_good_runs(run_log(spark, sf)).withColumn("last_good_utc", time_text("last_good_utc"))


@query(
    """, failed AS (SELECT source_id, min('bad ' || source_event_id) AS error FROM fx_raw_event WHERE feed_pos % 1501 = 7 GROUP BY 1)
SELECT r.id AS source_id, error, CASE WHEN error IS NULL THEN coalesce(n, 0) ELSE 0 END AS event_count, error IS NULL AS succeeded
FROM (SELECT DISTINCT id FROM fx_registry WHERE enabled) r LEFT JOIN (SELECT source_id, count(*) AS n FROM fx_raw_event GROUP BY 1) c ON c.source_id = r.id LEFT JOIN failed f ON f.source_id = r.id""",
    "fx_registry fx_raw_event",
)
def run_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    raw = view(spark, sf, "fx_raw_event")
    errors = raw.filter("feed_pos % 1501 = 7").select("source_id", F.concat(F.lit("bad "), "source_event_id").alias("error"))
    sources = view(spark, sf, "fx_registry").dropDuplicates(["id"])
    runs = health.run_outcomes(sources, raw, errors, "2024-03-01")
    return runs.select("source_id", "error", "event_count", F.col("success_utc").isNotNull().alias("succeeded"))


@query("SELECT count(*) AS unresolved_count FROM fx_raw_event WHERE lat IS NULL", "fx_raw_event")
def unresolved_count(spark: SparkSession, sf: str) -> DataFrame:
    return health.unresolved_count(events(spark, sf))


@query(
    "SELECT e.source_event_id, coalesce(r.org, e.source_id) AS org FROM fx_raw_event e LEFT JOIN (SELECT id, min(org) AS org FROM fx_registry WHERE type <> 'rss' GROUP BY 1) r ON r.id = e.source_id",
    "fx_registry fx_raw_event",
)
def event_orgs(spark: SparkSession, sf: str) -> DataFrame:
    sources = view(spark, sf, "fx_registry").filter("type <> 'rss'").groupBy("id").agg(F.min("org").alias("org"))
    return health.with_source_org(view(spark, sf, "fx_raw_event"), sources).select("source_event_id", "org")


# --- registry --------------------------------------------------------------------------------


@query(
    """SELECT id, rule FROM (
  SELECT id, 'unknown-type' AS rule FROM fx_registry WHERE type NOT IN ('ics', 'html', 'gdg-sitemap')
  UNION ALL SELECT id, 'html-without-adapter' FROM fx_registry WHERE type = 'html' AND adapter IS NULL
  UNION ALL SELECT id, 'unregistered-adapter' FROM fx_registry WHERE type = 'html' AND adapter <> 'meetup-group'
  UNION ALL SELECT id, 'sitemap-without-slugs' FROM fx_registry WHERE type = 'gdg-sitemap'
  UNION ALL SELECT id, 'duplicate-id' FROM fx_registry GROUP BY id HAVING count(*) > 1)""",
    "fx_registry",
)
def registry_violations(spark: SparkSession, sf: str) -> DataFrame:
    sources = view(spark, sf, "fx_registry").withColumn("slugs", F.array().cast("array<string>"))
    return reg.registry_violations(sources).select("id", "rule")


@query(
    "SELECT id, org, type, coalesce(adapter, '-') AS adapter, 0 AS tags, enabled FROM fx_registry WHERE enabled",
    "fx_registry",
)
def enabled_registry(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("array<string>")
    landed = view(spark, sf, "fx_registry").withColumns(
        {"tags": none, "slugs": none, "enabled": F.when(~F.col("enabled"), F.lit(False))}
    )
    sources = reg.enabled_sources(reg.with_registry_defaults(landed))
    return sources.select("id", "org", "type", F.coalesce("adapter", F.lit("-")).alias("adapter"), F.size("tags").alias("tags"), "enabled")
