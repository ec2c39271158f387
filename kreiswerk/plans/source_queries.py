"""Queries over landed pages, sitemaps, calendars, robots rules, fetches and discovery."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import not_ended
from ..functions.urls import url_host
from ..operators import discover, health
from ..session import write_through
from ..sources import calendar, crawl, pages, robots, sitemap
from ..sources.registry import with_registry_defaults
from .catalog import joined, query, time_sql, time_text
from .fixtures import table, view
from .ingest import collect_raw

_NOW = datetime(2024, 1, 15)
_START = "cast(cast(ts AS date) AS timestamp) + interval 1 hour * hour(ts) - interval 1 hour"


# --- pages -----------------------------------------------------------------------------------


@query(f"""
SELECT 'src' || (user_id % 20) AS source_id, event_id || '' AS source_event_id, CASE WHEN event_id % 6 = 0 THEN '' ELSE event_type || ' night' END AS title,
  {time_sql(f"{_START} + interval 15 minute")} AS start_utc, CASE WHEN event_id % 2 = 0 THEN {time_sql("cast(cast(ts AS date) AS timestamp) + interval 1365 minute")} END AS end_utc,
  CASE WHEN event_id % 4 <> 1 THEN 'Haus ' || user_id END AS venue_name, CASE WHEN event_id % 4 <> 1 THEN 'Weg ' || (user_id % 9) END AS venue_address,
  CASE WHEN event_id % 4 <> 1 AND user_id % 8 <> 0 THEN 'Town ' || (user_id % 120) END AS city,
  CASE event_id % 4 WHEN 0 THEN 'InPerson' WHEN 1 THEN 'Online' WHEN 2 THEN 'Hybrid' END AS attendance_hint,
  CASE WHEN event_id % 3 = 0 THEN 'https://e.example/' || event_id ELSE 'https://x.example/g' || event_id || '/events/' END AS url
FROM events WHERE event_id % 17 > 2
  AND CASE WHEN event_id % 2 = 0 THEN cast(cast(ts AS date) AS timestamp) + interval 1365 minute ELSE {_START} + interval 15 minute END >= timestamp '2024-01-15'""")
def state_page_events(spark: SparkSession, sf: str) -> DataFrame:
    found, _ = pages.extract_state_events(view(spark, sf, "fx_state_page"))
    kept = found.filter(not_ended("start_utc", "end_utc", _NOW))
    return kept.select(
        "source_id", "source_event_id", "title", time_text("start_utc").alias("start_utc"), time_text("end_utc").alias("end_utc"),
        "venue_name", "venue_address", "city", "attendance_hint", "url",
    )


@query("""
SELECT 'src' || (user_id % 20) AS source_id, 'https://x.example/g' || event_id || '/events/' AS url,
  CASE WHEN event_id % 17 = 0 THEN 'no __NEXT_DATA__ script found' ELSE '__NEXT_DATA__ has no props.pageProps.__APOLLO_STATE__' END AS error
FROM events WHERE event_id % 17 < 2""")
def state_page_errors(spark: SparkSession, sf: str) -> DataFrame:
    return pages.extract_state_events(view(spark, sf, "fx_state_page"))[1]


@query(f"""
SELECT 'src' || (user_id % 20) AS source_id, event_id || '' AS source_event_id, event_type AS title, CASE WHEN event_id % 4 <> 0 THEN 'Talk ' || user_id END AS description,
  {time_sql(_START)} AS start_utc, CASE WHEN event_id % 3 = 0 THEN {time_sql("cast(cast(ts AS date) AS timestamp) + interval 1379 minute")} END AS end_utc, 'V' AS venue_name,
  CASE WHEN event_id % 2 = 0 THEN 'Weg 1, ' ELSE '' END || (10000 + (user_id % 120) * 7) || ', Town ' || (user_id % 120) AS venue_address, 'Town ' || (user_id % 120) AS city,
  (10000 + (user_id % 120) * 7) || '' AS postal_code, CASE event_id % 4 WHEN 0 THEN 'InPerson' WHEN 1 THEN 'Online' WHEN 2 THEN 'Hybrid' END AS attendance_hint
FROM events WHERE event_id % 13 > 2""")
def jsonld_events(spark: SparkSession, sf: str) -> DataFrame:
    tail = F.regexp_extract("url", "presents-([0-9]+)", 1)
    rows = pages.extract_jsonld_events(view(spark, sf, "fx_jsonld_page"))
    return rows.select(
        "source_id", tail.alias("source_event_id"), "title", "description", time_text("start_utc").alias("start_utc"),
        time_text("end_utc").alias("end_utc"), "venue_name", "venue_address", "city", "postal_code", "attendance_hint",
    )


@query("SELECT count(*) AS pages, 0 AS structured, count_if(contains(html, '<script')) AS scripted FROM pages")
def raw_page_scripts(spark: SparkSession, sf: str) -> DataFrame:
    """The given web pages hold scripts, but none with structured data."""
    script = pages.first_script(F.col("html"), "ld.json")
    return table(spark, sf, "pages").agg(
        F.count(F.lit(1)).alias("pages"), F.count(script).alias("structured"), F.count(pages.first_script(F.col("html"), "")).alias("scripted")
    )


# --- sitemaps --------------------------------------------------------------------------------


@query("""
SELECT url AS sitemap_url, source_id, unnest(['https://x.example/events/details/google-gdg-' || (CAST(regexp_extract(body, 'google-gdg-([0-9]+)', 1) AS int)) || CASE WHEN event_id % 2 = 0 THEN '-presents-' ELSE '-cloud-presents-' END
  || (event_id % 500) || '/?a=1&b=2', 'https://x.example/other/' || (event_id % 50)]) AS loc FROM fx_sitemap WHERE event_id % 29 <> 0""", "fx_sitemap")
def sitemap_addresses(spark: SparkSession, sf: str) -> DataFrame:
    return sitemap.sitemap_locs(view(spark, sf, "fx_sitemap"))[0]


@query("SELECT source_id, url, 'sitemap is not well-formed XML' AS error FROM fx_sitemap WHERE event_id % 29 = 0", "fx_sitemap")
def sitemap_errors(spark: SparkSession, sf: str) -> DataFrame:
    return sitemap.sitemap_locs(view(spark, sf, "fx_sitemap"))[1]


@query("""
SELECT event_id, (2023 + event_id % 3) * 12 + event_id % 12 AS month_key FROM events WHERE (2023 + event_id % 3) * 12 + event_id % 12 BETWEEN 2024 * 12 AND 2024 * 12 + 12""")
def sitemap_months(spark: SparkSession, sf: str) -> DataFrame:
    listed = view(spark, sf, "fx_sitemap").select("event_id", F.col("url").alias("loc"))
    return sitemap.monthly_sitemaps(listed, _NOW).select("event_id", "month_key")


_URLS = """
urls AS (SELECT source_id, 'https://x.example/events/details/google-gdg-' || regexp_extract(body, 'google-(gdg-[0-9]+(?:-cloud)?-presents-[0-9]+)', 1) AS url,
  regexp_extract(body, 'google-(gdg-[0-9]+(?:-cloud)?)-presents-', 1) AS slug FROM fx_sitemap WHERE event_id % 29 <> 0)
"""


@query(
    f", {_URLS}, slugs AS (SELECT 'src' || i AS source_id, unnest(['gdg-' || (i % 12), (i % 7) || '-cloud', 'gdg-1']) AS slug FROM range(20) r(i)) "
    "SELECT DISTINCT u.source_id, u.url FROM urls u WHERE EXISTS (SELECT 1 FROM slugs s WHERE s.source_id = u.source_id AND contains(u.url, '-' || s.slug || '-presents-'))",
    "fx_sitemap",
)
def chapter_urls(spark: SparkSession, sf: str) -> DataFrame:
    i = F.regexp_extract("source_id", "[0-9]+", 0).cast("int")
    slugs = F.array(F.concat(F.lit("gdg-"), i % 12), F.concat(i % 7, F.lit("-cloud")), F.lit("gdg-1"))
    wanted = view(spark, sf, "fx_sitemap").select("source_id").distinct().select("source_id", F.explode(slugs).alias("slug"))
    return sitemap.match_chapters(_listed(spark, sf), wanted)


def _listed(spark: SparkSession, sf: str) -> DataFrame:
    chapter = F.regexp_extract("body", "google-(gdg-[0-9]+(?:-cloud)?-presents-[0-9]+)", 1)
    rows = view(spark, sf, "fx_sitemap").filter("event_id % 29 <> 0")
    return rows.select("source_id", F.concat(F.lit("https://x.example/events/details/google-gdg-"), chapter).alias("url"))


# --- calendars -------------------------------------------------------------------------------

_LOCAL = "cast(cast(ts AS date) AS timestamp) + interval 1110 minute"


@query(f"""
SELECT * FROM (
SELECT 'src' || (user_id % 20) AS source_id, 'u' || event_id || '@t#' || strftime(start_utc, '%Y%m%dT%H%M%SZ') AS source_event_id, event_type || ', Treffen' AS title,
  {time_sql('start_utc')} AS start_utc, {time_sql('start_utc + interval 1 minute * minutes')} AS end_utc, 'Town ' || (user_id % 120) AS venue_address, zone AS time_zone_id
FROM (
  SELECT *, 120 AS minutes, 'Europe/Berlin' AS zone, timezone('UTC', timezone('Europe/Berlin', {_LOCAL} + interval 1 day * k)) AS start_utc FROM (
    SELECT *, unnest(CASE event_id % 6 WHEN 1 THEN list_transform(range(1 + event_id % 20), lambda i: i * 7) WHEN 2 THEN [0, 2, 4] ELSE [0] END) AS k FROM events WHERE event_id % 6 IN (0, 1, 2, 5))
  UNION ALL SELECT *, 0 AS k, 1440 AS minutes, NULL AS zone, cast(cast(ts AS date) AS timestamp) AS start_utc FROM events WHERE event_id % 6 = 3)
WHERE event_id % 23 > 1 AND start_utc + interval 1 minute * minutes >= timestamp '2024-01-15')""")
def calendar_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = calendar.extract_calendar_events(view(spark, sf, "fx_feed"), _NOW)
    return rows.select(
        "source_id", "source_event_id", "title", time_text("start_utc").alias("start_utc"), time_text("end_utc").alias("end_utc"),
        "venue_address", "time_zone_id",
    )


_MOVED = "event_id % 6 IN (1, 2) AND event_id % 5 < 2"


@query(f"""
SELECT * FROM (
SELECT 'u' || event_id || '@t#' || strftime(start_utc, '%Y%m%dT%H%M%SZ') AS source_event_id, CASE WHEN minutes = 30 THEN 'Moved' ELSE event_type || ', Treffen' END AS title,
  {time_sql('start_utc')} AS start_utc, {time_sql('start_utc + interval 1 minute * minutes')} AS end_utc
FROM (
  SELECT *, CASE WHEN k = 0 AND {_MOVED} THEN 30 ELSE 120 END AS minutes,
    timezone('UTC', timezone('Europe/Berlin', {_LOCAL} + interval 1 day * k + interval 1 minute * (CASE WHEN k = 0 AND {_MOVED} THEN 1530 ELSE 0 END))) AS start_utc FROM (
    SELECT *, unnest(CASE event_id % 6 WHEN 1 THEN list_transform(range(1 + event_id % 20), lambda i: i * 7) WHEN 2 THEN [0, 2, 4] ELSE [0] END) AS k FROM events WHERE event_id % 6 IN (0, 1, 2, 5))
  UNION ALL SELECT *, 0 AS k, 1440 AS minutes, cast(cast(ts AS date) AS timestamp) AS start_utc FROM events WHERE event_id % 6 = 3)
WHERE event_id % 23 > 1 AND start_utc + interval 1 minute * minutes >= timestamp '2024-01-15')""")
def calendar_overrides(spark: SparkSession, sf: str) -> DataFrame:
    """The first occurrence of some series moves to the evening after; the place it leaves is empty."""
    n = F.regexp_extract("url", "([0-9]+)[.]ics", 1).cast("bigint")
    day = F.regexp_extract("body", "DTSTART;TZID=Europe/Berlin:([0-9]{8})", 1)
    next_day = F.date_format(F.date_add(F.try_to_timestamp(day, F.lit("yyyyMMdd")).cast("date"), 1), "yyyyMMdd")
    zone = F.lit(";TZID=Europe/Berlin:")
    lines = F.concat_ws(
        "\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:u"), n, F.lit("@t")), F.concat(F.lit("RECURRENCE-ID"), zone, day, F.lit("T183000")),
        F.concat(F.lit("DTSTART"), zone, next_day, F.lit("T200000")), F.lit("DURATION:PT30M"), F.lit("SUMMARY:Moved"), F.lit("END:VEVENT"),
        F.lit("END:VCALENDAR"),
    )
    moved = n.isNotNull() & (n % 6).isin(1, 2) & (n % 5 < 2) & (n % 23 > 1)
    body = F.when(moved, F.replace("body", F.lit("END:VCALENDAR"), lines)).otherwise(F.col("body"))
    rows, _ = calendar.extract_calendar_events(view(spark, sf, "fx_feed").withColumn("body", body), _NOW, overrides=True)
    return rows.select("source_event_id", "title", time_text("start_utc").alias("start_utc"), time_text("end_utc").alias("end_utc"))


@query("""
SELECT 'https://x.example/' || event_id || '.ics' AS url, CASE WHEN event_id % 23 = 0 THEN 'feed is empty or not a calendar' ELSE 'entry u' || event_id || '@t: unsupported frequency' END AS error
FROM events WHERE event_id % 23 = 0 OR (event_id % 23 > 1 AND event_id % 6 = 4)""")
def calendar_errors(spark: SparkSession, sf: str) -> DataFrame:
    return calendar.extract_calendar_events(view(spark, sf, "fx_feed"), _NOW)[1].select("url", "error")


# --- robots ----------------------------------------------------------------------------------

_HOSTS = "(SELECT host, length(host) AS n FROM fx_robots)"


@query(f"SELECT host, array_to_string(list_sort(['/en/' || (n % 10), '/es/', '/de/*']), ',') AS disallow, CASE WHEN n % 3 = 0 THEN 2.5 END AS crawl_delay_s FROM {_HOSTS}", "fx_robots")
def robots_rules(spark: SparkSession, sf: str) -> DataFrame:
    return robots.robots_rules(view(spark, sf, "fx_robots"), "unnamed").withColumn("disallow", joined("disallow"))


@query(f"SELECT host, '/fr/' AS disallow, CASE WHEN n % 2 = 0 THEN 7.0 END AS crawl_delay_s FROM {_HOSTS}", "fx_robots")
def robots_rules_for_agent(spark: SparkSession, sf: str) -> DataFrame:
    return robots.robots_rules(view(spark, sf, "fx_robots"), "scoutbot").withColumn("disallow", joined("disallow"))


@query(f"""SELECT host, count(*) AS directives, max(stanza) AS stanzas FROM (SELECT host, unnest(CASE WHEN n % 3 = 0 THEN [1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3] ELSE [1, 1, 1, 2, 2, 2, 2, 3, 3, 3] END) AS stanza FROM {_HOSTS}) GROUP BY host""", "fx_robots")
def robots_stanzas(spark: SparkSession, sf: str) -> DataFrame:
    lines = robots.robots_directives(view(spark, sf, "fx_robots"))
    return lines.groupBy("host").agg(F.count(F.lit(1)).alias("directives"), F.max("stanza").alias("stanzas"))


@query(
    f"""SELECT page_id, n IS NULL OR NOT (starts_with(path, '/en/' || (n % 10)) OR starts_with(path, '/es/')) AS allowed
FROM (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages) p LEFT JOIN {_HOSTS} h USING (host)""",
    "fx_robots",
)
def url_admission(spark: SparkSession, sf: str) -> DataFrame:
    rules = robots.robots_prefixes(view(spark, sf, "fx_robots"), "unnamed")
    return robots.mark_allowed(table(spark, sf, "pages").select("page_id", "url"), rules).select("page_id", "allowed")


@query("""
, rules AS (SELECT DISTINCT split_part(split_part(url, '://', 2), '/', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages WHERE page_id % 3 = 0),
p AS (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, NOT EXISTS (SELECT 1 FROM rules r WHERE r.host = p.host AND starts_with(p.path, r.path) AND r.path <> '') AS allowed FROM p""".replace(", rules AS", "WITH rules AS", 1))
def url_admission_many_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Every third page's path is a rule of its host."""
    pages = table(spark, sf, "pages")
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1)
    rules = pages.filter("page_id % 3 = 0").select(url_host("url").alias("host"), path.alias("prefix")).filter("prefix <> ''")
    return robots.mark_allowed(pages.select("page_id", "url"), rules).select("page_id", "allowed")


# --- fetches ---------------------------------------------------------------------------------

_GOOD = """
good AS (SELECT source_id, url, arg_max(body, fetched_at) AS body, max(fetched_at) AS fetched_at FROM fx_crawl WHERE http_status = 200 AND fetched_at < timestamp '2024-01-10' GROUP BY ALL),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, url ORDER BY fetched_at DESC) AS rn FROM fx_crawl WHERE fetched_at >= timestamp '2024-01-10') WHERE rn = 1)
"""


def _rounds(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    landed = view(spark, sf, "fx_crawl")
    late = F.col("fetched_at") >= F.lit("2024-01-10").cast("timestamp")
    return crawl.last_good(landed.filter(~late)), crawl.newest_fetches(landed.filter(late))


@query(f", {_GOOD} SELECT source_id, url, body, {time_sql("fetched_at")} AS fetched_at FROM good", "fx_crawl")
def last_good_fetches(spark: SparkSession, sf: str) -> DataFrame:
    return _rounds(spark, sf)[0].select("source_id", "url", "body", time_text("fetched_at").alias("fetched_at"))


@query(
    f""", {_GOOD} SELECT n.source_id, n.url, CASE WHEN n.http_status = 304 THEN g.body ELSE n.body END AS body, n.http_status IS NOT DISTINCT FROM 304 AND g.body IS NOT NULL AS not_modified,
  CASE WHEN n.http_status IS NULL THEN 'unreachable' WHEN n.http_status = 200 OR (n.http_status = 304 AND g.body IS NOT NULL) THEN 'ok' ELSE 'http-error' END AS outcome,
  CASE WHEN n.http_status IS NULL THEN 'Failed to reach ' || n.url || ': timed out' WHEN n.http_status = 404 OR (n.http_status = 304 AND g.body IS NULL) THEN n.http_status || ' fetching ' || n.url END AS problem
FROM newest n LEFT JOIN good g USING (source_id, url)""",
    "fx_crawl",
)
def carried_fetches(spark: SparkSession, sf: str) -> DataFrame:
    cached, landed = _rounds(spark, sf)
    return crawl.carry_forward(landed, cached).select("source_id", "url", "body", "not_modified", "outcome", "problem")


@query(
    """SELECT source_id, url AS page_url, CASE WHEN event_id % 2 = 0 THEN 'parsed before' ELSE body END AS title FROM fx_crawl WHERE http_status = 200""",
    "fx_crawl",
)
def reused_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Even pages were parsed in an earlier run; only the others go through the extractor."""
    landed = view(spark, sf, "fx_crawl").filter("http_status = 200")
    fetches = landed.withColumn("url", F.concat_ws("#", "url", "event_id"))
    known = fetches.filter("event_id % 2 = 0").select(
        "source_id", F.col("url").alias("page_url"), F.lit("parsed before").alias("title"), crawl.content_hash().alias("content_hash")
    )
    extract = lambda p: p.select("source_id", F.col("url").alias("page_url"), F.col("body").alias("title"))
    rows = crawl.reuse_parsed(fetches.select("source_id", "url", "body"), known, extract)
    return rows.select("source_id", F.substring_index("page_url", "#", 1).alias("page_url"), "title")


# --- adapters and verification -----------------------------------------------------------------


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    """One HTML source per landed state page, a tenth under robots rules, some of other kinds."""
    n = F.regexp_extract("url", "/g([0-9]+)/", 1).cast("bigint")
    rows = view(spark, sf, "fx_state_page").select(n.alias("n"), "url")
    return with_registry_defaults(
        rows.select(
            "n",
            F.concat(F.lit("s"), "n").alias("id"),
            F.lit("org").alias("org"),
            F.when(n % 31 == 0, "rss").otherwise("html").alias("type"),
            "url",
            F.when(n % 37 == 0, "other").otherwise("meetup-group").alias("adapter"),
            F.lit(None).cast("array<string>").alias("tags"),
            F.lit(None).cast("array<string>").alias("slugs"),
            (n % 41 != 0).alias("enabled"),
        )
    )


def _fetches(spark: SparkSession, sf: str) -> DataFrame:
    n = F.regexp_extract("url", "/g([0-9]+)/", 1).cast("bigint")
    status = F.when(n % 7 == 0, 503).when(n % 7 != 1, 200)
    landed = view(spark, sf, "fx_state_page").select(
        F.concat(F.lit("s"), n).alias("source_id"), "url", status.cast("int").alias("http_status"),
        F.when(n % 7 == 1, "refused").alias("error"), "body", F.lit(None).cast("string").alias("etag"),
        F.lit(None).cast("string").alias("last_modified"), F.lit("2024-01-01").cast("timestamp").alias("fetched_at"),
    )
    return crawl.carry_forward(landed, crawl.last_good(landed.filter("1 = 0")))


def _rules(spark: SparkSession, sf: str) -> DataFrame:
    hosts = view(spark, sf, "fx_state_page").select(url_host("url").alias("host")).distinct()
    return hosts.withColumn("disallow", F.array(F.lit("/g1")))


_VERIFIED = """
s AS (SELECT event_id AS n, 's' || event_id AS source_id, 'https://x.example/g' || event_id || '/events/' AS url, ts FROM events WHERE event_id % 41 <> 0),
outcome AS (SELECT *, CASE WHEN n % 31 = 0 THEN 'type' WHEN starts_with(url, 'https://x.example/g1') THEN 'robots' WHEN n % 37 = 0 THEN 'adapter' WHEN n % 7 = 1 THEN 'down' WHEN n % 7 = 0 THEN 'status'
  WHEN n % 17 < 2 THEN 'parse' ELSE 'ok' END AS o FROM s)
"""


@query(f"""
WITH {_VERIFIED} SELECT source_id, o NOT IN ('type', 'down') AS reachable, CASE o WHEN 'status' THEN 503 WHEN 'ok' THEN 200 END AS http_status,
  CASE WHEN o = 'ok' AND n % 17 > 2 AND CASE WHEN n % 2 = 0 THEN cast(cast(ts AS date) AS timestamp) + interval 1365 minute ELSE {_START} + interval 15 minute END >= timestamp '2024-01-15' THEN 1 ELSE 0 END AS event_count,
  CASE o WHEN 'type' THEN 'Sources of type ''rss'' have no adapter.' WHEN 'robots' THEN 'robots.txt disallows fetching ' || url WHEN 'adapter' THEN 'Pages of adapter ''other'' have no parser.'
    WHEN 'down' THEN 'Failed to reach ' || url || ': refused' WHEN 'parse' THEN CASE WHEN n % 17 = 0 THEN 'no __NEXT_DATA__ script found' ELSE '__NEXT_DATA__ has no props.pageProps.__APOLLO_STATE__' END END AS first_parse_error
FROM outcome""")
def source_verification(spark: SparkSession, sf: str) -> DataFrame:
    sources, fetches = _sources(spark, sf), _fetches(spark, sf)
    rows, errors = collect_raw(sources, fetches, _rules(spark, sf), _NOW)
    return health.verify_sources(sources, fetches, rows, errors)


@query(f"WITH {_VERIFIED} SELECT count(*) AS failed FROM outcome WHERE o <> 'ok'")
def failed_sources(spark: SparkSession, sf: str) -> DataFrame:
    sources, fetches = _sources(spark, sf), _fetches(spark, sf)
    rows, errors = collect_raw(sources, fetches, _rules(spark, sf), _NOW)
    report = health.verify_sources(sources, fetches, rows, errors)
    return health.failed_sources(report).agg(F.count(F.lit(1)).alias("failed"))


# --- discovery -------------------------------------------------------------------------------


@query("""
SELECT slug, count(*) AS future_events FROM (SELECT regexp_extract(url, '/events/details/google-(.+?)-presents-', 1) AS slug FROM fx_jsonld_page) WHERE slug <> '' GROUP BY slug""", "fx_jsonld_page")
def chapter_counts(spark: SparkSession, sf: str) -> DataFrame:
    return discover.chapter_counts(view(spark, sf, "fx_jsonld_page"))


@query("""
SELECT 'gdg-' || k AS slug, CASE WHEN k % 5 = 0 THEN 'gdg-' || k ELSE 'Title ' || k END AS title, CASE WHEN k % 2 = 0 THEN 'Town ' || k ELSE '' END AS location, n AS future_events
FROM (SELECT user_id % 12 AS k, count(*) AS n FROM events GROUP BY 1) WHERE k % 3 <> 0""")
def chapter_report(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    body = F.concat(
        F.lit('<script>{"country" : "'), F.when(k % 3 == 0, "US").otherwise("DE"), F.lit('"'),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(',"chapter_title":"Title '), k, F.lit('"'))),
        F.lit(',"chapter_location": "'), F.when(k % 2 == 0, F.concat(F.lit("Town "), k)).otherwise(""), F.lit('"}</script>'),
    )
    chapters = table(spark, sf, "events").select((F.col("user_id") % 12).alias("k")).distinct()
    landed = chapters.select(F.concat(F.lit("gdg-"), k).alias("slug"), body.alias("body"))
    counts = discover.chapter_counts(view(spark, sf, "fx_jsonld_page"))
    return discover.chapter_report(counts, landed)


_HARVEST = """
seen AS (SELECT event_id, user_id % 40 AS k, 'Town ' || (event_id % 7) AS city, 'City' || (event_id % 4) || '/kw' || (event_id % 3) AS route FROM events WHERE event_id % 17 > 2),
harvest AS (SELECT 'g' || k AS slug, 'Group ' || k AS name, arg_min(city, event_id) AS city, array_to_string(list_sort(list(DISTINCT route))[1:3], ',') AS routes FROM seen GROUP BY k)
"""


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    n = F.regexp_extract("url", "/g([0-9]+)/", 1).cast("bigint")
    route = F.concat(F.lit("City"), n % 4, F.lit("/kw"), n % 3)
    found = view(spark, sf, "fx_state_page").select(n.alias("page_no"), route.alias("route"), "body")
    city = found.select("page_no", F.col("route").alias("city"), "body")
    return discover.harvest_groups(found, city)


@query(f"WITH {_HARVEST} SELECT * FROM harvest")
def group_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _candidates(spark, sf).withColumn("routes", joined("routes"))


# The landed page of group g<k> is the state page of event k.
_REPORT = f"""
{_HARVEST}, report AS (SELECT h.slug, h.name, h.city AS search_city, CASE WHEN up AND e.event_id % 4 IN (0, 2) AND e.user_id % 8 <> 0 THEN 'Town ' || (e.user_id % 120) ELSE '' END AS venue_city,
  CASE WHEN up THEN 1 ELSE 0 END AS upcoming, CASE WHEN up AND e.event_id % 4 IN (0, 2) THEN 1 ELSE 0 END AS physical, CASE WHEN up THEN cast(cast(e.ts AS date) AS varchar) END AS next,
  CASE WHEN up AND e.event_id % 6 <> 0 THEN left(e.event_type || ' night', 8) ELSE '' END AS titles, h.routes
FROM harvest h JOIN (SELECT *, event_id % 17 > 2 AND cast(ts AS date) >= date '2024-01-01' AS up FROM events) e ON h.slug = 'g' || e.event_id)
"""


def _group_report(spark: SparkSession, sf: str, candidates: DataFrame) -> DataFrame:
    slug = F.concat(F.lit("g"), F.regexp_extract("url", "/g([0-9]+)/", 1))
    landed = view(spark, sf, "fx_state_page").select(slug.alias("slug"), "body")
    return discover.group_report(candidates, landed, "2024-01-01", titles_kept=2, title_width=8)


@query(f"WITH {_REPORT} SELECT * FROM report")
def group_report(spark: SparkSession, sf: str) -> DataFrame:
    candidates = write_through(_candidates(spark, sf), "candidates")
    report = discover.ranked_groups(_group_report(spark, sf, candidates), "physical")
    return report.withColumns({"titles": joined("titles"), "routes": joined("routes")})


@query(f"WITH {_REPORT} SELECT (SELECT count(*) FROM harvest) AS candidates, (SELECT count(*) FROM report) AS reachable, (SELECT count(*) FROM report WHERE upcoming > 0) AS live")
def discovery_summary(spark: SparkSession, sf: str) -> DataFrame:
    candidates = write_through(_candidates(spark, sf), "candidates")
    return discover.discovery_summary(candidates, _group_report(spark, sf, candidates))
