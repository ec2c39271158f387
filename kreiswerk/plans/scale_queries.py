"""Queries over keyword tables, the substring index, paging by cursor, and repeated passes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold, fold_constant, tokenize
from ..operators import search, store
from ..operators.gazetteer import place_keys, postal_lookup
from ..operators.keywords import keyword_tags
from ..operators.rows import computed
from ..operators.text_index import TEXT_KEY, distinct_texts, text_key, with_text_indexed, write_text_index
from ..session import new_folder, write_through
from .catalog import bounded_sql, fold_sql, query, time_sql, time_text, tokens_sql
from .fixtures import table, view
from .ingest import ingest, page_adapter
from .search_queries import _STORED, CENTER, _circle_sql, places, postal, stored_events
from .source_queries import _VERIFIED, _rules, _sources, _START
from .store_queries import _EVENTS, events

# --- keywords --------------------------------------------------------------------------------


@query(f"""
WITH b AS (SELECT {tokens_sql(fold_sql('text'))} AS t FROM benchmark),
k AS (SELECT DISTINCT unnest(t) AS keyword FROM b UNION SELECT DISTINCT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM b
  UNION SELECT DISTINCT unnest(t) || '.' FROM b),
d AS (SELECT conv_id, turn, {fold_sql('text')} AS folded FROM conversations),
w AS (SELECT DISTINCT conv_id, turn, folded, unnest({tokens_sql('folded')}) AS word FROM d),
m AS (SELECT DISTINCT conv_id, turn, folded, keyword FROM w JOIN k ON split_part(replace(keyword, '.', ''), ' ', 1) = word)
SELECT conv_id, turn, substr(keyword, 1, 2) AS tag, count(*) AS keywords FROM m
WHERE {bounded_sql('folded', "' || replace(keyword, '.', '[.]') || '")} GROUP BY ALL""")
def keyword_table_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Words, pairs of words and words with a full stop of the benchmark, as keywords of the turns."""
    words = computed(table(spark, sf, "benchmark"), tokenize(fold("text")).alias("t"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.concat_ws(" ", F.get("t", i - 1), F.get("t", i)))
    stops = F.transform("t", lambda w: F.concat(w, F.lit(".")))
    every = F.concat("t", F.when(F.size("t") > 1, pairs).otherwise(F.array().cast("array<string>")), stops)
    keywords = words.select(F.explode(every).alias("keyword")).distinct()
    named = keywords.withColumn("tag", F.concat_ws("|", F.left("keyword", F.lit(2)), "keyword"))
    turns = table(spark, sf, "conversations")
    found = keyword_tags(turns, named, F.col("text"), ["conv_id", "turn"])
    found = found.withColumn("tag", F.substring_index("tag", "|", 1))
    return found.groupBy("conv_id", "turn", "tag").agg(F.count(F.lit(1)).alias("keywords"))


# --- substring index and cursor ----------------------------------------------------------------


@query(
    f""", {_STORED}, n AS (SELECT unnest(['koel', 'o', 'groesse', 'keinstueck', 'machine learn']) AS needle)
SELECT needle, id FROM stored, n WHERE contains({fold_sql('title')}, needle) OR contains({fold_sql("coalesce(description, '')")}, needle)
  OR contains({fold_sql("coalesce(venue_name, '')")}, needle) OR contains({fold_sql("coalesce(city, '')")}, needle) OR contains({fold_sql("array_to_string(tags, '|')")}, needle)""",
    "fx_raw_event",
)
def text_search_indexed(spark: SparkSession, sf: str) -> DataFrame:
    rows = write_through(stored_events(spark, sf).withColumn("text_key", text_key()), "events")
    texts = write_through(distinct_texts(rows), "texts")
    index = write_text_index(texts, new_folder(spark, "grams"), TEXT_KEY, F.col("text"))
    out = None
    for text in ("KÖL", "o", "Größe", "keinstück", "machine LEARN"):
        needle = fold_constant(text) if text != "KÖL" else "koel"
        found = with_text_indexed(rows, index, needle, TEXT_KEY).select(F.lit(needle).alias("needle"), "id")
        out = found if out is None else out.unionByName(found)
    return out


@query(
    f""", {_STORED}, ranked AS (SELECT id, start_utc, row_number() OVER (ORDER BY start_utc, id) AS n FROM stored WHERE {_circle_sql(*CENTER, 300.0)})
SELECT CAST((n - 1) // 40 AS integer) AS page, id, {time_sql('start_utc')} AS start_utc FROM ranked WHERE n <= 120""",
    "fx_raw_event",
)
def pages_by_cursor(spark: SparkSession, sf: str) -> DataFrame:
    """Three pages, each from where the one before ended; equal to pages by offset."""
    rows = write_through(stored_events(spark, sf), "events")
    after, out = None, None
    for n in range(3):
        page, _ = search.search_events(rows, search.EventQuery(*CENTER, 300.0, limit=40, after=after))
        page = write_through(page.select(F.lit(n).alias("page"), "id", "start_utc"), "page")
        after = search.cursor(page) or after
        out = page if out is None else out.unionByName(page)
    return out.withColumn("start_utc", time_text("start_utc"))


# --- passes ------------------------------------------------------------------------------------


@query(
    f""", {_EVENTS}, first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, dedupe_key ORDER BY seen, feed_pos) AS rn FROM stored) WHERE rn = 1)
SELECT id, CAST(1 AS integer) AS version, CAST(2 AS integer) AS month FROM first""",
    "fx_raw_event",
)
def store_after_empty_pass(spark: SparkSession, sf: str) -> DataFrame:
    """A merge without events, one with all, the same once more, and another without events."""
    every = write_through(events(spark, sf), "events")
    none, errors = every.limit(0), every.limit(0).selectExpr("source_id", "'' AS error")
    kept = store.EventStore(spark, new_folder(spark, "store"), buckets=8)
    for rows, when, name in ((none, "2024-01-01", "a"), (every, "2024-02-01", "b"), (every, "2024-03-01", "b"), (none, "2024-04-01", "c")):
        version = kept.upsert_events(rows, errors, when, name)
    return kept.events.read().select("id", F.lit(version).alias("version"), F.month("last_seen_utc").alias("month"))


def _landed(spark: SparkSession, sf: str) -> DataFrame:
    n = F.regexp_extract("url", "/g([0-9]+)/", 1).cast("bigint")
    return view(spark, sf, "fx_state_page").select(
        F.concat(F.lit("s"), n).alias("source_id"), "url", F.when(n % 7 == 0, 503).when(n % 7 != 1, 200).cast("int").alias("http_status"),
        F.when(n % 7 == 1, "refused").alias("error"), "body", F.lit(None).cast("string").alias("etag"),
        F.lit(None).cast("string").alias("last_modified"), F.lit("2024-01-01").cast("timestamp").alias("fetched_at"),
    )


_LIVE = f"o = 'ok' AND n % 17 > 2 AND CASE WHEN n % 2 = 0 THEN cast(cast(ts AS date) AS timestamp) + interval 1365 minute ELSE {_START} + interval 15 minute END >= timestamp '2024-01-15'"

_LATE = _LIVE.replace("2024-01-15", "2024-01-16")


@query(f"""
WITH {_VERIFIED} SELECT source_id, CAST(2 AS bigint) AS runs, CASE WHEN {_LIVE} THEN 1 ELSE 0 END AS event_count, CAST(CASE WHEN {_LIVE} THEN 1 ELSE 0 END AS bigint) AS stored,
  CASE WHEN {_LIVE} THEN 15 END AS first_day, CASE WHEN {_LATE} THEN 16 WHEN {_LIVE} THEN 15 END AS last_day,
  CASE WHEN o = 'type' THEN 'Sources of type ''rss'' have no adapter.' ELSE least(CASE WHEN n % 37 = 0 THEN 'Pages of adapter ''other'' have no parser.' END,
    CASE WHEN starts_with(url, 'https://x.example/g1') THEN 'robots.txt disallows fetching ' || url WHEN n % 7 = 1 THEN 'Failed to reach ' || url || ': refused' WHEN n % 7 = 0 THEN '503 fetching ' || url
      WHEN o = 'parse' THEN CASE WHEN n % 17 = 0 THEN 'no __NEXT_DATA__ script found' ELSE '__NEXT_DATA__ has no props.pageProps.__APOLLO_STATE__' END END) END AS error
FROM outcome""")
def ingest_run(spark: SparkSession, sf: str) -> DataFrame:
    """A pass over all sources, a second one where every good page is unchanged, and that one repeated.

    Of several errors of a source the log has the smallest.
    """
    registry, crawl = write_through(_sources(spark, sf), "registry"), write_through(_landed(spark, sf), "crawl")
    rules = write_through(_rules(spark, sf), "rules")
    unchanged = crawl.withColumns(
        {
            "http_status": F.when(F.col("http_status") == 200, 304).otherwise(F.col("http_status")),
            "body": F.when(F.col("http_status") != 200, F.col("body")),
            "fetched_at": F.lit("2024-01-02").cast("timestamp"),
        }
    )
    kept = store.EventStore(spark, new_folder(spark, "store"), buckets=8)
    keys = write_through(place_keys(places(spark, sf)), "places")
    codes = write_through(postal_lookup(postal(spark, sf)), "codes")
    first, second = datetime(2024, 1, 15), datetime(2024, 1, 16)
    passes = (crawl, first, "p1"), (unchanged, second, "p2"), (unchanged, second, "p2")
    for rows, when, name in passes:
        ingest(kept, registry, rows, rules, keys, codes, when, keyword_to_tag={}, adapters={"html": page_adapter()}, pass_id=name)
    log = kept.runs.read().groupBy("source_id").agg(
        F.count(F.lit(1)).alias("runs"), F.max("event_count").alias("event_count"), F.max_by("error", "run_utc").alias("error")
    )
    found = kept.events.read().groupBy("source_id").agg(
        F.count(F.lit(1)).alias("stored"), F.min(F.day("first_seen_utc")).alias("first_day"), F.max(F.day("last_seen_utc")).alias("last_day")
    )
    return log.join(found, "source_id", "left").withColumn("stored", F.coalesce("stored", F.lit(0).cast("long")))
