"""Event store: per-source upsert with last-good retention, run log, fetch, parse and geocode caches."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import instant
from ..sources.crawl import PARSED_KEY, PARSED_SCHEMA, last_good, succeeded
from ..sources.events import EVENT_COLUMNS, EVENT_KEY, EVENT_SCHEMA
from ..sources.geocode import CACHE_SCHEMA, newest_entries
from .dedupe import dedupe_batch, drop_id_collisions
from .health import RUN_SCHEMA
from .joins import lookup_join
from .search import search_text
from .tables import AppendTable, BucketTable

# Parsed pages stay for so long after a pass last met them.
PARSED_DAYS = 60
_FETCH_SCHEMA = "source_id string, url string, body string, etag string, last_modified string, fetched_at timestamp"


def upsert(current: DataFrame, batch: DataFrame, now: datetime | str) -> DataFrame:
    """Stored events after a batch.

    The batch is reduced to one row per source and dedupe key. New events get both times set to
    ``now``; known ones take every value of the batch, keep their first time and get a new last
    time. Events that are missing from the batch stay as they are.
    """
    incoming = drop_id_collisions(dedupe_batch(batch)).select(*EVENT_COLUMNS)
    c, n = current.alias("c"), incoming.alias("n")
    same = [F.col(f"c.{k}") == F.col(f"n.{k}") for k in EVENT_KEY]
    arrived = F.col("n.source_id").isNotNull()
    kept = {"first_seen_utc": F.coalesce("c.first_seen_utc", instant(now)), "id": F.coalesce("c.id", "n.id")}
    kept["last_seen_utc"] = F.when(arrived, instant(now)).otherwise(F.col("c.last_seen_utc"))
    value = lambda name: F.when(arrived, F.col(f"n.{name}")).otherwise(F.col(f"c.{name}"))
    return c.join(n, same, "full_outer").select(*[kept.get(f, value(f)).alias(f) for f in EVENT_COLUMNS])


def only_successful(events: DataFrame, errors: DataFrame) -> DataFrame:
    """Events of sources without an error; the stored events of a failed source are not touched."""
    failed = errors.select("source_id").distinct()
    return lookup_join(events, failed, ["source_id"], "left_anti", spread_by=["source_event_id"])


class EventStore:
    """The tables of one store folder."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.events = BucketTable(spark, f"{path}/events", EVENT_SCHEMA, ["source_id"], buckets)
        self.fetches = BucketTable(spark, f"{path}/fetches", _FETCH_SCHEMA, ["source_id"], buckets)
        self.parsed = BucketTable(spark, f"{path}/parsed", PARSED_SCHEMA, ["source_id"], buckets)
        self.runs = AppendTable(spark, f"{path}/runs", RUN_SCHEMA)
        self.geocodes = AppendTable(spark, f"{path}/geocodes", CACHE_SCHEMA)

    def upsert_events(self, batch: DataFrame, errors: DataFrame, now: datetime | str, pass_id: str | None = None) -> int:
        """Merge the events of the successful sources and return the version."""
        good = only_successful(batch, errors)
        return self.events.merge(good, lambda current, new: upsert(current, new, now), pass_id)

    def keep_parsed(self, pages: DataFrame, now: datetime | str, pass_id: str | None = None, days: int = PARSED_DAYS) -> int:
        """Remember parsed pages (see ``sources.crawl.PARSED_SCHEMA``); those not met for ``days`` go."""
        newest = W.partitionBy(*PARSED_KEY).orderBy(F.desc("used_utc"))
        oldest = F.timestamp_add("DAY", F.lit(-days), instant(now))

        def combine(old: DataFrame, new: DataFrame) -> DataFrame:
            every = old.unionByName(new).withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
            return every.filter(F.col("used_utc") >= oldest)

        return self.parsed.merge(pages, combine, pass_id)

    def keep_fetches(self, crawl: DataFrame, pass_id: str | None = None) -> int:
        """Remember the newest successful body of each address."""
        columns = [f.split()[0] for f in _FETCH_SCHEMA.split(", ")]
        fresh = crawl.filter(succeeded()).select(*columns)
        status = {"http_status": F.lit(200), "error": F.lit(None).cast("string")}
        return self.fetches.merge(
            fresh, lambda old, new: last_good(old.unionByName(new).withColumns(status)).select(*columns), pass_id
        )

    def geocode_cache(self) -> DataFrame:
        return newest_entries(self.geocodes.read())


def write_search_table(events: DataFrame, path: str) -> None:
    """Copy of the events laid out for radius search.

    Rows are range-partitioned and sorted by quarter-degree cell and start, so a box filter skips
    most row groups by their statistics and a crowded cell spreads over several files. The folded
    search text is stored with them.
    """
    cell = [F.floor(F.col("lat") * 4), F.floor(F.col("lon") * 4)]
    located = events.withColumn("search_text", search_text())
    laid_out = located.repartitionByRange(*cell, "start_utc").sortWithinPartitions(*cell, "start_utc")
    laid_out.write.mode("errorifexists").parquet(path)
