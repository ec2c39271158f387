"""Address geocoder: pending queries, landed answers and the cache."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import geocode_key, geocode_precision, geocode_query, looks_like_street
from ..functions.fixed_values import GERMANY_LAT, GERMANY_LON
from ..functions.times import instant
from ..operators.joins import salted_join

_ANSWER = (
    "features array<struct<geometry:struct<coordinates:array<double>>,"
    "properties:struct<street:string,housenumber:string>>>"
)
CACHE_SCHEMA = "query string, found boolean, lat double, lon double, precision string, resolved_at timestamp"


def geocoder_eligible() -> Column:
    """No explicit coordinates, not online, and an address that looks like a street."""
    explicit = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    online = F.coalesce(F.col("attendance_hint") == "Online", F.lit(False))
    return ~explicit & ~online & looks_like_street("venue_address")


def geocode_requests(raw: DataFrame) -> DataFrame:
    """Distinct queries the raw events need: cache key and query text."""
    asked = raw.filter(geocoder_eligible()).select(
        geocode_key("venue_address", "postal_code", "city").alias("query"),
        geocode_query("venue_address", "postal_code", "city").alias("text"),
    )
    return asked.groupBy("query").agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("events"))


def pending_geocodes(raw: DataFrame, cache: DataFrame, cap: int | None = None) -> DataFrame:
    """Queries without a cache entry; with ``cap``, a geocoder's quota, at most so many per run.

    Under a quota the queries with the most events go first; the rest waits for a later run and
    falls back to the gazetteer until then.
    """
    open_queries = geocode_requests(raw).join(cache.select("query"), "query", "left_anti")
    return open_queries if cap is None else open_queries.orderBy(F.desc("events"), "query").limit(cap)


def read_answers(responses: DataFrame) -> DataFrame:
    """``query, http_status, body`` to ``query, found, lat, lon, precision``.

    The first feature counts if it lies in the country box and is precise to the street. Anything
    coarser and any status outside 2xx is a negative answer. Rows without a status, or whose body
    is no JSON, were not answered and are left out.
    """
    ok = F.col("http_status").between(200, 299)
    feature = F.get(F.col("answer.features"), F.lit(0))
    point = F.when(F.size(feature["geometry"]["coordinates"]) == 2, feature["geometry"]["coordinates"])
    parsed = responses.filter(F.col("http_status").isNotNull() & (~ok | F.try_parse_json("body").isNotNull())).select(
        "query", ok.alias("ok"), F.from_json("body", _ANSWER).alias("answer")
    )
    read = parsed.select(
        "query",
        "ok",
        point[1].alias("lat"),
        point[0].alias("lon"),
        geocode_precision(feature["properties"]["street"], feature["properties"]["housenumber"]).alias("precision"),
    )
    usable = F.coalesce(
        F.col("ok")
        & F.col("lat").between(*GERMANY_LAT)
        & F.col("lon").between(*GERMANY_LON)
        & F.col("precision").isNotNull(),
        F.lit(False),
    )
    return read.select(
        "query",
        usable.alias("found"),
        F.when(usable, F.col("lat")).alias("lat"),
        F.when(usable, F.col("lon")).alias("lon"),
        F.when(usable, F.col("precision")).otherwise(F.lit("None")).alias("precision"),
    )


def apply_answers(cache: DataFrame, responses: DataFrame, now: datetime | str) -> DataFrame:
    """Cache after a run: the newest entry per query."""
    answers = read_answers(responses).withColumn("resolved_at", instant(now))
    return newest_entries(cache.unionByName(answers))


def newest_entries(cache: DataFrame) -> DataFrame:
    fields = [c for c in cache.columns if c != "query"]
    newest = F.max_by(F.struct(*fields), F.struct("resolved_at", "found", "lat", "lon"))
    return cache.groupBy("query").agg(newest.alias("e")).select("query", "e.*")


def lookup_cached(raw: DataFrame, cache: DataFrame, spread_by: list[str]) -> DataFrame:
    """``raw`` plus ``cached``: the cache entry of its query, null for rows that ask none."""
    entry = cache.select(
        F.col("query").alias("_query"), F.struct("found", "lat", "lon", "precision").alias("cached")
    )
    key = F.when(geocoder_eligible(), geocode_key("venue_address", "postal_code", "city"))
    return salted_join(raw.withColumn("_query", key), entry, ["_query"], "left", spread_by).drop("_query")
