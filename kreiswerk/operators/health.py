"""Source health: run log, status views and verification."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import instant
from ..sources.registry import SOURCE_TYPES
from .joins import lookup_join

RUN_SCHEMA = "source_id string, run_utc timestamp, success_utc timestamp, event_count int, error string"


def run_outcomes(
    registry: DataFrame,
    events: DataFrame,
    errors: DataFrame,
    now: datetime | str,
    attempted: DataFrame | None = None,
) -> DataFrame:
    """One run-log row per enabled source, of those in ``attempted`` (source_id) or with an error if given.

    ``events`` are the normalised events before batch deduplication, which is what the count
    counts. ``errors`` has ``source_id, error``; a source with an error counts as failed, with no
    events and no success time.
    """
    counts = events.groupBy("source_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    first = errors.groupBy("source_id").agg(F.min("error").alias("error"))
    sources = registry.filter("enabled").select(F.col("id").alias("source_id"))
    if attempted is not None:
        tried = attempted.select("source_id").unionByName(errors.select("source_id")).distinct()
        sources = sources.join(tried, "source_id", "left_semi")
    ok = F.col("error").isNull()
    return (
        sources.join(counts, "source_id", "left")
        .join(first, "source_id", "left")
        .select(
            "source_id",
            instant(now).alias("run_utc"),
            F.when(ok, instant(now)).alias("success_utc"),
            F.when(ok, F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).alias("event_count"),
            "error",
        )
    )


def latest_status(runs: DataFrame) -> DataFrame:
    """Status of the newest run; after a failure the success time is null and the count zero."""
    newest = F.max_by(F.struct("run_utc", "success_utc", "event_count", "error"), F.struct("run_utc", "success_utc"))
    return (
        runs.groupBy("source_id")
        .agg(newest.alias("r"))
        .select(
            "source_id",
            F.col("r.run_utc").alias("last_run_utc"),
            F.col("r.success_utc").alias("last_success_utc"),
            F.col("r.event_count").alias("event_count"),
            F.col("r.error").alias("last_error"),
        )
    )


def last_good_runs(runs: DataFrame) -> DataFrame:
    """Last success over the whole log, which survives later failures."""
    return (
        runs.filter("success_utc is not null")
        .groupBy("source_id")
        .agg(F.max("success_utc").alias("last_good_utc"), F.max_by("event_count", "success_utc").alias("last_good_count"))
    )


def source_report(registry: DataFrame, status: DataFrame) -> DataFrame:
    """Every registry entry with its status; zero events and nulls where it never ran."""
    joined = registry.join(status.withColumnRenamed("source_id", "id"), "id", "left")
    return joined.select(
        "id", "org", "type", "url", "enabled", "last_run_utc", "last_success_utc",
        F.coalesce("event_count", F.lit(0)).alias("event_count"), "last_error",
    )


def unresolved_count(events: DataFrame) -> DataFrame:
    return events.filter("location_status = 'Unresolved'").agg(F.count(F.lit(1)).alias("unresolved_count"))


def with_source_org(events: DataFrame, registry: DataFrame) -> DataFrame:
    """Events with the organisation of their source, the source id where it is not registered."""
    orgs = registry.select(F.col("id").alias("source_id"), "org")
    joined = lookup_join(events, orgs, ["source_id"], "left", spread_by=["source_event_id"])
    return joined.withColumn("org", F.coalesce("org", "source_id"))


# --- verification --------------------------------------------------------------------------


def verify_sources(registry: DataFrame, fetches: DataFrame, events: DataFrame, errors: DataFrame) -> DataFrame:
    """One row per enabled source: reachable, status, number of events, first problem.

    ``fetches`` is the result of ``carry_forward``, ``errors`` has ``source_id, kind, error`` with
    kind ``robots``, ``parse`` or ``registry``. Outcomes are tested in the order in which a fetch
    can fail: unknown type, robots, unregistered adapter, no answer, bad status, unreadable answer.
    """
    counts = events.groupBy("source_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    bad = fetches.filter("outcome <> 'ok'").groupBy("source_id").agg(
        F.min_by(F.struct("outcome", "http_status", "problem"), F.struct("outcome", "url")).alias("bad")
    )
    kind = lambda k: F.min(F.when(F.col("kind") == k, F.col("error")))
    problems = errors.groupBy("source_id").agg(
        kind("robots").alias("robots"), kind("parse").alias("parse"), kind("registry").alias("unregistered")
    )
    sources = registry.filter("enabled").select(F.col("id").alias("source_id"), "type")
    joined = sources
    for other in (counts, bad, problems):
        joined = joined.join(other, "source_id", "left")
    known = F.col("type").isin(*SOURCE_TYPES)
    cases = [
        (~known, False, None, F.concat(F.lit("Sources of type '"), "type", F.lit("' have no adapter."))),
        (F.col("robots").isNotNull(), True, None, F.col("robots")),
        (F.col("unregistered").isNotNull(), True, None, F.col("unregistered")),
        (F.col("bad.outcome") == "unreachable", False, None, F.col("bad.problem")),
        (F.col("bad.outcome") == "http-error", True, F.col("bad.http_status"), None),
        (F.col("parse").isNotNull(), True, None, F.col("parse")),
    ]
    return joined.select(
        "source_id",
        _first_case(cases, 1, F.lit(True)).alias("reachable"),
        _first_case(cases, 2, F.lit(200)).cast("int").alias("http_status"),
        _first_case([(c, 0) for c, *_ in cases], 1, F.coalesce("n", F.lit(0))).cast("int").alias("event_count"),
        _first_case(cases, 3, F.lit(None)).cast("string").alias("first_parse_error"),
    )


def failed_sources(report: DataFrame) -> DataFrame:
    return report.filter(
        ~F.col("reachable") | ~F.col("http_status").eqNullSafe(200) | F.col("first_parse_error").isNotNull()
    )


def _first_case(cases: list, field: int, otherwise: Column) -> Column:
    out = otherwise
    for case in reversed(cases):
        value = case[field]
        out = F.when(F.coalesce(case[0], F.lit(False)), value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out
