"""Ingestion of landed crawl results: adapters, normalisation, and one complete run."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import KEYWORD_TO_TAG
from ..functions.tags import extract_tags, merge_tags
from ..functions.text import clean_description, clean_title
from ..functions.times import dedupe_key, default_zone, instant, not_ended
from ..functions.urls import event_id
from ..operators.health import run_outcomes
from ..operators.joins import fits_broadcast, key_counts, lookup_join, salted_join
from ..operators.keywords import keyword_tags
from ..operators.resolve import resolve_locations
from ..operators.store import EventStore
from ..session import prepare, write_through
from ..sources.calendar import calendar_events
from ..sources.crawl import (
    PARSED_SCHEMA, carry_forward, known_good, newest_fetches, parse_pages, parsed_events, with_unlanded,
)
from ..sources.events import RAW_SCHEMA, raw_events
from ..sources.geocode import apply_answers, pending_geocodes
from ..sources.pages import extract_jsonld_events, extract_state_events
from ..sources.registry import enabled_sources
from ..sources.robots import mark_allowed
from ..sources.sitemap import match_chapters, monthly_sitemaps, sitemap_locs


class ParseCache:
    """Pages parsed in earlier passes, and those of this pass, which ``used`` gathers per parser.

    Parsers of pages go through it; calendars do not, as what a recurrence expands to depends on the
    time of the pass.
    """

    def __init__(self, parsed: DataFrame, now: datetime | str):
        self.parsed, self.now, self.used = parsed, now, []

    def __call__(self, name: str, parse: PageParser, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = write_through(parse_pages(pages, self.parsed, name, parse, instant(self.now)), "parsed")
        self.used.append(rows)
        return parsed_events(rows)


def parse_all(name: str, parse: PageParser, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parse every page; what an adapter does without a cache."""
    return parse(pages)


@dataclass(frozen=True)
class Landed:
    """What an adapter reads: its sources, their resolved fetches, robots rules and the run time.

    ``sources`` says in ``allowed`` whether robots rules admit the address of the source. ``fetches``
    say in ``entries`` (adapter, allowed) which registry rows name their address. ``parse`` applies a
    named page parser to pages.
    """

    sources: DataFrame
    fetches: DataFrame
    robots: DataFrame
    now: datetime | str
    parse: Callable[[str, PageParser, DataFrame], tuple[DataFrame, DataFrame]] = field(default=parse_all)


# An adapter turns landed data into raw events and errors (source_id, kind, error).
Adapter = Callable[[Landed], tuple[DataFrame, DataFrame]]
# A page parser turns pages (source_id, url, body) into raw events and errors (source_id, url, error).
PageParser = Callable[[DataFrame], tuple[DataFrame, DataFrame]]

PAGE_PARSERS: dict[str, PageParser] = {"meetup-group": extract_state_events}


# --- adapters ------------------------------------------------------------------------------


def calendar_adapter(landed: Landed) -> tuple[DataFrame, DataFrame]:
    pages, errors = _entry_pages(landed)
    rows, parse_errors, _ = calendar_events(pages, landed.now)  # an odd entry fails no feed
    return raw_events(rows), errors.unionByName(_as_errors(parse_errors, "parse"))


def page_adapter(parsers: Mapping[str, PageParser] = PAGE_PARSERS) -> Adapter:
    """Adapter for HTML sources: each page goes to the parser its source names."""

    def run(landed: Landed) -> tuple[DataFrame, DataFrame]:
        _, errors = _entry_pages(landed)
        unknown = landed.sources.filter(~F.coalesce(F.col("adapter").isin(*parsers), F.lit(False)))
        message = F.concat(F.lit("Pages of adapter '"), F.coalesce("adapter", F.lit("")), F.lit("' have no parser."))
        errors = errors.unionByName(
            unknown.select(F.col("id").alias("source_id"), F.lit("registry").alias("kind"), message.alias("error"))
        )
        rows = []
        for key, parse in parsers.items():
            admitted = F.filter("entries", lambda e: e["allowed"])["adapter"]
            own = landed.fetches.filter("outcome = 'ok'").filter(F.array_contains(admitted, key))
            found, failed = landed.parse(key, parse, own.select("source_id", "url", "body"))
            rows.append(raw_events(found.filter(not_ended("start_utc", "end_utc", landed.now))))
            errors = errors.unionByName(_as_errors(failed, "parse"))
        return _union(rows), errors

    return run


def sitemap_adapter(landed: Landed) -> tuple[DataFrame, DataFrame]:
    """Sitemap sources: index, monthly sitemaps of the window, matching event pages, JSON-LD."""
    now = landed.now if isinstance(landed.now, datetime) else datetime.fromisoformat(landed.now)
    index, errors = _entry_pages(landed)
    ok = landed.fetches.filter("outcome = 'ok'").select("source_id", "url", "body")
    listed, broken_index = sitemap_locs(index)
    months = monthly_sitemaps(listed, now).select("source_id", F.col("loc").alias("url")).distinct()
    urls, broken_months = sitemap_locs(ok.join(months, ["source_id", "url"], "left_semi"))
    slugs = landed.sources.select(F.col("id").alias("source_id"), F.explode("slugs").alias("slug"))
    wanted = match_chapters(urls.select("source_id", F.col("loc").alias("url")), slugs)
    admitted = mark_allowed(wanted, landed.robots).filter("allowed").select("source_id", "url")
    requested = months.unionByName(admitted).distinct()
    failed = landed.fetches.filter("outcome <> 'ok'").join(requested, ["source_id", "url"], "left_semi")
    pages = ok.join(admitted, ["source_id", "url"], "left_semi")
    found, _ = landed.parse("json-ld", _jsonld, pages)
    rows = found.filter(not_ended("start_utc", "end_utc", landed.now))
    errors = _union(
        [
            errors,
            _as_errors(broken_index, "parse"),
            _as_errors(broken_months, "parse"),
            failed.select("source_id", F.lit("fetch").alias("kind"), F.col("problem").alias("error")),
        ]
    )
    return raw_events(rows), errors


def _jsonld(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A page without readable data is no failure of its source."""
    none = pages.sparkSession.createDataFrame([], "source_id string, url string, error string")
    return extract_jsonld_events(pages), none


# Sources whose events are found by a walk over several pages.
WALKED_TYPES = ("gdg-sitemap",)

ADAPTERS: dict[str, Adapter] = {"ics": calendar_adapter, "html": page_adapter(), "gdg-sitemap": sitemap_adapter}


def _entry_pages(landed: Landed) -> tuple[DataFrame, DataFrame]:
    """Bodies of the addresses the registry names, with errors for refused and failed ones."""
    refused = landed.sources.filter("not allowed").select(
        F.col("id").alias("source_id"), F.lit("robots").alias("kind"), F.concat(F.lit("robots.txt disallows fetching "), "url").alias("error")
    )
    fetched = landed.fetches.select("*", F.explode("entries").alias("entry")).filter("entry.allowed")
    failed = fetched.filter("outcome <> 'ok'").select(
        "source_id", F.lit("fetch").alias("kind"), F.col("problem").alias("error")
    )
    pages = fetched.filter("outcome = 'ok'").select("source_id", "url", "body")
    return pages, refused.unionByName(failed)


def _as_errors(failed: DataFrame, kind: str) -> DataFrame:
    return failed.select("source_id", F.lit(kind).alias("kind"), "error")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def collect_raw(
    registry: DataFrame,
    fetches: DataFrame,
    robots: DataFrame,
    now: datetime | str,
    adapters: Mapping[str, Adapter] = ADAPTERS,
    parse: Callable[[str, PageParser, DataFrame], tuple[DataFrame, DataFrame]] = parse_all,
    counts: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Raw events and errors of all enabled sources, each type through its adapter.

    Sources are held against the robots rules once, and fetches against their sources once, both
    written. ``counts`` (source_id, _rows) may hand in bounds on the fetches of each source.
    """
    spark = registry.sparkSession
    sources = write_through(mark_allowed(enabled_sources(registry), robots), "sources")
    unknown = sources.filter(~F.col("type").isin(*adapters)).select(
        F.col("id").alias("source_id"),
        F.lit("registry").alias("kind"),
        F.concat(F.lit("Sources of type '"), "type", F.lit("' have no adapter.")).alias("error"),
    )
    rows, errors = [spark.createDataFrame([], RAW_SCHEMA)], [unknown]
    typed = write_through(_with_sources(fetches, sources, counts), "fetches")
    for kind, adapter in adapters.items():
        own = typed.withColumn("entries", _offers_of(kind)).filter(F.size("entries") > 0).drop("offers")
        named = F.filter("entries", lambda o: o["url"] == F.col("url"))
        own = own.withColumn("entries", F.transform(named, lambda o: F.struct(o["adapter"], o["allowed"])))
        found, failed = adapter(Landed(sources.filter(F.col("type") == kind), own, robots, now, parse))
        rows.append(found)
        errors.append(failed)
    return _union(rows), _union(errors)


def _offers_of(kind: str) -> Column:
    return F.filter("offers", lambda o: o["type"] == kind)


def _with_sources(fetches: DataFrame, sources: DataFrame, counts: DataFrame | None) -> DataFrame:
    """Fetches of the given sources with what the registry says of each: one row per address.

    ``offers`` has as many entries as registry rows share an id, one in a valid registry.
    """
    rows = sources.select(F.col("id").alias("source_id"), "type", "url", "adapter", "allowed")
    offer = F.struct("type", "url", "adapter", "allowed")
    offers = rows.groupBy("source_id").agg(F.collect_list(offer).alias("offers"))
    if fits_broadcast(rows):
        return fetches.join(F.broadcast(offers), "source_id")
    return salted_join(fetches, offers, ["source_id"], "inner", ["url"], counts=counts)


# --- normalisation -------------------------------------------------------------------------


def normalize_events(
    raw: DataFrame,
    registry: DataFrame,
    keys: DataFrame,
    postal: DataFrame,
    geocode_cache: DataFrame | None,
    now: datetime | str,
    keyword_to_tag: Mapping[str, str] | DataFrame = KEYWORD_TO_TAG,
) -> DataFrame:
    """Raw events to event rows: clean texts, resolve the place, tag, and compute the dedupe key.

    ``keyword_to_tag`` is a map, which becomes part of the plan, or a table (keyword, tag) of any size,
    which is joined.
    """
    cleaned = raw.withColumns(
        {
            "title": clean_title("title"),
            "description": F.when(F.col("description").isNotNull(), clean_description("description")),
            "time_zone_id": default_zone("time_zone_id"),
        }
    )
    resolved = resolve_locations(cleaned, keys, postal, geocode_cache)
    source_tags = registry.select(F.col("id").alias("source_id"), F.col("tags").alias("source_tags"))
    tagged = lookup_join(resolved, source_tags, ["source_id"], "left", spread_by=["source_event_id"])
    placed = tagged.withColumn("city", F.coalesce("matched_place", "city"))
    if isinstance(keyword_to_tag, DataFrame):
        placed = _with_keyword_tags(placed, keyword_to_tag)
        keyword_tags_of = F.col("keyword_tags")
    else:
        keyword_tags_of = extract_tags("title", "description", keyword_to_tag)
    return placed.select(
        event_id("source_id", "source_event_id").alias("id"),
        "source_id",
        "source_event_id",
        "title",
        "description",
        "start_utc",
        "end_utc",
        "time_zone_id",
        "venue_name",
        "venue_address",
        "city",
        "postal_code",
        "lat",
        "lon",
        "location_status",
        "location_precision",
        F.coalesce("attendance_hint", F.lit("InPerson")).alias("attendance"),
        "url",
        merge_tags("source_tags", keyword_tags_of).alias("tags"),
        instant(now).alias("first_seen_utc"),
        instant(now).alias("last_seen_utc"),
        dedupe_key("title", "start_utc", "time_zone_id", "city").alias("dedupe_key"),
        "feed_pos",
    )


def _with_keyword_tags(rows: DataFrame, keywords: DataFrame) -> DataFrame:
    """``rows`` with ``keyword_tags``; each distinct text is asked once."""
    text = F.concat("title", F.lit(" "), F.coalesce("description", F.lit("")))
    named = rows.withColumn("text_key", F.sha2(text, 256))
    texts = named.select("text_key", text.alias("text")).dropDuplicates(["text_key"])
    found = keyword_tags(texts, keywords, F.col("text"), ["text_key"])
    found = found.groupBy("text_key").agg(F.array_sort(F.collect_set("tag")).alias("keyword_tags"))
    return lookup_join(named, found, ["text_key"], "left", spread_by=["source_event_id"]).drop("text_key")


# --- one run -------------------------------------------------------------------------------

# Answers geocoder queries (query, text) with query, http_status and body.
Geocoder = Callable[[DataFrame], DataFrame]


def ingest(
    store: EventStore,
    registry: DataFrame,
    crawl: DataFrame,
    robots: DataFrame,
    keys: DataFrame,
    postal: DataFrame,
    now: datetime | str,
    geocoder: Geocoder | None = None,
    keyword_to_tag: Mapping[str, str] | DataFrame = KEYWORD_TO_TAG,
    adapters: Mapping[str, Adapter] = ADAPTERS,
    geocode_cap: int | None = None,
    pass_id: str | None = None,
) -> DataFrame:
    """One ingestion pass over landed crawl results; returns the run-log rows it wrote.

    A pass sees what earlier passes stored, so it does not matter how a crawl was cut into batches.
    Fetches are resolved once and written. A source with an error keeps what earlier passes stored. Raw events, normalised events and
    errors are written once each, because several outputs are derived from them. Pages whose bodies an
    earlier pass parsed are not parsed again.

    A pass with a ``pass_id`` that failed midway may be repeated with the same id as the next pass:
    what it had finished writing is recognised and left alone, the rest is written. Repeated once
    more, it returns its rows of the log.
    """
    prepare(registry.sparkSession)
    if pass_id is not None and store.runs.holds(pass_id):
        return store.runs.of_pass(pass_id)
    stored = store.fetches.read()
    walked = registry.filter(F.col("type").isin(*WALKED_TYPES)).select(F.col("id").alias("source_id"))
    landed = newest_fetches(crawl)
    if not walked.isEmpty():
        landed = with_unlanded(landed, stored, walked)
    fetches = carry_forward(landed, known_good(crawl, stored))
    counts = key_counts(crawl.select("source_id").unionAll(stored.select("source_id")), ["source_id"])
    cache = ParseCache(store.parsed.read(), now)
    found, failed = collect_raw(registry, fetches, robots, now, adapters, cache, counts)
    raw, errors = write_through(found, "raw"), write_through(failed, "errors")
    if geocoder is not None and not (pass_id is not None and store.geocodes.holds(pass_id)):
        pending = write_through(pending_geocodes(raw, store.geocode_cache(), geocode_cap), "queries")
        try:
            answers = write_through(apply_answers(store.geocodes.read().limit(0), geocoder(pending), now), "answers")
        except Exception as failure:  # noqa: BLE001 - whatever a geocoder throws, the gazetteer stands in for it
            warnings.warn(f"geocoder failed, going on with the gazetteer: {failure}", stacklevel=2)
        else:
            store.geocodes.append(answers, pass_id)
    geocodes = store.geocode_cache() if geocoder is not None else None
    events = write_through(normalize_events(raw, registry, keys, postal, geocodes, now, keyword_to_tag), "events")
    store.upsert_events(events, errors, now, pass_id)
    if cache.used:
        store.keep_parsed(_union(cache.used), now, pass_id)
    store.keep_fetches(crawl, pass_id)
    runs = write_through(run_outcomes(registry, events, errors, now, crawl.select("source_id")), "runs")
    store.runs.append(runs, pass_id)
    return runs
