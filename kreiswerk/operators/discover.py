"""Discovery of further sources: chapters in sitemaps, groups on search and city pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.variants import strict_string
from ..session import write_through
from ..sources.pages import entity_map, state_script
from ..sources.sitemap import chapter_slug
from .joins import lookup_join
from .rows import computed


# --- chapters ------------------------------------------------------------------------------


def chapter_counts(urls: DataFrame) -> DataFrame:
    """Listed event addresses per chapter slug."""
    slugs = urls.select(chapter_slug("url").alias("slug")).filter("slug is not null")
    return slugs.groupBy("slug").agg(F.count(F.lit(1)).alias("future_events"))


def chapter_report(counts: DataFrame, pages: DataFrame, country: str = "DE") -> DataFrame:
    """Chapters of a country with title and place from their page (``slug, body``)."""
    facts = pages.select(
        "slug",
        _json_field("country").alias("country"),
        F.coalesce(_json_field("chapter_title", empty=True), "slug").alias("title"),
        F.coalesce(_json_field("chapter_location", empty=True), F.lit("")).alias("location"),
    ).filter(F.col("country") == country)
    return counts.join(facts, "slug").select("slug", "title", "location", "future_events")


def _json_field(name: str, empty: bool = False) -> Column:
    """First ``"name": "value"`` in the page text; null when it does not occur."""
    pattern = rf'"{name}"\s*:\s*"([^"]{"*" if empty else "+"})"'
    return F.when(F.col("body").rlike(pattern), F.regexp_extract("body", pattern, 1))


# --- groups --------------------------------------------------------------------------------

_LISTS = ("eventsInLocation", "todayEvents", "thisWeekendEvents")
_GROUP_OF_EVENT = r"^https://www\.meetup\.com/([^/]+)/events/"


def harvest_groups(find_pages: DataFrame, city_pages: DataFrame, routes_kept: int | None = 3) -> DataFrame:
    """Candidate groups ``slug, name, city, routes`` from search and city pages.

    ``find_pages`` has ``page_no, route, body`` and ``city_pages`` has ``page_no, city, body``.
    Name and city come from the first page a group appears on, search pages first; ``routes`` are
    its first ``routes_kept`` routes in sorted order, or with None all of them.
    """
    entity, link = F.col("entity"), F.rtrim(F.col("link"), F.lit("/"))
    text = lambda path: F.coalesce(strict_string(entity, path), F.lit(""))
    searched = (
        computed(find_pages, "page_no", "route", entity_map(state_script(F.col("body"))).alias("state"))
        .select("page_no", "route", F.posexplode("state").alias("pos", "key", "entity"))
        .filter(F.col("key").startswith("Group:"))
        .select("page_no", "pos", "route", text("$.link").alias("link"), text("$.name").alias("name"), text("$.city").alias("city"))
        .filter("link <> ''")
        .select(F.lit(0).alias("stage"), "page_no", "pos", "route", F.substring_index(link, "/", -1).alias("slug"), "name", "city")
    )
    root = F.try_parse_json(state_script(F.col("body")))
    none = F.array().cast("array<variant>")
    listed = F.concat(
        *[F.coalesce(F.try_variant_get(F.col("root"), f"$.props.pageProps.{n}", "array<variant>"), none) for n in _LISTS]
    )
    featured = (
        computed(computed(city_pages, "page_no", "city", root.alias("root")), "page_no", "city", listed.alias("listed"))
        .select("page_no", "city", F.posexplode("listed").alias("pos", "entity"))
        .select("page_no", "city", "pos", F.regexp_extract(text("$.eventUrl"), _GROUP_OF_EVENT, 1).alias("slug"))
        .filter("slug <> ''")
        .select(
            F.lit(1).alias("stage"), "page_no", "pos", F.concat(F.lit("cities/"), "city").alias("route"), "slug",
            F.lit("").alias("name"), "city",
        )
    )
    # Written once per group and route, so that names and routes do not each parse all pages.
    at = F.struct("stage", "page_no", "pos")
    seen = searched.unionByName(featured).groupBy("slug", "route").agg(
        F.min_by(F.struct("name", "city"), at).alias("first"), F.min(at).alias("at")
    )
    seen = write_through(seen, "group-routes")
    first = seen.groupBy("slug").agg(F.min_by("first", "at").alias("first"))
    ranked = seen.select("slug", "route").withColumn("n", F.row_number().over(W.partitionBy("slug").orderBy("route")))
    ranked = ranked if routes_kept is None else ranked.filter(F.col("n") <= routes_kept)
    routes = ranked.groupBy("slug").agg(F.sort_array(F.collect_list("route")).alias("routes"))
    return first.join(routes, "slug").select("slug", "first.name", "first.city", "routes")


def group_report(
    candidates: DataFrame, pages: DataFrame, after: str, titles_kept: int | None = 3, title_width: int | None = 70
) -> DataFrame:
    """Profile of each candidate whose page (``slug, body``) landed; pages of others are not parsed.

    ``candidates`` is read twice, so it should be a written table.
    Events later than ``after`` (ISO text) count, in page order. A page without an entity map
    counts as a reachable group without events. Everything about a page is computed inside its row.
    ``titles`` are the first ``titles_kept`` titles, each cut at ``title_width`` characters; None keeps
    all titles, or whole ones.
    """
    pages = lookup_join(pages, candidates.select("slug").distinct(), ["slug"], "left_semi", ["slug"])
    state = computed(pages, "slug", entity_map(state_script(F.col("body"))).alias("state"))
    entities = F.coalesce(F.map_entries("state"), F.array().cast("array<struct<key:string,value:variant>>"))
    upcoming = F.filter(
        entities,
        lambda e: e["key"].startswith("Event:") & F.coalesce(strict_string(e["value"], "$.dateTime") > after, F.lit(False)),
    )
    profile = computed(state, "slug", "state", upcoming.alias("upcoming"))
    on_site = F.filter(
        "upcoming", lambda e: F.coalesce(strict_string(e["value"], "$.eventType").isin("PHYSICAL", "HYBRID"), F.lit(False))
    )
    cities = F.filter(F.transform(on_site, _venue_city), lambda city: F.coalesce(city, F.lit("")) != "")
    whole = lambda e: F.coalesce(strict_string(e["value"], "$.title"), F.lit(""))
    title = whole if title_width is None else lambda e: F.left(whole(e), F.lit(title_width))
    titled = F.col("upcoming") if titles_kept is None else F.slice("upcoming", 1, titles_kept)
    facts = profile.select(
        "slug",
        strict_string(F.try_element_at("state", F.concat(F.lit("Group:"), "slug")), "$.name").alias("page_name"),
        F.coalesce(F.get(cities, F.lit(0)), F.lit("")).alias("venue_city"),
        F.size("upcoming").alias("upcoming"),
        F.size(on_site).alias("physical"),
        F.left(strict_string(F.get("upcoming", F.lit(0))["value"], "$.dateTime"), F.lit(10)).alias("next"),
        F.transform(titled, title).alias("titles"),
    )
    return candidates.join(facts, "slug").select(
        "slug",
        F.coalesce(F.nullif("name", F.lit("")), "page_name", F.lit("")).alias("name"),
        F.col("city").alias("search_city"),
        "venue_city",
        "upcoming",
        "physical",
        "next",
        "titles",
        "routes",
    )


def ranked_groups(report: DataFrame, by: str = "upcoming") -> DataFrame:
    """Groups with the most upcoming (or ``physical``) events first."""
    return report.orderBy(F.desc(by), "slug")


def discovery_summary(candidates: DataFrame, report: DataFrame) -> DataFrame:
    """Single row: candidates, reachable groups, groups with upcoming events."""
    reached = report.select("slug", "upcoming").withColumn("reached", F.lit(True))
    joined = candidates.select("slug").join(reached, "slug", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if("reached").alias("reachable"),
        F.count_if(F.col("upcoming") > 0).alias("live"),
    )


def _venue_city(event: Column) -> Column:
    ref = strict_string(event["value"], "$.venue.__ref")
    venue = F.when(ref.startswith("Venue:"), F.try_element_at(F.col("state"), ref))
    return strict_string(venue, "$.city")
