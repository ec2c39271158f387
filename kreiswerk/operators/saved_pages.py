"""Pages of saved searches that are kept from pass to pass and brought up to date by what changed.

A kept page is the result of ``radius_join.page_ids`` without offset: ``search_id``, the event's
identity, ``distance_km, start_utc, position``. Identities are unique in ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import DEFAULT_PAGE
from ..session import write_through
from .joins import lookup_join, salted_join
from .radius_join import digest, event_identity, page_ids, ranked_pages, searches_with_filters


def refreshed_pages(
    pages: DataFrame,
    events: DataFrame,
    changed: DataFrame,
    searches: DataFrame,
    known: DataFrame,
    limit: int = DEFAULT_PAGE,
    exact: bool = False,
) -> DataFrame:
    """The pages of ``searches`` over ``events``, from the ``pages`` kept for the searches ``known``.

    ``changed`` holds the identity of every event that is new, gone or different since; more of them
    do no harm. Only those are matched again. Events that were on no page start after the last one
    of a full page, so a page is found anew from all events only if fewer than ``limit`` of its
    rows, old and new together, come up to there. Searches that are new or ask for something else
    are found anew, too; those that are no longer in ``searches`` go. A page that was not full held
    all matches and takes the changed ones in. Repeated rows of ``changed`` count once.
    """
    identity = event_identity(events)
    touched = write_through(changed.select(*identity).distinct(), "changed")
    asked = searches_with_filters(searches)
    shape = digest(*[c for c in asked.columns if c != "search_id"]).alias("_shape")
    before = searches_with_filters(known).select("search_id", shape)
    same = asked.select("search_id", shape).join(before, ["search_id", "_shape"], "left_semi").select("search_id")
    same = write_through(same, "same-searches")

    old = pages.join(same, "search_id", "left_semi")
    kept = lookup_join(old, touched, identity, "left_anti", ["search_id"])
    again = lookup_join(events, touched, identity, "left_semi", identity)
    met = page_ids(again, searches.join(same, "search_id", "left_semi"), limit, 0, exact)
    rows = kept.select(*_columns(identity)).unionByName(met.select(*_columns(identity)))
    rows = write_through(ranked_pages(rows, identity, limit), "merged-pages")

    key = F.struct("start_utc", *identity)
    full = old.groupBy("search_id").agg(F.count(F.lit(1)).alias("_n"), F.max(key).alias("_last")).filter(F.col("_n") >= limit)
    sure = rows.join(full, "search_id").filter(key <= F.col("_last")).groupBy("search_id").agg(F.count(F.lit(1)).alias("_sure"))
    short = full.join(sure, "search_id", "left").filter(F.coalesce("_sure", F.lit(0)) < limit).select("search_id")
    fine = write_through(same.join(short, "search_id", "left_anti"), "fine-searches")

    anew = page_ids(events, searches.join(fine, "search_id", "left_anti"), limit, 0, exact)
    return rows.join(fine, "search_id", "left_semi").unionByName(anew.select(rows.columns))


def page_rows(pages: DataFrame, events: DataFrame) -> DataFrame:
    """Kept pages with all columns of their events."""
    return salted_join(pages.drop("start_utc"), events, event_identity(events), "inner", ["search_id"])


def _columns(identity: list[str]) -> list[str]:
    return ["search_id", *identity, "distance_km", "start_utc"]
