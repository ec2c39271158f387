"""Sitemaps: listed addresses, monthly windows and chapter slugs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col
from ..operators.joins import lookup_join
from ..operators.rows import computed

_SCHEMA = "url array<struct<loc:string>>, sitemap array<struct<loc:string>>, broken string"
_OPTIONS = {"columnNameOfCorruptRecord": "broken", "mode": "PERMISSIVE"}
_MONTHLY = r"sitemap-events-([0-9]{4})-([0-9]{2})\.xml"
_MARK = "-presents-"


def sitemap_locs(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Addresses listed by sitemap documents.

    ``documents`` has ``source_id, url, body``. Returns ``source_id, sitemap_url, loc`` and the
    documents that are not well-formed.
    """
    parsed = computed(documents, "source_id", "url", F.from_xml("body", _SCHEMA, _OPTIONS).alias("x"))
    readable = F.col("x").isNotNull() & F.col("x.broken").isNull()
    none = F.array().cast("array<struct<loc:string>>")
    entries = F.concat(F.coalesce("x.sitemap", none), F.coalesce("x.url", none))
    listed = F.when(readable, F.filter(entries, lambda e: e["loc"].isNotNull()))
    locs = parsed.select("source_id", F.col("url").alias("sitemap_url"), F.explode(listed).alias("e")).select(
        "source_id", "sitemap_url", F.regexp_replace("e.loc", r"(?U)^\s+|\s+$", "").alias("loc")
    )
    errors = parsed.filter(~readable).select("source_id", "url", F.lit("sitemap is not well-formed XML").alias("error"))
    return locs, errors


def month_key(url: Column | str) -> Column:
    """Running month number of a monthly sitemap address; null for other addresses."""
    year = F.regexp_extract(col(url), _MONTHLY, 1)
    month = F.regexp_extract(col(url), _MONTHLY, 2)
    return F.when(year != "", year.cast("int") * 12 + month.cast("int") - 1)


def monthly_sitemaps(locs: DataFrame, now: datetime, months: int = 12) -> DataFrame:
    """Monthly event sitemaps from the month of ``now`` on, ``months`` further ones included."""
    first = now.year * 12 + now.month - 1
    return locs.withColumn("month_key", month_key("loc")).filter(F.col("month_key").between(first, first + months))


def slug_candidates(url: Column | str) -> Column:
    """Every text that stands in ``url`` between a hyphen and ``-presents-``.

    A fixed slug occurs as ``-slug-presents-`` exactly when it is one of them, which turns the
    substring test into an equi join.
    """
    pieces = F.split(col(url), _MARK)
    heads = F.transform(
        F.slice(F.sequence(F.lit(1), F.size(pieces)), 1, F.size(pieces) - 1),
        lambda n: F.array_join(F.slice(pieces, 1, n), _MARK),
    )
    return F.array_distinct(F.flatten(F.transform(heads, _tails)))


def _tails(head: Column) -> Column:
    words = F.split(head, "-")
    starts = F.when(F.size(words) > 1, F.sequence(F.lit(2), F.size(words)))
    return F.transform(
        F.coalesce(starts, F.array().cast("array<int>")),
        lambda start: F.array_join(F.slice(words, start, F.size(words)), "-"),
    )


def match_chapters(urls: DataFrame, slugs: DataFrame) -> DataFrame:
    """Distinct ``source_id, url`` whose address names one of the source's chapters.

    ``urls`` has ``source_id, url`` and ``slugs`` has ``source_id, slug``.
    """
    distinct = urls.select("source_id", "url").distinct()
    named = computed(distinct, "source_id", "url", slug_candidates("url").alias("slugs"))
    candidates = named.select("source_id", "url", F.explode("slugs").alias("slug"))
    hits = lookup_join(candidates, slugs.distinct(), ["source_id", "slug"], "left_semi", spread_by=["url", "slug"])
    return hits.select("source_id", "url").distinct()


def chapter_slug(url: Column | str) -> Column:
    """Chapter named by an event address; null when the address has another form."""
    slug = F.regexp_extract(col(url), r"/events/details/google-(.+?)-presents-", 1)
    return F.nullif(slug, F.lit(""))
