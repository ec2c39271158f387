"""Landed crawl results: carry-forward of unchanged bodies and reuse of parsed rows.

``crawl`` has ``source_id, url, http_status, error, body, etag, last_modified, fetched_at``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.joins import lookup_join, salted_join
from ..session import write_through
from .events import RAW_COLUMNS, RAW_FIELDS

CRAWL_SCHEMA = (
    "source_id string, url string, http_status int, error string, body string, etag string, "
    "last_modified string, fetched_at timestamp"
)
# A page as a parser left it: its rows, not yet filtered by time, and its error. A page without either
# is remembered, too.
PARSED_SCHEMA = (
    "parser string, source_id string, page_url string, content_hash string, "
    f"rows array<struct<{RAW_FIELDS}>>, error string, used_utc timestamp"
)
PARSED_KEY = ["parser", "source_id", "page_url", "content_hash"]
_KEY = ["source_id", "url"]
_CACHED = ["body", "etag", "last_modified", "fetched_at"]


def succeeded() -> Column:
    return F.coalesce(F.col("http_status").between(200, 299), F.lit(False)) & F.col("error").isNull()


def newest_fetches(crawl: DataFrame) -> DataFrame:
    """Newest landed fetch per address: a batch may hold several crawls of the same page."""
    newest = W.partitionBy(*_KEY).orderBy(F.desc("fetched_at"), F.xxhash64("body"))
    return crawl.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def last_good(crawl: DataFrame) -> DataFrame:
    """Newest successful fetch per address: what a later 304 refers to."""
    newest = F.max_by(F.struct(*_CACHED), F.struct("fetched_at", F.xxhash64("body")))
    return crawl.filter(succeeded()).groupBy(*_KEY).agg(newest.alias("c")).select(*_KEY, "c.*")


def known_good(crawl: DataFrame, stored: DataFrame) -> DataFrame:
    """Newest good body per address, of the store and of those rows of a batch that it calls unchanged, too.

    ``stored`` has one row per address. A batch may hold a 200 and a later 304 of one address; the 304 means the body of the 200. Other
    bodies of the batch are nobody's cached ones and stay where they are.
    """
    unchanged = crawl.filter("http_status = 304").select(*_KEY).distinct()
    good = lookup_join(crawl.filter(succeeded()), unchanged, _KEY, "left_semi", spread_by=["fetched_at"])
    recent = write_through(good.select(*_KEY, *_CACHED), "recent")
    keys, stored = recent.select(*_KEY).distinct(), stored.select(*_KEY, *_CACHED)
    alone = lookup_join(stored, keys, _KEY, "left_anti", spread_by=["fetched_at"])
    both = recent.unionByName(lookup_join(stored, keys, _KEY, "left_semi", spread_by=["fetched_at"]))
    newest = F.max_by(F.struct(*_CACHED), F.struct("fetched_at", F.xxhash64("body")))
    return alone.unionByName(both.groupBy(*_KEY).agg(newest.alias("c")).select(*_KEY, "c.*"))


def with_unlanded(crawl: DataFrame, stored: DataFrame, sources: DataFrame) -> DataFrame:
    """``crawl`` and, for those of ``sources`` (source_id) in it, the stored addresses it does not hold.

    They count as unchanged, so a walk over several pages of a source finds the pages that landed in
    an earlier batch.
    """
    walked = sources.select("source_id").distinct()
    here = lookup_join(crawl.select("source_id", "url"), walked, ["source_id"], "left_semi", spread_by=["url"])
    here = here.select("source_id").distinct()
    missing = lookup_join(stored, here, ["source_id"], "left_semi", spread_by=["url"])
    missing = missing.join(crawl.select(*_KEY), _KEY, "left_anti")
    unchanged = {"http_status": F.lit(304), "error": F.lit(None).cast("string"), "body": F.lit(None).cast("string")}
    return crawl.unionByName(missing.withColumns(unchanged).select(crawl.columns))


def carry_forward(crawl: DataFrame, cached: DataFrame) -> DataFrame:
    """Resolve each landed fetch to a body or an error.

    Adds ``not_modified``, ``outcome`` (ok, unreachable, http-error) and ``problem``. A 304 takes
    the cached body; a 304 without one and any status outside 2xx is an error. ``crawl`` has one row
    per address, see ``newest_fetches``.
    """
    known = cached.select(*_KEY, F.col("body").alias("cached_body"))
    joined = crawl.join(known, _KEY, "left")
    not_modified = F.coalesce((F.col("http_status") == 304) & F.col("cached_body").isNotNull(), F.lit(False))
    outcome = (
        F.when(F.col("http_status").isNull() | F.col("error").isNotNull(), F.lit("unreachable"))
        .when(not_modified | F.col("http_status").between(200, 299), F.lit("ok"))
        .otherwise(F.lit("http-error"))
    )
    problem = (
        F.when(F.col("outcome") == "unreachable", F.concat(F.lit("Failed to reach "), "url", F.lit(": "), F.coalesce("error", F.lit("no response"))))
        .when(F.col("outcome") == "http-error", F.concat(F.col("http_status").cast("string"), F.lit(" fetching "), "url"))
    )
    body = F.when(not_modified, F.col("cached_body")).when(F.col("outcome") == "ok", F.col("body"))
    return (
        joined.withColumns({"not_modified": not_modified, "outcome": outcome})
        .withColumns({"problem": problem, "body": body})
        .drop("cached_body")
    )


def content_hash(body: Column | str = "body") -> Column:
    return F.sha2(F.col(body) if isinstance(body, str) else body, 256)


def parse_pages(
    pages: DataFrame,
    parsed: DataFrame,
    parser: str,
    extract: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
    now: Column,
) -> DataFrame:
    """``pages`` (source_id, url, body) as rows of ``PARSED_SCHEMA``, used ``now``.

    Only bodies that ``parsed`` does not hold for this parser reach ``extract``, which returns events
    that carry ``page_url`` and errors (source_id, url, error). The bodies of known pages end at the
    hash, so an unchanged page costs one digest. A parser with ``page_rows`` (pages with a body to pages
    with ``rows`` and ``error``) is run once per page, and its pages meet the known ones in one join;
    ``pages`` then has one row per address.
    """
    identity = PARSED_KEY[1:]
    if hasattr(extract, "page_rows"):
        return _parsed_rows(pages, parsed, parser, extract.page_rows, now)
    hashed = pages.withColumn("content_hash", content_hash()).withColumn("page_url", F.col("url"))
    known = parsed.filter(F.col("parser") == parser).select(*identity, "rows", "error")
    used = {"parser": F.lit(parser), "used_utc": now}
    columns = [f.name for f in parsed.schema]
    unchanged = known.join(hashed.select(*identity).distinct().hint("merge"), identity, "left_semi")
    fresh = hashed.join(known.select(*identity).hint("merge"), identity, "left_anti")
    found, failed = extract(fresh.select("source_id", "url", "body"))
    # A page holds no more events than its body; one list per page.
    rows = found.groupBy("source_id", "page_url").agg(F.collect_list(F.struct(*RAW_COLUMNS)).alias("rows"))
    errors = failed.groupBy("source_id", F.col("url").alias("page_url")).agg(F.min("error").alias("error"))
    new = fresh.select(*identity).distinct().join(rows, identity[:2], "left").join(errors, identity[:2], "left")
    new = new.withColumn("rows", F.coalesce("rows", F.array().cast(parsed.schema["rows"].dataType)))
    return unchanged.unionByName(new).withColumns(used).select(*columns)


def _parsed_rows(
    pages: DataFrame, parsed: DataFrame, parser: str, page_rows: Callable[[DataFrame], DataFrame], now: Column
) -> DataFrame:
    identity = PARSED_KEY[1:]
    known = parsed.filter(F.col("parser") == parser).select(*identity, F.struct("rows", "error").alias("known"))
    hashed = pages.select("source_id", F.col("url").alias("page_url"), content_hash().alias("content_hash"), "body")
    met = hashed.join(known.hint("merge"), identity, "left")
    body = F.when(F.col("known").isNull(), F.col("body"))
    read = page_rows(met.select(*identity, "known", F.col("page_url").alias("url"), body.alias("body")))
    kept = lambda name: F.when(F.col("known").isNull(), F.col(name)).otherwise(F.col("known")[name]).alias(name)
    used = {"parser": F.lit(parser), "used_utc": now}
    return read.select(*identity, kept("rows"), kept("error")).withColumns(used).select(*[f.name for f in parsed.schema])


def parsed_events(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events and errors (source_id, url, error) of parsed pages."""
    rows = parsed.select(F.explode("rows").alias("row"), "page_url").select("row.*", "page_url")
    errors = parsed.filter("error is not null").select("source_id", F.col("page_url").alias("url"), "error")
    return rows, errors


def reuse_parsed(
    pages: DataFrame, parsed: DataFrame, extract: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Rows of ``pages``, parsing only bodies that were not parsed before.

    ``parsed`` holds the rows of earlier runs with ``source_id, page_url, content_hash`` added and
    not yet filtered by time. ``extract`` turns pages into rows that carry ``source_id`` and
    ``page_url``; its rows come back with the hash, ready to be stored for the next run.
    """
    hashed = pages.withColumn("content_hash", content_hash()).withColumn("page_url", F.col("url"))
    identity = ["source_id", "page_url", "content_hash"]
    seen = parsed.select(*identity).distinct()
    fresh = hashed.join(seen, identity, "left_anti")
    unchanged = salted_join(parsed, hashed.select(*identity).distinct(), identity, "left_semi")
    hashes = fresh.select("source_id", "page_url", "content_hash").distinct()
    extracted = salted_join(extract(fresh.drop("content_hash", "page_url")), hashes, ["source_id", "page_url"])
    return unchanged.unionByName(extracted)
