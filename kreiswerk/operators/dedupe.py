"""Duplicates: inside one batch of a source, and across sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.events import EVENT_KEY


def dedupe_batch(events: DataFrame) -> DataFrame:
    """One row per source and dedupe key: earliest seen, then first in the feed.

    The rank filter is applied before the shuffle as well, so a key repeated a million times sends
    one row per task.
    """
    return first_per_key(events, ["source_id", "dedupe_key"], _feed_order(events))


def drop_id_collisions(events: DataFrame) -> DataFrame:
    """One row per source and event id, first in the feed; ``dedupe_batch`` comes before this."""
    return first_per_key(events, EVENT_KEY, _feed_order(events))


def id_collisions(events: DataFrame) -> DataFrame:
    """Event ids a source used for several different events of one batch, with the rows lost."""
    counts = dedupe_batch(events).groupBy(*EVENT_KEY).agg((F.count(F.lit(1)) - 1).alias("dropped"))
    return counts.filter("dropped > 0")


def merge_duplicates(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same event listed by several sources, as one card.

    Returns the cards (the earliest seen row of each dedupe key, ``source_count`` and
    ``url_count``) and the links of each card as rows ``dedupe_key, url``. Links stay rows because
    a key may collect any number of them.
    """
    order = [F.col("first_seen_utc"), *[F.col(c) for c in EVENT_KEY]]
    cards = first_per_key(events, ["dedupe_key"], order)
    links = events.select("dedupe_key", "url").distinct()
    sources = events.select("dedupe_key", "source_id").distinct()
    url_counts = links.groupBy("dedupe_key").agg(F.count(F.lit(1)).alias("url_count"))
    source_counts = sources.groupBy("dedupe_key").agg(F.count(F.lit(1)).alias("source_count"))
    return cards.join(url_counts, "dedupe_key").join(source_counts, "dedupe_key"), links


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def _feed_order(events: DataFrame) -> list[Column]:
    """Order inside a batch; the event id only separates rows that are equal otherwise."""
    names = ["first_seen_utc", "feed_pos", "source_event_id"]
    return [F.col(c) for c in names if c in events.columns]
