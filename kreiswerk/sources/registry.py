"""Source registry: one row per source, read from JSON lines or any table of that shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_null

REGISTRY_SCHEMA = (
    "id string, org string, type string, url string, adapter string, region string, "
    "tags array<string>, slugs array<string>, enabled boolean"
)
SOURCE_TYPES = ("ics", "html", "gdg-sitemap")
HTML_ADAPTERS = ("meetup-group",)


class RegistryError(ValueError):
    """The registry breaks one of its rules."""


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return with_registry_defaults(spark.read.schema(REGISTRY_SCHEMA).json(path))


def with_registry_defaults(registry: DataFrame) -> DataFrame:
    """Missing text is empty, missing lists are empty, a source is enabled unless it says no."""
    none = F.array().cast("array<string>")
    defaults = {
        **{c: F.coalesce(F.col(c), F.lit("")) for c in ("id", "org", "type", "url")},
        **{c: F.coalesce(F.col(c), none) for c in ("tags", "slugs")},
        "enabled": F.coalesce(F.col("enabled"), F.lit(True)),
    }
    return registry.withColumns(defaults)


def enabled_sources(registry: DataFrame) -> DataFrame:
    return registry.filter("enabled")


def registry_violations(registry: DataFrame, adapters: Sequence[str] = HTML_ADAPTERS) -> DataFrame:
    """One row ``(id, rule, message)`` per broken rule."""
    quoted = lambda text: F.concat(F.lit("Source '"), "id", F.lit(f"' {text}"))
    adapter = blank_to_null("adapter")
    html = F.col("type") == "html"
    rules = {
        "unknown-type": (~F.col("type").isin(*SOURCE_TYPES), quoted("has an unknown type.")),
        "html-without-adapter": (html & adapter.isNull(), quoted("is type 'html' but names no adapter.")),
        "unregistered-adapter": (
            html & adapter.isNotNull() & ~F.col("adapter").isin(*adapters),
            quoted("names an adapter that is not registered."),
        ),
        "sitemap-without-slugs": (
            (F.col("type") == "gdg-sitemap") & (F.size("slugs") == 0),
            quoted("is type 'gdg-sitemap' but names no chapter slugs."),
        ),
    }
    found = F.array_compact(
        F.array(
            *[
                F.when(broken, F.struct(F.lit(rule).alias("rule"), message.alias("message")))
                for rule, (broken, message) in rules.items()
            ]
        )
    )
    duplicates = registry.groupBy("id").count().filter("count > 1").select(
        "id", F.lit("duplicate-id").alias("rule"), quoted("appears more than once.").alias("message")
    )
    return registry.select("id", F.explode(found).alias("v")).select("id", "v.rule", "v.message").unionByName(duplicates)


def require_valid(registry: DataFrame, adapters: Sequence[str] = HTML_ADAPTERS, shown: int = 20) -> DataFrame:
    """Return the registry, or raise with the first violations."""
    broken = registry_violations(registry, adapters).orderBy("id", "rule").take(shown)
    if broken:
        raise RegistryError("; ".join(row.message for row in broken))
    return registry
