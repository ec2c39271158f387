"""Registry of named queries, each with the SQL that gives the same result on the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Register a query under its function name."""

    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = with_views(views, sql) if views else sql
        return run

    return register


# --- pieces shared by queries and their SQL ----------------------------------------------------


def fold_sql(text: str) -> str:
    """Fold of Latin text."""
    for umlaut, spelled in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        text = f"replace({'lower(' + text + ')' if umlaut == 'ä' else text}, '{umlaut}', '{spelled}')"
    return f"strip_accents({text})"


def tokens_sql(folded: str) -> str:
    return rf"regexp_extract_all({folded}, '[\p{{L}}\p{{Nd}}]+')"


def bounded_sql(folded: str, pattern: str) -> str:
    return rf"regexp_matches({folded}, '(?:^|[^\p{{L}}\p{{Nd}}]){pattern}(?:$|[^\p{{L}}\p{{Nd}}])')"


def plz_sql(text: str) -> str:
    return f"nullif(regexp_extract({text}, '(?:^|[^0-9])([0-9]{{5}})(?:[^0-9]|$)', 1), '')"


def distance_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    )
    return f"(2 * 6371.0088 * atan2(sqrt({a}), sqrt(1 - ({a}))))"


def time_sql(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S.%f')"


def time_text(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def local_day_sql(start: str, zone: str) -> str:
    safe = f"case when {zone} in ('Europe/Berlin', 'UTC') then {zone} else 'UTC' end"
    return f"cast(timezone({safe}, timezone('UTC', {start})) as date)"


def joined(array: Column | str) -> Column:
    return F.array_join(array, ",")
