"""URL parts and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

_ABSOLUTE = r"^(?i)[a-z][a-z0-9+.-]*:\S+$"


def url_host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_path(url: Column | str) -> Column:
    path = F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def path_tail(url: Column | str) -> Column:
    """Last segment of the path, trailing slash ignored."""
    return F.element_at(F.split(F.btrim(url_path(url), F.lit("/")), "/"), -1)


def absolute_or_null(url: Column | str) -> Column:
    return F.when(col(url).rlike(_ABSOLUTE), col(url))


def utc_stamp(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyyMMdd'T'HHmmss'Z'")


def occurrence_id(uid: Column | str, start: Column | str) -> Column:
    """Identity of one occurrence of a calendar entry."""
    return F.concat(col(uid), F.lit("#"), utc_stamp(start))


def event_id(source_id: Column | str, source_event_id: Column | str) -> Column:
    """Deterministic row id from the natural key."""
    return F.sha2(F.concat(col(source_id), F.lit("#"), col(source_event_id)), 256)


def feed_uid(key: Column | str, domain: str) -> Column:
    """Calendar UID that stays the same as long as the dedupe key does."""
    return F.concat(F.upper(F.sha2(col(key), 256)), F.lit(f"@{domain}"))
