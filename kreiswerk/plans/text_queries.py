"""Queries over the text, address, time and identifier functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address, tags, text, times, urls
from ..functions.fixed_values import KEYWORD_TO_TAG
from ..operators.gazetteer import related_names
from ..operators.rows import computed
from .catalog import (
    bounded_sql, fold_sql, joined, local_day_sql, plz_sql, query, time_sql, time_text, tokens_sql,
)
from .fixtures import table, view

# Words of the four languages in the documents, one phrase and one with punctuation.
OWN_KEYWORDS = {"der": "de", "und": "de", "the": "en", "que": "romance", "les": "fr", "de la": "romance", "un.": "stop", "für": "de"}

_SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _collapse_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_SPACE}', ' ', 'g'))"


def clean_sql(c: str) -> str:
    c = _collapse_sql(c)
    return f"case when starts_with(lower({c}), 'join us for') then {_collapse_sql(f'regexp_replace(substr({c}, 12), $$^[: -]+$$, $$$$)')} else {c} end"


def tags_sql(folded: str, keywords: dict[str, str]) -> str:
    """Sorted distinct tags as comma-separated text."""
    tests = {}
    for keyword, tag in keywords.items():
        folded_keyword = text.fold_constant(keyword)
        plain = text.tokenize_constant(folded_keyword) == [folded_keyword]
        quoted = "".join(ch if ch.isalnum() or ch == " " else "\\" + ch for ch in folded_keyword)
        test = f"list_contains({tokens_sql(folded)}, '{folded_keyword}')" if plain else bounded_sql(folded, quoted)
        tests.setdefault(tag, []).append(test)
    cases = ", ".join(f"case when {' or '.join(t)} then '{tag}' end" for tag, t in sorted(tests.items()))
    return f"concat_ws(',', {cases})"


@query(f"SELECT doc_id, {_collapse_sql('text')} AS clean FROM documents")
def collapse_whitespace(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.collapse_whitespace("text").alias("clean"))


@query(
    f"SELECT source_event_id, {clean_sql('title')} AS title, coalesce({clean_sql('description')}, '') AS description FROM fx_raw_event",
    "fx_raw_event",
)
def clean_texts(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_raw_event").select(
        "source_event_id", text.clean_title("title").alias("title"), text.clean_description("description").alias("description")
    )


@query(f"SELECT doc_id, {fold_sql('text')} AS folded FROM documents")
def fold_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.fold("text").alias("folded"))


@query(f"""
SELECT token, count(*) AS uses, count(DISTINCT doc_id) AS documents
FROM (SELECT doc_id, unnest({tokens_sql(fold_sql('text'))}) AS token FROM documents) GROUP BY token""")
def token_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    per_document = (
        computed(table(spark, sf, "documents"), "doc_id", text.tokenize(text.fold("text")).alias("tokens"))
        .select("doc_id", F.explode("tokens").alias("token"))
        .groupBy("token", "doc_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per_document.groupBy("token").agg(F.sum("n").alias("uses"), F.count(F.lit(1)).alias("documents"))


@query(f"""
SELECT doc_id, {tags_sql('folded', OWN_KEYWORDS)} AS tags
FROM (SELECT doc_id, {fold_sql("'' || ' ' || text")} AS folded FROM documents)""")
def tag_documents(spark: SparkSession, sf: str) -> DataFrame:
    found = tags.extract_tags(F.lit(""), "text", OWN_KEYWORDS)
    return table(spark, sf, "documents").select("doc_id", joined(found).alias("tags"))


@query(f"""
SELECT role, tag, count(*) AS turns FROM (
  SELECT role, unnest(string_split(tags, ',')) AS tag FROM (
    SELECT role, {tags_sql('folded', OWN_KEYWORDS)} AS tags
    FROM (SELECT role, {fold_sql("' ' || text")} AS folded FROM conversations)))
WHERE tag <> '' GROUP BY role, tag""")
def tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    found = tags.extract_tags(F.lit(""), "text", OWN_KEYWORDS)
    rows = computed(table(spark, sf, "conversations"), "role", found.alias("tags")).select("role", F.explode("tags").alias("tag"))
    return rows.groupBy("role", "tag").agg(F.count(F.lit(1)).alias("turns"))


@query(
    f"""
SELECT source_event_id, array_to_string(list_sort(list_distinct(list_concat(['zeta', 'ai'],
  list_filter(string_split({tags_sql('folded', KEYWORD_TO_TAG)}, ','), lambda x: x <> '')))), ',') AS tags
FROM (SELECT source_event_id, {fold_sql("title || ' ' || coalesce(description, '')")} AS folded FROM fx_raw_event)""",
    "fx_raw_event",
)
def tag_events(spark: SparkSession, sf: str) -> DataFrame:
    own = F.array(F.lit("zeta"), F.lit("ai"))
    merged = tags.merge_tags(own, tags.extract_tags("title", "description"))
    return view(spark, sf, "fx_raw_event").select("source_event_id", joined(merged).alias("tags"))


@query(f"""
SELECT doc_id, {bounded_sql(fold_sql('text'), 'les de')} AS phrase, {bounded_sql(fold_sql('text'), 'la[.]')} AS stop FROM documents""")
def bounded_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    folded = text.fold("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        text.contains_bounded(folded, "les de").alias("phrase"),
        text.contains_bounded(folded, "la.").alias("stop"),
    )


@query(f"""
SELECT doc_id, {plz_sql('text')} AS plz FROM documents WHERE {plz_sql('text')} IS NOT NULL""")
def plz_in_documents(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "documents").select("doc_id", address.extract_plz("text").alias("plz"))
    return found.filter("plz is not null")


_STREET = "strasse|str[.]|weg|allee|platz|gasse|ring|damm"


@query(f"""
SELECT doc_id, regexp_matches(text, '[0-9]') OR regexp_matches({fold_sql('text')}, '{_STREET}') AS street FROM documents""")
def street_like_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", address.looks_like_street("text").alias("street"))


@query(
    f"""
SELECT source_event_id, cast({local_day_sql('start_utc', 'time_zone_id')} AS varchar) AS day,
       {fold_sql('title')} || '|' || cast({local_day_sql('start_utc', 'time_zone_id')} AS varchar) || '|' || coalesce({fold_sql('city')}, '') AS dedupe_key,
       coalesce(nullif(time_zone_id, ''), 'UTC') AS zone
FROM fx_raw_event""",
    "fx_raw_event",
)
def dedupe_keys(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_raw_event").select(
        "source_event_id",
        times.local_date("start_utc", "time_zone_id").cast("string").alias("day"),
        times.dedupe_key("title", "start_utc", "time_zone_id", "city").alias("dedupe_key"),
        times.default_zone("time_zone_id").alias("zone"),
    )


@query(r"""
SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host,
       coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS path,
       list_last(string_split(trim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), '/')) AS tail
FROM pages""")
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id", urls.url_host("url").alias("host"), urls.url_path("url").alias("path"), urls.path_tail("url").alias("tail")
    )


@query(
    """
SELECT source_event_id, source_id || '@' || source_event_id || '#' || strftime(start_utc, '%Y%m%dT%H%M%SZ') AS occurrence,
       sha256(source_id || '#' || source_event_id) AS id, upper(sha256(title)) || '@events.invalid' AS uid
FROM fx_raw_event""",
    "fx_raw_event",
)
def identifiers(spark: SparkSession, sf: str) -> DataFrame:
    entry = F.concat("source_id", F.lit("@"), "source_event_id")
    return view(spark, sf, "fx_raw_event").select(
        "source_event_id",
        urls.occurrence_id(entry, "start_utc").alias("occurrence"),
        urls.event_id("source_id", "source_event_id").alias("id"),
        urls.feed_uid("title", "events.invalid").alias("uid"),
    )


@query(f"""
SELECT event_id, CASE WHEN event_id % 5 <> 4 THEN {time_sql("date_trunc('second', ts) - interval 1 hour * (event_id % 3)")} END AS instant FROM events""")
def iso_instants(spark: SparkSession, sf: str) -> DataFrame:
    local = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    offset = F.format_string("+0%d:00", F.col("event_id") % 3)
    written = F.when(F.col("event_id") % 5 == 4, F.lit("next week")).otherwise(F.concat(local, offset))
    return table(spark, sf, "events").select("event_id", time_text(times.parse_instant(written)).alias("instant"))


@query("""
SELECT event_id, CASE event_type WHEN 'click' THEN 'InPerson' WHEN 'view' THEN 'Online' WHEN 'error' THEN 'Hybrid' END AS by_type,
       CASE event_type WHEN 'view' THEN 'InPerson' WHEN 'click' THEN 'Online' WHEN 'signup' THEN 'Hybrid' END AS by_mode
FROM events""")
def attendance_values(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda pairs: F.element_at(F.create_map(*[F.lit(v) for p in pairs.items() for v in p]), F.col("event_type"))
    mode = "https://schema.org/{}EventAttendanceMode"
    kinds = pick({"click": "PHYSICAL", "view": "ONLINE", "error": "HYBRID", "signup": "hybrid"})
    modes = pick({"view": mode.format("Offline"), "click": mode.format("Online"), "signup": mode.format("Mixed"), "error": "x"})
    return table(spark, sf, "events").select(
        "event_id", address.attendance_from_type(kinds).alias("by_type"), address.attendance_from_mode(modes).alias("by_mode")
    )


@query("""
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 1 THEN true WHEN 3 THEN s_suppkey >= 10 ELSE false END AS related,
       coalesce(CASE WHEN s_nationkey BETWEEN 1 AND 16 THEN string_split('BW,BY,HB,HH,HE,NI,NW,RP,SL,SH,BB,MV,SN,ST,TH,BE', ',')[s_nationkey] END, '') AS state
FROM supplier""")
def place_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Equal when folded, same start, unrelated, or contained (only numbers of two digits hold the first digit)."""
    number = F.col("s_suppkey").cast("string")
    name = F.concat(F.lit("Köln-"), number)
    alias = (
        F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("KOELN-"), number))
        .when(F.col("s_suppkey") % 4 == 1, F.lit("Koelle"))
        .when(F.col("s_suppkey") % 4 == 2, F.lit("Cologne"))
        .otherwise(F.when(F.col("s_suppkey") >= 10, F.concat(F.lit("-"), F.left(number, F.lit(1)))).otherwise(F.lit("Bonn")))
    )
    return table(spark, sf, "supplier").select(
        "s_suppkey",
        related_names(alias, name).alias("related"),
        address.state_code(F.lpad(F.col("s_nationkey").cast("string"), 2, "0")).alias("state"),
    )
