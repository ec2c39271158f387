"""Landed inputs derived from the given tables, as SQL that Spark and other engines both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare

_DAY = "cast(cast(ts as date) as string)"
_HOUR = "lpad(cast(hour(ts) as string), 2, '0')"
_CRLF = "chr(13) || chr(10)"

VIEWS = {
    # Gazetteer: one alias and one postal code per place; every fourth place shares a name.
    "fx_place": """
select 'Town ' || cast(case when s_suppkey % 4 = 3 then s_suppkey - 1 else s_suppkey end as string) as name,
       'Markt ' || cast(s_suppkey as string) as alias,
       'A' || cast(s_nationkey as string) as admin1,
       cast(floor(abs(s_acctbal) * 100) as bigint) as population,
       47.3e0 + cast((s_suppkey * 37) % 780 as double) / 100e0 as lat,
       5.9e0 + cast((s_suppkey * 53) % 910 as double) / 100e0 as lon,
       cast(10000 + s_suppkey * 7 as string) as plz,
       s_suppkey as line_no
from supplier""",
    # Raw events; event_id % 5 selects the branch of the geo cascade.
    "fx_raw_event": """
select 'src' || cast(user_id % 20 as string) as source_id,
       'ev-' || cast(event_id as string) as source_event_id,
       case when event_id % 7 = 0 then 'Join us for: ' else '' end || event_type || '  Meetup ' || cast(user_id % 30 as string) as title,
       case event_type when 'click' then 'Kubernetes und C# in Köln' when 'view' then 'javascript, see http://demo.net/'
                       when 'error' then 'KI / machine learning' when 'signup' then null else '.NET 9 open source' end as description,
       ts as start_utc,
       case when event_id % 3 = 0 then null else ts + interval '2' hour end as end_utc,
       case when event_id % 11 = 0 then 'Mars/Base' when event_id % 13 = 0 then null else 'Europe/Berlin' end as time_zone_id,
       case when event_id % 4 = 0 then 'Café Größe ' || cast(user_id % 9 as string) end as venue_name,
       case when event_id % 5 = 1 then 'Hauptstraße ' || cast(user_id as string) || ', ' || cast(10000 + (user_id % 120) * 7 as string) || ' X'
            when event_id % 10 = 3 then 'beim Markt ' || cast(user_id % 120 as string) || ' links' end as venue_address,
       case when event_id % 5 = 0 then 'TOWN ' || cast(user_id % 120 as string)
            when event_id % 5 = 3 then 'Nowhere' end as city,
       case when event_id % 15 = 6 then '99999' when event_id % 15 = 1 then 'D-' || cast(10000 + (user_id % 50) * 7 as string) end as postal_code,
       case when event_id % 5 = 2 then 47.3e0 + cast(event_id % 780 as double) / 100e0 end as lat,
       case when event_id % 5 = 2 then 5.9e0 + cast(event_id % 910 as double) / 100e0 end as lon,
       case when event_id % 5 = 4 then 'Online' when event_id % 10 = 0 then 'Hybrid' when event_id % 25 = 6 then 'Online' end as attendance_hint,
       'https://x.example/' || cast(event_id % 900 as string) as url,
       event_id as feed_pos
from events""",
    # Registry: a disabled source, a source of a bad type, one without adapter, one repeated.
    "fx_registry": """
select distinct 'src' || cast(user_id % 20 as string) as id, 'Org ' || cast(user_id % 20 as string) as org,
       case when user_id % 20 = 0 then 'ics' when user_id % 20 = 1 then 'gdg-sitemap' when user_id % 20 = 19 then 'rss' else 'html' end as type,
       'https://s' || cast(user_id % 20 as string) || '.example/events' as url,
       case when user_id % 20 = 16 then 'other' when user_id % 20 between 2 and 17 then 'meetup-group' end as adapter,
       user_id % 20 <> 5 as enabled
from events
union all
select 'src7', 'Org again', 'html', 'https://again.example/', 'meetup-group', true from events where event_id = 0""",
    # Searches around centres of the country.
    "fx_saved_search": """
select c_custkey as search_id, 47.3e0 + cast((c_custkey * 41) % 780 as double) / 100e0 as lat,
       5.9e0 + cast((c_custkey * 59) % 910 as double) / 100e0 as lon,
       cast(1 + c_custkey % 190 as double) as radius_km,
       case when c_custkey % 3 = 1 then 'hybrid' end as attendance,
       case when c_custkey % 5 = 2 then 'MEETUP 1' end as text
from customer""",
    # Pages with JSON-LD; some without, with a list of places, without start, or broken.
    "fx_jsonld_page": f"""
select 'src' || cast(user_id % 20 as string) as source_id,
       'https://x.example/events/details/google-gdg-' || cast(user_id % 12 as string) || '-presents-' || cast(event_id as string) || '/' as url,
       case when event_id % 13 = 0 then '<html><body>no data</body></html>'
            when event_id % 13 = 1 then '<script type="application/ld+json">{{"name":</script>'
            else '<html><!-- <script type="application/ld+json">{{"name":"quoted"}}</script> --><script type="application/ld+json">{{"@type":"Event","name":"' || event_type
              || '",' || case when event_id % 13 = 2 then '' else '"startDate":"' || {_DAY} || 'T' || {_HOUR} || ':00:00+01:00",' end
              || case when event_id % 3 = 0 then '"endDate":"' || {_DAY} || 'T23:59:00+01:00",' else '' end
              || '"description":' || case when event_id % 4 = 0 then '17' else '"Talk ' || cast(user_id as string) || '"' end || ',"location":'
              || case when event_id % 5 = 0 then '[{{"@type":"VirtualLocation","url":"u"}},' else '' end
              || '{{"@type":"Place","name":"V","address":{{"addressLocality":"Town ' || cast(user_id % 120 as string) || '","postalCode":"'
              || cast(10000 + (user_id % 120) * 7 as string) || '"' || case when event_id % 2 = 0 then ',"streetAddress":"Weg 1"' else '' end || '}}}}'
              || case when event_id % 5 = 0 then ']' else '' end || ',"eventAttendanceMode":"https://schema.org/'
              || case event_id % 4 when 0 then 'Offline' when 1 then 'Online' when 2 then 'Mixed' else 'Other' end || 'EventAttendanceMode"}}</script></html>'
       end as body
from events""",
    # Pages with a map of entities; some without script, without map, or without events.
    "fx_state_page": f"""
select 'src' || cast(user_id % 20 as string) as source_id, 'https://x.example/g' || cast(event_id as string) || '/events/' as url,
       case when event_id % 17 = 0 then '<html><body>moved</body></html>'
            when event_id % 17 = 1 then '<script id="__NEXT_DATA__" type="application/json">{{"props":{{}}}}</script>'
            when event_id % 17 = 2 then '<script id="__NEXT_DATA__" type="application/json">{{"props":{{"pageProps":{{"__APOLLO_STATE__":{{"ROOT_QUERY":{{}}}}}}}}}}</script>'
            else '<html><script>var a = 1;</script><script type="application/json" id="__NEXT_DATA__">{{"props":{{"pageProps":{{"__APOLLO_STATE__":{{"Event:'
              || cast(event_id as string) || '":{{"title":' || case when event_id % 6 = 0 then '5' else '"' || event_type || ' night"' end
              || ',"dateTime":"' || {_DAY} || 'T' || {_HOUR} || ':15:00+01:00",'
              || case when event_id % 2 = 0 then '"endTime":"' || {_DAY} || 'T23:45:00+01:00",' else '' end
              || case when event_id % 3 = 0 then '"eventUrl":"https://e.example/' || cast(event_id as string) || '",' else '' end
              || '"eventType":"' || case event_id % 4 when 0 then 'PHYSICAL' when 1 then 'ONLINE' when 2 then 'HYBRID' else 'OTHER' end || '"'
              || case when event_id % 4 <> 1 then ',"venue":{{"__ref":"Venue:' || cast(user_id as string) || '"}}' else '' end
              || '}},"Event:' || cast(event_id as string) || '-tba":{{"title":"to be announced"}},"Group:g' || cast(user_id % 40 as string)
              || '":{{"name":"Group ' || cast(user_id % 40 as string) || '","city":"Town ' || cast(event_id % 7 as string) || '","link":"https://www.meetup.com/g'
              || cast(user_id % 40 as string) || '/"}},"Venue:' || cast(user_id as string) || '":{{"name":"Haus ' || cast(user_id as string)
              || '","address":"Weg ' || cast(user_id % 9 as string) || '","city":' || case when user_id % 8 = 0 then 'null' else '"Town ' || cast(user_id % 120 as string) || '"' end
              || '}}}}}}}}}}</script></html>'
       end as body
from events""",
    # Calendar feeds: weekly, daily and single entries, whole days, no UID, and no calendar.
    "fx_feed": f"""
select 'src' || cast(user_id % 20 as string) as source_id, 'https://x.example/' || cast(event_id as string) || '.ics' as url,
       case when event_id % 23 = 0 then '<html>gone</html>' else
         'BEGIN:VCALENDAR' || {_CRLF} || 'VERSION:2.0' || {_CRLF} || 'BEGIN:VEVENT' || {_CRLF}
         || case when event_id % 23 = 1 then '' else 'UID:u' || cast(event_id as string) || '@t' || {_CRLF} end
         || case when event_id % 6 = 3 then 'DTSTART;VALUE=DATE:' || replace({_DAY}, '-', '')
                 else 'DTSTART;TZID=Europe/Berlin:' || replace({_DAY}, '-', '') || 'T183000' || {_CRLF}
                   || 'DTEND;TZID=Europe/Berlin:' || replace({_DAY}, '-', '') || 'T203000' end || {_CRLF}
         || case when event_id % 6 = 1 then 'RRULE:FREQ=WEEKLY;COUNT=' || cast(1 + event_id % 20 as string) || {_CRLF}
                 when event_id % 6 = 2 then 'RRULE:FREQ=DAILY;INTERVAL=2;COUNT=3' || {_CRLF}
                 when event_id % 6 = 4 then 'RRULE:FREQ=HOURLY;COUNT=3' || {_CRLF} else '' end
         || 'SUMMARY:' || event_type || chr(92) || ', Treff' || {_CRLF} || ' en' || {_CRLF} || 'LOCATION:Town ' || cast(user_id % 120 as string) || {_CRLF}
         || 'BEGIN:VALARM' || {_CRLF} || 'DESCRIPTION:reminder' || {_CRLF} || 'END:VALARM' || {_CRLF}
         || 'END:VEVENT' || {_CRLF} || 'END:VCALENDAR' || {_CRLF} end as body
from events""",
    # Monthly sitemaps and some that are not well-formed.
    "fx_sitemap": """
select 'src' || cast(user_id % 20 as string) as source_id,
       'https://x.example/sitemap-events-' || cast(2023 + event_id % 3 as string) || '-' || lpad(cast(1 + event_id % 12 as string), 2, '0') || '.xml' as url,
       event_id,
       case when event_id % 29 = 0 then '<urlset><url>' else
         '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><!-- <loc>none</loc> --><url><loc> https://x.example/events/details/google-gdg-'
         || cast(user_id % 12 as string) || case when event_id % 2 = 0 then '-presents-' else '-cloud-presents-' end || cast(event_id % 500 as string)
         || '/?a=1&amp;b=2 </loc></url><url><loc>https://x.example/other/' || cast(event_id % 50 as string) || '</loc></url></urlset>' end as body
from events""",
    # robots.txt of every host in the pages table.
    "fx_robots": """
select host, '# robots' || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /en/' || cast(length(host) % 10 as string) || chr(10)
       || 'Disallow:' || chr(10) || case when length(host) % 3 = 0 then 'Crawl-delay: 2.5' || chr(10) else '' end
       || 'user-agent: ScoutBot' || chr(10) || 'User-agent: other' || chr(10) || 'Disallow: /fr/ # no French' || chr(13) || chr(10)
       || case when length(host) % 2 = 0 then 'Crawl-delay: 7' || chr(10) else 'crawl-delay: soon' || chr(10) end
       || 'User-agent: *' || chr(10) || 'Disallow: /es/' || chr(10) || 'Disallow: /de/*' as body
from (select distinct split_part(split_part(url, '://', 2), '/', 1) as host from pages) h
where length(host) % 7 <> 0""",
    # Landed fetches over two rounds: good, unchanged, failed, unreachable.
    "fx_crawl": """
select 'src' || cast(user_id % 20 as string) as source_id, 'https://x.example/p' || cast(event_id % 700 as string) as url,
       case event_id % 6 when 0 then 304 when 1 then 404 when 2 then null else 200 end as http_status,
       case when event_id % 6 = 2 then 'timed out' end as error,
       case when event_id % 6 > 2 then 'body ' || cast(event_id as string) end as body,
       cast(null as string) as etag, cast(null as string) as last_modified, ts as fetched_at, event_id
from events""",
    # Answers of the address geocoder.
    "fx_answer": """
select 'q' || cast(event_id as string) as query, case event_id % 9 when 8 then 500 when 7 then null else 200 end as http_status,
       case event_id % 9 when 0 then '{"features":[]}' when 6 then 'not json'
         else '{"features":[{"geometry":{"coordinates":[' || cast(cast(event_id % 20 as double) as string) || ',' || cast(cast(45 + event_id % 12 as double) as string)
           || ']},"properties":{' || case event_id % 9 when 1 then '"street":"S","housenumber":"1"' when 2 then '"street":"S"' when 3 then '"city":"C"' when 4 then '"housenumber":"9"' else '"street":"","housenumber":"3"' end
           || '}},{"geometry":{"coordinates":[0,0]}}]}' end as body,
       event_id
from events""",
    # GeoNames dumps as tab-separated lines.
    "fx_dump": """
select s_suppkey as line_no, cast(s_suppkey as string) || chr(9) || 'Place ' || cast(s_suppkey % 70 as string) || chr(9) || 'Plaza ' || cast(s_suppkey as string)
       || chr(9) || 'Ort,Placentia ' || cast(s_suppkey as string) || ',Groß Place ' || cast(s_suppkey % 70 as string) || ',BER'
       || chr(9) || '50.5' || chr(9) || '9.25' || chr(9) || case when s_suppkey % 11 = 0 then 'A' else 'P' end || chr(9) || 'PPL' || chr(9) || 'DE' || chr(9)
       || chr(9) || lpad(cast(s_nationkey as string), 2, '0') || chr(9) || chr(9) || chr(9) || chr(9)
       || case when s_suppkey % 13 = 0 then '' else cast(cast(floor(abs(s_acctbal)) as bigint) % 500 as string) end as line
from supplier""",
    "fx_alternate": """
select c_custkey as line_no, cast(c_custkey as string) || chr(9) || cast(c_custkey % 60 as string) || chr(9) || case when c_custkey % 4 = 0 then 'en' else 'de' end
       || chr(9) || case when c_custkey % 9 = 0 then '' else 'Örtchen ' || cast(c_custkey % 25 as string) end || chr(9) || case when c_custkey % 10 = 1 then '1' else '' end as line
from customer""",
    "fx_postal_dump": """
select s_suppkey as line_no, 'DE' || chr(9) || case when s_suppkey % 17 = 0 then '' else cast(10000 + s_suppkey % 60 as string) end || chr(9) || 'Ort ' || cast(s_suppkey as string)
       || chr(9) || 'State' || chr(9) || lpad(cast(s_nationkey as string), 2, '0') || chr(9) || chr(9) || chr(9) || chr(9) || chr(9) || '50.' || cast(s_suppkey as string)
       || chr(9) || '9.5' || case when s_suppkey % 19 = 0 then '' else chr(9) || '4' end as line
from supplier""",
}

def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame, times as instants."""
    prepare(spark)
    for source in set(re.findall(r"\bfrom (\w+)", VIEWS[name])):
        table(spark, sf_dir, source).createOrReplaceTempView(source)
    df = spark.sql(VIEWS[name])
    zoned = {f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"}
    return df.withColumns(zoned) if zoned else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(names: str, body: str) -> str:
    """One SQL statement with the named views in front of ``body``, which may go on with ``, name AS``."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names.split()) + "\n" + body.strip()
