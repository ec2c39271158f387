"""Extraction from pages, sitemaps, calendars and robots.txt, registry rules, and fetch handling."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kreiswerk.functions import times, urls
from kreiswerk.operators import feed, health
from kreiswerk.sources import calendar, crawl, pages, registry, robots, sitemap

PAGES = "source_id string, url string, body string"
NOW = datetime(2026, 1, 1)


def page(spark, *bodies):
    return spark.createDataFrame([("s", f"https://h.example/events/details/p{i}/", b) for i, b in enumerate(bodies)], PAGES)


def state_html(state, attributes='id="__NEXT_DATA__" type="application/json"'):
    return f"<html><!-- <script id=\"__NEXT_DATA__\" type=\"application/json\">old</script> --><SCRIPT {attributes}>{json.dumps({'props': {'pageProps': {'__APOLLO_STATE__': state}}})}</SCRIPT></html>"


def test_state_pages(spark):
    state = {
        "ROOT_QUERY": {"x": 1},
        "Event:1": {"title": "Night", "dateTime": "2026-08-04T17:30:00+02:00", "endTime": "2026-08-04T20:30:00+02:00", "eventType": "PHYSICAL", "eventUrl": "https://e/1", "venue": {"__ref": "Venue:9"}},
        "Event:2": {"title": 5, "dateTime": "2026-09-02T18:00:00Z", "eventType": "ONLINE", "description": None},
        "Event:3": {"title": "no start"},
        "Event:4": {"title": "bad ref", "dateTime": "2026-09-02T18:00:00Z", "venue": {"__ref": "Venue:0"}, "eventType": "x"},
        "Event:5": 7,
        "Venue:9": {"name": "Haus", "address": "Weg 3", "city": ["no text"]},
    }
    rows, errors = pages.extract_state_events(page(spark, state_html(state), state_html({}), "<p>moved</p>", state_html(1), '<script id="__NEXT_DATA__" type="application/json">{"a"</script>', state_html(state, 'id="__NEXT_DATA__"')))
    got = {r.source_event_id: r for r in rows.collect()}
    assert set(got) == {"1", "2", "4"}
    first = got["1"]
    assert (first.title, first.start_utc, first.venue_name, first.venue_address, first.city, first.attendance_hint, first.url) == (
        "Night", datetime(2026, 8, 4, 15, 30), "Haus", "Weg 3", None, "InPerson", "https://e/1",
    )
    assert (got["2"].title, got["2"].end_utc, got["2"].url, got["2"].attendance_hint) == ("", None, "https://h.example/events/details/p0/", "Online")
    assert got["4"].venue_name is None and got["4"].attendance_hint is None
    assert {e.url[-3:]: e.error for e in errors.collect()} == {
        "p2/": "no __NEXT_DATA__ script found",
        "p3/": "__NEXT_DATA__ has no props.pageProps.__APOLLO_STATE__",
        "p4/": "__NEXT_DATA__ is not valid JSON",
        "p5/": "no __NEXT_DATA__ script found",
    }


def test_ended_events_are_dropped(spark):
    rows = spark.createDataFrame([(1, datetime(2025, 12, 31), datetime(2026, 1, 1)), (2, datetime(2025, 12, 31), None), (3, datetime(2026, 1, 1), None)], "i int, s timestamp, e timestamp")
    assert [r.i for r in rows.filter(times.not_ended("s", "e", NOW)).orderBy("i").collect()] == [1, 3]


def ld(value):
    return f"<!-- the <script type='application/ld+json'> block --><script type='application/ld+json'>{value if isinstance(value, str) else json.dumps(value)}</script>"


def test_jsonld_pages(spark):
    place = {"@type": "Place", "name": "Isar", "address": {"streetAddress": "33 Weg", "addressLocality": "München", "postalCode": "80636", "addressCountry": "US"}}
    base = {"name": "Talk", "startDate": "2026-07-08T18:15:00+02:00"}
    rows = pages.extract_jsonld_events(
        page(
            spark,
            ld(base | {"location": place, "eventAttendanceMode": "https://schema.org/MixedEventAttendanceMode"}),
            ld(base | {"location": [{"@type": "VirtualLocation", "url": "u"}, 3, place], "description": 4, "endDate": "soon"}),
            ld(base | {"location": {"name": "no address"}}),
            ld(base | {"name": "  "}), ld({"name": "x", "startDate": "later"}), ld("{broken"), "<p>none</p>", ld([1]),
        )
    )
    got = {r.source_event_id: r for r in rows.collect()}
    assert set(got) == {"p0", "p1", "p2"}
    for key in ("p0", "p1"):
        assert (got[key].venue_name, got[key].venue_address, got[key].city, got[key].postal_code) == ("Isar", "33 Weg, 80636, München", "München", "80636")
    assert got["p0"].start_utc == datetime(2026, 7, 8, 16, 15) and got["p0"].attendance_hint == "Hybrid" and got["p0"].time_zone_id == "Europe/Berlin"
    assert got["p1"].description is None and got["p1"].end_utc is None and got["p1"].attendance_hint is None
    assert got["p2"].venue_name is None and got["p2"].venue_address is None


def test_sitemaps(spark):
    names = [f"https://h/sitemap-events-{m}.xml" for m in ("2025-12", "2026-01", "2027-01", "2027-02")] + ["https://h/other.xml"]
    entries = "".join(f"<sitemap><loc>\n {n} </loc></sitemap>" for n in names)
    index = f'<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{entries}</sitemapindex>'
    month = '<urlset xmlns="u" xmlns:i="i"><url><loc>https://h/a?x=1&amp;y</loc><i:image><i:loc>no</i:loc></i:image></url></urlset>'
    locs, errors = sitemap.sitemap_locs(page(spark, index, month, "<urlset><url>", "<urlset></urlset>"))
    assert sorted(r["loc"] for r in locs.collect()) == sorted([*names, "https://h/a?x=1&y"])
    assert [e.url[-3:] for e in errors.collect()] == ["p2/"]
    assert sorted(r["loc"] for r in sitemap.monthly_sitemaps(locs, NOW).collect()) == names[1:3]


def test_chapter_slugs(spark):
    rows = [("s", u) for u in ("https://h/google-gdg-berlin-presents-a/", "https://h/google-gdg-berlin-android-presents-b-presents-c/", "https://h/google-x-gdg-berlin-presents-a/", "https://h/gdg-berlin", "https://h/google-gdg-berlin-presents-a/")]
    find = lambda *slugs: sorted(r.url[10:] for r in sitemap.match_chapters(spark.createDataFrame(rows, "source_id string, url string"), spark.createDataFrame([("s", s) for s in slugs] + [("t", "x")], "source_id string, slug string")).collect())  # noqa: E731, E501
    assert find("gdg-berlin") == ["google-gdg-berlin-presents-a/", "google-x-gdg-berlin-presents-a/"]
    assert find("gdg-berlin-android") == ["google-gdg-berlin-android-presents-b-presents-c/"]
    assert find("b") == ["google-gdg-berlin-android-presents-b-presents-c/"] or find("b") == []
    assert find("gdg-berlin-android-presents-b", "zzz") == ["google-gdg-berlin-android-presents-b-presents-c/"]


# --- calendars -------------------------------------------------------------------------------


def vevent(*lines, uid="u"):
    return "\r\n".join(["BEGIN:VCALENDAR", "BEGIN:VTIMEZONE", "DTSTART:19700101T000000", "END:VTIMEZONE", "BEGIN:VEVENT", f"UID:{uid}", *lines, "END:VEVENT", "END:VCALENDAR", ""])


def test_moved_occurrences_take_the_place_of_others(spark):
    """By wall clock, by UTC, as a whole day; moved out of the window; another UID and another feed stay."""
    weekly = ["DTSTART;TZID=Europe/Berlin:20260302T180000", "DURATION:PT1H", "RRULE:FREQ=WEEKLY;COUNT=4"]
    instead = lambda uid, *lines: "\r\n".join(["BEGIN:VEVENT", f"UID:{uid}", *lines, "END:VEVENT", ""])
    moved = (
        instead("u", "RECURRENCE-ID;TZID=Europe/Berlin:20260309T180000", "DTSTART;TZID=Europe/Berlin:20260310T200000")
        + instead("u", "RECURRENCE-ID:20260316T170000Z", "DTSTART:20200101T000000Z")
        + instead("v", "RECURRENCE-ID;TZID=Europe/Berlin:20260302T180000", "DTSTART:20260304T000000Z")
        + instead("d", "DTSTART;VALUE=DATE:20260401", "RRULE:FREQ=DAILY;COUNT=2")
        + instead("d", "RECURRENCE-ID;VALUE=DATE:20260402", "DTSTART;VALUE=DATE:20260405")
    )
    feed = vevent(*weekly).replace("END:VCALENDAR", moved + "END:VCALENDAR")
    when = datetime(2026, 3, 1, tzinfo=NOW.tzinfo)

    def found(overrides):
        rows, _ = calendar.extract_calendar_events(page(spark, feed), when, overrides=overrides)
        return sorted(f"{r.source_event_id.split('#')[0]} {r.start_utc:%m%d %H%M}" for r in rows.collect())

    assert found(True) == ["d 0401 0000", "d 0405 0000", "u 0302 1700", "u 0310 1900", "u 0323 1700", "v 0304 0000"]
    assert found(False) == sorted([*found(True), "d 0402 0000", "u 0309 1700", "u 0316 1700"])


def starts(spark, *lines, now=NOW):
    rows, errors = calendar.extract_calendar_events(page(spark, vevent(*lines)), now)
    return [f"{r.start_utc:%y%m%d %H%M}" for r in rows.orderBy("start_utc").collect()], [e.error for e in errors.collect()]


BERLIN = "DTSTART;TZID=Europe/Berlin:"
RULES = {
    ("20260324T183000", "FREQ=WEEKLY;BYDAY=TU;COUNT=3"): ["260324 1730", "260331 1630", "260407 1630"],
    ("20260106T100000", "FREQ=WEEKLY;INTERVAL=2;BYDAY=TU,FR;COUNT=4"): ["260106 0900", "260109 0900", "260120 0900", "260123 0900"],
    ("20260105T100000", "FREQ=DAILY;INTERVAL=3;UNTIL=20260111T090000Z"): ["260105 0900", "260108 0900", "260111 0900"],
    ("20260105T100000", "FREQ=DAILY;BYDAY=SA,SU;COUNT=3"): ["260110 0900", "260111 0900", "260117 0900"],
    ("20260113T100000", "FREQ=MONTHLY;BYDAY=2TU;COUNT=3"): ["260113 0900", "260210 0900", "260310 0900"],
    ("20260130T100000", "FREQ=MONTHLY;BYDAY=-1FR;COUNT=2"): ["260130 0900", "260227 0900"],
    ("20260131T100000", "FREQ=MONTHLY;COUNT=3"): ["260131 0900", "260331 0800", "260531 0800"],
    ("20260115T100000", "FREQ=MONTHLY;BYMONTHDAY=15,-1;COUNT=3"): ["260115 0900", "260131 0900", "260215 0900"],
    ("20250301T100000", "FREQ=YEARLY;COUNT=5"): ["260301 0900"],
    ("20260105T100000", "FREQ=WEEKLY;BYMONTH=2;BYDAY=MO;UNTIL=20260210"): ["260202 0900", "260209 0900"],
    ("20251229T100000", "FREQ=WEEKLY;COUNT=2"): ["260105 0900"],
    ("20260105T100000", "FREQ=MONTHLY;BYDAY=MO;BYSETPOS=1;COUNT=3"): ["260105 0900", "260202 0900", "260302 0900"],
    ("20260130T100000", "FREQ=MONTHLY;BYDAY=MO,TU,WE,TH,FR;BYSETPOS=-1;COUNT=3"): ["260130 0900", "260227 0900", "260331 0800"],
    ("20260112T100000", "FREQ=MONTHLY;BYDAY=MO,TH;BYSETPOS=2,-1;COUNT=3"): ["260129 0900", "260205 0900", "260226 0900"],
    ("20260101T100000", "FREQ=YEARLY;BYMONTH=3;BYDAY=-1SU;COUNT=1"): ["260329 0800"],
    ("20260101T100000", "FREQ=YEARLY;BYMONTH=2,6;BYDAY=1MO;COUNT=2"): ["260202 0900", "260601 0800"],
    ("20260101T100000", "FREQ=YEARLY;BYDAY=SA;BYSETPOS=-1;COUNT=1"): ["261226 0900"],
    ("20260101T100000", "FREQ=YEARLY;BYMONTHDAY=15;COUNT=2"): ["260115 0900", "260215 0900"],
}


@pytest.mark.parametrize("case", RULES, ids=lambda c: c[1])
def test_recurrence(spark, case):
    assert starts(spark, BERLIN + case[0], "RRULE:" + case[1]) == (RULES[case], [])


def test_open_rule_stops_after_twelve_months(spark):
    got, _ = starts(spark, BERLIN + "20251201T100000", "RRULE:FREQ=MONTHLY")
    assert got[0] == "260101 0900" and got[-1] == "261201 0900" and len(got) == 12


def test_exclusions_count_and_extra_dates(spark):
    got, _ = starts(spark, BERLIN + "20260105T100000", "RRULE:FREQ=DAILY;COUNT=3", "EXDATE;TZID=Europe/Berlin:20260106T100000", "RDATE;TZID=Europe/Berlin:20260110T100000,20260111T100000")
    assert got == ["260105 0900", "260107 0900", "260110 0900", "260111 0900"]


def test_desktop_zone_names(spark):
    got, _ = starts(spark, "DTSTART;TZID=W. Europe Standard Time:20260105T100000", "RRULE:FREQ=DAILY;COUNT=3", 'EXDATE;TZID="Eastern Standard Time":20260106T040000')
    assert got == ["260105 0900", "260107 0900"]


def test_unsupported_rules_are_reported(spark):
    for rule in ("FREQ=HOURLY", "FREQ=WEEKLY;BYDAY=MO;BYSETPOS=1", "FREQ=YEARLY;BYDAY=1MO", "COUNT=3"):
        got, errors = starts(spark, BERLIN + "20260105T100000", "RRULE:" + rule)
        assert got == [] and len(errors) == 1 and errors[0].startswith("entry u: ")


def test_entry_fields(spark):
    body = vevent(
        "DTSTART:20260301T120000Z", "DURATION:PT1H30M", "SUMMARY;LANGUAGE=de:Treffen\\, heute\\; ja", "DESCRIPTION:eins\\nzwei \\\\n", "  drei",
        "LOCATION:Haus 1", "GEO:48.5;9.25", "URL:https://e.example/x", "BEGIN:VALARM", "DESCRIPTION:wecken", "END:VALARM",
    )
    day = vevent("DTSTART;VALUE=DATE:20260315", "DTEND;VALUE=DATE:20260316", uid="d").replace("\r\n", "\n")
    odd = vevent("DTSTART;TZID=Mars/Base:20260401T100000", uid="m")
    anonymous = vevent("DTSTART:20260301T120000Z").replace("UID:u\r\n", "")
    rows, errors = calendar.extract_calendar_events(page(spark, body, day, odd, anonymous, "<html>", vevent("SUMMARY:no start")), NOW)
    got = {r.source_event_id: r for r in rows.collect()}
    first = got["u#20260301T120000Z"]
    assert (first.title, first.description, first.venue_address, first.lat, first.lon, first.url, first.time_zone_id) == (
        "Treffen, heute; ja", "eins\nzwei \\n drei", "Haus 1", 48.5, 9.25, "https://e.example/x", "UTC",
    )
    assert first.end_utc == datetime(2026, 3, 1, 13, 30)
    whole = got["d#20260315T000000Z"]
    assert (whole.end_utc, whole.time_zone_id, whole.title, whole.url) == (datetime(2026, 3, 16), None, "", "https://h.example/events/details/p1/")
    assert got["m#20260401T100000Z"].time_zone_id == "Mars/Base" and len(got) == 3
    assert [e.error for e in errors.collect()] == ["feed is empty or not a calendar"]


# --- robots and registry -----------------------------------------------------------------------

ROBOTS = {
    "plain": ("User-agent: *\nDisallow: /a\nDisallow:\n", ["/a"], None),
    "union": ("User-agent: *\nDisallow: /a\n\nUser-agent: *\nDisallow: /b # why\nCrawl-delay: 2\n", ["/a", "/b"], 2.0),
    "specific": ("User-agent: *\nDisallow: /a\nUser-Agent: BOT\nDisallow: /c\n", ["/c"], None),
    "group": ("User-agent: bot\nUser-agent: x\nDisallow: /d\nCrawl-delay: nan\nCrawl-delay: 1.5", ["/d"], 1.5),
    "closed": ("User-agent: *\nAllow: /\nUser-agent: x\nDisallow: /e", [], None),
    "before": ("Disallow: /f\nno colon\nUser-agent: *\nDisallow: /g\r\n", ["/g"], None),
    "other": ("User-agent: x\nDisallow: /", None, None),
    "empty": ("", None, None),
}


def test_robots(spark):
    rows = spark.createDataFrame([(h, body) for h, (body, _, _) in ROBOTS.items()], "host string, body string")
    rules = robots.robots_rules(rows, "bot")
    got = {r.host: (r.disallow, r.crawl_delay_s) for r in rules.collect()}
    assert got == {h: (d, c) for h, (_, d, c) in ROBOTS.items() if d is not None}
    asked = spark.createDataFrame([(u,) for u in ("https://PLAIN/a/x?q", "http://plain:80/b", "https://other/z", "https://plain", "https://union/b*")], "url string")
    assert sorted(r.url for r in robots.allowed_urls(asked, rules).collect()) == ["http://plain:80/b", "https://other/z", "https://plain"]


def test_registry(spark, tmp_path):
    entries = [{"id": "a", "type": "ics", "url": "u"}, {"id": "a", "type": "html", "adapter": " "}, {"id": "b", "type": "rss"}, {"id": "c", "type": "html", "adapter": "x", "enabled": False}, {"id": "d", "type": "gdg-sitemap", "slugs": []}]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, entries)))
    sources = registry.read_registry(spark, str(tmp_path / "r.json"))
    assert sorted((v.id, v.rule) for v in registry.registry_violations(sources).collect()) == [
        ("a", "duplicate-id"), ("a", "html-without-adapter"), ("b", "unknown-type"), ("c", "unregistered-adapter"), ("d", "sitemap-without-slugs"),
    ]
    assert registry.enabled_sources(sources).count() == 4 and sources.filter("size(tags) = 0").count() == 5
    with pytest.raises(registry.RegistryError):
        registry.require_valid(sources)
    assert registry.require_valid(sources.filter("type = 'ics'")).count() == 1


# --- fetches, status, feeds ----------------------------------------------------------------------


def test_carry_forward(spark):
    rows = [("s", "u1", 200, None, "new"), ("s", "u2", 304, None, None), ("s", "u3", 304, None, None), ("s", "u4", 404, None, "x"), ("s", "u5", None, "dns", None)]
    landed = spark.createDataFrame([(*r, None, None, NOW) for r in rows], crawl.CRAWL_SCHEMA)
    cached = spark.createDataFrame([("s", "u1", "old"), ("s", "u2", "old")], PAGES)
    got = {r.url: (r.body, r.outcome, r.problem) for r in crawl.carry_forward(landed, cached).collect()}
    assert got["u1"] == ("new", "ok", None) and got["u2"] == ("old", "ok", None)
    assert got["u3"][1:] == ("http-error", "304 fetching u3") and got["u4"] == (None, "http-error", "404 fetching u4")
    assert got["u5"] == (None, "unreachable", "Failed to reach u5: dns")


def test_status_after_failure(spark):
    runs = spark.createDataFrame([("s", datetime(2026, 1, 1), datetime(2026, 1, 1), 5, None), ("s", datetime(2026, 1, 2), None, 0, "down")], health.RUN_SCHEMA)
    latest = health.latest_status(runs).first()
    assert (latest.last_success_utc, latest.event_count, latest.last_error) == (None, 0, "down")
    good = health.last_good_runs(runs).first()
    assert (good.last_good_utc, good.last_good_count) == (datetime(2026, 1, 1), 5)


def test_feed_text(spark):
    row = {"search_id": 1, "position": 1, "dedupe_key": "k", "title": "A, b; c\\d", "description": "ö" * 60 + "\nx", "venue_name": None, "city": "Ulm", "url": "no url", "start_utc": datetime(2026, 1, 2, 3, 4, 5), "end_utc": None}
    schema = "search_id int, position int, dedupe_key string, title string, description string, venue_name string, city string, url string, start_utc timestamp, end_utc timestamp"
    searches = spark.createDataFrame([(1, 48.6483, 9.4, 25.0), (2, 1.0, 2.0, 7.5)], "search_id int, lat double, lon double, radius_km double")
    out = {r.search_id: r.feed for r in feed.render_feeds(spark.createDataFrame([row], schema), searches, NOW, "x.example").collect()}
    assert all(len(line.encode()) <= 75 for text in out.values() for line in text.split("\r\n"))
    plain = out[1].replace("\r\n ", "")
    for line in ("SUMMARY:A\\, b\\; c\\\\d", "DESCRIPTION:" + "ö" * 60 + "\\nx", "LOCATION:Ulm", "DTSTART:20260102T030405Z", "X-WR-CALNAME:Events — 25 km around 48.648\\,9.4"):
        assert line + "\r\n" in plain
    assert "URL:" not in plain and "DTEND" not in plain and "@x.example" in plain
    assert "VEVENT" not in out[2] and "7.5 km around 1\\,2" in out[2] and out[2].endswith("END:VCALENDAR\r\n")


def test_dedupe_key_and_zones(spark):
    rows = spark.createDataFrame(
        [("Café Night", datetime(2026, 7, 1, 21, 30), z, c) for z, c in (("Europe/Berlin", "München"), ("Asia/Tokyo", None), ("Mars/Base", ""), ("", "Ulm"))],
        "t string, s timestamp, z string, c string",
    )
    got = [r.k for r in rows.select(times.dedupe_key("t", "s", "z", "c").alias("k")).collect()]
    assert got == ["cafe night|2026-07-01|muenchen", "cafe night|2026-07-02|", "cafe night|2026-07-01|", "cafe night|2026-07-01|ulm"]


def test_every_known_zone_can_be_read(spark):
    zones = spark.createDataFrame([(z, datetime(2026, 7, 1)) for z in times.known_zones()], "z string, s timestamp")
    assert zones.select(times.local_date("s", "z").alias("d")).filter("d is null").count() == 0


def test_urls(spark):
    rows = spark.createDataFrame([("https://User@Host.example:8080/a/b/?q#f",), ("mailto:x",), ("http://h",)], "u string")
    got = rows.select(urls.url_host("u").alias("h"), urls.url_path("u").alias("p"), urls.path_tail("u").alias("t"), urls.absolute_or_null("u").alias("a")).collect()
    assert tuple(got[0]) == ("host.example", "/a/b/", "b", "https://User@Host.example:8080/a/b/?q#f")
    assert got[1].a == "mailto:x" and tuple(got[2])[:2] == ("h", "/")


def test_excluded_and_extra_dates_have_zones(spark):
    lines = ("DTSTART;TZID=Europe/Berlin:20260105T100000", "RRULE:FREQ=DAILY;COUNT=3", "SUMMARY:z")
    lines += ("EXDATE:20260106T090000Z", "RDATE:20260110T090000Z", "RDATE;TZID=America/New_York:20260111T040000")
    rows, _ = calendar.extract_calendar_events(page(spark, vevent(*lines)), NOW.replace(year=2026, month=1, day=1))
    assert sorted(r.start_utc.strftime("%d %H") for r in rows.collect()) == ["05 09", "07 09", "10 09", "11 09"]


def test_gazetteer_lines_that_cannot_be_read(spark):
    from kreiswerk.sources import gazetteer_files as files

    many = "|".join(f"alias{i}" for i in range(12))
    lines = spark.createDataFrame([(f"A;{many};X;5;50.0;10.0", 0), ("B;;X;many;50;10", 1), ("short;x", 2)], "line string, line_no bigint")
    assert [(r.name, len(r.aliases)) for r in files.parse_places(lines).collect()] == [("A", 12)]
    assert sorted(r.line_no for r in files.unread_places(lines).collect()) == [1, 2]
