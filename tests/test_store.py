"""Upsert rules, the versioned tables, and complete ingestion runs, batch and streaming."""

import json
from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from kreiswerk.operators import dedupe, health, store, tables
from kreiswerk.operators.gazetteer import place_keys, postal_lookup
from kreiswerk.plans import ingest as plan
from kreiswerk.session import write_through
from kreiswerk.sources import crawl
from kreiswerk.sources.events import EVENT_SCHEMA
from kreiswerk.sources.registry import REGISTRY_SCHEMA
from kreiswerk.streaming.ingest_stream import ingest_pass, stream_ingest

T1, T2, T3 = datetime(2026, 1, 1), datetime(2026, 1, 2), datetime(2026, 1, 3)
NO_ERRORS = "source_id string, error string"


def batch(spark, *rows):
    """Rows of source, event id, title and dedupe key, in feed order."""
    fields = [f.split()[0] for f in EVENT_SCHEMA.split(", ")]
    out = []
    for pos, (source, event, title, key) in enumerate(rows):
        row = dict.fromkeys(fields) | {"source_id": source, "source_event_id": event, "title": title, "dedupe_key": key}
        out.append(row | {"id": f"{source}#{event}", "first_seen_utc": T1, "last_seen_utc": T1, "feed_pos": pos})
    return spark.createDataFrame(out, EVENT_SCHEMA + ", feed_pos bigint")


def state(df):
    return {(r.source_id, r.source_event_id): (r.title, r.first_seen_utc, r.last_seen_utc) for r in df.collect()}


def test_upsert_rules(spark):
    first = store.upsert(spark.createDataFrame([], EVENT_SCHEMA), batch(spark, ("a", "1", "one", "k1"), ("a", "2", "two", "k2"), ("a", "3", "copy", "k2"), ("a", "1", "clash", "k9")), T1)
    assert state(first) == {("a", "1"): ("one", T1, T1), ("a", "2"): ("two", T1, T1)}
    second = store.upsert(first, batch(spark, ("a", "1", "new", "k1"), ("b", "1", "other", "k1")), T2)
    assert state(second) == {("a", "1"): ("new", T1, T2), ("a", "2"): ("two", T1, T1), ("b", "1"): ("other", T2, T2)}
    again = store.upsert(second, batch(spark, ("a", "1", "new", "k1"), ("b", "1", "other", "k1")), T2)
    assert state(again) == state(second)


def test_collisions_and_merge(spark):
    rows = batch(spark, ("a", "1", "x", "k1"), ("a", "1", "y", "k2"), ("a", "2", "z", "k1"), ("b", "9", "w", "k1"))
    assert [tuple(r) for r in dedupe.id_collisions(rows).collect()] == [("a", "1", 1)]
    cards, links = dedupe.merge_duplicates(rows.withColumn("url", F.concat("source_id", "source_event_id")))
    got = {r.dedupe_key: (r.title, r.source_count, r.url_count) for r in cards.collect()}
    assert got == {"k1": ("x", 2, 3), "k2": ("y", 1, 1)} and links.count() == 4


def test_store_versions_and_failed_source(spark, tmp_path):
    target = store.EventStore(spark, str(tmp_path), buckets=4)
    assert target.events.version() == 0 and target.events.read().count() == 0
    none = spark.createDataFrame([], NO_ERRORS)
    target.upsert_events(write_through(batch(spark, ("a", "1", "one", "k"), ("b", "1", "bee", "k")), "b"), none, T1)
    failed = spark.createDataFrame([("a", "down")], NO_ERRORS)
    version = target.upsert_events(write_through(batch(spark, ("a", "1", "lost", "k"), ("b", "1", "bees", "k")), "b"), failed, T2)
    assert version == 2 == target.events.version()
    assert state(target.events.read()) == {("a", "1"): ("one", T1, T1), ("b", "1"): ("bees", T1, T2)}
    untouched = store.EventStore(spark, str(tmp_path), buckets=4).events
    assert len({r.data for r in untouched._manifest(untouched.version())}) <= 2


def test_empty_merge_and_a_version_that_exists(spark, tmp_path):
    table = tables.BucketTable(spark, str(tmp_path), "k string, v int", ["k"], buckets=2)
    rows = write_through(spark.createDataFrame([("a", 1)], "k string, v int"), "t")
    assert table.merge(rows.limit(0), lambda old, new: new) == 0 == table.version() and table.read().count() == 0
    assert table.merge(rows, lambda old, new: new) == 1
    assert table.merge(rows.limit(0), lambda old, new: new) == 1 == table.version()
    assert table.read().collect() == [("a", 1)]
    left = tmp_path / "manifest" / "v=2" / "_temporary"  # of a driver that was killed
    left.mkdir(parents=True)
    assert table.version() == 1 and table.merge(rows, lambda old, new: new) == 2

    def meddle(old, new):
        frame = spark.createDataFrame([(0, "none")], tables._MANIFEST).coalesce(1)
        frame.write.json(f"{table.path}/manifest/v=3")
        return new

    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        table.merge(rows, meddle)


def test_search_table_layout(spark, tmp_path):
    rows = batch(spark, ("a", "1", "Größe", "k1"), ("a", "2", "x", "k2")).withColumns({"lat": F.lit(48.0), "lon": F.lit(9.0)})
    store.write_search_table(rows, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.filter(F.col("search_text").contains("groesse")).count() == 1
    plan_text = back.filter("lat between 47 and 49")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lat), GreaterThanOrEqual(lat,47.0), LessThanOrEqual(lat,49.0)]" in plan_text


# --- ingestion -------------------------------------------------------------------------------


def state_page(title, start, venue="Town 1"):
    entities = {"Event:1": {"title": title, "dateTime": start, "eventType": "PHYSICAL", "venue": {"__ref": "Venue:1"}}, "Venue:1": {"city": venue}}
    script = json.dumps({"props": {"pageProps": {"__APOLLO_STATE__": entities}}})
    return f'<script id="__NEXT_DATA__" type="application/json">{script}</script>'


CALENDAR = "BEGIN:VCALENDAR\nBEGIN:VEVENT\nUID:c\nDTSTART:20260301T100000Z\nSUMMARY:Rust Treff\nLOCATION:Weg 1, 73230 Ort\nEND:VEVENT\nEND:VCALENDAR\n"
LD = '<script type="application/ld+json">{"name":"Talk","startDate":"2026-03-02T18:00:00+01:00","location":{"address":{"addressLocality":"Town 1"}}}</script>'
INDEX = "<sitemapindex><sitemap><loc>https://m.example/sitemap-events-2026-03.xml</loc></sitemap><sitemap><loc>https://m.example/sitemap-events-2020-03.xml</loc></sitemap></sitemapindex>"
MONTH = "<urlset>" + "".join(f"<url><loc>https://m.example/events/details/google-{n}/</loc></url>" for n in ("gdg-x-presents-a", "gdg-y-presents-b", "gdg-x-presents-no")) + "</urlset>"


@pytest.fixture
def inputs(spark):
    sources = [
        ("page", "P", "html", "https://p.example/g", "meetup-group", None, ["local"], [], True),
        ("cal", "C", "ics", "https://c.example/f.ics", None, None, [], [], True),
        ("map", "M", "gdg-sitemap", "https://m.example/sitemap.xml", None, None, [], ["gdg-x"], True),
        ("off", "O", "html", "https://o.example/", "meetup-group", None, [], [], False),
        ("odd", "D", "html", "https://d.example/", "unknown", None, [], [], True),
        ("shut", "S", "html", "https://s.example/private", "meetup-group", None, [], [], True),
    ]
    registry = spark.createDataFrame(sources, REGISTRY_SCHEMA)
    rules = spark.createDataFrame([("s.example", ["/private"]), ("m.example", ["/events/details/google-gdg-x-presents-no"])], "host string, disallow array<string>")
    places = spark.createDataFrame([("Town 1", [], "A", 5, 50.0, 10.0, 0)], "name string, aliases array<string>, admin1 string, population bigint, lat double, lon double, line_no bigint")
    postal = spark.createDataFrame([("73230", "Ort", "A", 48.6, 9.4, 0)], "plz string, name string, admin1 string, lat double, lon double, line_no bigint")
    return registry, rules, place_keys(places), postal_lookup(postal)


def landed(spark, when, **bodies):
    where = {"page": "https://p.example/g", "cal": "https://c.example/f.ics", "odd": "https://d.example/", "off": "https://o.example/", "shut": "https://s.example/private"}
    rows = []
    for source, body in bodies.items():
        status, text = (200, body) if isinstance(body, str) else (body, None)
        rows.append((source, where[source], status, None, text, None, None, when))
    for url, body in {"sitemap.xml": INDEX, "sitemap-events-2026-03.xml": MONTH, "sitemap-events-2020-03.xml": "<broken", "events/details/google-gdg-x-presents-a/": LD, "events/details/google-gdg-x-presents-no/": LD}.items():
        rows.append(("map", f"https://m.example/{url}", 200, None, body, None, None, when))
    return spark.createDataFrame(rows, crawl.CRAWL_SCHEMA)


def test_ingest_run(spark, tmp_path, inputs):
    registry, rules, keys, postal = inputs
    target = store.EventStore(spark, str(tmp_path), buckets=8)
    good = state_page("Join us for: Java  Night", "2026-02-01T18:00:00+01:00")
    run = lambda rows, now, **k: plan.ingest(target, registry, rows, rules, keys, postal, now, **k)
    answer = json.dumps({"features": [{"geometry": {"coordinates": [9.5, 48.5]}, "properties": {"street": "Weg", "housenumber": "1"}}]})
    geocoder = lambda queries: queries.select("query", F.lit(200).alias("http_status"), F.lit(answer).alias("body"))

    runs = {r.source_id: (r.event_count, r.error) for r in run(landed(spark, T1, page=good, cal=CALENDAR, odd="x", off=good, shut=good), T1, geocoder=geocoder).collect()}
    assert set(runs) == {"page", "cal", "map", "odd", "shut"}
    assert runs["page"] == (1, None) and runs["cal"] == (1, None) and runs["map"] == (1, None)
    assert runs["odd"] == (0, "Pages of adapter 'unknown' have no parser.")
    assert runs["shut"] == (0, "robots.txt disallows fetching https://s.example/private")
    events = {r.source_id: r for r in target.events.read().collect()}
    page = events["page"]
    assert (page.title, page.city, page.lat, page.location_precision, page.attendance, page.tags) == ("Java Night", "Town 1", 50.0, "City", "InPerson", ["java", "local"])
    assert page.dedupe_key == "java night|2026-02-01|town 1" and page.time_zone_id == "UTC"
    assert (events["cal"].lat, events["cal"].location_precision, events["cal"].tags) == (48.5, "Address", ["systems"])
    assert events["map"].source_event_id == "google-gdg-x-presents-a" and events["map"].attendance == "InPerson"

    # The page did not change, the calendar fails, the sitemap pages are as before.
    runs = {r.source_id: (r.event_count, r.error) for r in run(landed(spark, T2, page=304, cal=500), T2).collect()}
    assert runs["page"] == (1, None) and runs["cal"] == (0, "500 fetching https://c.example/f.ics")
    seen = {r.source_id: (r.first_seen_utc, r.last_seen_utc) for r in target.events.read().collect()}
    assert seen == {"page": (T1, T2), "cal": (T1, T1), "map": (T1, T2)}
    status = {r.source_id: r for r in health.latest_status(target.runs.read()).collect()}
    assert status["cal"].last_success_utc is None and status["page"].last_success_utc == T2
    assert target.geocode_cache().count() == 2  # "Weg 1" and "Town 1" hold a digit


def test_stream_ingest(spark, tmp_path, inputs):
    registry, rules, keys, postal = inputs
    target = store.EventStore(spark, str(tmp_path / "store"), buckets=4)
    go = lambda: stream_ingest(spark, str(tmp_path / "in"), str(tmp_path / "cp"), ingest_pass(target, registry, rules, keys, postal)).awaitTermination()
    landed(spark, T1, page=state_page("A", "2026-02-01T18:00:00Z"), cal=CALENDAR).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    assert target.events.read().count() == 3
    landed(spark, T3, page=state_page("B", "2026-02-01T18:00:00Z")).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    titles = {r.source_id: (r.title, r.last_seen_utc) for r in target.events.read().collect()}
    assert titles["page"] == ("B", T3) and titles["cal"] == ("Rust Treff", T1)
    go()
    assert target.events.version() == 2


def test_pass_does_not_depend_on_the_cut(spark, tmp_path, inputs):
    """Index, month and event page of one sitemap: together, and each in a pass of its own."""
    registry, rules, keys, postal = inputs
    rows = landed(spark, T1).filter("source_id = 'map'").collect()
    rows = [r for r in rows if "2020" not in r.url and "presents-no" not in r.url]
    assert len(rows) == 3
    found = []
    for name, cut in (("one", [rows]), ("three", [[r] for r in rows])):
        target = store.EventStore(spark, str(tmp_path / name), buckets=2)
        for part in cut:
            plan.ingest(target, registry, spark.createDataFrame(part, crawl.CRAWL_SCHEMA), rules, keys, postal, T1)
        found.append(sorted(r.source_event_id for r in target.events.read().collect()))
    assert found[0] == found[1] == ["google-gdg-x-presents-a"]


def test_unchanged_after_good_in_one_batch(spark, tmp_path, inputs):
    registry, rules, keys, postal = inputs
    target = store.EventStore(spark, str(tmp_path), buckets=2)
    page = state_page("A", "2026-02-01T18:00:00+01:00")
    both = landed(spark, T1, page=page).unionByName(landed(spark, T2, page=304)).filter("source_id = 'page'")
    runs = plan.ingest(target, registry, both, rules, keys, postal, T2).filter("source_id = 'page'")
    assert [(r.event_count, r.error) for r in runs.collect()] == [(1, None)]
    again = plan.ingest(target, registry, landed(spark, T3, page=304).filter("source_id = 'page'"), rules, keys, postal, T3)
    assert [(r.event_count, r.error) for r in again.filter("source_id = 'page'").collect()] == [(1, None)]


def test_odd_entry_and_failing_geocoder(spark, tmp_path, inputs):
    registry, rules, keys, postal = inputs
    target = store.EventStore(spark, str(tmp_path), buckets=2)
    odd = "BEGIN:VEVENT\nUID:o\nDTSTART:20260301T100000Z\nRRULE:FREQ=HOURLY\nSUMMARY:x\nEND:VEVENT\nEND:VCALENDAR"
    crawl_rows = landed(spark, T1, cal=CALENDAR.replace("END:VCALENDAR", odd)).filter("source_id = 'cal'")

    def broken(queries):
        raise RuntimeError("down")

    with pytest.warns(UserWarning, match="geocoder failed"):
        runs = plan.ingest(target, registry, crawl_rows, rules, keys, postal, T1, geocoder=broken)
    assert [(r.event_count, r.error) for r in runs.filter("source_id = 'cal'").collect()] == [(1, None)]
    assert [(r.source_event_id[:1], r.location_precision) for r in target.events.read().collect()] == [("c", "City")]


@pytest.fixture
def light(inputs, monkeypatch):
    """One page source and a plain normalisation: what is under test are the writes of a pass."""

    def plainly(raw, *_):
        extra = {f: F.lit(None) for f in ("location_status", "location_precision", "attendance", "tags")}
        extra |= {"id": F.concat("source_id", "source_event_id"), "dedupe_key": F.col("title")}
        rows = raw.withColumns({**extra, "first_seen_utc": F.lit(T1), "last_seen_utc": F.lit(T1)})
        return rows.select(*[F.col(f.split()[0]).cast(f.split()[1]).alias(f.split()[0]) for f in EVENT_SCHEMA.split(", ")], "feed_pos")

    monkeypatch.setattr(plan, "normalize_events", plainly)
    registry, *rest = inputs
    return registry.filter("id = 'page'"), *rest


def page_of(spark, when, body):
    return landed(spark, when, page=body).filter("source_id = 'page'")


def contents(target):
    events = {(r.id, r.title, r.first_seen_utc, r.last_seen_utc) for r in target.events.read().collect()}
    logged = sorted(map(repr, target.runs.read().collect()))
    return events, logged, target.events.version(), target.geocodes.read().count(), sorted(map(repr, target.parsed.read().drop("rows").collect()))


def test_pass_repeated_after_each_write(spark, tmp_path, light, monkeypatch):
    """A pass that dies right after each write in turn and is repeated leaves what one whole pass leaves."""
    registry, rules, keys, postal = light
    geocoder = lambda queries: queries.select(F.lit("q").alias("query"), F.lit(200).alias("http_status"), F.lit('{"features":[]}').alias("body"))
    first = page_of(spark, T1, state_page("A", "2026-02-01T18:00:00Z"))
    second = page_of(spark, T2, state_page("B", "2026-02-03T18:00:00Z"))
    adapters = {"html": plan.page_adapter()}
    run = lambda target, rows, now, name: plan.ingest(target, registry, rows, rules, keys, postal, now, geocoder=geocoder, adapters=adapters, pass_id=name)
    whole = store.EventStore(spark, str(tmp_path / "whole"), buckets=2)
    run(whole, first, T1, "s-0"), run(whole, second, T2, "s-1")
    target = store.EventStore(spark, str(tmp_path / "cut"), buckets=2)
    run(target, first, T1, "s-0")
    for table, method, after in (("geocodes", "append", True), ("events", "merge", True), ("parsed", "merge", True), ("fetches", "merge", True), ("runs", "append", False)):
        real = getattr(getattr(target, table), method)

        def dies(*args, real=real, after=after):
            if after:
                real(*args)
            raise RuntimeError("killed")

        with monkeypatch.context() as patched:
            patched.setattr(getattr(target, table), method, dies)
            if table == "geocodes":  # a geocoder's failure alone would only warn
                patched.setattr(getattr(target, table), method, real)
                patched.setattr(target, "upsert_events", lambda *args: dies(after=False))
            with pytest.raises(RuntimeError, match="killed"):
                run(target, second, T2, "s-1")
    run(target, second, T2, "s-1")
    got = contents(target)
    assert got == contents(whole) and got[2] == 2
    again = run(target, second, T2, "s-1")
    assert [r.run_utc for r in again.collect()] == [T2] and contents(target) == got


def test_stream_repeats_a_killed_batch(spark, tmp_path, light):
    registry, rules, keys, postal = light
    target = store.EventStore(spark, str(tmp_path / "store"), buckets=2)
    whole = ingest_pass(target, registry, rules, keys, postal, adapters={"html": plan.page_adapter()})
    page_of(spark, T1, state_page("A", "2026-02-01T18:00:00Z")).write.parquet(str(tmp_path / "in"))

    def killed(*args):
        whole(*args)
        raise RuntimeError("killed")

    for run in (killed, whole):
        stream = stream_ingest(spark, str(tmp_path / "in"), str(tmp_path / "cp"), run)
        try:
            stream.awaitTermination()
        except Exception as failure:  # noqa: BLE001
            assert run is killed and "killed" in str(failure)
    assert target.events.version() == 1 and target.runs.read().count() == 1


def test_pass_parses_unseen_pages_only(spark, tmp_path, light):
    registry, rules, keys, postal = light
    target = store.EventStore(spark, str(tmp_path), buckets=2)
    seen = []

    def counting(pages):
        seen.append(pages.count())
        return plan.PAGE_PARSERS["meetup-group"](pages)

    adapters = {"html": plan.page_adapter({"meetup-group": counting})}
    run = lambda when, body: plan.ingest(target, registry, page_of(spark, when, body), rules, keys, postal, when, adapters=adapters).first()
    page, broken = state_page("A", "2026-02-01T18:00:00Z"), "<html>moved</html>"
    assert run(T1, page).event_count == run(T2, page).event_count == run(T3, 304).event_count == 1
    assert seen == [1, 0, 0] and target.events.read().first().last_seen_utc == T3
    late, far = datetime(2026, 2, 10), datetime(2026, 6, 10)
    assert run(late, page).event_count == 0 and seen[-1] == 0  # ended, though known
    assert target.events.read().first().last_seen_utc == T3
    assert [run(late, broken).error for _ in "ab"] == ["no __NEXT_DATA__ script found"] * 2 and seen[-2:] == [1, 0]
    run(far, state_page("C", "2026-07-01T18:00:00Z"))
    assert target.parsed.read().count() == 1  # what no pass met for long is gone


def test_unchanged_pages_meet_the_newer_of_store_and_batch(spark):
    row = lambda url, status, body, day: ("s", url, status, None, body, None, None, datetime(2026, 1, day))
    rows = [row("a", 200, "a-batch", 5), row("a", 304, None, 6), row("b", 200, "b-batch", 5), row("b", 304, None, 6), row("c", 304, None, 6), row("d", 200, "d-batch", 5)]
    batch = spark.createDataFrame(rows, crawl.CRAWL_SCHEMA)
    stored = spark.createDataFrame([row("a", 200, "a-store", 1), row("b", 200, "b-store", 7), row("c", 200, "c-store", 1)], crawl.CRAWL_SCHEMA)
    known = {r.url: r.body for r in crawl.known_good(batch, stored).collect()}
    assert known == {"a": "a-batch", "b": "b-store", "c": "c-store"}  # d is called unchanged by no one: it is no cached body


def test_state_pages_are_parsed_once(spark, tmp_path, light, monkeypatch):
    """Pages go through the parser's form of one row per page, known and new ones in one step."""
    registry, rules, keys, postal = light
    seen, whole = [], plan.extract_state_events.page_rows

    def counting(pages):
        seen.append(pages.filter("body is not null").count())
        return whole(pages)

    monkeypatch.setattr(plan.extract_state_events, "page_rows", counting)
    target = store.EventStore(spark, str(tmp_path), buckets=2)
    run = lambda when, body: plan.ingest(target, registry, page_of(spark, when, body), rules, keys, postal, when, adapters={"html": plan.page_adapter()}).first()
    page = state_page("A", "2026-02-01T18:00:00Z")
    assert [run(T1, page).event_count, run(T2, 304).event_count, run(T3, page).event_count] == [1, 1, 1]
    assert seen == [1, 0, 0] and target.parsed.read().count() == 1
