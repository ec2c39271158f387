"""Gazetteer lookups, the geo cascade, the build, and the geocoder."""

import json

import pytest
from pyspark.sql import functions as F

from kreiswerk.operators import gazetteer
from kreiswerk.operators.resolve import resolve_locations
from kreiswerk.sources import gazetteer_files as files
from kreiswerk.sources import geocode
from kreiswerk.sources.events import RAW_SCHEMA

PLACES = [
    ("München", ["Munich", "MUC"], "BY", 1_500_000, 48.137, 11.575),
    ("Kirchheim unter Teck", ["Kirchheim"], "BW", 40_000, 48.648, 9.451),
    ("Kirchheim", [], "TH", 1_000, 50.9, 11.0),
    ("Neustadt", [], "A", 500, 1.0, 1.0),
    ("Neustadt", [], "B", 900, 2.0, 2.0),
    ("Neustadt", [], "C", 900, 3.0, 3.0),
    ("Baden-Baden", [], "BW", 50_000, 48.76, 8.24),
    ("Berlin", ["BER"], "BE", 3_600_000, 52.52, 13.405),
    ("Ulm", [], "BW", 120_000, 48.4, 9.98),
]


@pytest.fixture(scope="module")
def lookups(spark):
    places = spark.createDataFrame([(*p, i) for i, p in enumerate(PLACES)], "name string, aliases array<string>, admin1 string, population bigint, lat double, lon double, line_no bigint")
    postal = spark.createDataFrame(
        [("73230", "Kirchheim unter Teck", "BW", 48.65, 9.45, 0), ("73230", "Firma", "BW", 0.0, 0.0, 1), ("80331", "München", "BY", 48.13, 11.57, 2)],
        "plz string, name string, admin1 string, lat double, lon double, line_no bigint",
    )
    return places, gazetteer.place_keys(places), gazetteer.postal_lookup(postal)


def raw(spark, **values):
    row = {field.split()[0]: None for field in RAW_SCHEMA.split(", ")} | {"source_id": "s", "source_event_id": "e", "feed_pos": 0} | values
    return spark.createDataFrame([row], RAW_SCHEMA)


def resolved(spark, lookups, cache=None, **values):
    r = resolve_locations(raw(spark, **values), lookups[1], lookups[2], cache).first()
    return r.matched_place, r.location_status, r.location_precision, r.lat


def test_keys(spark, lookups):
    keys = {r.phrase: (r.matched_place, r.lat) for r in lookups[1].collect()}
    assert keys["munich"] == ("München", 48.137) and "muc" not in keys and "ber" not in keys and "ulm" in keys
    assert keys["kirchheim"][0] == "Kirchheim unter Teck"  # larger population wins over the plain name
    assert keys["neustadt"][1] == 2.0  # tie: first line
    assert gazetteer.longest_key_words(lookups[1]).first()[0] == 3


def test_cascade(spark, lookups):
    go = lambda **k: resolved(spark, lookups, **k)
    assert go(lat=1.5, lon=2.5, city="Raw", postal_code="73230") == ("Raw", "Resolved", "Address", 1.5)
    assert go(postal_code="D-73230") == ("Kirchheim unter Teck", "Resolved", "City", 48.65)
    assert go(venue_address="Weg 1, 80331 M") == ("München", "Resolved", "City", 48.13)
    assert go(postal_code="99999", venue_address="Weg 1, 80331 X") == (None, "Unresolved", "None", None)
    assert go(postal_code="99999", city="ULM") == ("Ulm", "Resolved", "City", 48.4)
    assert go(city="Treffen in Kirchheim unter Teck")[0] == "Kirchheim unter Teck"
    assert go(city="Muenchen oder Berlin")[0] == "München"  # same length: leftmost
    assert go(city="nirgends", venue_address="Rathaus Ulm")[0] == "Ulm"
    assert go(city="Ulm", venue_address="Berlin")[0] == "Ulm"  # city before address
    assert go(city="Baden-Baden")[1] == "Unresolved"  # keys keep their hyphen, phrases do not
    assert go(city="Berliner Allee", venue_address=None)[1] == "Unresolved"  # whole tokens only
    assert go()[1] == "Unresolved"


def test_hyphen_option(spark, lookups):
    keys = gazetteer.place_keys(lookups[0], token_keys=True)
    assert resolve_locations(raw(spark, city="Baden-Baden"), keys, lookups[2]).first().matched_place == "Baden-Baden"


def test_geocode_cache_in_cascade(spark, lookups):
    entries = [("weg 1, 80331 ulm, deutschland", True, 50.0, 9.0, "Street"), ("weg 2, ulm, deutschland", False, None, None, "None")]
    cache = spark.createDataFrame(entries, "query string, found boolean, lat double, lon double, precision string")
    go = lambda **k: resolved(spark, lookups, cache, **k)
    assert go(venue_address="Weg 1", postal_code="80331", city="Ulm") == ("Ulm", "Resolved", "Street", 50.0)
    assert go(venue_address="Weg 2", city="Ulm") == ("Ulm", "Resolved", "City", 48.4)  # negative entry: gazetteer
    assert go(venue_address="Weg 1", postal_code="80331", city="Ulm", attendance_hint="Online")[2] == "City"
    assert go(lat=1.0, lon=1.0, venue_address="Weg 1", postal_code="80331", city="Ulm")[2] == "Address"


def test_large_gazetteer_path_gives_the_same(spark, lookups, monkeypatch):
    from kreiswerk.operators import joins

    monkeypatch.setattr(joins, "fits_broadcast", lambda df: False)
    monkeypatch.setattr(joins, "ROWS_PER_TASK", 2)
    rows = raw(spark, city="Ulm").unionByName(raw(spark, city="Kirchheim unter Teck", source_event_id="f")).unionByName(raw(spark, postal_code="80331", source_event_id="g"))
    got = resolve_locations(rows, lookups[1], lookups[2]).orderBy("source_event_id").collect()
    assert [r.matched_place for r in got] == ["Ulm", "Kirchheim unter Teck", "München"]


def test_place_search(spark, lookups):
    names = lambda q, n=None: [r.name for r in gazetteer.search_places(lookups[0], q, n).collect()]
    assert names("MÜN") == ["München"] and names("muc") == [] and names(" ") == [] and names(None) == []
    assert names("e", 0) == ["Berlin"] and len(names("e", 99)) == 8 and names("kirchheim")[0] == "Kirchheim unter Teck"


def test_files(spark, tmp_path):
    (tmp_path / "places.csv").write_text(files.PLACES_HEADER + "\nA;x|y||z;BW;5;1.5;2.5\n\nshort;a;b\nB;;BY;7;1;2\n")
    places = files.parse_places(files.read_lines(spark, str(tmp_path / "places.csv"))).orderBy("line_no").collect()
    assert [(p.name, p.aliases, p.population, p.lat) for p in places] == [("A", ["x", "y", "z"], 5, 1.5), ("B", [], 7, 1.0)]
    (tmp_path / "postal.csv").write_text(files.POSTAL_HEADER + '\n1;"A";BW;1;2\n1;B;BW;3;4\n2;C;BW;5\n')
    postal = gazetteer.postal_lookup(files.parse_postal(files.read_lines(spark, str(tmp_path / "postal.csv")))).collect()
    assert [(p.plz, p.matched_place) for p in postal] == [("1", '"A"')]
    files.write_gazetteer(
        files.parse_places(files.read_lines(spark, str(tmp_path / "places.csv"))),
        files.parse_postal(files.read_lines(spark, str(tmp_path / "postal.csv"))),
        str(tmp_path / "out-places"), str(tmp_path / "out-postal"),
    )
    back = files.parse_places(files.read_lines(spark, str(tmp_path / "out-places")))
    assert sorted(r.name for r in back.collect()) == ["A", "B"]


def test_build(spark):
    line = lambda *f: "\t".join(map(str, f))
    dump = [line(1, "Munich", "Munich", "Monaco,Muenchen,Münchem,MUC", 48.1, 11.5, "P", "", "", "", "02", "", "", "", 1500), line(2, "River", "", "", 1, 1, "H", "", "", "", "02", "", "", "", 1), line(3, "Ulm", "Ulm", "Ulma", 48, 9, "P", "", "", "", "99", "", "", "", "")]
    alternates = [line(9, 1, "de", "Minga", ""), line(9, 1, "de", "München", "1"), line(9, 1, "en", "Munich", ""), line(9, 1, "de", "Landeshauptstadt München", "1"), line(9, 1, "de", "", "")]
    lines = lambda rows: spark.createDataFrame([(r, i) for i, r in enumerate(rows)], "line string, line_no bigint")
    places = gazetteer.build_places(files.parse_geonames(lines(dump)), files.parse_alternate_names(lines(alternates)))
    got = {r.name: (r.aliases, r.admin1, r.population) for r in places.collect()}
    assert got == {
        "Landeshauptstadt München": (["München", "Minga", "Munich"], "BY", 1500),
        "Ulm": (["Ulma"], "", 0),
    }


HOUSE = {"geometry": {"coordinates": [9.17, 48.77]}, "properties": {"street": "S", "housenumber": "10", "city": "Stuttgart"}}


@pytest.mark.parametrize(
    ("status", "features", "expected"),
    [
        (200, [HOUSE], ("Address", True)),
        (200, [HOUSE | {"properties": {"street": "S"}}], ("Street", True)),
        (200, [HOUSE | {"properties": {"city": "Stuttgart"}}], ("None", False)),
        (200, [HOUSE | {"geometry": {"coordinates": [2.35, 48.85]}}], ("None", False)),
        (200, [], ("None", False)),
        (500, [HOUSE], ("None", False)),
        (None, [HOUSE], None),
    ],
)
def test_geocode_answers(spark, status, features, expected):
    rows = spark.createDataFrame([("q", status, json.dumps({"features": features}))], "query string, http_status int, body string")
    got = [(r.precision, r.found) for r in geocode.read_answers(rows).collect()]
    assert got == ([] if expected is None else [expected])


def test_pending_geocodes_and_cache(spark):
    rows = raw(spark, venue_address="Weg 1", city="Ulm")
    for i in range(2, 6):
        rows = rows.unionByName(raw(spark, venue_address=f"Weg {i}", city="Ulm", source_event_id=str(i)))
    rows = rows.unionByName(raw(spark, venue_address="Rathaus", city="Ulm")).unionByName(raw(spark, venue_address="Weg 9", attendance_hint="Online"))
    cache = spark.createDataFrame([("weg 1, ulm, deutschland", False, None, None, "None", None)], geocode.CACHE_SCHEMA)
    pending = geocode.pending_geocodes(rows, cache, cap=3).collect()
    assert [p.query for p in pending] == [f"weg {i}, ulm, deutschland" for i in (2, 3, 4)]
    answers = spark.createDataFrame([("weg 1, ulm, deutschland", 200, json.dumps({"features": [HOUSE]}))], "query string, http_status int, body string")
    entry = geocode.apply_answers(cache, answers, "2026-01-01").first()
    assert entry.found and entry.precision == "Address" and entry.lat == 48.77


def test_limits_of_lists_accept_none(spark):
    from kreiswerk.operators import discover

    line = lambda *f: "\t".join(map(str, f))
    listed = ",".join(f"Ulm {c}{c}" for c in "abcdefgh")
    lines = lambda rows: spark.createDataFrame([(r, i) for i, r in enumerate(rows)], "line string, line_no bigint")
    dump = lines([line(3, "Ulm", "Ulm", listed, 48, 9, "P", "", "", "", "02", "", "", "", 5)])
    german = files.parse_alternate_names(lines([line(9, 3, "de", "Ulm", "1")]))
    sizes = [len(gazetteer.build_places(files.parse_geonames(dump), german, **m).first().aliases) for m in ({}, {"max_aliases": None})]
    assert sizes == [5, 8]
    state = {"Group:1": {"link": "https://www.meetup.com/g/", "name": "G", "city": "Ulm"}}
    state |= {f"Event:{i}": {"title": "t" * 90, "dateTime": "2025-01-01T10:00"} for i in range(5)}
    script = json.dumps({"props": {"pageProps": {"__APOLLO_STATE__": state}}})
    body = f'<script id="__NEXT_DATA__" type="application/json">{script}</script>'
    pages = spark.createDataFrame([(i, f"r{i}", body) for i in range(5)], "page_no bigint, route string, body string")
    cities = spark.createDataFrame([], "page_no bigint, city string, body string")
    landed = spark.createDataFrame([("g", body)], "slug string, body string")
    for kept, n, width in (({}, 3, 70), ({"titles_kept": None, "title_width": None}, 5, 90)):
        found = discover.harvest_groups(pages, cities, **({"routes_kept": None} if kept else {}))
        row = discover.group_report(found, landed, "2024-01-01", **kept).first()
        assert (len(row.routes), [len(t) for t in row.titles]) == (n, [width] * n)


def test_discovery_parses_pages_once_and_only_those_of_candidates(spark):
    from kreiswerk.operators import discover

    state = {"Group:1": {"link": "https://www.meetup.com/g/", "name": "G", "city": "Ulm"}}
    script = json.dumps({"props": {"pageProps": {"__APOLLO_STATE__": state}}})
    body = f'<script id="__NEXT_DATA__" type="application/json">{script}</script>'
    pages = spark.createDataFrame([(2 - i, f"r{i}", body.replace("Ulm", f"Ulm{i}")) for i in (0, 1, 1)], "page_no bigint, route string, body string")
    cities = spark.createDataFrame([], "page_no bigint, city string, body string")
    found = discover.harvest_groups(pages, cities)
    assert [tuple(r) for r in found.collect()] == [("g", "G", "Ulm1", ["r0", "r1"])]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan(found)
    landed = spark.createDataFrame([("g", body), ("other", body), (None, body)], "slug string, body string")
    report = discover.group_report(found, landed, "2024-01-01")
    assert [(r.slug, r.upcoming) for r in report.collect()] == [("g", 0)]
    lines = plan(report).splitlines()
    parse, semi = (next(i for i, line in enumerate(lines) if word in line) for word in ("from_json", "LeftSemi"))
    assert parse < semi
