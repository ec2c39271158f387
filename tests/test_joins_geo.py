"""Balanced joins, distances, radius search and the many-centre join."""

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kreiswerk.functions import geo
from kreiswerk.operators import joins, radius_join, saved_pages, search
from kreiswerk.session import write_through

EVENT = "id string, source_id string, source_event_id string, title string, description string, venue_name string, city string, lat double, lon double, start_utc timestamp, location_status string, attendance string, tags array<string>"


def distance(lat1, lon1, lat2, lon2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2
    a += math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0088 * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def events(spark, points, **fixed):
    rows = []
    for i, (lat, lon) in enumerate(points):
        row = {"title": f"Talk {i}", "description": None, "venue_name": None, "city": None, "attendance": "InPerson", "tags": ["a"]}
        row |= {"lat": lat, "lon": lon, "start_utc": datetime(2026, 1, 1 + i % 28), "location_status": "Resolved"} | fixed
        rows.append(row | {"id": f"{i:05d}", "source_id": "s", "source_event_id": str(i)})
    return spark.createDataFrame(rows, EVENT)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_join(spark, how):
    """A third of the rows on one key, another third on null; pieces of three rows."""
    rows = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 40)).alias("k"))
    lookup = spark.createDataFrame([("hot", 1), ("k1", 2), ("k4", 3), (None, 4)], "k string, v int")
    plain = rows.join(lookup, ["k"], how)
    salted = joins.salted_join(rows, lookup, ["k"], how, ["id"], rows_per_task=3)
    assert sorted(map(repr, salted.select(plain.columns).collect())) == sorted(map(repr, plain.collect()))


def test_hot_rows_are_spread(spark):
    rows = spark.range(1000).select("id", F.lit("hot").alias("k"))
    hot = joins.hot_keys(rows, ["k"], rows_per_task=100).collect()
    assert [r._pieces for r in hot] == [10]


def test_every_hot_key_is_cut(spark):
    rows = spark.range(6000).select("id", (F.col("id") % 1500).alias("k"))
    assert joins.hot_keys(rows, ["k"], rows_per_task=2).filter("_pieces = 2").count() == 1500


@pytest.mark.parametrize("bounded", [False, True])
def test_balanced_join_equals_join(spark, bounded):
    left = spark.range(200).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 5).alias("k"))
    right = spark.range(150).select(F.col("id").alias("rid"), F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 7).alias("k"))
    bound = F.lit(200) if bounded else None
    got = joins.balanced_join(left, right, ["k"], ["id"], ["rid"], bound, pairs_per_task=50, block_rows=7)
    want = left.join(right, "k")
    assert sorted(got.select("id", "rid", "k").collect()) == sorted(want.select("id", "rid", "k").collect())


def test_fits_broadcast(spark):
    assert joins.fits_broadcast(spark.range(10))
    assert not joins.fits_broadcast(spark.range(10), max_rows=9)
    assert joins.fits_broadcast(spark.range(10).filter("id < 0"))
    assert not joins.fits_broadcast(spark.range(10).select(F.repeat(F.lit("x"), 100).alias("x")), max_bytes=500)


def test_known_distance_and_box(spark):
    """Two towns 24.3 km apart; the box holds a circle on all bearings."""
    row = spark.range(1).select(geo.haversine_km(F.lit(48.6483), F.lit(9.4513), F.lit(48.7758), F.lit(9.1829)).alias("d")).first()
    assert abs(row.d - 24.2653) < 1e-3 and abs(row.d - distance(48.6483, 9.4513, 48.7758, 9.1829)) < 1e-9
    box = geo.bounding_box(48.6483, 9.4513, 25)
    for bearing in range(0, 360, 10):
        b, d = math.radians(bearing), 24.99 / 6371.0088
        lat1, lon1 = math.radians(48.6483), math.radians(9.4513)
        lat = math.asin(math.sin(lat1) * math.cos(d) + math.cos(lat1) * math.sin(d) * math.cos(b))
        lon = lon1 + math.atan2(math.sin(b) * math.sin(d) * math.cos(lat1), math.cos(d) - math.sin(lat1) * math.sin(lat))
        assert box.min_lat <= math.degrees(lat) <= box.max_lat and box.min_lon <= math.degrees(lon) <= box.max_lon
    assert geo.bounding_box(90, 0, 10).max_lon == 180
    wide, exact = geo.bounding_box(48.65, 9, 500), geo.bounding_box(48.65, 9, 500, exact=True)
    assert exact.max_lon > wide.max_lon


def test_search_filters_and_page(spark):
    rows = events(spark, [(48.65, 9.45)] * 6 + [(52.5, 13.4)])
    query = search.EventQuery(48.65, 9.45, 25, limit=2, offset=1)
    page, total = search.search_events(rows.withColumns({c: F.lit(None).cast("string") for c in ("end_utc", "time_zone_id", "venue_address", "postal_code", "location_precision", "url")}), query)
    assert [r.id for r in page.collect()] == ["00001", "00002"] and total.first()[0] == 6
    pick = lambda **k: sorted(r.id for r in search.matching(rows, search.EventQuery(48.65, 9.45, 25, **k)).collect())
    assert pick(start_from=datetime(2026, 1, 2), start_to=datetime(2026, 1, 3)) == ["00001", "00002"]
    assert pick(tags=["b", "a"]) and not pick(tags=["b"]) and not pick(attendance="online")
    assert pick(text="TALK 3") == ["00003"] and len(pick(text="  ")) == 6


def test_folded_search_and_unresolved(spark):
    found = events(spark, [(48.1, 11.5)], city="München", title="Größe")
    for text in ("muenchen", "MÜNCHEN", "groesse"):
        assert search.matching(found, search.EventQuery(48.1, 11.5, 5, text=text)).count() == 1
    hidden = events(spark, [(48.1, 11.5)], location_status="Unresolved")
    assert search.matching(hidden, search.EventQuery(48.1, 11.5, 5)).count() == 0


def test_query_rules():
    bad = search.EventQuery(91, -181, 501, datetime(2026, 2, 1), datetime(2026, 1, 1), attendance="maybe", limit=501, offset=-1)
    assert set(bad.errors()) == {"lat", "lon", "radius_km", "to", "attendance", "limit", "offset"}
    with pytest.raises(search.InvalidQuery):
        bad.checked()
    good = search.EventQuery(0, 0, 500, attendance=" HYBRID ", text=" ")
    assert not good.errors() and good.known_attendance() == "Hybrid" and good.needle() is None


@pytest.mark.parametrize("exact", [False, True])
def test_radius_join_equals_brute_force(spark, exact):
    rng = random.Random(7)
    points = [(rng.uniform(47, 55), rng.uniform(5, 15)) for _ in range(250)] + [(50.0, 10.0)] * 120
    points += [(rng.uniform(-89, 89), rng.uniform(-180, 180)) for _ in range(80)]
    searches = [(i, rng.uniform(46, 56), rng.uniform(4, 16), rng.choice([0.5, 3, 20, 77, 200, 500])) for i in range(60)]
    searches += [(100 + i, rng.uniform(-89, 89), rng.uniform(-180, 180), 400.0) for i in range(40)]
    table = spark.createDataFrame([(i, la, lo, float(r)) for i, la, lo, r in searches], "search_id int, lat double, lon double, radius_km double")
    got = {(r.search_id, r.id) for r in radius_join.radius_join(events(spark, points), table, exact).collect()}
    want = set()
    for i, lat, lon, radius in searches:
        box = geo.bounding_box(lat, lon, radius, exact)
        for n, (a, b) in enumerate(points):
            if box.min_lat <= a <= box.max_lat and box.min_lon <= b <= box.max_lon and distance(lat, lon, a, b) <= radius:
                want.add((i, f"{n:05d}"))
    assert got == want


def test_hot_cells_and_points_keep_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(radius_join, "balanced_join", lambda *a, **k: joins.balanced_join(*a, **k, pairs_per_task=20, block_rows=3))
    rows = events(spark, [(50.0, 10.0)] * 40 + [(50.0 + i / 100, 10.0) for i in range(30)])
    table = spark.createDataFrame([(i, 50.0, 10.0, 10.0 + i) for i in range(25)], "search_id int, lat double, lon double, radius_km double")
    near = lambda n, r: n < 40 or distance(50, 10, 50 + (n - 40) / 100, 10) <= r
    assert radius_join.radius_join(rows, table).count() == sum(near(n, 10.0 + i) for i in range(25) for n in range(70))


def test_first_matches_equals_full_ranking(spark):
    rows = events(spark, [(50.0, 10.0)] * 50 + [(50.0 + i / 50, 10.0) for i in range(50)])
    table = spark.createDataFrame(
        [(i, 50.0, 10.0, 5.0 + 7 * i, "a" if i % 2 else None) for i in range(8)],
        "search_id int, lat double, lon double, radius_km double, tag string",
    ).withColumn("tags", F.when(F.col("tag").isNotNull(), F.array("tag")))
    got = {(r.search_id, r.position, r.id) for r in radius_join.first_matches(rows, table, limit=6, offset=3).collect()}
    ranked = {}
    for r in radius_join.radius_join(rows, table).collect():
        ranked.setdefault(r.search_id, []).append((r.start_utc, r.id))
    want = {(s, n, i) for s, found in ranked.items() for n, (_, i) in enumerate(sorted(found), 1) if 3 < n <= 9}
    assert got == want


def test_kept_pages_equal_new_ones(spark):
    """Pages that lose all, some or none of their rows, pages that were not full, and changed searches."""
    before = events(spark, [(50.0, 10.0 + i / 200) for i in range(60)])
    n = F.col("id").try_cast("int")
    day = lambda by: F.timestamp_add("DAY", F.lit(by), F.col("start_utc"))
    now = before.filter(n % 7 != 1).withColumn("start_utc", F.when(n % 9 == 2, day(40)).when(n % 9 == 4, day(-40)).otherwise(F.col("start_utc")))
    now = now.withColumn("title", F.when(n % 5 == 0, F.lit("Other")).otherwise(F.col("title"))).unionByName(
        events(spark, [(50.0, 10.05)] * 3).withColumn("id", F.concat(F.lit("new"), "id"))
    )
    changed = before.filter((n % 7 == 1) | (n % 9).isin(2, 4) | (n % 5 == 0)).select("id")
    changed = changed.unionByName(now.filter("id like 'new%'").select("id")).unionByName(changed)
    schema = "search_id int, lat double, lon double, radius_km double, text string"
    known = [(i, 50.0, 10.0 + i / 100, 0.2 + i, "talk" if i % 3 == 0 else None) for i in range(12)]
    asked = [(i, la, lo, r * 2 if i == 5 else r, t) for i, la, lo, r, t in known if i != 7] + [(99, 50.0, 10.0, 9.0, None)]
    known, asked = spark.createDataFrame(known, schema), spark.createDataFrame(asked, schema)
    for limit in (4, 30):
        kept = write_through(radius_join.page_ids(before, known, limit), "kept")
        got = saved_pages.refreshed_pages(kept, now, changed, asked, known, limit)
        want = radius_join.page_ids(now, asked, limit).select(got.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())), limit
    full = saved_pages.page_rows(want, now)
    assert full.count() == want.count() and set(now.columns) < set(full.columns)


def test_kept_pages_of_empty_tables(spark):
    rows = events(spark, [(50.0, 10.0)] * 3)
    asked = spark.createDataFrame([(1, 50.0, 10.0, 5.0)], "search_id int, lat double, lon double, radius_km double")
    none, no_rows = asked.limit(0), rows.limit(0)
    empty = radius_join.page_ids(no_rows, none, 2)
    first = write_through(saved_pages.refreshed_pages(empty, rows, rows.select("id"), asked, none, 2), "first")
    assert [(r.id, r.position) for r in first.orderBy("position").collect()] == [("00000", 1), ("00001", 2)]
    assert saved_pages.refreshed_pages(first, no_rows, rows.select("id"), asked, asked, 2).count() == 0
    assert saved_pages.refreshed_pages(first, rows, rows.select("id"), none, asked, 2).count() == 0


def test_equal_searches_share_circles_and_filters_meet_events_once(spark):
    rows = events(spark, [(50.0, 10.0)] * 5 + [(50.1, 10.0)] * 5)
    schema = "search_id int, lat double, lon double, radius_km double, start_from timestamp"
    late = datetime(2020, 1, 1, 0, 0, 0, 1)
    table = spark.createDataFrame([(i, 50.0, 10.0, 99.0, (None, late, late.replace(microsecond=2))[i % 3]) for i in range(30)], schema)
    members, circles = radius_join._asked(rows, table, False)
    assert (members.count(), members.select("_ask").distinct().count(), circles.count()) == (30, 3, 6)
    met = radius_join._filtered(radius_join._with_texts(rows), circles, members, ["id"])
    assert met.count() == 30
    assert radius_join.radius_join(rows, table).count() == 300


def test_side_of_one_block_is_not_repeated(spark, tmp_path, monkeypatch):
    heavy = []
    monkeypatch.setattr(joins, "write_through", lambda df, label: heavy.extend(df.collect()) or df)
    left, right = (spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias(name)) for n, name in ((1000, "a"), (5, "b")))
    assert joins.balanced_join(left, right, ["k"], ["a"], ["b"], pairs_per_task=2500, block_rows=10).count() == 5000
    assert [(r._lb, r._rb) for r in heavy] == [(2, 1)]


def test_radius_join_writes_no_pairs(spark, monkeypatch):
    """200 searches meet 200 positions, all different: what is written follows the two tables, not the 40 000 pairs."""
    written = []
    for module in (joins, radius_join):
        monkeypatch.setattr(module, "write_through", lambda df, label: written.append(write_through(df, label)) or written[-1])
    rows = events(spark, [(50.0 + i / 1000, 10.0) for i in range(200)])
    table = spark.createDataFrame([(i, 50.0, 10.0 + i / 1000, 100.0) for i in range(200)], "search_id int, lat double, lon double, radius_km double")
    assert radius_join.radius_join(rows, table).count() == 40_000
    assert sum(t.count() for t in written) < 1000


def test_cut_cells_with_filters_keep_all_pairs(spark, monkeypatch):
    """Blocks and rows of a few entries; equal searches, repeated and null ids, filters of every kind."""
    for name, few in {"SEARCHES_PER_ROW": 3, "EVENTS_PER_ROW": 2, "SEARCHES_PER_TASK": 8, "POINTS_PER_CELL": 4, "PAIRS_PER_TASK": 25}.items():
        monkeypatch.setattr(radius_join, name, few)
    rng = random.Random(3)
    points = [(50.0, 10.0)] * 25 + [(rng.uniform(49.5, 50.5), rng.uniform(9.5, 10.5)) for _ in range(60)]
    n = F.col("id").try_cast("int")
    rows = events(spark, points).withColumns({"attendance": F.when(n % 3 > 0, "Online"), "tags": F.array(F.concat(F.lit("t"), n % 2)), "title": F.concat(F.lit("Größe "), n % 5)})
    rows = rows.unionByName(rows.filter(n % 10 == 0)).unionByName(rows.filter(n < 4).withColumn("id", F.lit(None).cast("string")))
    rows = rows.unionByName(rows.filter(n == 5).withColumn("location_status", F.lit("Unresolved"))).unionByName(rows.filter(n == 6).withColumn("lat", F.lit(None).cast("double")))
    day = lambda d: datetime(2026, 1, d)
    filters = [(None,) * 5, (day(5), None, None, None, None), (None, day(9), None, "online", None), (None, None, ["t1", "x"], " ", None), (day(2), day(20), [], None, "GROESSE 1")]
    asked = [(i % 30 if i % 7 else None, 50.0, 10.0 + i % 4 / 10, (0.5, 8.0, 30.0)[i % 3], *filters[i % 5]) for i in range(60)]
    schema = "search_id int, lat double, lon double, radius_km double, start_from timestamp, start_to timestamp, tags array<string>, attendance string, text string"
    got = radius_join.radius_join(rows, spark.createDataFrame(asked, schema), digits=3)
    assert got.columns == [*rows.columns, "search_id", "distance_km"]
    want = []
    for search_id, lat, lon, radius, start, end, tags, attendance, text in asked:
        box = geo.bounding_box(lat, lon, radius)
        for e in rows.filter("location_status = 'Resolved' and lat is not null").collect():
            d = distance(lat, lon, e.lat, e.lon)
            inside = d <= radius and box.min_lat <= e.lat <= box.max_lat and box.min_lon <= e.lon <= box.max_lon
            dated = (not start or e.start_utc >= start) and (not end or e.start_utc <= end)
            kind = attendance in (None, " ") or (e.attendance or "").lower() == attendance
            if inside and dated and kind and (not tags or set(tags) & set(e.tags)) and (not text or "Größe 1" in e.title):
                want.append((*e, search_id, round(d, 3)))
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))


def test_blocks_of_cells_share_the_pairs(spark, monkeypatch):
    """A cell with nearly all searches and events is cut on both sides; no task holds too many searches; small cells stay whole."""
    monkeypatch.setattr(radius_join, "PAIRS_PER_TASK", 10)
    monkeypatch.setattr(radius_join, "SEARCHES_PER_ROW", 1)
    monkeypatch.setattr(radius_join, "EVENTS_PER_ROW", 1)
    cell = lambda df, n: df.select(F.lit(1).alias("level"), F.when(F.col("id") < n, 0).otherwise(1).cast("long").alias("cell_y"), F.lit(0).cast("long").alias("cell_x"), F.lit(1).alias("_rows"))
    searches, points = cell(spark.range(402), 400).drop("_rows"), cell(spark.range(103), 100)
    assert [(r.cell_y, r._sb, r._eb) for r in radius_join._layout(searches, points).collect()] == [(0, 2, 2)]
    monkeypatch.setattr(radius_join, "SEARCHES_PER_TASK", 50)
    assert [(r.cell_y, r._sb, r._eb) for r in radius_join._layout(searches, points).collect()] == [(0, 8, 1)]


@pytest.mark.parametrize(("crowd", "level"), [(5, 0), (6, 9)])
def test_cells_follow_the_positions(spark, monkeypatch, crowd, level):
    monkeypatch.setattr(radius_join, "POINTS_PER_CELL", 5)
    points = spark.createDataFrame([(50.0 + i / 10_000, 10.0) for i in range(crowd)], "lat double, lon double")
    assert radius_join._deepest(points) == level
    assert radius_join._deepest(points.limit(0)) == 0


def test_keys_are_cut_into_pieces(spark):
    rows = spark.range(100).select("id", F.when(F.col("id") < 90, F.lit(None)).otherwise("k").alias("k"))
    cut = joins.in_pieces(rows, ["k"], ["id"], 30)
    assert cut.count() == 100 and {(r.k, r._piece) for r in cut.collect()} == {(None, 0), (None, 1), (None, 2), ("k", 0)}
