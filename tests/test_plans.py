"""Physical plans: what reaches the scan, and which joins and windows are chosen."""

from pyspark.sql import functions as F

from kreiswerk.operators import dedupe, radius_join, search
from kreiswerk.plans import search_queries as q
from kreiswerk.plans import store_queries
from kreiswerk.plans.fixtures import view

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_pushes_bounds_and_prunes_columns(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    q.stored_events(spark, SF).write.parquet(str(tmp_path / "e"))
    found = search.matching(spark.read.parquet(str(tmp_path / "e")), search.EventQuery(48.6, 9.4, 75.0)).select("id")
    text = plan(found)
    assert "GreaterThanOrEqual(lat," in text and "LessThanOrEqual(lon," in text and "EqualTo(location_status,Resolved)" in text
    assert "description" not in text.split("ReadSchema")[1] and "Exchange" not in text


def test_search_page_is_a_top_k(spark):
    page, _ = search.search_events(q.stored_events(spark, SF), search.EventQuery(48.6, 9.4, 75.0))
    assert "TakeOrderedAndProject" in plan(page)


def test_radius_join_has_no_nested_loop(spark):
    text = plan(radius_join.radius_join(q.stored_events(spark, SF), view(spark, SF, "fx_saved_search")))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_batch_dedupe_limits_groups_before_the_shuffle(spark):
    text = plan(dedupe.dedupe_batch(store_queries.events(spark, SF)))
    before_shuffle = text.split("Exchange hashpartitioning(source_id")[1]
    assert "WindowGroupLimit" in before_shuffle


def test_no_query_runs_python_on_rows(spark):
    import __spark_entry__ as registered

    for name in ("normalized_events", "state_page_events", "jsonld_events", "calendar_occurrences", "fold_documents"):
        text = plan(registered.queries()[name](spark, SF))
        assert "EvalPython" not in text and "MapInPandas" not in text, name
