"""Keyword tables, the substring index, prefix rules and cursors against the plain forms of the same rules."""

from datetime import datetime

from pyspark.sql import functions as F

from kreiswerk.functions.tags import extract_tags
from kreiswerk.operators import search, text_index
from kreiswerk.operators.keywords import keyword_tags
from kreiswerk.sources import robots

KEYWORDS = {
    "java": "java", "Machine Learning": "ai", "c#": "dotnet", ".NET": "dotnet", "C++": "cpp", "köln": "place", "KI": "ai",
    "a\\Eb": "odd", "web  dev": "web", "node.js": "js", "r&d": "lab", "++": "signs", "x (y)": "par",
}
TEXTS = [
    "Java and javascript", "machine learning, Köln!", "MACHINE  LEARNING", "C# or c#x or xc#", "asp.net .NET 9 a.net", "c++ c++11 C++.",
    None, "", "koeln ki", "a\\Eb z", "web  dev", "web dev", "node.js nodexjs", "R&D r & d", "x (y) x (y)z", "KÖLN-KI-JAVA", "ki " * 20_000,
]


def test_keyword_table_equals_keyword_map(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "n int, text string")
    table = spark.createDataFrame(list(KEYWORDS.items()) * 2, "keyword string, tag string")
    found = keyword_tags(rows, table, F.concat_ws(" ", F.lit(""), "text"), ["n"]).groupBy("n").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    got = {r.n: r.tags for r in found.collect()}
    plain = {k: v for k, v in KEYWORDS.items() if v != "signs"}  # a table's keyword needs a letter or digit
    want = {r.n: r.tags for r in rows.select("n", extract_tags(F.lit(""), "text", plain).alias("tags")).collect()}
    assert got == {n: tags for n, tags in want.items() if tags} and got[4] == ["dotnet"] and got[8] == ["ai", "place"]
    assert keyword_tags(rows, table.limit(0), F.col("text"), ["n"]).count() == 0


def test_plan_does_not_grow_with_keywords(spark):
    rows = spark.createDataFrame([(1, "k7 k8")], "n int, text string")
    size = lambda n: len(
        keyword_tags(rows, spark.range(n).select(F.concat(F.lit("k"), "id").alias("keyword"), F.lit("t").alias("tag")), F.col("text"), ["n"])
        ._jdf.queryExecution().optimizedPlan().toString()
    )
    assert abs(size(3000) - size(30)) < 400


def test_index_equals_scan(spark, tmp_path):
    texts = ["Größe", "ab", "abc", "xabcx", "日本語テスト", "😀abc😀", "line\nbreak", "", "aaaa"]
    rows = spark.createDataFrame([(str(i), t, None, None, None, ["Tag😀x"] if i else None) for i, t in enumerate(texts)], "id string, title string, description string, venue_name string, city string, tags array<string>")
    index = text_index.write_text_index(rows, str(tmp_path / "grams"))
    ids = lambda df: sorted(r.id for r in df.select("id").collect())
    for needle in ("groesse", "abc", "ab", "a", "本語テ", "😀abc", "e\nb", "aaa", "aaaaa", "tag😀", "zzz", None):
        assert ids(text_index.with_text_indexed(rows, index, needle)) == ids(search.with_text(rows, needle)), needle
    plan = text_index.candidates(index, "abcd")._jdf.queryExecution().executedPlan().toString()
    assert "In(gram, [abc,bcd])" in plan


def test_index_by_text_holds_each_text_once(spark, tmp_path):
    schema = "id string, title string, description string, venue_name string, city string, tags array<string>"
    rows = spark.createDataFrame([(str(i), f"Größe {i % 3}", None, None, None, ["Tag"]) for i in range(30)], schema)
    keyed = rows.withColumn("text_key", text_index.text_key())
    texts = text_index.distinct_texts(keyed)
    assert texts.count() == 3
    index = text_index.write_text_index(texts, str(tmp_path / "grams"), text_index.TEXT_KEY, F.col("text"))
    assert index.filter("gram = 'gro'").count() == 3
    ids = lambda df: sorted(r.id for r in df.select("id").collect())
    for needle in ("groesse", "e 1", "1", "tag", "zzz", None):
        assert ids(text_index.with_text_indexed(keyed, index, needle, text_index.TEXT_KEY)) == ids(search.with_text(rows, needle)), needle
    # Two texts under one key: both are found by their own pieces and told apart by the search.
    one = rows.withColumn("text_key", F.lit(7).cast("long"))
    index = text_index.write_text_index(text_index.distinct_texts(one), str(tmp_path / "one"), text_index.TEXT_KEY, F.col("text"))
    assert ids(text_index.with_text_indexed(one, index, "e 1", text_index.TEXT_KEY)) == ids(search.with_text(rows, "e 1"))


def test_cursor_goes_on_within_equal_starts(spark):
    when = [datetime(2026, 1, 1 + i // 4) for i in range(10)]
    rows = spark.createDataFrame([(f"e{i}", w) for i, w in enumerate(when)], "id string, start_utc timestamp")
    after, seen = None, []
    while True:
        page = search.after_cursor(rows, after).orderBy("start_utc", "id").limit(3)
        if (after := search.cursor(page)) is None:
            break
        seen += [r.id for r in page.orderBy("start_utc", "id").collect()]
    assert seen == [f"e{i}" for i in range(10)]


def test_many_rules_on_one_host(spark, tmp_path):
    rules = spark.range(100_000).select(F.lit("h.example").alias("host"), F.concat(F.lit("/p"), "id", F.lit("/")).alias("prefix"))
    rules.write.parquet(str(tmp_path / "rules"))  # a host that the planner sees as a constant is no join key
    rules = spark.read.parquet(str(tmp_path / "rules"))
    urls = spark.createDataFrame([("https://h.example/p99999/x",), ("https://h.example/p100000/x",), ("https://other.example/p1/",), ("https://h.example/p1",), (None,)], "url string")
    marked = robots.mark_allowed(urls, rules)
    assert {r.url: r.allowed for r in marked.collect()} == dict(zip([r.url for r in urls.collect()], [False, True, True, True, True], strict=True))
    text = marked._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
