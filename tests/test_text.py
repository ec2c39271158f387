"""Text functions: folding, whitespace, boilerplate, tokens, tags."""

import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kreiswerk.functions import address, tags, text


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in rows.select("i", expression(F.col("t")).alias("x")).orderBy("i").collect()]


def plain_fold(value):
    """Fold written out step by step."""
    value = "".join(c if c == "İ" or len(c.lower()) != 1 else c.lower() for c in value)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        value = value.replace(a, b)
    kept = (c for c in unicodedata.normalize("NFKD", value) if ord(c) > 0xFFFF or unicodedata.category(c) != "Mn")
    return "".join(kept)


FOLD_CASES = {
    "München": "muenchen",
    "MÜNCHEN Ä Ö ß ẞ": "muenchen ae oe ss ss",
    "Mu\u0308nchen": "munchen",
    "Café Ångstrom": "cafe angstrom",
    "ﬁn ½ ™": "fin 1⁄2 TM",
    "한글": unicodedata.normalize("NFKD", "한글"),
    "가 각": unicodedata.normalize("NFKD", "가 각"),
    "①⑩": "110",
    "🎉 party": "🎉 party",
    "ΣΊΣΥΦΟΣ": "σισυφοσ",
    "\u212aK": "kk",
    "": "",
}


def test_fold_cases(spark):
    assert column(spark, FOLD_CASES, text.fold) == list(FOLD_CASES.values())
    assert [text.fold_constant(t) for t in FOLD_CASES] == list(FOLD_CASES.values())
    assert column(spark, [None], text.fold) == [None]


def test_fold_every_letter_matches_plain_form(spark):
    """One row per assigned character with its neighbours, against the step-by-step form."""
    chars = [chr(c) for c in [*range(0x20, 0xD800), *range(0xF900, 0x10000)] if unicodedata.category(chr(c)) != "Cn"]
    lines = ["".join(f"{c}a" for c in chars[i : i + 50]) for i in range(0, len(chars), 50)]
    assert column(spark, lines, text.fold) == [plain_fold(line) for line in lines]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=12, alphabet=st.characters(exclude_categories=("Cs", "Cn", "Mc", "Mn"))), min_size=1, max_size=20))
def test_fold_random_text(spark, values):
    assert column(spark, values, text.fold) == [plain_fold(v) for v in values]


def test_collapse_whitespace(spark):
    values = ["  a \t\n b  c  ", "　", "x​y"]
    assert column(spark, values, text.collapse_whitespace) == ["a b c", "", "x\u200by"]


def test_boilerplate_first_prefix_only(spark):
    cases = {
        "Join us for: Kotlin Night": "Kotlin Night",
        "Please join us for join us for tea": "join us for tea",
        "SAVE THE DATE: - About this event": "About this event",
        "You're invited to   a  talk": "a talk",
        "We join us for": "We join us for",
        "About this event": "",
    }
    assert column(spark, cases, text.clean_title) == list(cases.values())
    assert column(spark, [None], text.clean_description) == [""]
    assert column(spark, [None], text.clean_title) == [None]


def test_tokenize(spark):
    assert column(spark, ["a-b c1_d", "", "år2024!"], text.tokenize) == [["a", "b", "c1", "d"], [], ["år2024"]]
    assert text.tokenize_constant("a-b c1_d") == ["a", "b", "c1", "d"]


TAG_CASES = [
    ("Hackergarten im Mai", "siehe https://demo.example.net", ["opensource"]),
    ("What's new in .NET 10", None, ["dotnet"]),
    ("Let's go to the venue", None, []),
    ("JavaScript Meetup", None, ["frontend"]),
    ("Java Meetup", None, ["java"]),
    ("C# und C++", "", ["dotnet", "systems"]),
    ("ABC#1", None, []),
    ("Machine  Learning", "machine learning", ["ai"]),
    ("CI-CD: Open Source", None, ["devops", "opensource"]),
    ("KI in München", "Sicherheit", ["ai", "security"]),
    ("Domain driven daily", "mainframe", []),
    ("c++", "linux/.net", ["dotnet", "opensource", "systems"]),
]


def test_tags(spark):
    rows = spark.createDataFrame([(i, t, d) for i, (t, d, _) in enumerate(TAG_CASES)], "i int, t string, d string")
    got = rows.select("i", tags.extract_tags("t", "d").alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [expected for _, _, expected in TAG_CASES]


def test_tags_empty_map_and_merge(spark):
    rows = spark.createDataFrame([("java", ["b", "a", "b"])], "t string, s array<string>")
    got = rows.select(
        tags.extract_tags("t", F.lit(None).cast("string"), {}).alias("none"),
        tags.merge_tags("s", F.array(F.lit("B"), F.lit("a"))).alias("merged"),
        tags.merge_tags(F.lit(None).cast("array<string>"), "s").alias("from_null"),
    ).first()
    assert (got.none, got.merged, got.from_null) == ([], ["B", "a", "b"], ["a", "b"])


@pytest.mark.parametrize(
    ("value", "found"),
    [("net", True), ("x.net", False), (".net", True), ("(.net)", True), ("a.netb .net", True)],
)
def test_contains_bounded(spark, value, found):
    needle = ".net" if "." in value else "net"
    assert column(spark, [value], lambda c: text.contains_bounded(c, needle)) == [found]


def test_address_functions(spark):
    assert column(spark, ["D-73230 K", "123456", "1234 12345", "70178x 99999", None], address.extract_plz) == [
        "73230", None, "12345", "70178", None,
    ]
    assert column(spark, ["Haus 3", "Königsallee", "Marienstr.", "Berlin", "", None], address.looks_like_street) == [
        True, True, True, False, False, False,
    ]
    rows = spark.createDataFrame([("A 1", "70178", "Ulm"), ("A 1", " ", None)], "a string, p string, c string")
    got = [r.q for r in rows.select(address.geocode_query("a", "p", "c").alias("q")).collect()]
    assert got == ["A 1, 70178 Ulm, Deutschland", "A 1, Deutschland"]
    got = [r.q for r in rows.select(address.assemble_address("a", "p", "c").alias("q")).collect()]
    assert got == ["A 1, 70178, Ulm", "A 1"]
