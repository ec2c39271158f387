"""Gazetteer lookups: place names, postal codes, place search, and the build from GeoNames dumps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.address import state_code
from ..functions.fixed_values import MAX_ALIASES, MIN_ALIAS_LENGTH
from ..functions.text import fold, fold_constant, let, tokenize
from .joins import lookup_join, salted_join
from .rows import computed


# --- lookup tables -------------------------------------------------------------------------


def place_keys(places: DataFrame, token_keys: bool = False) -> DataFrame:
    """Folded names and aliases with the place they stand for: ``phrase, matched_place, lat, lon``.

    Aliases count from four folded characters on. Where places share a key, the larger population
    wins and among equals the first line. Keys keep their punctuation, so a hyphenated name never
    equals a phrase of tokens; ``token_keys`` normalises them instead.
    """
    place = [F.col("name").alias("matched_place"), F.col("lat"), F.col("lon"), "population", "line_no"]
    names = places.select(fold("name").alias("phrase"), *place)
    aliases = (
        places.select(F.explode("aliases").alias("alias"), *place)
        .withColumn("phrase", fold("alias"))
        .filter(F.length("phrase") >= MIN_ALIAS_LENGTH)
        .drop("alias")
    )
    keys = names.unionByName(aliases)
    if token_keys:
        keys = keys.withColumn("phrase", F.array_join(tokenize("phrase"), " "))
    best = W.partitionBy("phrase").orderBy(F.desc("population"), "line_no")
    ranked = keys.withColumn("rank", F.row_number().over(best)).filter("rank = 1")
    return ranked.select("phrase", "matched_place", "lat", "lon")


def postal_lookup(postal: DataFrame) -> DataFrame:
    """First row per postal code: ``plz, matched_place, lat, lon``."""
    first = W.partitionBy("plz").orderBy("line_no")
    ranked = postal.withColumn("rank", F.row_number().over(first)).filter("rank = 1")
    return ranked.select("plz", F.col("name").alias("matched_place"), "lat", "lon")


def longest_key_words(keys: DataFrame) -> DataFrame:
    """Number of words of the longest key, at least one; a single row ``max_words``."""
    words = F.max(F.greatest(F.size(tokenize("phrase")), F.lit(1)))
    return keys.agg(F.coalesce(words, F.lit(1)).alias("max_words"))


# --- name matching -------------------------------------------------------------------------


def match_names(texts: DataFrame, keys: DataFrame, columns: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Best place name inside the text columns of each distinct row of ``texts``.

    An earlier column is searched completely before a later one; inside a text the longest phrase
    wins, then the leftmost. Returns ``columns`` and ``carry`` (further columns that identify a
    row) plus ``matched_place, lat, lon`` for the rows with a match. Every text is cut into its own
    word runs, so the work grows with text length times the longest key, and the runs meet the keys
    in one equi join.
    """
    row = [*columns, *carry]
    limited = texts.select(*row, longest_key_words(keys).scalar().alias("_limit"))
    runs = F.concat(*[_word_runs(F.col(c), prio, F.col("_limit")) for prio, c in enumerate(columns)])
    phrases = computed(limited, *row, runs.alias("runs")).select(*row, F.explode("runs").alias("run")).select(
        *row, "run.phrase", F.struct("run.prio", "run.neg_words", "run.start").alias("rank")
    )
    found = lookup_join(phrases, keys, ["phrase"], "inner", spread_by=[*row, "rank"])
    best = found.groupBy(*row).agg(F.min_by(F.struct("matched_place", "lat", "lon"), "rank").alias("place"))
    return best.select(*row, "place.*")


def _word_runs(text: Column, prio: int, limit: Column) -> Column:
    """All runs of up to ``limit`` tokens with their rank fields."""

    def runs(tokens: Column) -> Column:
        count = F.size(tokens)

        def of_length(n: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(0), count - n),
                lambda start: F.struct(
                    F.lit(prio).alias("prio"),
                    (-n).alias("neg_words"),
                    start.alias("start"),
                    F.array_join(F.slice(tokens, start + 1, n), " ").alias("phrase"),
                ),
            )

        lengths = F.when(count > 0, F.sequence(F.lit(1), F.least(count, limit)))
        return F.flatten(F.transform(F.coalesce(lengths, F.array().cast("array<int>")), of_length))

    return let(F.coalesce(tokenize(fold(text)), F.array().cast("array<string>")), runs)


# --- place search --------------------------------------------------------------------------


def search_places(places: DataFrame, query: str | None, limit: int | None = None) -> DataFrame:
    """Autocomplete: canonical names holding the folded query, most populous first."""
    fields = ["name", "admin1", "population", "lat", "lon"]
    if query is None or not query.strip():
        return places.select(*fields).filter(F.lit(False))
    bounded = min(max(10 if limit is None else limit, 1), 50)
    hits = places.filter(fold("name").contains(fold_constant(query)))
    return hits.orderBy(F.desc("population"), "name", "admin1").limit(bounded).select(*fields)


# --- build from GeoNames dumps ---------------------------------------------------------------


def related_names(alias: Column | str, name: Column | str) -> Column:
    """Different folded names where one holds the other or both start with the same four characters."""

    def test(pair: Column) -> Column:
        a, n = pair["a"], pair["n"]
        close = n.contains(a) | a.contains(n) | (F.left(a, F.lit(4)) == F.left(n, F.lit(4)))
        return (a != n) & close

    return let(F.struct(fold(alias).alias("a"), fold(name).alias("n")), test)


def build_places(geonames: DataFrame, german_names: DataFrame, max_aliases: int | None = MAX_ALIASES) -> DataFrame:
    """Places with German canonical names and aliases, one row per folded name and state.

    The canonical name is the preferred German one (of several, the last listed), else the first
    German one, else the GeoNames name. The names of a place are ranked under group limits, and the
    first ``max_aliases`` are gathered, or with None all of them.
    """
    german = german_names.select(
        "geonameid",
        "name",
        F.when(F.col("preferred"), F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("rank1"),
        F.when(F.col("preferred"), -F.col("line_no")).otherwise(F.col("line_no")).alias("rank2"),
    )
    canonical = german.groupBy("geonameid").agg(
        F.min_by("name", F.struct("rank1", "rank2")).alias("german_name"),
        F.min(F.struct("rank1", "rank2")).alias("german_rank"),
    )
    named = geonames.join(canonical, "geonameid", "left").withColumn("canonical", F.coalesce("german_name", "name"))

    place = ["line_no", "canonical"]
    rank = lambda a, b: [F.lit(a).cast("bigint").alias("rank1"), b.cast("bigint").alias("rank2")]
    owners = named.select("geonameid", "german_rank", *place)
    others = (
        salted_join(german, owners, ["geonameid"], spread_by=["name", "rank2"])
        .filter(F.struct("rank1", "rank2") != F.col("german_rank"))
        .select(*place, F.col("name").alias("alias"), "rank1", "rank2")
    )
    own = named.select(
        *place, F.posexplode(F.array("name", "ascii_name")).alias("pos", "alias")
    ).select(*place, "alias", *rank(2, F.col("pos")))
    listed = (
        named.select(*place, F.posexplode(F.split("alternate_names", ",")).alias("pos", "alias"))
        .filter(related_names("alias", "canonical"))
        .select(*place, "alias", *rank(3, F.col("pos")))
    )
    spelled = (
        others.unionByName(own)
        .unionByName(listed)
        .filter(F.length("alias") >= MIN_ALIAS_LENGTH)
        .withColumn("folded", fold("alias"))
        .filter(F.col("folded") != fold("canonical"))
    )
    order = F.struct("rank1", "rank2")
    distinct = spelled.groupBy("line_no", "folded").agg(F.min(order).alias("rank"), F.min_by("alias", order).alias("alias"))
    kept = distinct.withColumn("n", F.row_number().over(W.partitionBy("line_no").orderBy("rank")))
    kept = kept if max_aliases is None else kept.filter(F.col("n") <= max_aliases)
    aliases = kept.groupBy("line_no").agg(F.array_sort(F.collect_list(F.struct("n", "alias"))).alias("ranked"))

    largest = W.partitionBy("folded_name", "admin1").orderBy(F.desc("population"), "line_no")
    unique = (
        named.withColumns({"folded_name": fold("canonical"), "admin1": state_code("admin1_code")})
        .withColumn("place_rank", F.row_number().over(largest))
        .filter("place_rank = 1")
    )
    return unique.join(aliases, "line_no", "left").select(
        F.col("canonical").alias("name"),
        F.coalesce(F.col("ranked.alias"), F.array().cast("array<string>")).alias("aliases"),
        "admin1",
        "population",
        "lat",
        "lon",
        "line_no",
    )


def build_postal(geonames_postal: DataFrame) -> DataFrame:
    """First line per postal code, with the state abbreviation."""
    first = W.partitionBy("plz").orderBy("line_no")
    ranked = geonames_postal.withColumn("rank", F.row_number().over(first)).filter("rank = 1")
    return ranked.select("plz", "name", state_code("admin1_code").alias("admin1"), "lat", "lon", "line_no")
