"""Substring search by an index of three-character pieces.

Rows whose texts repeat are best indexed by text: store ``text_key()`` with the rows, write the index
of ``distinct_texts(rows)`` with the key ``TEXT_KEY`` and pass that key to the search. Each different
text is then indexed once, under eight bytes, and rows are searched without moving them while the
texts found are few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import lookup_join
from .rows import computed
from .search import search_text, with_text

GRAM = 3
TEXT_KEY = ("text_key",)


def grams(text: Column) -> Column:
    """Distinct pieces of three characters, overlapping."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def needle_grams(needle: str) -> list[str]:
    return sorted({needle[i : i + GRAM] for i in range(len(needle) - GRAM + 1)})


def text_key(text: Column | None = None) -> Column:
    """Hash of a text; texts that share it are found together and told apart by the final search."""
    return F.xxhash64(search_text() if text is None else text).alias(*TEXT_KEY)


def distinct_texts(rows: DataFrame, text: Column | None = None) -> DataFrame:
    """``text_key`` and ``text`` of every different text; ``rows`` has ``text_key``."""
    return rows.select(*TEXT_KEY, (search_text() if text is None else text).alias("text")).distinct()


def postings(rows: DataFrame, key: Sequence[str], text: Column | None = None) -> DataFrame:
    """``gram`` and ``key``, once for each row that holds the piece; the default text is ``search_text()``."""
    texts = computed(rows, *key, grams(search_text() if text is None else text).alias("grams"))
    found = texts.select(F.explode("grams").alias("gram"), *key)
    return found.distinct() if tuple(key) == TEXT_KEY else found


def write_text_index(rows: DataFrame, path: str, key: Sequence[str] = ("id",), text: Column | None = None) -> DataFrame:
    """Write the postings sorted by piece, so that a look-up reads the row groups of its pieces only.

    A piece that most rows hold lies in many files, as rows are dealt by piece and key.
    """
    found = postings(rows, key, text)
    found.repartitionByRange("gram", *key).sortWithinPartitions("gram", *key).write.mode("errorifexists").parquet(path)
    return open_text_index(rows.sparkSession, path)


def open_text_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def candidates(index: DataFrame, needle: str, key: Sequence[str] = ("id",)) -> DataFrame:
    """Keys of the rows that hold all pieces of ``needle``; it must have three characters or more."""
    wanted = needle_grams(needle)
    met = index.filter(F.col("gram").isin(wanted))
    return met.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(wanted)).select(*key)


def with_text_indexed(rows: DataFrame, index: DataFrame, needle: str | None, key: Sequence[str] = ("id",)) -> DataFrame:
    """``search.with_text`` by the index: only the texts of candidates are folded and searched.

    A needle of fewer than three characters has no piece; the rows are scanned for it.
    """
    if needle is None or len(needle) < GRAM:
        return with_text(rows, needle)
    return with_text(lookup_join(rows, candidates(index, needle, key), list(key), "left_semi", spread_by=list(key)), needle)
