"""Tags from a table of keywords, of any number, met by equi joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ALNUM, fold, tokenize
from ..session import write_through
from .joins import lookup_join, salted_join
from .rows import computed


def keyword_runs(keywords: DataFrame) -> DataFrame:
    """``folded, tag, words, run`` of a table (keyword, tag).

    A keyword is known by the hash of its run of words and by their number; one without any letter or
    digit has none and matches nothing.
    """
    folded = computed(keywords.select("tag", fold("keyword").alias("folded")).distinct(), "tag", "folded", tokenize("folded").alias("tokens"))
    runs = folded.select("folded", "tag", F.size("tokens").alias("words"), F.xxhash64("tokens").alias("run"))
    return runs.filter("words > 0")


def keyword_tags(rows: DataFrame, keywords: DataFrame, text: Column, key: Sequence[str]) -> DataFrame:
    """``key`` and ``tag``, once each, of the rows whose folded ``text`` holds a keyword of the tag.

    The rule is that of ``functions.tags.extract_tags``: a keyword occurs where no letter or digit
    stands directly before or after it. What stands between such bounds is a run of whole words, so
    each row gives the hashes of its runs, of the numbers of words that keywords have, and meets the
    keywords in an equi join. Only a keyword that is more than one plain word is then looked up in
    the text, and only in the texts of the rows it met. The plan does not depend on the number of
    keywords. Rows are told apart by ``key``, which must be unique.
    """
    key = list(key)
    runs = write_through(keyword_runs(keywords), "keywords")
    lengths = [r[0] for r in runs.select("words").distinct().collect()]  # as many as words in the longest keyword
    folded = write_through(computed(rows, *key, fold(text).alias("folded")), "folded")
    tokens = computed(folded, *key, tokenize("folded").alias("tokens"))

    def of_length(n: int) -> Column:
        last = F.size("tokens") - n
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice("tokens", i + 1, n)))
        return F.transform(F.array_distinct(hashes), lambda h: F.struct(F.lit(n).alias("words"), h.alias("run")))

    if not lengths:
        return folded.select(*key, F.lit("").alias("tag")).limit(0)
    found = tokens.select(*key, F.explode(F.concat(*map(of_length, lengths))).alias("r")).select(*key, "r.*")
    met = lookup_join(found, runs, ["words", "run"], "inner", spread_by=key)
    # The text tells what words alone do not: signs in a keyword, and what stands between its words.
    plain = (F.col("words") == 1) & ~F.col("folded").rlike(rf"[^\p{{L}}\p{{Nd}}]")
    met = write_through(met.select(*key, "folded", "tag", plain.alias("plain")), "met")
    texts = folded.select(*key, F.col("folded").alias("text"))
    asked = met.filter("not plain")
    checked = salted_join(asked, texts, key, "inner", spread_by=["folded"])
    quoted = F.concat(F.lit(rf"(?<!{ALNUM})\Q"), F.replace("folded", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(rf"\E(?!{ALNUM})"))
    checked = checked.filter(F.col("text").contains(F.col("folded")) & F.rlike("text", quoted))
    return met.filter("plain").select(*key, "tag").unionByName(checked.select(*key, "tag")).distinct()
