"""Topic tags from keywords."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import KEYWORD_TO_TAG
from .text import col, contains_bounded, fold, fold_constant, let, tokenize, tokenize_constant


def extract_tags(
    title: Column | str, description: Column | str, keyword_to_tag: Mapping[str, str] = KEYWORD_TO_TAG
) -> Column:
    """Sorted distinct tags whose keyword occurs in the folded title or description.

    A keyword that is one plain word must equal a token; any other keyword (phrase, symbols) must
    occur between word boundaries. The token test is a single hash intersection per row, whatever
    the number of keywords.
    """
    words: dict[str, set[str]] = {}
    phrases: dict[str, set[str]] = {}
    for keyword, tag in keyword_to_tag.items():
        folded = fold_constant(keyword)
        kind = words if tokenize_constant(folded) == [folded] else phrases
        kind.setdefault(tag, set()).add(folded)
    tags = sorted({*words, *phrases}, key=lambda t: t.encode("utf-16-be"))
    if not tags:
        return F.array().cast("array<string>")
    text = fold(F.concat(col(title), F.lit(" "), F.coalesce(col(description), F.lit(""))))
    all_words = _strings(sorted(set().union(*words.values())))

    def pick(row: Column) -> Column:
        hits = []
        for tag in tags:
            tests = [contains_bounded(row["text"], p) for p in sorted(phrases.get(tag, ()))]
            if tag in words:
                tests.insert(0, F.arrays_overlap(row["words"], _strings(sorted(words[tag]))))
            hits.append(F.when(reduce(Column.__or__, tests), F.lit(tag)))
        return F.array_compact(F.array(*hits))

    return let(
        text, lambda t: let(F.struct(t.alias("text"), F.array_intersect(tokenize(t), all_words).alias("words")), pick)
    )


def merge_tags(source_tags: Column | str, keyword_tags: Column | str) -> Column:
    """Union of two tag lists, distinct and sorted."""
    none = F.array().cast("array<string>")
    return F.array_sort(
        F.array_union(F.coalesce(col(source_tags), none), F.coalesce(col(keyword_tags), none))
    )


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")
