"""Text columns: whitespace, boilerplate, folding, tokens. Everything stays in JVM expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import BOILERPLATE_PREFIXES

# Letters and decimal digits. Characters beyond U+FFFF never count as part of a token.
ALNUM = r"[\p{L}\p{Nd}&&[\x{0}-\x{FFFF}]]"

_UMLAUTS = (
    ("ä", "ae"), ("Ä", "ae"), ("ö", "oe"), ("Ö", "oe"),
    ("ü", "ue"), ("Ü", "ue"), ("ß", "ss"), ("ẞ", "ss"),
)
_HANGUL = (0xAC00, 0xD7A3)
_NOT_ASCII = r"[^\x00-\x7F]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def blank_to_null(c: Column | str) -> Column:
    """Null when nothing but whitespace is left."""
    c = col(c)
    return F.when(c.rlike(r"(?U)\S"), c)


def collapse_whitespace(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def strip_boilerplate(c: Column | str, prefixes=BOILERPLATE_PREFIXES) -> Column:
    """Remove the first prefix of the list that matches, ignoring case."""
    c = col(c)
    out = c
    for prefix in reversed(prefixes):
        rest = F.regexp_replace(F.substring(c, len(prefix) + 1, 2**31 - 1), "^[: -]+", "")
        hit = F.lower(F.substring(c, 1, len(prefix))) == prefix.lower()
        out = F.when(hit, collapse_whitespace(rest)).otherwise(out)
    return out


def clean_title(c: Column | str) -> Column:
    return let(collapse_whitespace(c), lambda t: strip_boilerplate(t))


def clean_description(c: Column | str) -> Column:
    """As ``clean_title``; a null becomes the empty string."""
    return F.coalesce(clean_title(c), F.lit(""))


# --- folding ------------------------------------------------------------------------------


def _fold_char(ch: str) -> str:
    """Fold of one character: simple lower case, compatibility decomposition, no accents."""
    low = ch if ch == "İ" or len(ch.lower()) != 1 else ch.lower()
    return "".join(
        c
        for c in unicodedata.normalize("NFKD", low)
        if ord(c) > 0xFFFF or unicodedata.category(c) != "Mn"
    )


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str], str]:
    """Character tables generated from Unicode data: 1->1 and 1->0 for translate, 1->n apart.

    The last value is a regex class of ranges that hold all 1->n characters.
    """
    umlauts = {a for a, _ in _UMLAUTS}
    source, target, dropped, longer = [], [], [], {}
    for cp in [*range(0x41, 0x5B), *range(0x80, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)]:
        ch = chr(cp)
        if ch in umlauts or _HANGUL[0] <= cp <= _HANGUL[1]:
            continue
        folded = _fold_char(ch)
        if folded == ch:
            continue
        if not folded:
            dropped.append(ch)
        elif len(folded) == 1:
            source.append(ch)
            target.append(folded)
        else:
            longer[ch] = folded
    ranges: list[list[int]] = [list(_HANGUL)]
    for cp in map(ord, longer):
        if ranges[-1] != list(_HANGUL) and 0 <= cp - ranges[-1][1] <= 256:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    rare = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"
    return "".join(source + dropped), "".join(target), longer, rare


def fold(c: Column | str) -> Column:
    """Comparison form of a text: lower case, umlauts spelled out, accents and marks removed.

    ASCII rows only pay ``lower``; other rows one ``translate``. What is still not ASCII then may
    hold characters that decompose into several (ligatures, fractions, Hangul); they are replaced
    one by one in the few rows where some lie in the ranges of such characters.
    """
    source, target, longer, rare = _fold_tables()

    def general(text: Column) -> Column:
        for umlaut, spelled in _UMLAUTS:
            text = F.replace(text, F.lit(umlaut), F.lit(spelled))
        return let(
            F.translate(text, source, target),
            lambda t: F.when(t.rlike(_NOT_ASCII) & t.rlike(rare), _expand_rare(t, longer)).otherwise(t),
        )

    return let(col(c), lambda t: F.when(t.rlike(_NOT_ASCII), general(t)).otherwise(F.lower(t)))


def _expand_rare(text: Column, longer: dict[str, str]) -> Column:
    expansions = F.str_to_map(
        F.lit("\u0001".join(f"{k}\u0002{v}" for k, v in longer.items())), F.lit("\u0001"), F.lit("\u0002")
    )
    chars = F.array_distinct(F.regexp_extract_all(text, F.lit(_NOT_ASCII), F.lit(0)))
    known = F.array_intersect(chars, F.map_keys(expansions))
    spelled = F.aggregate(known, text, lambda acc, ch: F.replace(acc, ch, F.element_at(expansions, ch)))
    syllables = F.filter(chars, lambda ch: F.ascii(ch).between(*_HANGUL))
    return F.aggregate(syllables, spelled, lambda acc, ch: F.replace(acc, ch, _jamo(ch)))


def _jamo(syllable: Column) -> Column:
    """Canonical decomposition of a Hangul syllable by its code point arithmetic."""
    lead = "".join(chr(0x1100 + i) for i in range(19))
    vowel = "".join(chr(0x1161 + i) for i in range(21))
    tail = "".join(chr(0x11A8 + i) for i in range(27))
    index = F.ascii(syllable) - _HANGUL[0]
    at = lambda table, i: F.lit(table).substr((i + 1).cast("int"), F.lit(1))
    return F.concat(
        at(lead, F.floor(index / 588)),
        at(vowel, F.floor(index % 588 / 28)),
        F.when(index % 28 == 0, F.lit("")).otherwise(at(tail, index % 28 - 1)),
    )


def fold_constant(text: str) -> str:
    """``fold`` of a Python string, for keywords and request values."""
    for umlaut, spelled in _UMLAUTS:
        text = text.replace(umlaut, spelled)
    return "".join(_fold_char(ch) for ch in text)


# --- tokens -------------------------------------------------------------------------------


def tokenize(c: Column | str) -> Column:
    """Maximal runs of letters and digits, in order."""
    return F.regexp_extract_all(col(c), F.lit(f"{ALNUM}+"), F.lit(0))


def tokenize_constant(text: str) -> list[str]:
    word = lambda ch: ord(ch) <= 0xFFFF and (ch.isalpha() or ch.isdecimal())
    return ["".join(run) for is_word, run in groupby(text, word) if is_word]


def java_quote(text: str) -> str:
    """Regex that matches ``text`` literally."""
    return "".join(ch if ch.isalnum() or ord(ch) > 127 else "\\" + ch for ch in text)


def contains_bounded(c: Column | str, needle: str) -> Column:
    """Whether ``needle`` occurs with no letter or digit directly before or after it."""
    c = col(c)
    return c.contains(needle) & c.rlike(f"(?<!{ALNUM}){java_quote(needle)}(?!{ALNUM})")
