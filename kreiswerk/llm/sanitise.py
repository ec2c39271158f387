"""Personal data: fixed patterns, and words that reveal what they found, by corpus co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import cut

# The patterns of the four kinds. Their quantifiers never give back what they took and a run is tried
# at its first character only; neither changes a match, but long runs are read once.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# What a text has to hold for a valid match; texts without it are not searched.
HOLDS = (r"@[A-Za-z0-9-]++\.", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?:[0-9][\x20-]?){13}[0-9]", r"\+[0-9]")
PATTERNS = (EMAIL, IP, CARD, PHONE)
PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
KINDS = ("email", "ip", "card", "phone", "removed", "general")
MARKS = ("<EMAIL>", "<IP>", "<CARD>", "<PHONE>", "", "<WORD>")
REMOVED, GENERAL = 4, 5

# A term is a word of three letters or more; of those within REACH code points on either side of an
# entity the NEAREST count.
TERM = r"(?<![^\s\"'(])\p{L}{3,}+(?=[.,;:!?)\"']*+(?:\s|$))"
NEAREST, REACH = 8, 160
# Different surroundings in which a term must have met an entity, and the shares of the entity's
# information from which on it is generalised or removed.
SUPPORT, GENERALISE, REMOVE = 3, 0.7, 0.9
BLOCK = 4096


def find_personal(
    docs: DataFrame,
    support: int = SUPPORT,
    generalise: float = GENERALISE,
    remove: float = REMOVE,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id, n_email, n_ip, n_card, n_phone, base and spans (strings).

    The patterns give the base spans; their values (letters lowered, of cards and phones the digits)
    are the entities to protect. What a term t discloses of an entity e is the share of e's
    information that their pointwise mutual information makes up,

        log(n(t, e) N / (n(t) n(e))) / log(N / n(e)),

    with N all rows, n(t) and n(e) those that hold t and e, and n(t, e) those where t is among the
    eight terms before or after a mention of e. A share of 1 means that t stands nowhere but with e.
    Terms with a share of ``remove`` are removed, others with one of ``generalise`` generalised,
    wherever they stand with that entity. Both need ``support`` different surroundings, so copies
    and single uses of a rare word are no evidence. The counts cover all rows.

    Spans are kind:start:end in code points, end exclusive, by start, then kind; removed and general
    are the added kinds. No term overlaps a base span. Null text is empty; null ids and repeated rows
    stay; other columns are ignored; an empty table gives an empty result. ``with_text`` adds the
    text as ``_text``. All steps are SQL functions; mentions are counted before they are shuffled,
    and what is joined are rows per mention, never pairs of rows.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(id_col).cast("long").alias("_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"),
    )
    found = cut(_scanned(rows, with_text), "personal-found")
    mentions = cut(_mentions(found), "personal-mentions")
    terms = cut(_terms(mentions), "personal-terms")
    revealing = cut(_revealing(docs, text_col, mentions, terms, support, generalise, remove), "personal-revealing")
    added = terms.join(revealing.hint("merge"), ["entity", "term"]).groupBy("_row", "at", "stop").agg(F.min("kind").alias("kind"))
    spans = mentions.select("_row", "at", "kind", "stop").unionByName(added).groupBy("_row")
    spans = spans.agg(F.sort_array(F.collect_list(F.struct("at", "kind", "stop"))).alias("s"))
    every = F.coalesce("s", F.array().cast("array<struct<at: long, kind: int, stop: long>>"))
    out = found.join(spans.hint("merge"), "_row", "left").withColumn("s", every)
    of_kind = lambda kind: F.size(F.filter("s", lambda x: x.kind == kind)).cast("long")
    counts = [of_kind(k).alias(f"n_{KINDS[k]}") for k in range(4)]
    base = _listed(F.filter("s", lambda x: x.kind < REMOVED))
    text = ["_text", "s", "_row"] if with_text else []
    return out.select(F.col("_id").alias(id_col), *counts, base.alias("base"), _listed(F.col("s")).alias("spans"), *text)


def _scanned(rows: DataFrame, with_text: bool) -> DataFrame:
    """Rows with ``m``: (kind, pos, n, match, before, after) of all matches.

    ``n`` is the length of the match and of what lies before it, back to the last one, so places are
    running sums of ``n``.
    """
    text = F.col("_text")
    for k, (pattern, holds) in enumerate(zip(PATTERNS, HOLDS, strict=True)):
        none = F.array().cast("array<string>")
        for name, group, at in (("parts", f"(?:{pattern})", 0), ("found", f"({pattern})", 1)):
            all_ = F.regexp_extract_all(text, F.lit(rf"\G(?s:.*?){group}"), F.lit(at))
            rows = rows.withColumn(f"{name}{k}", F.when(text.rlike(holds), all_).otherwise(none))
    for k in range(len(PATTERNS)):
        length = F.aggregate(f"parts{k}", F.lit(0), lambda n, x: n + F.length(x))
        rows = rows.withColumn(f"tail{k}", F.when(F.size(f"parts{k}") > 0, F.substring(text, length + 1, REACH + 1)))

    def of(k: int) -> Column:
        def one(match: Column, i: Column) -> Column:
            part, size = F.get(f"parts{k}", i), F.length(match)
            after = F.coalesce(F.get(f"parts{k}", i + 1), F.col(f"tail{k}"))
            before = F.substring(part, F.greatest(F.lit(1), F.length(part) - size - REACH), F.least(F.length(part) - size, F.lit(REACH + 1)))
            valid = _valid(match, k)
            return F.struct(
                F.lit(k).alias("kind"),
                i.alias("pos"),
                F.length(part).cast("long").alias("n"),
                F.when(valid, match).alias("match"),
                F.when(valid, before).alias("before"),
                F.when(valid, F.substring(after, 1, REACH + 1)).alias("after"),
            )

        return F.transform(f"found{k}", one)

    kept = ["_row", "_id", *(["_text"] if with_text else [])]
    return rows.select(*kept, F.concat(*map(of, range(len(PATTERNS)))).alias("m"))


def _valid(match: Column, kind: int) -> Column:
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return match.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == 3:
        return F.length(digits).between(10, 15)
    return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)


def _luhn(digits: Column) -> Column:
    """Whether the sum of the digits, every second from the right doubled, ends in 0."""
    back = F.reverse(digits)
    digit = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    twice = lambda x: 2 * x - F.when(x > 4, 9).otherwise(0)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, twice(digit(i))).otherwise(digit(i))
    )
    return total % 10 == 0


def _mentions(found: DataFrame) -> DataFrame:
    """(_row, kind, at, stop, entity, before, after) of the valid matches."""
    rows = found.select("_row", F.explode("m").alias("m")).select("_row", "m.*")
    so_far = Window.partitionBy("_row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("stop", F.sum("n").over(so_far)).filter("match is not null")
    value = F.when(F.col("kind") < 2, F.lower("match")).otherwise(F.regexp_replace("match", "[^0-9]", ""))
    return rows.select(
        "_row",
        "kind",
        (F.col("stop") - F.length("match")).alias("at"),
        "stop",
        F.concat_ws(":", F.col("kind").cast("string"), value).alias("entity"),
        "before",
        "after",
    )


def _terms(mentions: DataFrame) -> DataFrame:
    """(_row, entity, term, at, stop, around): the terms near each mention; ``around`` names them all."""
    rows = mentions
    for side in ("before", "after"):
        for name, group, at in (("gaps", f"(?:{TERM})", 0), ("words", f"({TERM})", 1)):
            rows = rows.withColumn(f"{name}_{side}", F.regexp_extract_all(side, F.lit(rf"\G(?s:.*?){group}"), F.lit(at)))

    def placed(side: str) -> Column:
        def one(word: Column, i: Column) -> Column:
            end = F.aggregate(F.slice(f"gaps_{side}", 1, i + 1), F.lit(0), lambda n, x: n + F.length(x))
            return F.struct((end - F.length(word)).alias("a"), end.alias("b"), F.lower(word).alias("term"))

        # A word that touches the far edge of a full window may be part of a longer one.
        found = F.transform(f"words_{side}", one)
        whole = (lambda x: x.a > 0) if side == "before" else (lambda x: x.b < F.length("after"))
        found = F.filter(found, lambda x: (F.length(side) <= REACH) | whole(x))
        first = F.greatest(F.size(found) - NEAREST, F.lit(0)) + 1 if side == "before" else F.lit(1)
        near = F.slice(found, first, NEAREST)
        base = F.col("at") - F.length("before") if side == "before" else F.col("stop")
        return F.transform(near, lambda x: F.struct(x.term.alias("term"), (x.a + base).alias("at"), (x.b + base).alias("stop")))

    rows = rows.select("_row", "entity", F.concat(placed("before"), placed("after")).alias("t"))
    around = F.xxhash64(F.transform("t", lambda x: x.term))
    return rows.withColumn("around", around).select("_row", "entity", F.explode("t").alias("t"), "around").select(
        "_row", "entity", "t.term", "t.at", "t.stop", "around"
    )


def _revealing(
    docs: DataFrame, text_col: str, mentions: DataFrame, terms: DataFrame, support: int, generalise: float, remove: float
) -> DataFrame:
    """(entity, term, kind, share) of the terms that disclose enough."""
    one = F.count(F.lit(1))
    pairs = terms.groupBy("entity", "term", "_row").agg(F.min("around").alias("around"))
    pairs = pairs.groupBy("entity", "term", "around").agg(one.alias("n"))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("n").alias("n_te"), one.alias("support"))
    pairs = cut(pairs.filter(F.col("support") >= support), "personal-pairs")
    entities = mentions.select("entity", "_row").distinct().groupBy("entity").agg(one.alias("n_e"))
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(TERM), F.lit(0)))
    held = docs.select(F.explode(words).alias("term")).groupBy("term").agg(one.alias("n_t"))
    every = docs.agg(one.alias("n"))
    rows = pairs.join(entities.hint("merge"), "entity").join(held.hint("merge"), "term", "left")
    rows = rows.join(F.broadcast(every), F.lit(True))  # one row
    with_t = F.greatest("n_t", "n_te")
    share = F.log(F.col("n_te") / with_t * (F.col("n") / F.col("n_e"))) / F.log(F.col("n") / F.col("n_e"))
    rows = rows.filter("n > n_e").withColumn("share", share).filter(F.col("share") >= generalise)
    kind = F.when(F.col("share") >= remove, REMOVED).otherwise(GENERAL)
    return rows.select("entity", "term", kind.alias("kind"), "share")


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    one = lambda x: F.concat_ws(":", F.get(names, x.kind), x.at.cast("string"), x.stop.cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, spans and text of every row, the text with a mark in place of each span; see :func:`find_personal`.

    Entities become ``<EMAIL>``, ``<IP>``, ``<CARD>`` or ``<PHONE>``, general terms ``<WORD>``, and
    removed ones go. Spans that overlap are replaced together by the mark of the first. The text is
    cut into blocks once, and each part between spans is put together from blocks.
    """
    rows = cut(find_personal(docs, id_col=id_col, text_col=text_col, with_text=True, **options), "personal-rows")
    spans = rows.select("_row", F.explode("s").alias("s")).select("_row", "s.*")
    in_order = Window.partitionBy("_row").orderBy("at", "kind", "stop")
    earlier, until = in_order.rowsBetween(Window.unboundedPreceding, -1), in_order.rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.coalesce(F.col("at") >= F.max("stop").over(earlier), F.lit(True))
    spans = spans.withColumn("fresh", fresh.cast("int")).withColumn("group", F.sum("fresh").over(until))
    merged = spans.groupBy("_row", "group").agg(
        F.min("at").alias("at"), F.max("stop").alias("stop"), F.min(F.struct("at", "kind")).alias("first")
    )
    cuts = merged.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("at", "stop", "first.kind"))).alias("cuts"))
    rows = rows.join(cuts.hint("merge"), "_row", "left")
    rows = rows.withColumn("blocks", F.when(F.col("cuts").isNotNull(), F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))

    def between(a: Column, b: Column) -> Column:
        """Code points from ``a`` to before ``b``."""
        x, y = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
        at = lambda i: F.coalesce(F.get("blocks", i), F.lit(""))
        x_in, y_in = (a - x * BLOCK).cast("int"), (b - y * BLOCK).cast("int")
        middle = F.array_join(F.slice("blocks", x + 2, F.greatest(y - x - 1, F.lit(0))), "")
        apart = F.concat(F.substring(at(x), x_in + 1, F.lit(BLOCK)), middle, F.substring(at(y), F.lit(1), y_in))
        return F.when(x == y, F.substring(at(x), x_in + 1, y_in - x_in)).otherwise(apart)

    marks = F.array(*map(F.lit, MARKS))
    zero = F.lit(0).cast("long")
    start = lambda i: F.coalesce(F.get("cuts", i - 1).stop, zero)
    parts = F.transform("cuts", lambda x, i: F.concat(between(start(i), x.at), F.get(marks, x.kind)))
    tail = between(F.element_at("cuts", -1).stop, F.length("_text").cast("long"))
    text = F.when(F.col("cuts").isNull(), F.col("_text")).otherwise(F.concat(F.array_join(parts, ""), tail))
    return rows.select(id_col, "spans", text.alias("text"))
