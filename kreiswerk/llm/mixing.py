"""Mix sources to target weights by entropy balancing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import cut, free

# Rates are held as whole millionths, so that sums do not depend on the order of their terms.
MILLION = 1_000_000
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, target, one row per source, from rows of (source, size, n).

    Sources by code point, null last, take ``weights`` in turn and share all words. A target stops
    at ``most`` times its source's words; the excess is shared anew by weight. That is the level L
    at which the targets min(cap, L * weight) sum up to all words: sources are capped in the order
    of cap / weight, and L follows from the sums before and after each of them.
    """
    sums = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    rows = sums.withColumn("w", turn).withColumn("cap", F.col("source_size") * most)
    rows = rows.withColumn("breaks", F.col("cap") / F.col("w"))
    order = Window.orderBy("breaks", F.col("source").asc_nulls_last())
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    rows = rows.select(
        "source",
        "source_size",
        "w",
        "cap",
        "breaks",
        (
            (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(below), F.lit(0))) / F.sum("w").over(rest)
        ).alias("if_next"),
    )
    # The first source that its own share does not reach the cap of gives the level of all others.
    level = F.min(F.when(F.col("if_next") <= F.col("breaks"), F.struct("breaks", "if_next"))).over(every)["if_next"]
    share = F.least(F.col("cap").cast("double"), F.col("w") * level)
    return rows.select("source", "source_size", F.coalesce(share, F.col("cap").cast("double")).alias("target"))


def rate(tilt: Column, size: Column, mean: Column, most: int) -> Column:
    """Millionths of a copy: the exponential tilt of one copy, at most ``most`` copies."""
    e = F.least(F.lit(20.0), tilt * (size / mean))
    return F.least(F.lit(most * MILLION).cast("long"), F.round(F.exp(e) * MILLION).cast("long"))


def tilts(sizes: DataFrame, aims: DataFrame, most: int = 3, steps: int = 60, near: float = 1e-7) -> DataFrame:
    """source, source_size, target, mean, tilt: the balancing multipliers.

    Of all rates with sum(rate * size) = target per source and rate <= ``most``, those nearest to one
    copy each in relative entropy are min(most, exp(tilt * size)). The dual is convex with one
    multiplier per source; its gradient is the sum of rate * size less the target, its second
    derivative the sum of rate * size^2 over rates below the bound. Each Newton step is one
    aggregation over (source, size, n), which is far smaller than the documents. A bracket around
    each root catches steps that leave it; such a source takes the middle instead.
    """
    mean = sizes.groupBy("source").agg(
        (F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("mean")
    )
    mean = mean.withColumnRenamed("source", "of")
    state = aims.join(mean, F.col("source").eqNullSafe(F.col("of"))).select(
        "source",
        "source_size",
        "target",
        F.greatest("mean", F.lit(1e-9)).alias("mean"),
        F.lit(0.0).alias("tilt"),
        F.lit(-60.0).alias("low"),
        # A tilt of the bound's logarithm times the mean size brings every document to the bound.
        (F.log(F.lit(float(most))) * F.greatest("mean", F.lit(1.0)) + 1).alias("high"),
        F.lit(1.0).alias("off"),
    )
    state = cut(state, "mix-state")
    for _ in range(steps):
        row = sizes.withColumnRenamed("source", "of").join(state, F.col("of").eqNullSafe(F.col("source")))
        row = row.withColumn("r", rate(F.col("tilt"), F.col("size"), F.col("mean"), most))
        big = lambda c: c.cast("decimal(38,0)")
        words = F.col("size") * F.col("n")
        sums = row.groupBy("source", "source_size", "target", "mean", "tilt", "low", "high").agg(
            F.sum(big(words) * F.col("r").cast("decimal(10,0)")).alias("got"),
            F.sum(
                F.when(F.col("r") < most * MILLION, big(words) * F.col("size") * F.col("r").cast("decimal(10,0)"))
            ).alias("bend"),
        )
        got = F.col("got").cast("double") / MILLION
        over = got - F.col("target")
        bend = F.coalesce(F.col("bend").cast("double"), F.lit(0.0)) / MILLION / F.col("mean")
        low = F.when(over < 0, F.greatest("low", "tilt")).otherwise(F.col("low"))
        high = F.when(over > 0, F.least("high", "tilt")).otherwise(F.col("high"))
        stepped = sums.select(
            "source", "source_size", "target", "mean", "tilt", low.alias("low"), high.alias("high"),
            (F.abs(over) / F.greatest("target", F.lit(1.0))).alias("off"),
            (F.col("tilt") - F.when(bend > 0, over / bend)).alias("newton"),
        )
        inside = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
        moved = F.when(F.col("off") <= near, F.col("tilt")).otherwise(
            F.when(inside, F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2)
        )
        state = cut(stepped.withColumn("tilt", moved).drop("newton"), "mix-state")
        # Beyond the precision of whole millionths a bracket closes without reaching the target.
        open_ = (F.col("off") > near) & (F.col("high") - F.col("low") > 1e-12)
        if not state.filter(open_).limit(1).count():
            break
    return state


def row_key(seed: int, id_col: str, text_col: str, source_col: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col), F.col(source_col))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    seed: int = 11,
    bins: int = 4096,
    tries: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: id, key (of the row), size, source_size, target, rate, copies, taken.

    Rates come from :func:`tilts`. They are rounded at random, but evenly: a copy is added where a
    hash of the row falls below the fraction of its rate. Per source all hashes are moved by one
    shift, which is found from sums over ``bins`` bins and brings the words taken to the target as
    near as the documents of one bin allow; of ``tries`` independent hashes each source takes the
    one that comes nearest. Hot sources are summed before each shuffle; the documents themselves
    move only with id, source and size.

    Null text has size 0, null source is a source of its own and comes last, null ids are allowed;
    repeated rows are rounded alike. Sources without words have target 0. An empty table gives an
    empty result. Everything is computed from whole numbers or in a fixed order, so reruns agree.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(text_col).alias("size"),
        row_key(seed, id_col, text_col, source_col).alias("key"),
    )
    rows = cut(rows, "mix-rows")
    sizes = cut(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    state = tilts(sizes, targets(sizes, weights, most), most).withColumnRenamed("source", "of")
    r = rate(F.col("tilt"), F.col("size"), F.col("mean"), most)
    rated = rows.join(state, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", "size", "source_size", "target", "key", r.alias("rate")
    )
    rated = cut(rated, "mix-rates")
    whole = F.floor(F.col("rate") / MILLION)
    part = F.pmod(F.col("rate"), F.lit(MILLION))
    # A copy is added where part > chance + shift; a document whose rate is whole gains and loses none.
    edge = F.when(part > 0, part - F.pmod(F.xxhash64("key", "try"), F.lit(MILLION)))
    bin_ = F.floor((edge + MILLION) / (2 * MILLION // bins))
    per_bin = (
        rated.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
        .groupBy("source", "target", "try", bin_.alias("bin"))
        .agg(F.sum("size").alias("add"), F.sum(F.col("size") * whole).alias("base"))
    )
    one_try = Window.partitionBy("source", "try")
    from_top = one_try.orderBy(F.col("bin").desc_nulls_first()).rangeBetween(Window.unboundedPreceding, 0)
    # The row without a bin stands first and adds nothing: it is the choice of no further copy.
    reach = per_bin.withColumn("add", F.when(F.col("bin").isNotNull(), F.col("add")).otherwise(0))
    reach = reach.withColumn("words", F.sum("base").over(one_try) + F.sum("add").over(from_top))
    choice = F.struct(F.abs(F.col("words") - F.col("target")).alias("off"), "try", F.coalesce("bin", F.lit(bins)).alias("bin"))
    best = reach.groupBy("source").agg(F.min(choice).alias("best"))
    best = cut(best.select(F.col("source").alias("of"), "best.try", F.col("best.bin").alias("from_bin")), "mix-shift")
    copies = (whole + F.when(bin_ >= F.col("from_bin"), 1).otherwise(0)).cast("int")
    return rated.join(best, F.col("source").eqNullSafe(F.col("of")), "left").select(
        F.col("doc_id").alias(id_col),
        "key",
        "size",
        "source_size",
        "target",
        (F.col("rate") / MILLION).alias("rate"),
        copies.alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
    )


def mixed_rows(
    docs: DataFrame, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mix` takes it; columns of any names kept."""
    key, copies, copy = free(docs, "key", "copies", "copy")
    taken = mix(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    times = taken.filter("copies > 0").groupBy(F.col("key").alias(key)).agg(F.max("copies").alias(copies))
    rows = docs.withColumn(key, row_key(seed, id_col, text_col, source_col))
    rows = rows.join(cut(times, "mix-copies").hint("merge"), key)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(docs.columns)
