"""Exact dedup by distributed MSD radix partitioning: no digest decides equality."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import cut, free, lower_ascii, one_of, per_slice, raw_bytes

# Bytes of the first digit, and how much wider each following digit is.
FIRST_DIGIT = 64
WIDER = 8


def radix_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: int = FIRST_DIGIT, wider: int = WIDER
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A to Z. Of equal texts the largest id stays.

    Every round splits the groups that are still open by their next digit, a run of successive
    bytes. A group of one row leaves, and so does a group whose texts have ended, as a digit
    shorter than its width says. Digits widen from round to round, so a text of n bytes takes
    log(n) rounds. Rows of one digit are counted before the shuffle, the counts are written, and
    rows meet them in a join that Spark can split: a group with a third of all rows stays in no
    single task. Whole texts are shuffled once; later rounds hold only what has company so far.

    Null text counts as empty; an empty text is a group of its own kind. Null ids are kept as they
    are and come last among equals; repeated rows count as rows, and all rows with the kept id are
    kept. Other columns are ignored. An empty table gives an empty result. A row is told from
    others by its id and its text, so ids may repeat.
    """

    def digits(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.lower() for t in raw_bytes(batch.column(1))]
        return pa.record_batch(
            [
                batch.column(0),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                pa.array([t[:first] for t in texts], pa.binary()),
                pa.array([t[first:] for t in texts], pa.binary()),
            ],
            names=["_id", "_sha", "_digit", "_rest"],
        )

    def first_digits(batch: pa.RecordBatch) -> pa.RecordBatch:
        heads = [t[:first].lower() for t in raw_bytes(batch.column(1))]
        return pa.record_batch([batch.column(0), pa.array(heads, pa.binary())], names=["_id", "_digit"])

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    heads = texts.mapInArrow(per_slice(first_digits, "_text"), "_id long, _digit binary")
    counts = heads.groupBy("_digit").agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_keep"))
    rows = texts.mapInArrow(per_slice(digits, "_text"), "_id long, _sha string, _digit binary, _rest binary")
    step = _split(rows, cut(counts.filter("_n > 1"), "radix-counts"), ["_digit"], F.col("_digit"), first)
    step = cut(step, "radix")
    done, width = [step.filter("_rest is null")], first * wider
    while (open_rows := step.filter("_rest is not null")).limit(1).count():
        rows = open_rows.select(
            "_id",
            "_sha",
            "_group",
            F.substring("_rest", 1, width).alias("_digit"),
            F.expr(f"substring(_rest, {width + 1})").alias("_rest"),
        )
        name = F.concat_ws("/", F.col("_sha"), F.col("_id").cast("string")).cast("binary")
        counts = rows.groupBy("_group", "_digit").agg(
            F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_keep"), F.max(name).alias("_name")
        )
        counts = cut(counts.filter("_n > 1"), "radix-counts")
        step = cut(_split(rows, counts, ["_group", "_digit"], F.col("_name"), width), "radix")
        done.append(step.filter("_rest is null"))
        width *= wider
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def _split(rows: DataFrame, counts: DataFrame, on: list[str], name, width: int) -> DataFrame:
    """Rows with their new group; ``_rest`` is null where the row is settled."""
    open_ = F.col("_n").isNotNull() & (F.length("_digit") == width)
    # One plan at every size: the counts are never broadcast, as their number grows with the rows.
    return rows.join(counts.hint("merge"), on, "left").select(
        "_id",
        "_sha",
        F.when(open_, name).alias("_group"),
        F.when(open_, F.col("_rest")).alias("_rest"),
        F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("_keep"),
        F.coalesce("_n", F.lit(1).cast("long")).alias("_n"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the exact copies, all columns kept; of repeated rows one stays.

    Rows meet the verdict by id and text, and the window that leaves one of repeated rows needs no
    further shuffle. Columns may have any names.
    """
    (own,) = free(docs, "name")
    name = lambda id_, sha: F.concat_ws("/", F.coalesce(F.col(id_).cast("string"), F.lit("null")), sha)
    keep = radix_groups(docs, id_col, text_col).filter("kept")
    keep = cut(keep.select(name(id_col, F.col("text_sha256")).alias(own)).distinct(), "radix-kept")
    sha = F.sha2(lower_ascii(F.coalesce(text_col, F.lit(""))), 256)
    return one_of(docs.withColumn(own, name(id_col, sha)).join(keep.hint("merge"), own), own).select(docs.columns)
