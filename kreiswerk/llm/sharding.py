"""Global shuffle into shards in two passes."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import cut, free, new_path, starts

# Text bytes that one bucket holds on average; a bucket is shuffled in the memory of one task.
BUCKET_BYTES = 8_000_000
# Buckets that a task of the second pass shuffles, one after the other.
BUCKETS_PER_TASK = 8


def shuffle_into_shards(
    docs: DataFrame,
    shards: int = 16,
    seed: int = 17,
    bucket_bytes: int = BUCKET_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
) -> DataFrame:
    """Write all rows of ``docs`` in a seeded random order, cut into shards, and read them back.

    First pass: a seeded hash of id and text scatters the rows over buckets whose number follows
    the bytes of the table, so each fits into memory; copies of a text differ by their ids. Second pass: each bucket is
    sorted, shuffled by Fisher and Yates with a seed of its own, and written. The order of the
    buckets and the order within them give every row a place among all rows; shards are equal
    stretches of these places, so their counts differ by one at most, and a bucket writes to one or
    two shards only.

    Returned are the columns of ``docs`` with shard and slot, which is the place in the shard from
    0. Null texts and ids are rows like others. Repeated rows, equal in
    id and text, share a bucket and get a place each. Columns named shard or slot are replaced, others may
    have any names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.drop("shard", "slot")
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + 1
    seen = rows.agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    buckets, every = max(1, -(-(seen["bytes"] or 0) // bucket_bytes)), seen["rows"]
    # The digest tells rows apart in a fixed order; it decides no equality.
    order = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    by, in_bucket = free(rows, "order", "bucket")
    schema = rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).schema
    rows = rows.withColumn(by, order).withColumn(in_bucket, F.pmod(F.col(by), F.lit(buckets)))
    counts = rows.groupBy(F.col(in_bucket).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    places = cut(starts(counts, "_bucket", "_n").select("_bucket", "_first"), "shard-places")

    def shuffled(bucket: pa.Table, place_of: pa.Table) -> pa.Table:
        number, first = bucket[in_bucket][0].as_py(), place_of["_first"][0].as_py()
        bucket = bucket.sort_by([(by, "ascending"), (id_col, "ascending")])
        order = list(range(bucket.num_rows))
        random.Random(f"{seed}/{number}").shuffle(order)
        place = [first + i for i in range(len(order))]
        shard = [p * shards // every for p in place]
        slot = [p - -(-s * every // shards) for p, s in zip(place, shard, strict=True)]
        bucket = bucket.take(pa.array(order, pa.int64())).drop_columns([by, in_bucket])
        return bucket.append_column("shard", pa.array(shard, pa.int32())).append_column(
            "slot", pa.array(slot, pa.int64())
        )

    # Tasks follow the buckets, so what one reads does not grow with the table.
    tasks = max(-(-buckets // BUCKETS_PER_TASK), min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    out = rows.repartition(tasks, in_bucket).groupBy(in_bucket).cogroup(places.groupBy("_bucket")).applyInArrow(shuffled, schema)
    path = path or new_path(spark, "shards")
    out.write.partitionBy("shard").parquet(path)
    return spark.read.schema(schema).parquet(path)
