"""Continuous ingestion: each micro-batch of landed crawl files is one ingestion pass."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.ingest import ingest
from ..session import prepare, write_through
from ..sources.crawl import CRAWL_SCHEMA


def stream_ingest(
    spark: SparkSession,
    landed_path: str,
    checkpoint_path: str,
    run: Callable[[DataFrame, datetime, str], object],
    max_files: int | None = None,
) -> StreamingQuery:
    """Process all crawl files landed since the last call, then stop.

    ``run(crawl, now, pass_id)`` is one pass, for example ``ingest_pass(...)``. The time of a pass is the
    newest fetch time in its batch and its id names checkpoint and batch, so a batch that is repeated
    after a failure gives the same result and does not write twice what it had written. The deployer decides how often to call. ``max_files`` bounds the files of one pass; a pass
    sees what earlier ones stored, so the bound does not change which events are found.
    """
    prepare(spark)
    reader = spark.readStream.schema(CRAWL_SCHEMA)
    landed = (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).parquet(landed_path)

    stream = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint_path).hex[:12]

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        crawl = write_through(batch, f"crawl-{batch_id}")
        newest = crawl.agg(F.unix_micros(F.max("fetched_at"))).first()[0]
        if newest is not None:
            run(crawl, datetime.fromtimestamp(newest / 1e6, tz=timezone.utc), f"{stream}-{batch_id}")

    return (
        landed.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )


def ingest_pass(store, registry, robots, keys, postal, **options) -> Callable[[DataFrame, datetime, str], DataFrame]:
    """``run`` for ``stream_ingest`` that shares the batch code path."""

    def run(crawl: DataFrame, now: datetime, pass_id: str) -> DataFrame:
        return ingest(store, registry, crawl, robots, keys, postal, now, pass_id=pass_id, **options)

    return run
