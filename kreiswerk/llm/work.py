"""Shared folder for intermediate tables, and small helpers for Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


_SHIPPED: set[str] = set()
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Let executors import this package, also where it is not installed: once per application.

    The driver hands the sources to Spark, which serves them to every executor. Arrow batches are
    kept short, so that workers hold little of their partition at a time.
    """
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    package = Path(__file__).parents[1]
    path = f"{tempfile.mkdtemp(prefix='llm-')}/{package.name}-sources.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in package.rglob("*.py"):
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(path)
    # Rows of one Arrow batch: Spark counts rows only, and texts are long.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    _SHIPPED.add(spark.sparkContext.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors can reach.

    Only a local session that names none gets a folder of its own, once.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/llm/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    Lineage ends here: a lost executor costs a re-read. The files belong to the caller's checkpoint
    folder and may be deleted once the result has been written.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def raw_bytes(column: pa.Array) -> list[bytes]:
    """Strings as UTF-8 bytes, without decoding; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one slice hold about ``most`` bytes, a longer text alone."""
    for batch in batches:
        start = held = 0
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def per_slice(
    rows: Callable[[pa.RecordBatch], pa.RecordBatch], column: str, most: int = 2_000_000
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function that applies ``rows`` to slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, most):
            yield rows(batch)

    return run


def lower_ascii(text: Column | str) -> Column:
    """Lower-case the letters A to Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def starts(counts: DataFrame, number: str, n: str, within: tuple[str, ...] = (), block: int = 4096) -> DataFrame:
    """``counts`` with ``_first``: the sum of ``n`` over all smaller values of ``number``.

    ``number`` counts from 0 and is unique within ``within``. Sums are formed in blocks, then over
    the blocks, so that no task holds more than a 4096th of a long table.
    """
    rows = counts.withColumn("_block", F.floor(F.col(number) / block).cast("int"))
    blocks = rows.groupBy(*within, "_block").agg(F.sum(n).alias("_in_block"))
    before = Window.partitionBy(*within).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*within, "_block", F.coalesce(F.sum("_in_block").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*within, "_block").orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inner", F.coalesce(F.sum(n).over(inner), F.lit(0)))
    return (
        rows.join(blocks, [*within, "_block"])
        .withColumn("_first", F.col("_base") + F.col("_inner"))
        .drop("_block", "_base", "_inner")
    )


def one_of(rows: DataFrame, name: str) -> DataFrame:
    """One row of those with the same ``name``."""
    (at,) = free(rows, "number")
    number = F.row_number().over(Window.partitionBy(name).orderBy(name))
    return rows.withColumn(at, number).filter(F.col(at) == 1).drop(at)


def free(rows: DataFrame, *names: str) -> list[str]:
    """``names`` with so many underscores in front that ``rows`` has no such column."""
    taken = {c.lower() for c in rows.columns}
    found = []
    for name in names:
        while (name := f"_{name}").lower() in taken:
            pass
        found.append(name)
    return found
