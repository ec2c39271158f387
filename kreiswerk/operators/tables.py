"""Versioned parquet tables in buckets: a merge rewrites only the buckets it touches.

Layout under the table path: ``data/<commit>/bucket=<n>/*.parquet`` and ``manifest/v=<n>/*.json``
with the data folder each bucket is read from. Nothing that a reader may be using is ever
overwritten; a version becomes visible when its manifest is finished, which ``_SUCCESS`` says.

A table has one writer at a time; the caller sees to that. What a killed driver left unfinished is
written anew by the next merge. Data folders that the newest manifest does not name may be deleted.

A merge or an append may carry the id of the pass it belongs to. A pass that is repeated after a
failure finds its id in what it had finished and does not write that again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "bucket int, data string"
# The manifest's row for the pass that wrote it; there is always one, so no manifest is empty.
_PASS = -1


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a job has written all of the folder."""
    mark, files = _file_system(spark, f"{path}/_SUCCESS")
    return files.exists(mark)


class BucketTable:
    """A table keyed by bucket columns. The bucket count bounds the manifest."""

    def __init__(self, spark: SparkSession, path: str, schema: str, bucket_by: Sequence[str], buckets: int = 256):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.bucket_by, self.buckets = list(bucket_by), buckets

    def version(self) -> int:
        """Newest finished version, 0 for a table without any; folder names are listed, nothing is read."""
        folder, files = _file_system(self.spark, f"{self.path}/manifest")
        names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
        for version in sorted((int(n[2:]) for n in names if n.startswith("v=")), reverse=True):
            if finished(self.spark, self._place(version)):
                return version
        return 0

    def last_pass(self) -> str | None:
        """Id of the pass that wrote the newest version."""
        return next((r.data for r in self._rows(self.version()) if r.bucket == _PASS), None)

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """Rows of the newest version, of the given buckets only if any are named."""
        wanted = [r for r in self._manifest(self.version()) if buckets is None or r.bucket in set(buckets)]
        if not wanted:
            return self.spark.createDataFrame([], self.schema).filter(F.lit(False))  # known to be empty: joins fall away
        paths = [f"{self.path}/data/{r.data}/bucket={r.bucket}" for r in wanted]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def merge(
        self, batch: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], pass_id: str | None = None
    ) -> int:
        """Replace the touched buckets by ``combine(their rows, batch)`` and return the version.

        ``batch`` is read twice, so it should be a written table. A batch without rows touches nothing
        and leaves the version as it is; so does one of the pass that wrote the newest version.
        """
        version = self.version()
        if pass_id is not None and version and self.last_pass() == pass_id:
            return version
        touched = [r[0] for r in batch.select(self._bucket()).distinct().collect()]
        if not touched:
            return version
        rows = self._manifest(version)
        commit = uuid.uuid4().hex
        merged = combine(self.read(touched), batch).withColumn("bucket", self._bucket())
        merged.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{commit}")
        written = self._written(commit)
        places = {r.bucket: r.data for r in rows if r.bucket not in set(touched)} | dict.fromkeys(written, commit)
        frame = self.spark.createDataFrame([(_PASS, pass_id), *sorted(places.items())], _MANIFEST).coalesce(1)
        place, files = _file_system(self.spark, self._place(version + 1))
        left_over = files.exists(place) and not finished(self.spark, self._place(version + 1))
        frame.write.mode("overwrite" if left_over else "errorifexists").json(self._place(version + 1))
        return version + 1

    def _written(self, commit: str) -> list[int]:
        """Buckets of a data folder; ``combine`` may have left some without rows."""
        folder, files = _file_system(self.spark, f"{self.path}/data/{commit}")
        names = [f.getPath().getName() for f in files.listStatus(folder)]
        return [int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int").alias("bucket")

    def _place(self, version: int) -> str:
        return f"{self.path}/manifest/v={version}"

    def _manifest(self, version: int) -> list:
        """Buckets of a version and the folders they are read from."""
        return [r for r in self._rows(version) if r.bucket != _PASS]

    def _rows(self, version: int) -> list:
        if version == 0:
            return []
        return self.spark.read.schema(_MANIFEST).json(self._place(version)).collect()


class AppendTable:
    """A log of rows, a folder per pass; readers decide which row of a key counts."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def append(self, rows: DataFrame, pass_id: str | None = None) -> None:
        """Add ``rows``; those of a pass are added once, and anew if a failure cut them off."""
        pass_id = pass_id or uuid.uuid4().hex
        if not self.holds(pass_id):
            rows.write.mode("overwrite").parquet(self._place(pass_id))

    def holds(self, pass_id: str) -> bool:
        return finished(self.spark, self._place(pass_id))

    def of_pass(self, pass_id: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self._place(pass_id))

    def read(self) -> DataFrame:
        columns = [f.split()[0] for f in self.schema.split(", ")]
        try:
            return self.spark.read.schema(f"{self.schema}, pass string").parquet(self.path).select(*columns)
        except AnalysisException as problem:
            if problem.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], self.schema)
            raise

    def _place(self, pass_id: str) -> str:
        return f"{self.path}/pass={pass_id}"
