"""Write pages as WARC archives, read them back, and merge their indexes into capture histories."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import cut, new_path, per_slice, raw_bytes

# Payload bytes of one archive file, and captures of one range of the merged index.
FILE_BYTES = 16_000_000
CAPTURES_PER_RANGE = 100_000
# Pages have no capture time of their own: a page counts as fetched so many seconds after this.
FIRST_CAPTURE = datetime(2024, 1, 1, tzinfo=UTC)

CAPTURE = (
    "page_id long, url string, urlkey string, timestamp string, record_type string, payload_digest string,"
    " payload_bytes long, refers_to long, run string, offset long, record_bytes long"
)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """Sort key of a URL: host labels from the right, then path and query, in lower case."""
    try:
        parts = urlsplit(url.lower())
        host = ",".join(reversed((parts.hostname or "").removeprefix("www.").split(".")))
    except ValueError:
        return url.lower()
    return f"{host}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def write_archives(
    pages: DataFrame,
    path: str,
    least: int = 0,
    file_bytes: int = FILE_BYTES,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
) -> None:
    """Write one WARC record per row under ``path``, gzipped.

    Of rows with equal payloads of ``least`` bytes or more the one with the largest id is written as
    response, the others as revisits that name it and carry no payload; smaller payloads are all
    responses. Digests are counted before they are shuffled and written, and the rows meet them in a
    join that Spark can split, so thousands of copies of one page stay in no single task. Spark's
    text writer makes the files: a record is a line, and the line end is the blank lines that end a
    record; so any shared file system does, and a lost task is written again.

    A null payload is empty, a null URL is empty, null ids are the smallest and are written as -1;
    repeated rows with the largest id are responses all. Other columns are ignored.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col(id_col).cast("long").alias("_id"),
        F.coalesce(F.col(url_col), F.lit("")).alias("_url"),
        F.col(payload_col).alias("_payload"),
    )

    def digests(batch: pa.RecordBatch) -> pa.RecordBatch:
        payloads = raw_bytes(batch.column("_payload"))
        found = pa.array([digest_of(p) for p in payloads], pa.string())
        sizes = pa.array([len(p) for p in payloads], pa.int64())
        return pa.record_batch([batch.column("_id"), found, sizes], names=["_id", "_digest", "_bytes"])

    def with_digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([digest_of(p) for p in raw_bytes(batch.column("_payload"))], pa.string())
        return batch.append_column("_digest", found)

    known = rows.select("_id", "_payload").mapInArrow(
        per_slice(digests, "_payload"), "_id long, _digest string, _bytes long"
    )
    counts = known.groupBy("_digest").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_first"), F.max("_bytes").alias("_bytes")
    )
    counts = cut(counts, "warc-digests")
    seen = counts.agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_bytes")).alias("bytes")).first()
    per_file = max(1, file_bytes // max(1, (seen["bytes"] or 0) // max(1, seen["n"] or 0) + 500))
    shared = counts.filter((F.col("_n") > 1) & (F.col("_bytes") >= least)).select("_digest", "_first")
    rows = rows.mapInArrow(per_slice(with_digest, "_payload"), "_id long, _url string, _payload string, _digest string")
    rows = rows.join(shared.hint("merge"), "_digest", "left")
    names = ["_id", "_url", "_payload", "_digest", "_first"]

    def records(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [batch.column(c).to_pylist() for c in ("_id", "_url", "_digest", "_first")]
        payloads = raw_bytes(batch.column("_payload"))
        found = [_record(*row, payload) for *row, payload in zip(*columns, payloads, strict=True)]
        return pa.record_batch([pa.array(found, pa.binary()).cast(pa.string())], names=["value"])

    lines = rows.select(*names).mapInArrow(per_slice(records, "_payload"), "value string")
    writer = lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
    writer.option("maxRecordsPerFile", per_file).text(path)
    spark.catalog.refreshByPath(path)


def _name(page: int | None) -> str:
    return f"<urn:page:{-1 if page is None else page}>"


def _record(page: int | None, url: str, digest: str, first: int | None, payload: bytes) -> bytes:
    revisit = first is not None and page != first
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page)}",
        f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}",
        f"WARC-Date: {(FIRST_CAPTURE + timedelta(seconds=max(0, page or 0) % 10**9)).strftime('%Y-%m-%dT%H:%M:%SZ')}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        head += [f"WARC-Refers-To: {_name(first)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block


_URL_SAFE = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c) not in '<>"')


def read_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], dict[str, str], bytes]]:
    """(offset, size, WARC fields, HTTP fields, payload) of each record of an unpacked archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        fields = _fields(data[at:end])
        block = end + 4
        stop = block + int(fields["content-length"])
        body = data.index(b"\r\n\r\n", block, stop) + 4
        yield at, stop - at, fields, _fields(data[block : body - 4]), data[body:stop]
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} does not end where its length says")
        at = stop + 4


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(": ") for line in head.decode().split("\r\n")[1:])
    return {name.lower(): value for name, _, value in pairs}


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives under ``path``: per archive a run sorted by URL key and time.

    Digest and length of a response are computed from the payload that was read, and must be those
    that its fields state; a revisit has those of the full payload in its fields.
    """

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = zlib.decompressobj(31).decompress(content.as_py())
                rows = sorted(map(_capture, read_records(data)), key=_order)
                rows = [(*row[:8], file.rpartition("/")[2], *row[8:]) for row in rows]
                yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(runs, CAPTURE)


def _capture(record: tuple) -> tuple:
    offset, size, fields, http, payload = record
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (digest_of(payload), len(payload)) != (digest, int(http["content-length"])):
        raise ValueError(f"payload of {fields['warc-record-id']} is not what its record states")
    page = _page(fields["warc-record-id"])
    refers = _page(fields["warc-refers-to"]) if kind == "revisit" else None
    time = "".join(c for c in fields["warc-date"] if c.isdigit())
    url = fields["warc-target-uri"]
    return page, url, url_key(url), time, kind, digest, int(http["content-length"]), refers, offset, size


def _page(name: str) -> int | None:
    page = int(name.removeprefix("<urn:page:").removesuffix(">"))
    return None if page == -1 else page


def _order(capture: tuple) -> tuple:
    return capture[2], capture[3], -1 if capture[0] is None else capture[0]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in CAPTURE.split(", ")]
    kinds = [pa.int64() if c.endswith(" long") else pa.string() for c in CAPTURE.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def merge_runs(runs: list[list], key: Callable) -> Iterator:
    """Merge k sorted runs with a loser tree: one comparison per level and row.

    Leaf i belongs to run i; an inner node holds the run that lost the match there, the top the
    overall winner. A run that has ended loses every match.
    """
    k = len(runs)
    at = [0] * k
    heads = [(key(run[0]), i) if run else None for i, run in enumerate(runs)]

    def beats(a: int, b: int) -> bool:
        return heads[b] is None or (heads[a] is not None and heads[a] < heads[b])

    losers = [-1] * max(1, k)

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        winner, losers[node] = (a, b) if beats(a, b) else (b, a)
        return winner

    winner = play(1) if k else -1
    while k and heads[winner] is not None:
        run = runs[winner]
        yield run[at[winner]]
        at[winner] += 1
        heads[winner] = (key(run[at[winner]]), winner) if at[winner] < len(run) else None
        node = (winner + k) // 2
        while node:
            if beats(losers[node], winner):
                winner, losers[node] = losers[node], winner
            node //= 2


def merge_index(index: DataFrame, per_range: int = CAPTURES_PER_RANGE) -> DataFrame:
    """All captures in order of URL key, timestamp and page, from the sorted runs of the archives.

    The runs are written, cut at common splitters into ranges, and each range merges its stretches
    of all runs by a loser tree. A URL with a third of all captures spreads over ranges by time and
    page. ``index_part`` and ``index_row`` give the global order.
    """
    index = cut(index, "cdx-runs")
    ranges = max(1, -(-index.count() // per_range))
    names = index.columns

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        part, runs = TaskContext.get().partitionId(), {}
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                runs.setdefault(row[8], []).append(row)
        for run in runs.values():
            run.sort(key=_order)  # the shuffle brings a run in stretches; each is sorted already
        rows, done = [], 0
        for row in merge_runs([runs[name] for name in sorted(runs)], _order):
            rows.append(row)
            if len(rows) == 10_000:
                yield _numbered(rows, part, done)
                done, rows = done + len(rows), []
        yield _numbered(rows, part, done)

    by = F.coalesce("page_id", F.lit(-1))
    ranged = index.repartitionByRange(ranges, "urlkey", "timestamp", by)
    return ranged.mapInArrow(merged, f"{CAPTURE}, index_part int, index_row long")


def _numbered(rows: list[tuple], part: int, first: int) -> pa.RecordBatch:
    batch = _batch(rows)
    batch = batch.append_column("index_part", pa.array([part] * len(rows), pa.int32()))
    return batch.append_column("index_row", pa.array(range(first, first + len(rows)), pa.int64()))


def captures(pages: DataFrame, least: int = 0, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, read them back and return the merged index."""
    path = path or new_path(pages.sparkSession, "warc")
    write_archives(pages, path, least)
    return merge_index(read_index(pages.sparkSession, path))
