"""Remove every byte covered by a string that repeats anywhere, by suffix arrays of shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffix_array import permuted_lcp, suffix_array
from .work import cut, per_slice, raw_bytes

LENGTH = 400
# Bytes whose hash picks the anchor of a window, and window starts that are handled at a time.
GRAM = 24
CHUNK = 1 << 16
# Pieces of one anchor that one shard may hold, and bytes of one shard.
HOT_PIECES = 2000
SHARD_BYTES = 4_000_000
# Spread of the window starts of a piece: the first holds all windows of an anchor, and those of hot
# anchors are cut into narrower ones, at last into single windows.
WIDTHS = 64, 8, 1

_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 17) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@lru_cache(2)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, n), _powers(pow(_BASE, -1, 2**64), n)


def anchors(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, anchor, first start, last start) of the windows of ``data``, by their anchor.

    The anchor of a window of ``length`` bytes is the leftmost of its smallest gram hashes. It
    depends on the window's bytes alone, so equal windows have equal anchors at equal offsets, and
    each window belongs to exactly one anchor.
    """
    n, gram = len(data) - length + 1, min(GRAM, max(1, length // 2))
    up, down = _tables(CHUNK + length)
    found: list[tuple[np.ndarray, ...]] = []
    span = length - gram + 1
    for at in range(0, max(0, n), CHUNK):
        b = np.frombuffer(data, np.uint8, min(CHUNK, n - at) + length - 1, at).astype(np.uint64)
        sums = np.r_[np.uint64(0), np.cumsum(b * up[: len(b)])]
        x = (sums[gram:] - sums[:-gram]) * down[: len(b) - gram + 1]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        least = (x & ~_LOW) | np.arange(len(x), dtype=np.uint64)
        held = 1
        while held * 2 <= span:
            least = np.minimum(least[:-held], least[held:])
            held *= 2
        if held < span:
            least = np.minimum(least[: held - span], least[span - held :])
        place = (least & _LOW).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        found.append((x[place[first]], place[first] + at, first + at))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    key, anchor, first = (np.concatenate(c) for c in zip(*found, strict=True))
    new = np.r_[True, anchor[1:] != anchor[:-1]]  # a chunk may go on with the anchor of the one before
    key, anchor, first = key[new], anchor[new], first[new]
    return key.view(np.int64), anchor, first, np.r_[first[1:], n] - 1


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, and the spans.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same
    text or another. Texts are UTF-8 bytes, and matches never cross them.

    The windows of a text are dealt to anchors, see :func:`anchors`, and only anchors that recur are
    followed. The stretch of an anchor's windows is a piece; equal pieces are counted before any
    byte is shuffled, so thousands of copies are one piece that repeats. Different pieces of one
    anchor meet in a shard, whose suffix array is induced and whose permuted common prefixes tell
    the windows that repeat. An anchor with more than ``HOT_PIECES`` different pieces is cut into
    narrower pieces keyed by the bytes that their windows share, down to single windows, which
    repeat if they are counted twice: no group stays in one task, and nothing is capped.

    Null text counts as empty. Rows are told apart by id and text; repeated rows repeat each
    other's strings. Null ids stay; other columns are ignored. ``spans`` lists the removed runs as
    start:end, joined by commas.
    """
    uid = F.xxhash64(id_col, text_col).alias("uid")
    texts = docs.select(uid, F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def anchored(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: list[list] = [[], [], [], [], []]
        digests = []
        for row, text in zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1)), strict=True):
            key, anchor, first, last = anchors(text, length)
            for column, values in zip(columns, (key, np.full(len(key), row), anchor, first, last), strict=True):
                column.append(values)
            of = xxhash.xxh3_128_digest
            digests += [of(text[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)]
        arrays = [pa.array(np.concatenate(c).astype(np.int64) if c else [], pa.int64()) for c in columns]
        return pa.record_batch([*arrays, pa.array(digests, pa.binary())], names=names)

    names = ["key", "uid", "anchor", "first", "last", "same"]
    schema = "key long, uid long, anchor long, first long, last long, same binary"
    found = cut(texts.select("uid", "_text").mapInArrow(per_slice(anchored, "_text"), schema), "anchors")
    often = cut(found.groupBy("key").count().filter("count > 1").select("key"), "anchor-keys")
    rows = cut(found.join(often.hint("merge"), "key"), "anchors-again")
    spans, shards = [], []
    for width in (*(w for w in WIDTHS if w < length), 0):
        alike, pieces = _compare(rows, length)
        spans.append(alike)
        if "bytes" not in pieces.columns:
            pieces = _with_bytes(pieces, texts, length)
        pieces = cut(pieces, "pieces")
        shards.append(pieces.filter(F.col("pieces") <= HOT_PIECES))
        hot = pieces.filter(F.col("pieces") > HOT_PIECES)
        if not width or not hot.limit(1).count():
            break
        rows = cut(_narrower(hot, width, length), "anchors-narrow")
    spans += [_repeats(s, length) for s in shards]
    every = spans[0]
    for s in spans[1:]:
        every = every.unionByName(s)
    lists = cut(every.groupBy("uid").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans")), "spans")
    whole = texts.join(lists.hint("merge"), "uid", "left").select("_id", "_text", "spans")
    return _kept(whole).withColumnRenamed("_id", id_col)


def _compare(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Spans of equal pieces, and one of each piece whose anchor has different ones."""
    carried = [c for c in ("bytes",) if c in rows.columns]
    one = F.min(F.struct("uid", "anchor", "first", "last", *carried)).alias("one")
    kinds = cut(rows.groupBy("key", "same").agg(F.count(F.lit(1)).alias("n"), one), "piece-kinds")
    repeated = kinds.filter("n > 1").select("key", "same")
    alike = rows.join(repeated.hint("merge"), ["key", "same"]).select(
        "uid", F.col("first").alias("start"), (F.col("last") + length).alias("stop")
    )
    many = cut(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("pieces")).filter("pieces > 1"), "piece-counts")
    return cut(alike, "spans-alike"), kinds.join(many.hint("merge"), "key").select("key", "pieces", "n", "one.*")


def _with_bytes(pieces: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """Pieces with their bytes, read from the texts that hold any."""
    wanted = pieces.groupBy("uid").agg(F.collect_list(F.struct("key", "pieces", "n", "anchor", "first", "last")).alias("p"))
    # Equal rows give their pieces once each; they are repeated as wholes already, and shards take one.
    found = texts.join(cut(wanted, "pieces-wanted").hint("merge"), "uid").select("uid", "_text", "p")

    def sliced(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for uid, text, wanted in zip(batch["uid"].to_pylist(), raw_bytes(batch["_text"]), batch["p"].to_pylist(), strict=True):
            rows += [
                (p["key"], p["pieces"], p["n"], uid, p["anchor"], p["first"], p["last"], text[p["first"] : p["last"] + length])
                for p in wanted
            ]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 8
        return pa.record_batch(
            [*(pa.array(c, pa.int64()) for c in columns[:7]), pa.array(columns[7], pa.binary())], names=names
        )

    names = ["key", "pieces", "n", "uid", "anchor", "first", "last", "bytes"]
    schema = "key long, pieces long, n long, uid long, anchor long, first long, last long, bytes binary"
    return found.mapInArrow(per_slice(sliced, "_text", 2_000_000), schema)


def _narrower(pieces: DataFrame, width: int, length: int) -> DataFrame:
    """Pieces cut by the offset of their windows to the anchor, keyed by the bytes all windows share."""

    def parts(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        columns = [batch[c].to_pylist() for c in ("key", "uid", "anchor", "first", "last", "bytes")]
        for key, uid, anchor, first, last, data in zip(*columns, strict=True):
            for number in range((anchor - last) // width, (anchor - first) // width + 1):
                # Offsets of this part: number * width and the width - 1 after it.
                a, b = max(first, anchor - number * width - width + 1), min(last, anchor - number * width)
                low, high = anchor - number * width, anchor - number * width - width + 1 + length
                name = b"%d/%d/%d/" % (key, width, number) + data[low - first : high - first]
                of = data[a - first : b + length - first]
                new = int.from_bytes(xxhash.xxh3_64_digest(name), "big", signed=True)
                out.append((new, uid, anchor, a, b, xxhash.xxh3_128_digest(of), of))
        columns = list(zip(*out, strict=True)) if out else [()] * 7
        kinds = [pa.int64()] * 5 + [pa.binary()] * 2
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    names = ["key", "uid", "anchor", "first", "last", "same", "bytes"]
    schema = "key long, uid long, anchor long, first long, last long, same binary, bytes binary"
    return pieces.mapInArrow(per_slice(parts, "bytes", 1_000_000), schema)


def _repeats(pieces: DataFrame, length: int) -> DataFrame:
    """Spans of the windows that repeat among the different pieces of each anchor."""

    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        key = None
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("key", "n", "uid", "first", "last", "bytes")]
            for k, n, uid, first, last, data in zip(*columns, strict=True):
                if k != key and size >= SHARD_BYTES:
                    yield spans(held)
                    held, size = {}, 0
                key = k
                if (uid, first) not in held:
                    held[uid, first] = n, last, data
                    size += len(data)
        if held:
            yield spans(held)

    def spans(held: dict) -> pa.RecordBatch:
        again = repeated_starts([data for _, _, data in held.values()], length)
        uids, starts, stops = [], [], []
        for ((uid, first), (n, last, _)), at in zip(held.items(), again, strict=True):
            at = at[at <= last - first] + first
            if n > 1 or not len(at):
                continue  # pieces that stand twice are gone as a whole already
            edge = np.flatnonzero(np.r_[True, np.diff(at) > length])
            uids += [uid] * len(edge)
            starts += at[edge].tolist()
            stops += (np.r_[at[edge[1:] - 1], at[-1]] + length).tolist()
        return pa.record_batch([pa.array(c, pa.int64()) for c in (uids, starts, stops)], names=["uid", "start", "stop"])

    rows = pieces.select("key", "n", "uid", "first", "last", "bytes")
    rows = rows.repartition("key").sortWithinPartitions("key", "uid", "first")
    return cut(rows.mapInArrow(shards, "uid long, start long, stop long"), "spans-shards")


def repeated_starts(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """Per piece, the starts of its strings of ``length`` bytes that start elsewhere among the pieces too."""
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes + 1)
    text = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8).astype(np.uint16) + 2
    text[ends - 1] = 1  # no byte equals the mark between pieces
    text = np.r_[text, np.uint16(0)]
    order = suffix_array(text)
    lcp, before = permuted_lcp(text, order)
    # Between equal strings no mark stands, unless the strings hold it: those are no strings of a piece.
    left = np.repeat(ends - 1, sizes + 1) - np.arange(len(text) - 1)
    here = np.flatnonzero((lcp[:-1] >= length) & (left >= length))
    again = np.zeros(len(text), bool)
    again[here] = True
    again[before[here]] = True
    return [np.flatnonzero(again[e - 1 - s : e - 1]) for e, s in zip(ends, sizes, strict=True)]


def _kept(whole: DataFrame) -> DataFrame:
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, spans in zip(raw_bytes(batch["_text"]), batch["spans"].to_pylist(), strict=True):
            runs: list[list[int]] = []
            for span in spans or ():
                if runs and span["start"] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], span["stop"])
                else:
                    runs.append([span["start"], span["stop"]])
            edges = [0, *(x for run in runs for x in run), len(text)]
            kept = b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
            listed = ",".join(f"{a}:{b}" for a, b in runs)
            out.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), listed))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.record_batch([batch["_id"], *arrays], names=names)

    names = ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    schema = "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string"
    whole = whole.withColumn("_id", F.col("_id").cast("long"))
    return whole.mapInArrow(per_slice(rows, "_text"), schema)
