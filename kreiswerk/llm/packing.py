"""Tokenize documents and pack their pieces into sequences by bulk-synchronous best fit."""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .work import cut, per_slice, raw_bytes, starts

CAPACITY = 2048
# Words and parts a worker remembers the ids of, twice over: what was used since the last time the
# memory was full outlives it, the rest is encoded again when it comes back.
REMEMBERED = 800_000
ROWS_PER_BUCKET = 50_000

# Words of these characters are split as the tokenizer splits them: all are their own NFC form and
# their own lower case but for plain letters, and none is white space or a control character.
_PLAIN = re.compile(r"[\x21-\x7E\xA1-\xFF]+")
_LETTERS, _NUMBERS = "a-z\xAA\xB5\xBA\xDF-\xF6\xF8-\xFF", "0-9\xB2\xB3\xB9\xBC-\xBE"
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")


def _byte_characters() -> dict[int, str]:
    """The character the model has for each byte: itself if printable, else the next one from 256 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in kept)
    return {b: chr(256 + i) for i, b in enumerate(others)}


_BYTES = _byte_characters()


class WordIds:
    """Ids of words as little-endian 32-bit numbers.

    The tokenizer drops white space and never looks across it, so a text's ids are those of its
    words, one after the other. Words repeat; their parts repeat even more, so only parts not seen
    before are encoded.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        self.model = self.tokenizer.model
        self.words, self.old_words = {}, {}
        self.parts, self.old_parts = {}, {}

    def learn(self, texts: list[list[bytes]]) -> dict[bytes, bytes]:
        """The ids of all words of ``texts``, and of others."""
        if len(self.words) > self.remembered:
            self.words, self.old_words = {}, self.words
        if len(self.parts) > self.remembered:
            self.parts, self.old_parts = {}, self.parts
        words, old_words, whole = self.words, self.old_words, []
        for word in set().union(*texts).difference(words):
            if word in old_words:
                words[word] = old_words[word]
                continue
            text = word.decode()
            if word.isalpha():
                words[word] = self._part(text.lower())
            elif _PLAIN.fullmatch(text) and "<|" not in text:
                words[word] = b"".join(map(self._part, _PARTS.findall(text.lower())))
            else:
                whole.append(word)
        found = self.tokenizer.encode_batch([w.decode() for w in whole], add_special_tokens=False)
        words.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(whole, found, strict=True))
        return words

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            ids = self.old_parts.get(part) or self._encode(part)
            self.parts[part] = ids
        return ids

    def _encode(self, part: str) -> bytes:
        """Ids of a part, straight from the model: nothing is left to normalize or split."""
        characters = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTES)
        ids = [token.id for token in self.model.tokenize(characters)]
        return struct.pack(f"<{len(ids)}I", *ids)


_LOADED: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, remembered: int) -> WordIds:
    """This worker's memory for a tokenizer; it outlives the task, as a task's own globals would not."""
    if (path, remembered) not in _LOADED:
        _LOADED[path, remembered] = WordIds(path, remembered)
    return _LOADED[path, remembered]


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    with_ids: bool = False,
    remembered: int = REMEMBERED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the ids themselves (little-endian) if asked for.

    Every text becomes its ids and ``end_id``; what is longer than ``capacity`` is cut into pieces
    of that length and a rest. Null texts count as empty and give one piece with the end id. Null
    ids and repeated rows are kept; other columns are ignored. ``remembered`` words and as many parts
    are kept in a worker's memory, twice over, at 200 bytes each or so; ids do not depend on it.
    """

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.split() for t in raw_bytes(batch.column(1))]
        ids_of = word_ids(tokenizer, remembered).learn(texts)
        end = np.array([end_id], "<u4").tobytes()
        rows = [], [], [], [], [], []
        for doc, words in zip(batch.column(0).to_pylist(), texts, strict=True):
            ids = b"".join([ids_of[w] for w in words]) + end
            for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[start : start + 4 * capacity]
                for column, value in zip(
                    rows, (doc, piece, start // 4, len(part) // 4, zlib.crc32(part), part), strict=True
                ):
                    column.append(value)
        kinds = pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()
        n = 6 if with_ids else 5
        return pa.record_batch([pa.array(c, k) for c, k in zip(rows[:n], kinds, strict=False)], names=names[:n])

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids binary" * with_ids
    out = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(per_slice(pieces, text_col), schema)
    return out.withColumnRenamed("doc_id", id_col)


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Where the pieces of each length go: (length, from rank, to rank, first sequence, offset).

    Sorted pieces and sorted gaps are held as runs of equal values, at most one run of pieces per
    length and one class of gaps per size, however many documents there are. In a superstep every
    waiting length looks up its successor, the smallest gap that holds it, in the gaps as they were
    when the step began. Where several want the same gaps the longer one ranks first, and a shorter
    one never takes gaps that a longer one still waits for. Then gaps are updated. When a superstep
    places nothing, the longest length that waits opens as many sequences as its pieces fill.
    """
    waiting = {length: n for length, n in sorted(counts.items(), reverse=True) if n}
    rank = dict.fromkeys(waiting, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}
    opened, plan = 0, []
    while waiting:
        sizes = sorted(gaps)
        supply = {g: sum(n for _, n in gaps[g]) for g in sizes}
        updates: list[tuple[int, int, int]] = []
        limit = capacity + 1
        for length in list(waiting):
            i = bisect_left(sizes, length)
            if i == len(sizes) or sizes[i] >= limit:
                limit = min(limit, length)
                continue
            gap = sizes[i]
            take = min(waiting[length], supply[gap])
            supply[gap] -= take
            waiting[length] -= take
            while take:
                first, n = gaps[gap].pop()
                if n > take:
                    gaps[gap].append((first + take, n - take))
                    n = take
                plan.append((length, rank[length], rank[length] + n, first, capacity - gap))
                rank[length] += n
                updates.append((gap - length, first, n))
                take -= n
            if not supply[gap]:
                del sizes[i], gaps[gap]
            if waiting[length]:
                limit = min(limit, length)
            else:
                del waiting[length]
        if not updates:
            longest = next(iter(waiting))
            n = -(-waiting[longest] // (capacity // longest))
            updates.append((capacity, opened, n))
            opened += n
        for gap, first, n in updates:
            if gap:
                insort(gaps.setdefault(gap, []), (first, n))
    return plan


def best_fit(pieces: DataFrame, capacity: int = CAPACITY, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` with sequence_id and offset; their ``length`` must lie between 1 and ``capacity``.

    Pieces are ranked within their length: a hash of ``keys`` deals them over buckets, buckets are
    counted and numbered on, and rows are numbered within their bucket, so that a length that a
    third of all pieces has stays in no single task. Only the number of pieces per length, at most
    ``capacity`` numbers, goes through the driver, see :func:`best_fit_plan`. Offsets have no
    gaps. Repeated rows and null keys are placed like others; an empty table gives an empty result.
    """
    pieces = cut(pieces, "pieces")
    names = pieces.columns
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    tos, moves = {}, {}
    for length, moved in groupby(sorted(best_fit_plan(counts, capacity)), key=lambda move: move[0]):
        moved = np.array(list(moved))
        tos[length], moves[length] = moved[:, 2], np.stack([moved[:, 3] - moved[:, 1], moved[:, 4]], axis=1)
    buckets = max(1, -(-sum(counts.values()) // ROWS_PER_BUCKET))
    rows = pieces.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    per_bucket = rows.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    firsts = cut(starts(per_bucket, "_b", "_n", ("length",)).select("length", "_b", "_first"), "piece-ranks")
    in_bucket = F.row_number().over(Window.partitionBy("length", "_b").orderBy(*keys)) - 1
    rows = rows.withColumn("_rank", in_bucket).join(firsts, ["length", "_b"])
    rows = rows.select(*names, (F.col("_first") + F.col("_rank")).cast("long").alias("_rank"))

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for value in np.unique(length):
                here = length == value
                move = moves[int(value)][np.searchsorted(tos[int(value)], rank[here], side="right")]
                sequence[here], offset[here] = rank[here] + move[:, 0], move[:, 1]
            columns = [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)]
            yield pa.record_batch(columns, names=[*names, "sequence_id", "offset"])

    schema = pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return rows.mapInArrow(placed, schema)
