"""Fill-in-the-middle: documents cut at line ends that a Fenwick tree over text blocks finds."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import per_slice, raw_bytes

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
BLOCK_BYTES = 4096
SEED = 7


class BlockCounts:
    """Ends of units and code points of a text, summed over fixed blocks of bytes in a Fenwick tree.

    A unit is a line with its line feed, or what follows the last one. Blocks may begin within a
    code point, which counts where its first byte is.
    """

    def __init__(self, text: bytes, block: int = BLOCK_BYTES):
        self.text, self.block = text, block
        at = np.frombuffer(text, np.uint8)
        starts = np.arange(0, len(text), block)
        self.blocks = len(starts)
        lines = np.add.reduceat(at == 10, starts, dtype=np.int64) if len(text) else np.zeros(0, np.int64)
        points = np.add.reduceat((at & 0xC0) != 0x80, starts, dtype=np.int64) if len(text) else np.zeros(0, np.int64)
        self.line_feeds = int(lines.sum())
        self.units = self.line_feeds + (1 if text and not text.endswith(b"\n") else 0)
        self.lines, self.points = self._tree(lines), self._tree(points)

    def _tree(self, counts: np.ndarray) -> list[int]:
        tree = [0, *counts.tolist()]
        for i in range(1, len(tree)):
            up = i + (i & -i)
            if up < len(tree):
                tree[up] += tree[i]
        return tree

    def end_of(self, units: int) -> int:
        """The byte after so many units."""
        if units == 0:
            return 0
        if units > self.line_feeds:
            return len(self.text)
        # Descend to the last block before which fewer line feeds lie.
        block, left, step = 0, units, 1 << max(0, self.blocks.bit_length() - 1)
        while step:
            if block + step <= self.blocks and self.lines[block + step] < left:
                block += step
                left -= self.lines[block]
            step >>= 1
        at = block * self.block - 1
        for _ in range(left):
            at = self.text.index(b"\n", at + 1)
        return at + 1

    def code_points(self, end: int) -> int:
        """Code points before a byte."""
        block, n = end // self.block, 0
        tail = self.text[block * self.block : end]
        while block:
            n += self.points[block]
            block &= block - 1
        return n + len(tail) - sum(0x80 <= x < 0xC0 for x in tail)


def transform(doc: int | None, text: bytes, rate: int = 100, suffix_first: int = 50, seed: int = SEED) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    counts = BlockCounts(text)
    n = counts.units
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = (counts.end_of(u) for u in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    before = counts.code_points(a)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    lengths = before, counts.code_points(b) - before
    if h[3] % 100 < suffix_first:
        return n, "spm", *lengths, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", *lengths, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(
    docs: DataFrame,
    rate: int = 100,
    suffix_first: int = 50,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, n, form, prefix_chars, middle_chars and the output text.

    ``rate`` per cent of the texts are cut, ``suffix_first`` per cent of these put the suffix first
    (``spm``), the others the prefix (``psm``); all draws come from the id, so reruns agree. The
    units are lines; both cuts lie at their ends and each of the three parts may be empty. A text
    that is empty, not drawn or already holds a sentinel stays ``plain``. Null text is empty. A null
    id draws as an empty one, rows of equal ids draw the same, repeated rows stay, other columns are
    ignored. Every text is cut where it lies, without a shuffle; a task holds one slice at a time.
    """

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1)), strict=True)
        found = [transform(doc, text, rate, suffix_first, seed) for doc, text in texts]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        columns = [pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)]
        return pa.record_batch([batch.column(0), *columns[:4], columns[4].cast(pa.string())], names=names)

    names = ["_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    schema = "_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return texts.mapInArrow(per_slice(rows, "_text"), schema).withColumnRenamed("_id", id_col)


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text that an output was made of.

    No part holds a sentinel, and none arises where parts meet, as ``<`` begins and ``>`` ends every
    one; so each is found where it was put.
    """
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    p, s, m = (x.decode() for x in (PREFIX, SUFFIX, MIDDLE))
    before = lambda x, mark: F.substring_index(x, mark, 1)
    after = lambda x, mark: F.substring_index(x, mark, -1)
    psm = F.concat(after(before(output, s), p), after(output, m), before(after(output, s), m))
    spm = F.concat(before(after(output, p), m), after(output, m), after(before(output, p), s))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
