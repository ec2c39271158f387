"""Brown class-based n-gram model: exchange clustering of words, and smoothed scores of texts."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import cut, per_slice, raw_bytes

# The most frequent words, known by number in every task. All others are clustered and scored too, by
# tables that meet in shuffles.
HEAD_WORDS = 200_000
# Words seen less often tell too little of themselves to shape the classes; they only join one.
LEAST_SEEN = 4
CLASSES = 128
SWEEPS = 8
# Different words, or pairs, that a task holds before it hands them on.
HELD = 1_000_000
# Training tokens whose pairs make up one bucket of the context table, and the most buckets.
BUCKET_TOKENS, MOST_BUCKETS = 2_000_000, 4096
FLOOR = 0.1
FOLDS, HELD_OUT = 7, 2
END = b""


def is_held_out(doc: int | None) -> bool:
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % FOLDS == HELD_OUT


@dataclass
class Head:
    """Frequent words and unigram statistics of the training tokens.

    Words are numbered by frequency; the end token comes next, then one number for all other words.
    """

    words: list[bytes]
    counts: np.ndarray
    tokens: int
    distinct: int
    ends: int

    @property
    def end(self) -> int:
        return len(self.words)

    @property
    def units(self) -> int:
        return len(self.words) + 2

    def numbers(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over the training texts; the empty word is the end token."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1)), strict=True):
                if not is_held_out(doc):
                    held.update(text.lower().split())
                    held[END] += 1
                    if len(held) > HELD:
                        yield rows(held)
                        held = Counter()
        yield rows(held)

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    return texts.mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_of(counts: DataFrame, head: int = HEAD_WORDS, least: int = LEAST_SEEN) -> Head:
    seen = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = counts.filter(F.length("word") == 0).first()
    top = counts.filter((F.length("word") > 0) & (F.col("n") >= least)).orderBy(F.desc("n"), "word").limit(head).toArrow()
    words = [bytes(w) for w in top["word"].to_pylist()]
    return Head(words, np.array(top["n"].to_pylist(), np.int64), seen["n"], seen["v"], ends["n"] if ends else 0)


def _numbered(texts: list[list[bytes]], number: dict[bytes, int]) -> np.ndarray:
    """Numbers of all words, with the end token before the first text and after each."""
    end, other = len(number), len(number) + 1
    flat = [end]
    for words in texts:
        flat += [number.get(w, other) for w in words]
        flat.append(end)
    return np.array(flat, np.int64)


# --- contexts ----------------------------------------------------------------------------------


def _packed(code: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending codes and their counts, compressed."""
    steps = np.diff(code, prepend=0).astype("<i8")
    return pa.compress(steps.tobytes() + n.astype("<i8").tobytes(), "zstd", asbytes=True)


def _unpacked(blob: bytes, rows: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(pa.decompress(blob, 16 * rows, "zstd"), "<i8")
    return np.cumsum(both[:rows]), both[rows:]


def _merged(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(code, return_inverse=True)
    return code, np.bincount(at, n, len(code)).astype(np.int64)


def contexts(texts: DataFrame, head: Head, buckets: int) -> DataFrame:
    """What stands beside each word in the training texts, in two kinds of rows.

    (bucket, rows, blob): counts of units and their neighbours, once for each of both sides, packed
    per bucket of units. (word, a, b): every word that is not frequent, with the numbers of the
    units before and after it.
    """
    units = head.units
    schema = "bucket int, rows int, blob binary, word binary, a int, b int"
    names = ["bucket", "rows", "blob", "word", "a", "b"]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]

    def batch_of(n: int, **columns: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(columns.get(c, [None] * n), k) for c, k in zip(names, kinds, strict=True)], names=names)

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = head.numbers()
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held = none
        for batch in per_slice(lambda b: b, "_text", 8_000_000)(batches):
            docs = zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1)), strict=True)
            split = [t.lower().split() for d, t in docs if not is_held_out(d)]
            flat = _numbered(split, number)
            pair, n = np.unique(flat[:-1] * units + flat[1:], return_counts=True)
            held = _merged(np.r_[held[0], pair], np.r_[held[1], n])
            if len(held[0]) > 4 * HELD:
                yield packed(*held)
                held = none
            words = [w for text in split for w in (*text, END)]
            rare = np.flatnonzero(flat[1:] == units - 1)
            yield batch_of(len(rare), word=[words[i] for i in rare], a=flat[rare].astype(np.int32), b=flat[rare + 2].astype(np.int32))
        yield packed(*held)

    def packed(pair: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        a, b = pair // units, pair % units
        unit, code = np.r_[a, b], np.r_[a * 2 * units + b, (b * 2 + 1) * units + a]
        bucket = unit % buckets
        by = np.lexsort((code, bucket))
        bucket, code, n = bucket[by], code[by], np.r_[n, n][by]
        found, first = np.unique(bucket, return_index=True)
        last = np.r_[first, len(code)][1:]
        blobs = [_packed(code[i:j], n[i:j]) for i, j in zip(first, last, strict=True)]
        return batch_of(len(found), bucket=found.astype(np.int32), rows=(last - first).astype(np.int32), blob=blobs)

    return texts.mapInArrow(counted, schema)


def merged_contexts(parts: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket: the sums of the parts that tasks packed.

    The parts of a bucket come one after the other; held are only the sums so far, at most the pairs
    of the bucket's words.
    """

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting, size = None, [], 0
        for batch in batches:
            for bucket, rows, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != number:
                    if waiting:
                        yield row(number, waiting)
                    number, waiting, size = bucket, [], 0
                waiting.append(_unpacked(blob, rows))
                size += rows
                if size > 2 * HELD and size > 2 * len(waiting[0][0]):
                    waiting = [_merged(*(np.concatenate(c) for c in zip(*waiting, strict=True)))]
                    size = len(waiting[0][0])
        if waiting:
            yield row(number, waiting)

    def row(bucket: int, waiting: list) -> pa.RecordBatch:
        code, n = _merged(*(np.concatenate(c) for c in zip(*waiting, strict=True)))
        columns = [pa.array([bucket], pa.int32()), pa.array([len(code)], pa.int32()), pa.array([_packed(code, n)], pa.binary())]
        return pa.record_batch(columns, names=["bucket", "rows", "blob"])

    rows = parts.filter("bucket is not null").select("bucket", "rows", "blob")
    rows = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(merged, "bucket int, rows int, blob binary")


# --- clustering --------------------------------------------------------------------------------


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _fit(table: np.ndarray) -> float:
    """Log likelihood of the classes' pairs, but for what no move changes."""
    return _f(table).sum() - _f(table.sum(1)).sum() - _f(table.sum(0)).sum()


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """A table of classes from rows (i, j, n); at most its cells reach the driver."""
    rows = parts.groupBy("i", "j").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((size, size))
    table[rows["i"].to_numpy(), rows["j"].to_numpy()] = rows["n"].to_numpy()
    return table


def _cells(table: np.ndarray) -> pa.RecordBatch:
    i, j = np.nonzero(table)
    columns = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(table[i, j].astype(np.int64))]
    return pa.record_batch(columns, names=["i", "j", "n"])


def class_table(near: DataFrame, of: np.ndarray) -> np.ndarray:
    """How often a unit of class j follows one of class i."""
    units, size = len(of), int(of[-1]) + 1

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size * size)
        for batch in batches:
            for rows, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                code, n = _unpacked(blob, rows)
                side, other = code // units, code % units
                after = side % 2 == 0
                table += np.bincount(of[side[after] // 2] * size + of[other[after]], n[after], size * size)
        yield _cells(table.reshape(size, size))

    return _summed(near.select("rows", "blob").mapInArrow(counted, "i int, j int, n long"), size)


def _logs(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per class: log share of each class after it, and of each class before it."""
    after = (table + FLOOR) / (table.sum(1, keepdims=True) + FLOOR * len(table))
    before = (table + FLOOR) / (table.sum(0, keepdims=True) + FLOOR * len(table))
    return np.log(after), np.log(before).T


def best_classes(near: np.ndarray, table: np.ndarray, own: np.ndarray | None, classes: int) -> np.ndarray:
    """The class that suits each word's neighbours best, the word's present class being ``own``, if any.

    ``near`` has per word how often each class follows it, then how often each stands before it. The
    word's own share is taken out of its present class, which has no advantage by it.
    """
    size = len(table)
    after, before = near[:, :size], near[:, size:]
    logs = _logs(table)
    gain = after @ logs[0][:classes].T + before @ logs[1][:classes].T
    if own is not None:
        here = np.zeros(len(near))
        for side, whole in ((after, table[own]), (before, table.T[own])):
            rest = np.maximum(whole - side, 0)
            here += (side * np.log((rest + FLOOR) / (rest.sum(1, keepdims=True) + FLOOR * size))).sum(1)
        gain[np.arange(len(near)), own] = here
    return np.argmax(gain, 1)


def moved(near: DataFrame, of: np.ndarray, table: np.ndarray, sweep: int) -> np.ndarray:
    """The classes after every word, or from the second sweep on every other word, chose its best one."""
    units, size = len(of), len(table)

    def chosen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                code, n = _unpacked(blob, rows)
                side, other = code // units, code % units
                unit, at = np.unique(side // 2, return_inverse=True)
                cell = at * 2 * size + side % 2 * size + of[other]
                beside = np.bincount(cell, n, len(unit) * 2 * size).reshape(len(unit), 2 * size)
                moves = unit < units - 2
                if sweep:
                    moves &= unit % 2 == sweep % 2
                unit = unit[moves]
                best = best_classes(beside[moves], table, of[unit], size - 2)
                columns = [pa.array(unit.astype(np.int32)), pa.array(best.astype(np.int32))]
                yield pa.record_batch(columns, names=["unit", "class"])

    rows = near.select("rows", "blob").mapInArrow(chosen, "unit int, class int").toArrow()
    of = of.copy()
    of[rows["unit"].to_numpy()] = rows["class"].to_numpy()
    return of


def exchange(near: DataFrame, head: Head, classes: int = CLASSES, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """The class of each unit, and how often each class follows each.

    Words start in the class of their rank modulo ``classes``; ends are a class, and all words that
    are not frequent another one for now. In a sweep, tasks hold the contexts of their bucket of
    words and move each word to the class that raises the likelihood of the class bigrams most, to
    first order, as the classes were when the sweep began. Only the classes of the frequent words
    and the table of classes go through the driver. As what its neighbours' moves do to a word's
    context shows in the next sweep only, every other word moves per sweep, and the sweep that
    raises the likelihood no more is taken back and ends the clustering.
    """
    of = np.r_[np.arange(len(head.words)) % classes, classes, classes + 1]
    table = class_table(near, of)
    for sweep in range(sweeps):
        new = moved(near, of, table, sweep)
        new_table = class_table(near, new)
        if _fit(new_table) <= _fit(table):
            break
        of, table = new, new_table
    return of, table


def classed_words(parts: DataFrame, of: np.ndarray, table: np.ndarray, least: int) -> DataFrame:
    """The class of every word that is not frequent, by the same rule from its own contexts.

    Rows with a word: word, i (its class), n. Rows without: how often words of class i that were
    seen ``least`` times or more stand before (side 0) or after (side 1) class j. The contexts of a
    word come one after the other; held are only its counts per class.
    """
    size = len(table)
    names, kinds = ["word", "side", "i", "j", "n"], [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]

    def batch_of(rows: int, **columns: object) -> pa.RecordBatch:
        return pa.record_batch([pa.array(columns.get(c, [None] * rows), k) for c, k in zip(names, kinds, strict=True)], names=names)

    def assigned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, beside = None, np.zeros((0, 2 * size))
        cells = np.zeros((2, size, size))

        def rows(words: list[bytes], near: np.ndarray) -> pa.RecordBatch:
            best, n = best_classes(near, table, None, size - 2), near[:, :size].sum(1)
            settled = n >= least
            np.add.at(cells[0], best[settled], near[settled, :size])
            np.add.at(cells[1], best[settled], near[settled, size:])
            return batch_of(len(words), word=words, i=best.astype(np.int32), n=n.astype(np.int64))

        for batch in _gathered(batches):
            words = batch.column("word").to_pylist()
            new = np.r_[True, [a != b for a, b in zip(words[1:], words, strict=False)]]
            run, first = np.cumsum(new) - 1, np.flatnonzero(new)
            n = batch.column("n").to_numpy()
            near = np.zeros((len(first), 2 * size))
            for side, column in enumerate(("b", "a")):
                cell = run * 2 * size + side * size + of[batch.column(column).to_numpy()]
                near += np.bincount(cell, n, near.size).reshape(near.shape)
            runs = [words[i] for i in first]
            if word is not None and runs[0] == word:
                near[0] += beside[0]
            elif word is not None:
                yield rows([word], beside)
            word, beside = runs[-1], near[-1:]
            yield rows(runs[:-1], near[:-1])
        if word is not None:
            yield rows([word], beside)
        for side, found in enumerate(map(_cells, cells)):
            yield batch_of(found.num_rows, side=np.full(found.num_rows, side, np.int32), **{c: found[c] for c in "ijn"})

    seen = parts.filter("word is not null").groupBy("word", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    seen = seen.repartition("word").sortWithinPartitions("word")
    return seen.mapInArrow(assigned, "word binary, side int, i int, j int, n long")


def _gathered(batches: Iterable[pa.RecordBatch], least: int = 8_000) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= least:
            yield pa.Table.from_batches(held)
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _transitions(table: np.ndarray, cells: list[np.ndarray], rare: np.ndarray, few: np.ndarray, once: int) -> np.ndarray:
    """log10 P(class | class before), now that every word has its class; the last class is that of unseen words.

    Of pairs with one word that is not frequent, ``cells`` tell the class where that word was seen
    often enough. A word seen ``few`` times chose its class by what stands beside it and would
    flatter that class, so what stands beside such words as a whole is shared out by the tokens each
    class has of them. Pairs of two words that are not frequent are shared out by all their tokens,
    ``rare``. Unseen words stand where words seen few times do, as often as those seen ``once``.
    A class seldom seen leans on the shares of all classes.
    """
    size = len(table)
    after, before = cells
    of_all, of_few = (np.r_[n / max(n.sum(), 1), 0, 0] for n in (rare, few))
    counts = table + after + before.T
    counts[-1], counts[:, -1] = 0, 0
    first = np.r_[table[:-1, -1] - before.sum(0)[:-1], 0]
    then = np.r_[table[-1, :-1] - after.sum(0)[:-1], 0]
    both = table[-1, -1] - after[:, -1].sum()
    counts += np.outer(first, of_few) + np.outer(of_few, then) + np.outer(after[:, -1] + both * of_few, of_all)
    counts[:, -1] += (first + both * of_few) * once / max(few.sum(), 1)
    counts[-1] += (then + both * of_all) * once / max(few.sum(), 1)
    shares = (counts.sum(0) + FLOOR) / (counts.sum() + FLOOR * size)
    return np.log10((counts + size * shares) / (counts.sum(1, keepdims=True) + size))


# --- scores ------------------------------------------------------------------------------------


def score_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    head_words: int = HEAD_WORDS,
    least: int = LEAST_SEEN,
    classes: int = CLASSES,
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    The model learns from the texts whose ids' CRC-32 modulo 7 is not 2; every text is scored whole.
    Tokens are the words, lower-cased in A to Z, and an end token. ``base_score`` is the add-one
    unigram score; ``score`` is the sum of log10 P(class | class before) P(word | class), where an
    end stands before the text. Transitions are smoothed by the shares of all classes. A word has its
    share of its class. Unseen words are a class of their own, which stands where words seen once
    stand; each has one part in as many as there are words.

    Every word of the training texts has a class by its contexts. The ``head_words`` most frequent
    ones, seen ``least`` times or more, are clustered among each other by :func:`exchange` and are known to all tasks; every other
    word then takes the class that suits its contexts best, and meets the texts in shuffled joins.
    Null text is empty, a null id counts as empty text for the fold; repeated rows count and are
    scored each; other columns are ignored. Without training tokens every word is unseen.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    head = head_of(cut(word_counts(texts), "lm-words"), head_words, least)
    buckets = max(1, -(-head.tokens // BUCKET_TOKENS), -(-head.units // 4000))
    buckets = min(buckets, MOST_BUCKETS)
    parts = cut(contexts(texts, head, buckets), "lm-parts")
    of, table = exchange(cut(merged_contexts(parts, buckets), "lm-contexts"), head, classes)
    classed = cut(classed_words(parts, of, table, least), "lm-classes")
    words = classed.filter("word is not null").select("word", F.col("i").alias("class"), "n")
    cells = [_summed(classed.filter(F.col("side") == side), len(table)) for side in (0, 1)]
    mass = np.bincount(of[:-2], head.counts, classes) if head.words else np.zeros(classes)
    rare, few, once = np.zeros(classes), np.zeros(classes), 0
    seldom = F.when(F.col("n") < least, F.col("n")).otherwise(0)
    of_class = words.groupBy("class").agg(F.sum("n").alias("n"), F.sum(seldom).alias("few"), F.count_if(F.col("n") == 1).alias("once"))
    for row in of_class.collect():  # a row per class
        rare[row["class"]], few[row["class"]] = row["n"], row["few"]
        once += row["once"]
    mass = mass + rare
    step = _transitions(table, cells, rare, few, once)
    mass_log = np.log10(np.maximum(mass, 1))
    base_of = math.log10(head.tokens + head.distinct + 1)
    unseen = -math.log10(head.distinct + 1)
    state = np.r_[of[:-1], -1]
    emit = np.r_[np.log10(head.counts) - mass_log[of[:-2]], 0.0, 0.0]
    plain = np.r_[np.log10(head.counts + 1.0) - base_of, math.log10(head.ends + 1) - base_of, 0.0]
    end_known = int(head.ends > 0)
    other = head.units - 1

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = head.numbers()
        return per_slice(lambda batch: score_batch(batch, number), "_text")(batches)

    def score_batch(batch: pa.RecordBatch, number: dict[bytes, int]) -> pa.RecordBatch:
        texts = [t.lower().split() for t in raw_bytes(batch.column(1))]
        flat = _numbered(texts, number)
        c, word = state[flat], flat[1:]
        sums = np.cumsum([0, *(len(t) + 1 for t in texts)])
        add = lambda x: np.add.reduceat(x, sums[:-1])
        known = add((word != other).astype(np.int64)) - 1 + end_known
        told = (c[:-1] >= 0) & (c[1:] >= 0)
        every = [w for t in texts for w in (*t, END)]
        rest = np.flatnonzero(word == other)
        items = pa.StructArray.from_arrays(
            [pa.array(rest, pa.int32()), pa.array([every[i] for i in rest], pa.binary()), pa.array(c[rest], pa.int32()), pa.array(c[rest + 2], pa.int32())],
            ["at", "word", "before", "after"],
        )
        ends = np.searchsorted(rest, sums)
        columns = [
            batch.column(0),
            pa.array([is_held_out(d) for d in batch.column(0).to_pylist()], pa.bool_()),
            pa.array(np.diff(sums), pa.int64()),
            pa.array(known, pa.int64()),
            pa.array(add(plain[word])),
            pa.array(add(np.where(told, step[c[:-1], c[1:]], 0) + emit[word])),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items),
        ]
        return pa.record_batch(columns, names=names)

    names = ["_id", "held_out", "n_tokens", "n_known", "base", "class", "rest"]
    schema = (
        "_id long, held_out boolean, n_tokens long, n_known long, base double, class double,"
        " rest array<struct<at: int, word: binary, before: int, after: int>>"
    )

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over the words of a text that are not frequent; a text may come in several batches."""
        last = 0
        for batch in _gathered(batches):
            row, before, after, found, n = (batch.column(c).to_numpy() for c in ("_row", "before", "after", "class", "n"))
            log_n = np.log10(np.maximum(n, 1))
            # What stands before is the word of the row before, unless a frequent word or an end does.
            before = np.where(before < 0, np.r_[last, found[:-1]], before)
            gain = step[before, found] + np.where(n > 0, log_n - mass_log[np.minimum(found, classes - 1)], unseen)
            gain += np.where(after < 0, 0, step[found, after])
            last = found[-1]
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            columns = [
                pa.array(row[first]),
                pa.array(np.add.reduceat((n > 0).astype(np.int64), first)),
                pa.array(np.add.reduceat(np.log10(n + 1.0) - base_of, first)),
                pa.array(np.add.reduceat(gain, first)),
            ]
            yield pa.record_batch(columns, names=["_row", "_known", "_base", "_class"])

    rows = texts.mapInArrow(scored, schema).withColumn("_row", F.monotonically_increasing_id())
    rows = cut(rows, "lm-scores")
    met = rows.select("_row", F.explode("rest").alias("r")).select("_row", "r.*").join(words.hint("merge"), "word", "left")
    met = met.select(
        "_row", "at", "before", "after",
        F.coalesce("class", F.lit(classes + 1)).alias("class"), F.coalesce("n", F.lit(0).cast("long")).alias("n"),
    )
    met = met.repartition("_row").sortWithinPartitions("_row", "at")
    sums = met.mapInArrow(summed, "_row long, _known long, _base double, _class double").groupBy("_row")
    sums = cut(sums.agg(*(F.sum(c).alias(c) for c in ("_known", "_base", "_class"))), "lm-rare-sums")
    score = F.col("class") + F.coalesce("_class", F.lit(0.0))
    return rows.drop("rest").join(sums.hint("merge"), "_row", "left").select(
        F.col("_id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(head.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
