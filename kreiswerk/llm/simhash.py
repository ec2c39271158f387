"""Near-dedup: SimHash fingerprints with pivot distance tables, and shingle sets found by MinHash; components."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .work import cut, free, one_of, per_slice, raw_bytes

SEED = 42
PIVOTS = 8
# MinHash bands of a shingle set and hashes of a band: two sets of Jaccard s agree on one with odds
# 1 - (1 - s^8)^40, 0.9994 at 0.8, however many rows there are.
MIN_BANDS, BAND_HASHES = 40, 8
# So many standard deviations under the similarity may the share of equal MinHashes lie before a
# pair is not compared: one pair in ten millions at the similarity is lost by it.
SLACK = 5.4
_BY, _PLUS = np.random.default_rng(SEED + 2).integers(0, 2**32, (2, MIN_BANDS * BAND_HASHES), np.uint32)
_BY |= np.uint32(1)
# Fingerprints of one bucket that meet in one task at most, and rows a task works on at a time.
BUCKET_ROWS = 4096
ROWS_AT_ONCE = 100_000
# Bytes of shingle sets of one chunk of a bucket, and of the blocks a task works on at a time.
BUCKET_BYTES, BYTES_AT_ONCE = 8_000_000, 48_000_000


def fingerprint(words: list[bytes], shingle: int, lanes: int) -> bytes:
    """The sign of the bit sums over all shingles, repeats included; without words all zero."""
    if not words:
        return bytes(8 * lanes)
    return _signs(_hashes(words, shingle), lanes)


def _signs(first: np.ndarray, lanes: int) -> bytes:
    """The sign of the bit sums over hashes, and in further lanes over what they are mixed to."""
    n = len(first)
    lanes_of = [first, *(_mixed(first, lane) for lane in range(1, lanes))]
    out = []
    for hashes in lanes_of:
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)
        total = np.zeros(64, np.int64)
        for i in range(0, n, 255):  # a sum of 255 bits fits a byte
            total += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
        out.append(np.packbits(2 * total > n).tobytes())
    return b"".join(out)


def _hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """A hash of each shingle of one word or more, repeats included."""
    text, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    of = xxhash.xxh64_digest
    digests = b"".join([of(text[a:b], SEED) for a, b in zip(starts, ends[min(shingle, len(words)) - 1 :], strict=True)])
    return np.frombuffer(digests, ">u8").astype(np.uint64)


def _mixed(x: np.ndarray, lane: int) -> np.ndarray:
    """Another 64 bits from a hash, by the finaliser of SplitMix64."""
    x = x + np.uint64((lane * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(
    docs: DataFrame, shingle: int = 4, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id and fingerprint (8 bytes a lane) of every row; a null text has no words."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(t.lower().split(), shingle, lanes) for t in raw_bytes(batch.column(1))]
        return pa.record_batch([batch.column(0), pa.array(found, pa.binary())], names=["_id", "_fp"])

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return texts.mapInArrow(per_slice(rows, "_text"), "_id long, _fp binary")


def exact_tables(bits: int, radius: int, rows: int) -> list[list[int]]:
    """Bit sets of which any two fingerprints within ``radius`` agree on at least one.

    The bits are cut into blocks; ``radius`` differing bits leave all but ``radius`` blocks equal.
    More blocks mean more but longer keys, so that buckets stay small for any number of rows.
    """
    blocks = radius + 2
    while rows > 2 ** (bits * (blocks - radius) // blocks + 1) and blocks < 2 * radius:
        blocks += 1
    cuts = [bits * i // blocks for i in range(blocks + 1)]
    parts = [list(range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen, []) for chosen in combinations(parts, blocks - radius)]


def near_links(prints: DataFrame, radius: int, lanes: int, tables: list[list[int]]) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that connect all pairs within ``radius`` that share a key.

    Each fingerprint's Hamming distances to a set of reference fingerprints are computed once. It is
    sent to one bucket per table, by its bits there. A bucket is sorted by the first distance; a
    pair is discarded as soon as one coordinate differs by more than ``radius``, which by the
    triangle inequality no near pair does, and the survivors are compared. Of the links a task
    finds only a forest leaves it, so a group of m near copies gives less than m rows.

    A bucket of more than ``BUCKET_ROWS`` rows is cut into chunks, and any two chunks meet in a
    task: no pair is lost and no task holds more than two chunks.
    """
    keys = [np.array(t) for t in tables]
    refs = np.random.default_rng(SEED + 1).integers(0, 2**64, (PIVOTS, lanes), np.uint64, endpoint=False)

    def as_ints(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, lanes)

    def buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 5000):
                fps = whole.column(0).slice(at, 5000)
                ints = as_ints(fps)
                bits = np.unpackbits(ints.astype(">u8").view(np.uint8).reshape(len(fps), -1), axis=1)
                far = np.stack([np.bitwise_count(ints ^ r).sum(axis=1) for r in refs], axis=1).astype(">u2")
                far = pa.array([row.tobytes() for row in far], pa.binary())
                for t, key in enumerate(keys):
                    value = bits[:, key].astype(np.int64) @ (1 << np.arange(len(key), dtype=np.int64))
                    yield pa.record_batch([pa.array(value * len(keys) + t), fps, far], names=["bucket", "fp", "far"])

    rows = cut(prints.mapInArrow(buckets, "bucket long, fp binary, far binary"), "simhash-keys")
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    counts = cut(counts.withColumn("chunks", F.ceil(F.col("n") / BUCKET_ROWS).cast("int")), "simhash-buckets")
    rows = _dealt(rows.join(counts.select("bucket", "chunks").hint("merge"), "bucket"), "fp", ["far"])

    def links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _whole_blocks(batches):
            yield forest(table, group)

    def forest(table: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        if not table.num_rows:
            return pa.record_batch([pa.array([], pa.binary())] * 2, names=["a", "b"])
        fps, far = table["fp"].to_pylist(), b"".join(table["far"].to_pylist())
        ints = np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).reshape(-1, lanes)
        far = np.frombuffer(far, ">u2").astype(np.int32).reshape(-1, PIVOTS)
        nodes, node = np.unique(np.array(fps, f"V{8 * lanes}"), return_inverse=True)
        order = np.lexsort((far[:, 0], group))
        ints, far, node, group = ints[order], far[order], node[order], group[order]
        parent, left, lag = np.arange(len(nodes)), np.arange(len(group)), 0
        while True:
            lag += 1
            left = left[left + lag < len(group)]
            right = left + lag
            left = left[(group[left] == group[right]) & (far[right, 0] - far[left, 0] <= radius)]
            if not len(left):
                break
            a = left
            for p in range(1, PIVOTS):
                a = a[np.abs(far[a, p] - far[a + lag, p]) <= radius]
            a = a[np.bitwise_count(ints[a] ^ ints[a + lag]).sum(axis=1) <= radius]
            _unite(parent, node[a], node[a + lag])
        root = _find(parent, np.arange(len(nodes)))
        linked = np.flatnonzero(root != np.arange(len(nodes)))
        pick = lambda i: pa.array([nodes[k].tobytes() for k in i], pa.binary())
        return pa.record_batch([pick(root[linked]), pick(linked)], names=["a", "b"])

    return rows.mapInArrow(links, "a binary, b binary")


def _dealt(rows: DataFrame, node: str, more: list[str]) -> DataFrame:
    """Rows of buckets of so many ``chunks``, sorted by bucket and block: any two chunks share a block."""
    own = F.pmod(F.xxhash64(node), F.col("chunks")).cast("int")
    every = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda other: F.least(own, other) * F.col("chunks") + F.greatest(own, other),
    )
    rows = rows.select("bucket", F.explode(every).alias("block"), node, *more)
    return rows.repartition("bucket", "block").sortWithinPartitions("bucket", "block")


def _whole_blocks(
    batches: Iterable[pa.RecordBatch], most_bytes: float = float("inf")
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about ``ROWS_AT_ONCE`` rows or ``most_bytes`` that cut no block, with the numbers of their blocks."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS_AT_ONCE or sum(b.nbytes for b in held) >= most_bytes:
            table = pa.Table.from_batches(held).combine_chunks()
            group = _groups(table)
            stop = int(np.searchsorted(group, group[-1]))
            if stop:
                yield table.slice(0, stop), group[:stop]
            held = table.slice(stop).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _groups(table)


def _groups(table: pa.Table) -> np.ndarray:
    """Rising numbers of the blocks of a sorted table."""
    bucket, block = table["bucket"].to_numpy(), table["block"].to_numpy()
    return np.cumsum(np.r_[0, (np.diff(bucket) != 0) | (np.diff(block) != 0)])


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if np.array_equal(up, x):
            return x
        x = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        a, b = _find(parent, a), _find(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def near_groups(
    docs: DataFrame,
    shingle: int = 4,
    radius: int = 4,
    lanes: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id, fingerprint (hex) and component_id of every row of ``docs``.

    Texts are lower-cased in A to Z and cut into words at ASCII white space; their shingles of
    ``shingle`` words, or the whole of a shorter text, are hashed, and fingerprints that differ in
    ``radius`` bits or fewer are linked. ``component_id`` is the smallest id that links reach. With
    :func:`exact_tables` no link is missed.

    Equal fingerprints are one vertex, however many documents have them. A null or empty text has
    the fingerprint zero, which links like any other. Repeated rows give repeated rows; null ids
    are kept and are no component's id unless it has no other. An empty table gives an empty
    result; other columns are ignored.
    """
    rows = cut(fingerprints(docs, shingle, lanes, id_col, text_col), "simhash")
    vertices = cut(rows.groupBy("_fp").agg(F.min("_id").alias("_least")), "simhash-distinct")
    bits = 64 * lanes
    tables = exact_tables(bits, radius, vertices.count())
    roots = components(near_links(vertices.select("_fp"), radius, lanes, tables), "binary")
    of = vertices.join(roots, F.col("_fp") == F.col("node"), "left").select(
        "_fp", "_least", F.coalesce("root", "_fp").alias("_root")
    )
    of = cut(of, "simhash-roots")
    least = cut(of.groupBy("_root").agg(F.min("_least").alias("component_id")), "simhash-least")
    of = cut(of.join(least.hint("merge"), "_root").select("_fp", "component_id"), "simhash-components")
    return rows.join(of.hint("merge"), "_fp").select(
        F.col("_id").alias(id_col), F.lower(F.hex("_fp")).alias("fingerprint"), "component_id"
    )


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted hashes of the different shingles; a text without words has the empty one."""
    return np.unique(_hashes(text.lower().split() or [b""], shingle))


def min_hashes(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """A key for each band of MinHashes of a set, and a byte of each MinHash."""
    low, least = hashes.astype(np.uint32), np.full(len(_BY), 2**32 - 1, np.uint32)
    for i in range(0, len(low), 256):
        least = np.minimum(least, (low[i : i + 256, None] * _BY + _PLUS).min(axis=0))
    of = xxhash.xxh64_digest
    digests = [of(band.tobytes(), i) for i, band in enumerate(least.reshape(MIN_BANDS, BAND_HASHES))]
    return np.frombuffer(b"".join(digests), ">i8").astype(np.int64), least.astype(np.uint8).tobytes()


def shingle_rows(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """id, SHA-256 of the text, digest, size, fingerprint, band keys and MinHash bytes of the shingle set, of every row."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = raw_bytes(batch.column(1))
        sets = [shingle_set(t, shingle) for t in texts]
        found = [min_hashes(x) for x in sets]
        columns = [
            batch.column(0),
            pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
            pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary()),
            pa.array([len(x) for x in sets], pa.int32()),
            pa.array([_signs(x, 1) for x in sets], pa.binary()),
            pa.array([x for x, _ in found], pa.list_(pa.int64())),
            pa.array([x for _, x in found], pa.binary()),
        ]
        return pa.record_batch(columns, names=["_id", "_sha", "v", "size", "fp", "bands", "sketch"])

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    schema = "_id long, _sha string, v binary, size int, fp binary, bands array<long>, sketch binary"
    return texts.mapInArrow(per_slice(rows, "_text"), schema)


def print_pairs(vertices: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of ``vertices`` (v, size, fp) by their fingerprints, see :func:`near_links`.

    Of vertices with equal fingerprints the smallest meets the others; it stands for its fingerprint
    in the links between different ones. Sets whose sizes alone keep them under ``similarity`` make no pair.
    """
    prints = vertices.groupBy("fp").agg(F.min(F.struct("v", "size")).alias("one"))
    prints = cut(prints, "near-prints")
    linked = cut(near_links(prints.select("fp"), radius, 1, exact_tables(64, radius, prints.count())), "near-print-links")
    for end in "ab":
        linked = linked.join(prints.select(F.col("fp").alias(end), F.col("one").alias(f"of_{end}")).hint("merge"), end)
    own = F.struct("v", "size").alias("of_b")
    equal = vertices.join(prints.hint("merge"), "fp").select(F.col("one").alias("of_a"), own).filter("of_a.v <> of_b.v")
    pairs = linked.select("of_a", "of_b").unionByName(equal)
    small, large = F.least("of_a.size", "of_b.size"), F.greatest("of_a.size", "of_b.size")
    pairs = pairs.filter(small >= large * (similarity - 1e-9))
    return pairs.select(F.least("of_a.v", "of_b.v").alias("a"), F.greatest("of_a.v", "of_b.v").alias("b")).distinct()


def set_links(
    vertices: DataFrame, texts_of: Callable[[DataFrame], DataFrame], shingle: int, similarity: float, radius: int
) -> DataFrame:
    """Pairs (a, b) that connect all ``vertices`` (v, size, fp, bands, sketch) of ``similarity`` that share a band.

    Every pair is verified by the sets themselves, which are taken again from the texts that
    ``texts_of`` gives for a table of v. First come the pairs whose fingerprints block keys and pivot
    distances find within ``radius`` bits. Fingerprints of sets of ``similarity`` may lie farther apart,
    so MinHash bands find what these links leave in several parts: each bucket's members meet the one
    that has the most company in all buckets, if they are of another part. Then the buckets that are
    still in several parts bring their sets along, and pairs of different parts are compared in the
    task that holds both: it joins parts as it finds links, and only these leave it, so a large group
    of near copies gives no square of pairs.
    A bucket of many rows or bytes is cut into chunks of which any two meet. Sets whose sizes alone
    keep them under ``similarity`` are not compared, nor in the second step sets whose MinHashes are
    far from it.
    """
    hashes = MIN_BANDS * BAND_HASHES
    fewest = hashes * similarity - SLACK * (hashes * similarity * (1 - similarity)) ** 0.5
    pairs = cut(print_pairs(vertices, radius, similarity), "near-print-pairs")
    keys = vertices.select(F.explode("bands").alias("bucket"), "v", "size")
    counts = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    keys = cut(keys.join(cut(counts, "near-buckets").hint("merge"), "bucket"), "near-keys")
    company = cut(keys.groupBy("v").agg(F.sum("n").alias("company")), "near-company")
    wanted = company.select("v").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("v"))).distinct()
    texts = cut(texts_of(wanted), "near-texts")
    tested = cut(_verified(pairs, texts, shingle, similarity), "near-prints-tested")
    by_print = tested.filter("near").select("a", "b")

    roots = components(by_print, "binary")
    keys = keys.join(company.hint("merge"), "v").join(roots.hint("merge"), F.col("v") == F.col("node"), "left")
    keys = cut(keys.select("bucket", "v", "size", "company", F.coalesce("root", "v").alias("root")), "near-keys")
    centres = keys.groupBy("bucket").agg(F.max(F.struct("company", "v", "size", "root")).alias("c"))
    stars = keys.select("bucket", "v", "size", "root").join(cut(centres, "near-centres").hint("merge"), "bucket")
    small, large = F.least("size", "c.size"), F.greatest("size", "c.size")
    stars = stars.filter((F.col("root") != F.col("c.root")) & (small >= large * (similarity - 1e-9)))
    stars = stars.select(F.least("v", "c.v").alias("a"), F.greatest("v", "c.v").alias("b")).distinct()
    tested = cut(_verified(cut(stars, "near-stars"), texts, shingle, similarity), "near-tested")
    links = by_print.unionByName(tested.filter("near").select("a", "b"))

    roots = components(links, "binary")
    keys = keys.drop("root").join(roots.hint("merge"), F.col("v") == F.col("node"), "left")
    keys = cut(keys.select("bucket", "v", "size", F.coalesce("root", "v").alias("root")), "near-rooted")
    apart = keys.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("size").cast("long") * 8).alias("bytes"), F.min("root").alias("x"), F.max("root").alias("y")
    )
    chunks = F.greatest(F.ceil(F.col("n") / BUCKET_ROWS), F.ceil(F.col("bytes") / BUCKET_BYTES)).cast("int")
    apart = cut(apart.filter("x <> y").select("bucket", chunks.alias("chunks")), "near-apart")
    keys = cut(keys.join(apart.hint("merge"), "bucket"), "near-left")

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_set(t, shingle).tobytes() for t in raw_bytes(batch.column(1))]
        return pa.record_batch([batch.column(0), pa.array(found, pa.binary())], names=["v", "hashes"])

    wanted = texts.join(keys.select("v").distinct().hint("merge"), "v", "left_semi").select("v", "_text")
    wanted = wanted.mapInArrow(per_slice(sets, "_text"), "v binary, hashes binary")
    wanted = cut(wanted.join(vertices.select("v", "sketch").hint("merge"), "v"), "near-sets")
    rows = _dealt(keys.join(wanted.hint("merge"), "v"), "v", ["size", "root", "sketch", "hashes"])

    def rest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _whole_blocks(batches, BYTES_AT_ONCE):
            order = np.lexsort((table["size"].to_numpy(), group))
            table, group = table.take(pa.array(order)), group[order]
            size, v, held = table["size"].to_numpy(), table["v"], table["hashes"]
            root = np.unique(np.array(table["root"].to_pylist(), "V16"), return_inverse=True)[1]
            parent = np.arange(len(group))
            sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(group), hashes)
            set_of = lambda i: np.frombuffer(held[int(i)].as_py(), np.uint64)  # noqa: B023, E731
            ends, left, lag = ([], []), np.arange(len(group)), 0
            while len(left):
                lag += 1
                left = left[left + lag < len(group)]
                right = left + lag
                left = left[(group[left] == group[right]) & (size[left] >= size[right] * (similarity - 1e-9))]
                found = left[_find(parent, root[left]) != _find(parent, root[left + lag])]
                found = found[np.count_nonzero(sketch[found] == sketch[found + lag], axis=1) >= fewest]
                for i in found:
                    x, y = _find(parent, root[[i, i + lag]])
                    if x == y:
                        continue
                    a, b = set_of(i), set_of(i + lag)
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    if both / (len(a) + len(b) - both) >= similarity:
                        parent[max(x, y)] = min(x, y)
                        ends[0].append(v[int(i)].as_py())
                        ends[1].append(v[int(i + lag)].as_py())
            yield pa.record_batch([pa.array(e, pa.binary()) for e in ends], names=["a", "b"])

    return links.unionByName(cut(rows.mapInArrow(rest, "a binary, b binary"), "near-rest"))


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``pairs`` (a, b) with ``near``: whether the shingle sets have a Jaccard of ``similarity``."""

    def compared(batch: pa.RecordBatch) -> pa.RecordBatch:
        near, last, of = [], None, None
        for a, x, y in zip(batch.column(0).to_pylist(), raw_bytes(batch.column(2)), raw_bytes(batch.column(3)), strict=True):
            if a != last:
                last, of = a, shingle_set(x, shingle)
            other = shingle_set(y, shingle)
            both = len(np.intersect1d(of, other, assume_unique=True))
            near.append(both / (len(of) + len(other) - both) >= similarity)
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(near, pa.bool_())], names=["a", "b", "near"])

    for end in "ba":
        pairs = pairs.join(texts.select(F.col("v").alias(end), F.col("_text").alias(f"text_{end}")).hint("merge"), end)
    rows = pairs.select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(per_slice(compared, "text_b"), "a binary, b binary, near boolean")


def drop_near_copies(
    docs: DataFrame,
    shingle: int = 5,
    similarity: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = 4,
) -> DataFrame:
    """``docs`` with one row of each near-copy group, that of the smallest id, all columns kept.

    Rows are near copies when their sets of shingles (see :func:`near_groups`) have a Jaccard of
    ``similarity`` or more; a group is what such pairs connect. Pairs are found by SimHash fingerprints
    of the sets that differ in ``radius`` bits or fewer, with block keys and pivot distances, and
    between the groups these leave by MinHash bands. All are verified by the sets, so nothing goes
    without a partner of that similarity. Equal sets are one vertex, also those of texts without words. Rows are told apart by id and text: rows that
    share an id but are no near copies all stay, rows without an id come last in their group, and of
    repeated rows one stays. Columns may have any names.
    """
    rows = cut(shingle_rows(docs, shingle, id_col, text_col), "near-rows")
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("_id"), F.col("_sha").alias("_sha"))
    same = [F.first(c).alias(c) for c in ("size", "fp", "bands", "sketch")]
    vertices = rows.groupBy("v").agg(*same, F.min(order).alias("least"))
    vertices = cut(vertices, "near-vertices")
    name = lambda id_, sha: F.concat_ws("/", F.coalesce(id_.cast("string"), F.lit("null")), sha)
    of_text = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)

    def texts_of(wanted: DataFrame) -> DataFrame:
        names = vertices.join(wanted.hint("merge"), "v").select("v", name(F.col("least._id"), F.col("least._sha")).alias("_name"))
        texts = docs.select(name(F.col(id_col).cast("long"), of_text).alias("_name"), F.col(text_col).alias("_text"))
        return one_of(texts.join(cut(names, "near-names").hint("merge"), "_name"), "_name").select("v", "_text")

    links = set_links(vertices.select("v", "size", "fp", "bands", "sketch"), texts_of, shingle, similarity, radius)
    roots = components(links, "binary")
    of = vertices.join(roots.hint("merge"), F.col("v") == F.col("node"), "left")
    keep = of.groupBy(F.coalesce("root", "v").alias("root")).agg(F.min("least").alias("least"))
    (own,) = free(docs, "name")
    keep = cut(keep.select(name(F.col("least._id"), F.col("least._sha")).alias(own)), "near-kept")
    named = docs.withColumn(own, name(F.col(id_col).cast("long"), of_text))
    return one_of(named.join(keep.hint("merge"), own), own).select(docs.columns)
