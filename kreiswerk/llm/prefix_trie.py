"""Trie of conversations by their first turns, with subtree totals rolled up in bands of depth."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import cut

# Depths of one band: a node is exploded to so many ancestors at most, and a conversation of n turns
# takes n / HEIGHT rounds.
HEIGHT = 32
# Turns of one conversation, and ids of one list of ends, that meet in one group at most.
BLOCK_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["d", "p1", "p2"]


def numbered_turns(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Turns (c, part, at, h, words) in order, and (c, part, n, first, before) to number them with.

    ``h`` is the SHA-256 of role and text, so texts are not shuffled. The place of a turn within its
    conversation, from 1, is ``at - first + before + 1``: all turns are sorted by range, and only
    how many turns of a conversation lie in each range is counted, so that a conversation with a
    third of all turns is sorted in many tasks. Turns come by ``turn``, null first; ties by ``h``.
    Null roles and texts are empty. Rows without an id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("c"),
        F.col(turn_col).alias("turn"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("h"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = ["c", "turn", "h", "tie"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("c", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "h", "words")
    rows = cut(rows, "trie-turns")
    parts = rows.groupBy("c", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows, parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def with_shared_heads(rows: DataFrame, parts: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (c, d, h, words, last) and conversations (c, length).

    Conversation c starts with the first ``crc32(c) % most`` turns of conversation ``c - c % every``
    as far as there are any, and goes on with its own turns after as many.
    """
    parts = cut(parts, "trie-parts")
    taken = F.crc32(F.col("c").cast("string")) % most
    convs = parts.groupBy("c").agg(F.sum("n").alias("n"))
    convs = convs.withColumns({"head": taken, "base": F.col("c") - F.col("c") % every})
    lengths = convs.filter(F.col("c") == F.col("base")).select(F.col("c").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(lengths.hint("merge"), "base", "left")
    convs = convs.withColumn("taken", F.least("head", F.coalesce("n_base", F.lit(0))))
    convs = convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0)))
    convs = cut(convs.select("c", "base", "head", "taken", "length"), "trie-conversations")

    per_part = parts.join(convs.hint("merge"), "c")
    placed = rows.join(per_part.hint("merge"), ["c", "part"])
    placed = placed.withColumn("pos", F.col("at") - F.col("first") + F.col("before") + 1)
    own = placed.filter("pos > head").select(
        "c", (F.col("pos") - F.col("head") + F.col("taken")).alias("d"), "h", "words", "length"
    )
    heads = placed.filter((F.col("c") == F.col("base")) & (F.col("pos") < most)).select("base", F.col("pos").alias("d"), "h", "words")
    lent = convs.join(heads.hint("merge"), "base").filter("d <= head").select("c", "d", "h", "words", "length")
    out = own.unionByName(lent).withColumn("last", F.col("d") == F.col("length")).drop("length")
    return cut(out, "trie-rebuilt"), convs.select("c", "length")


def paths(turns: DataFrame) -> DataFrame:
    """(c, d, p1, p2, q1, q2, words, last): the node of each prefix, and its parent's.

    A node is named by its depth and 128 bits, the exclusive or of hashes of all its turns at their
    places. Such sums are formed in blocks of a conversation, then over its blocks.
    """
    z = {f"z{i}": F.xxhash64(F.lit(i), F.col("d"), F.col("h")) for i in (1, 2)}
    rows = turns.withColumns({**z, "block": F.shiftright("d", BLOCK_BITS)})
    inner = Window.partitionBy("c", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"x{i}": F.bit_xor(f"z{i}").over(inner) for i in (1, 2)})
    blocks = turns.withColumns({**z, "block": F.shiftright("d", BLOCK_BITS)}).groupBy("c", "block")
    blocks = blocks.agg(*(F.bit_xor(f"z{i}").alias(f"b{i}") for i in (1, 2)))
    before = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    blocks = blocks.select("c", "block", *(F.coalesce(F.bit_xor(f"b{i}").over(before), zero).alias(f"b{i}") for i in (1, 2)))
    rows = rows.join(blocks.hint("merge"), ["c", "block"])
    rows = rows.withColumns({f"p{i}": F.col(f"x{i}").bitwiseXOR(F.col(f"b{i}")) for i in (1, 2)})
    rows = rows.withColumns({f"q{i}": F.col(f"p{i}").bitwiseXOR(F.col(f"z{i}")) for i in (1, 2)})
    return rows.select("c", "d", "p1", "p2", "q1", "q2", "words", "last")


def prefix_trie(turns: DataFrame, convs: DataFrame, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trie, and (d, p1, p2, conv_id): the node each conversation ends at.

    ``turns`` (c, d, h, words, last) has the turns of each conversation with their depths from 1, h
    telling turns apart; ``convs`` (c, length) has all conversations, those without turns too. A
    node has conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves and
    saved_tokens, summed over its subtree, and its key d, p1, p2. The root, of depth 0, holds all.

    Totals roll up in bands of ``height`` depths. All nodes explode to their ancestors in their own
    band at once, by the path of their smallest member. Then, from the deepest band up, the complete
    totals of a band's roots are summed per parent and added to that parent's ancestors in the band
    above. So no node meets more than ``height`` ancestors, and rounds are depths / ``height``. The
    root's totals are those of the table. Sums are formed before they are shuffled, also where a
    third of all conversations share a node. Without conversations there are no nodes.
    """
    rows = cut(paths(turns), "trie-paths")
    found = rows.groupBy(*KEY).agg(
        F.min("c").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        *(F.first(x).alias(x) for x in ("words", "q1", "q2")),
    )
    found = cut(found, "trie-nodes")
    above = {"d": F.col("d") - 1, "p1": F.col("q1"), "p2": F.col("q2")}
    children = found.select(*(v.alias(k) for k, v in above.items())).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    children = cut(children, "trie-children")
    zero = F.lit(0).cast("long")
    nodes = found.join(children.hint("merge"), KEY, "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = nodes.withColumns(
        {
            "leaves": (F.col("n_children") == 0).cast("long"),
            "saved": (F.col("n_convs") - 1) * F.col("words"),
            "band": F.floor((F.col("d") - 1) / height),
        }
    )
    nodes = cut(nodes, "trie-counted")
    totals = _rolled_up(rows, nodes, height)

    top = convs.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    sums = nodes.agg(
        F.sum((F.col("d") == 1).cast("long")).alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")
    )
    # One row each; the join is of two totals. A root without children is the only leaf.
    root = top.filter("n_convs > 0").join(F.broadcast(sums), F.lit(True)).select(
        *(zero.alias(k) for k in KEY),
        "conv_id",
        F.lit(None).cast("long").alias("parent_conv_id"),
        "n_convs",
        F.coalesce("n_children", zero).alias("n_children"),
        F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce("saved_tokens", zero).alias("saved_tokens"),
    )
    root = cut(root, "trie-root")
    parents = found.select(*KEY, "conv_id").unionByName(root.select(*KEY, "conv_id"))
    parents = parents.select(F.col("d").alias("up"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.withColumn("up", F.col("d") - 1).join(parents.hint("merge"), ["up", "q1", "q2"])
    out = out.join(totals.hint("merge"), KEY).select(root.columns).unionByName(root)
    ends = rows.filter("last").select(*KEY, F.col("c").alias("conv_id")).unionByName(
        convs.filter("length = 0").select(*(zero.alias(k) for k in KEY), F.col("c").alias("conv_id"))
    )
    return out.withColumn("depth", F.col("d")), ends


def _rolled_up(rows: DataFrame, nodes: DataFrame, height: int) -> DataFrame:
    """(d, p1, p2, n_leaves, saved_tokens) of every node below the root."""
    # At most ``height`` nodes of a path lie in one band.
    lines = rows.groupBy("c", F.floor((F.col("d") - 1) / height).alias("band"))
    lines = lines.agg(F.collect_list(F.struct(*KEY)).alias("line"))
    up = nodes.join(lines.hint("merge").withColumnRenamed("c", "conv_id"), ["conv_id", "band"])
    up = up.withColumn("line", F.filter("line", lambda x: x.d <= F.col("d")))
    step = lambda x: x.select("leaves", "saved", F.explode("line").alias("a")).groupBy("a.d", "a.p1", "a.p2")
    summed = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    parts = [cut(step(up).agg(*summed), "trie-bands")]
    deepest = nodes.agg(F.max("band")).first()[0] or 0
    if deepest:
        # Where totals enter a band from below, and which totals leave it.
        doors = cut(up.filter((F.col("d") % height == 0) & (F.col("n_children") > 0)).select(*KEY, "line"), "trie-doors")
        tops = nodes.filter((F.col("band") > 0) & ((F.col("d") - 1) % height == 0)).select(*KEY, "q1", "q2")
        tops = cut(tops.join(parts[0].hint("merge"), KEY), "trie-tops")
    for band in range(deepest, 0, -1):
        full = tops.filter(F.col("d") == band * height + 1)
        if band < deepest:
            add = parts[-1].select(*KEY, F.col("leaves").alias("l"), F.col("saved").alias("s"))
            full = full.join(add.hint("merge"), KEY, "left").withColumns(
                {"leaves": F.col("leaves") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("s", F.lit(0))}
            )
        entering = full.groupBy((F.col("d") - 1).alias("d"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(*summed)
        parts.append(cut(step(entering.join(doors.hint("merge"), KEY)).agg(*summed), "trie-bands"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy(*KEY).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def end_digests(ends: DataFrame) -> DataFrame:
    """(d, p1, p2, ends_sha256): the hash of the comma-joined ids that end at each node, ascending.

    Ids are joined in blocks of 4096 numbers, which are hashed one after the other as they stream by.
    """
    blocks = ends.groupBy(*KEY, F.shiftright("conv_id", BLOCK_BITS).alias("block"))
    blocks = blocks.agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    blocks = blocks.repartition(*KEY).sortWithinPartitions(*KEY, "block")

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done = []
            columns = [batch.column(i).to_pylist() for i in range(3)]
            for key, ids in zip(zip(*columns, strict=True), batch.column(4).to_pylist(), strict=True):
                if key != node:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield rows(done)
        if node is not None:
            yield rows([(*node, digest.hexdigest())])

    def rows(done: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 3 + [pa.string()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    names = [*KEY, "ends_sha256"]
    return blocks.mapInArrow(hashed, "d long, p1 long, p2 long, ends_sha256 string")


def no_ends() -> Column:
    """The digest of a node where nothing ends."""
    return F.lit(hashlib.sha256(b"").hexdigest())
