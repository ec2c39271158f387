"""One query per operator, each over its whole table."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .class_lm import score_texts
from .exact_dedup import radix_groups
from .fill_middle import fill_in_middle, restored
from .mixing import mix
from .packing import best_fit, token_pieces
from .prefix_trie import KEY, end_digests, no_ends, numbered_turns, prefix_trie, with_shared_heads
from .quality import judge, train
from .registry import query
from .sanitise import find_personal
from .secrets import find_secrets
from .sharding import shuffle_into_shards
from .simhash import near_groups
from .suffix_dedup import remove_repeats
from .warc import captures
from .work import per_slice, raw_bytes

SHARDS = 16
TOKENIZER = "word_bpe_49k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query()
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdict of every document."""
    docs = documents(spark, sf_dir)
    return judge(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query()
def op2_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix(documents(spark, sf_dir))


@query("""
    with d as (
        select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
        from documents
    )
    select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
        doc_id = max(doc_id) over same as kept, sha256(t) as text_sha256
    from d window same as (partition by t)
""")
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts."""
    return radix_groups(documents(spark, sf_dir))


def _base32_sql(hex_digits: str) -> str:
    """SQL for the base32 form of 40 hex digits: five of them are four characters."""
    digit = lambda i: f"(instr('0123456789abcdef', substr({hex_digits}, {i}, 1)) - 1)"
    five = lambda j: " + ".join(f"{digit(5 * j + i + 1)} * {16 ** (4 - i)}" for i in range(5))
    one = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((({bits}) // {unit}) % 32 + 1)::int, 1)"
    return " || ".join(one.format(bits=five(j), unit=32 ** (3 - i)) for j in range(8) for i in range(4))


@query(f"""
    with p as (select page_id, encode(coalesce(html, '')) as b, sha1(coalesce(html, '')) as h from pages),
    d as (select page_id, octet_length(b) as n, {_base32_sql("h")} as digest, max(page_id) over (partition by b) as first from p)
    select page_id, n::bigint as payload_bytes, digest as payload_digest,
        case when page_id = first then 'response' else 'revisit' end as record_type,
        case when page_id <> first then first end as refers_to
    from d
""")
def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of all pages, read back from their archives and merged."""
    found = captures(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    found = find_secrets(documents(spark, sf_dir))
    return found.withColumn("base_sha256", F.sha2("base", 256)).drop("base")


@query()
def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and class-model scores of every document."""
    return score_texts(documents(spark, sf_dir))


@query()
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the strings of 400 bytes that repeat."""
    return remove_repeats(documents(spark, sf_dir)).drop("spans")


@query()
def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in the packed sequences."""
    import public_tokenizers

    packed = best_fit(token_pieces(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER)))
    return packed.withColumn("length", F.col("length").cast("long"))


@query()
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document after the global shuffle, read from the written shards."""
    written = shuffle_into_shards(documents(spark, sf_dir).select("doc_id", "text"), SHARDS)

    def digests(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = raw_bytes(batch.column("text"))
        columns = {
            "doc_id": batch.column("doc_id"),
            "size": pa.array([len(t) + 1 for t in texts], pa.int64()),
            "text_crc32": pa.array([zlib.crc32(t) for t in texts], pa.int64()),
            "shard": batch.column("shard"),
            "slot": batch.column("slot"),
        }
        return pa.RecordBatch.from_pydict(columns)

    rows = written.mapInArrow(
        per_slice(digests, "text"), "doc_id long, size long, text_crc32 long, shard int, slot long"
    )
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query()
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy component of every document."""
    return near_groups(documents(spark, sf_dir))


_CRC_BYTES = "list_transform(range(1, length(c::varchar) + 1), lambda i: ascii(substr(c::varchar, i::int, 1))::bigint)"


def _crc32_sql(bits: int = 8) -> str:
    """SQL for the CRC-32 of the decimal form of ``c``, bit by bit."""
    return f"""xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, {_CRC_BYTES}), lambda a, b:
        list_reduce(list_prepend(xor(a, b), list_transform(range({bits}), lambda i: 0::bigint)),
            lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""


@query(f"""
    with o as (
        select conv_id as c, coalesce(text, '') as t, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) as h,
            row_number() over (partition by conv_id order by turn nulls first,
                sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos
        from conversations where conv_id is not null
    ),
    v as (select c, c - c % 20 as base, {_crc32_sql()} % 4 as head from (select distinct c from o)),
    w as (select v.*, least(head, (select count(*) from o where o.c = v.base)) as taken from v),
    r as (
        select w.c, o.pos as d, o.h, o.t from w join o on o.c = w.base and o.pos <= w.head
        union all
        select w.c, o.pos - w.head + w.taken, o.h, o.t from w join o on o.c = w.c and o.pos > w.head
    ),
    p as (
        select c, d, string_agg(h, '') over (partition by c order by d rows unbounded preceding) as k,
            len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) as words
        from r
        union all select c, 0, '', 0 from w
    ),
    e as (select c, max(d) as length, max_by(k, d) as k from p group by c),
    n as (select d, k, min(c) as conv_id, count(*) as n_convs, any_value(words) as words from p group by d, k),
    x as (
        select n.*, (select count(*) from n as m where m.d = n.d + 1 and starts_with(m.k, n.k)) as n_children,
            (select string_agg(e.c::varchar, ',' order by e.c) from e where e.k = n.k) as ends
        from n
    )
    select a.conv_id, a.d::bigint as depth, any_value(u.conv_id) as parent_conv_id, any_value(a.n_convs)::bigint as n_convs,
        any_value(a.n_children)::bigint as n_children, count(*) filter (b.n_children = 0)::bigint as n_leaves,
        sum((b.n_convs - 1) * b.words)::bigint as saved_tokens, sha256(coalesce(any_value(a.ends), '')) as ends_sha256
    from x as a join x as b on b.d >= a.d and starts_with(b.k, a.k)
    left join n as u on u.d = a.d - 1 and starts_with(a.k, u.k)
    group by a.conv_id, a.d
""")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all conversations, rebuilt with shared heads."""
    turns, convs = with_shared_heads(*numbered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    nodes, ends = prefix_trie(turns, convs)
    rows = nodes.join(end_digests(ends).hint("merge"), KEY, "left")
    rows = rows.withColumn("ends_sha256", F.coalesce("ends_sha256", no_ends()))
    return rows.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


@query("""
    with d as (
        select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(doc_id::varchar, '')) as g from documents
    ),
    u as (
        select doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as l,
            list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(g, i::int, 8))::bigint) as h
        from d
    ),
    f as (
        select doc_id, t, l, len(l) as n, case
            when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 100 then 'plain'
            when h[4] % 100 < 50 then 'spm' else 'psm' end as form,
            least(h[1] % (len(l) + 1), h[2] % (len(l) + 1)) as a, greatest(h[1] % (len(l) + 1), h[2] % (len(l) + 1)) as b
        from u
    ),
    c as (
        select *, array_to_string(l[1:a], '') as x, array_to_string(l[a + 1:b], '') as y, array_to_string(l[b + 1:], '') as z
        from f
    )
    select doc_id, n::bigint as n, form,
        case when form <> 'plain' then length(x) end as prefix_chars, case when form <> 'plain' then length(y) end as middle_chars,
        sha256(case form when 'plain' then t when 'psm' then '<P>' || x || '<S>' || z || '<M>' || y
            else '<S>' || z || '<P>' || x || '<M>' || y end) as output_sha256,
        sha256(t) as restored_sha256
    from c
""")
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut for filling in its middle, with what its output restores to."""
    made = fill_in_middle(documents(spark, sf_dir))
    digests = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(), 256)}
    return made.withColumns(digests).drop("output")


@query()
def op13_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, and the terms that reveal it."""
    found = find_personal(documents(spark, sf_dir))
    return found.withColumn("base_sha256", F.sha2("base", 256)).drop("base")
