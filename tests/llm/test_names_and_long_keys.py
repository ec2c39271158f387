"""Stage functions on tables whose columns are named like the operators' own, and keys without prose beside them."""

import random

from kreiswerk.llm import exact_dedup, mixing, secrets, sharding, simhash
from kreiswerk.llm.work import ship

CLASHES = ["_name", "_number", "_key", "_copy", "_copies", "_order", "_bucket", "_row", "_id", "_text", "_sha", "_fp", "v", "key", "_n", "_first", "name", "__name"]


def test_names_of_other_columns(spark):
    ship(spark)
    rng = random.Random(2)
    words = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij"]) + str(rng.randint(0, 99)) for _ in range(60)) for _ in range(20)]
    rows = [(i, words[i % 20] if i < 30 else words[i % 20] + " more", "ab"[i % 2], *(f"{c}{i}" for c in CLASHES)) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES))
    plain = frame.select("doc_id", "text", "source")
    whole = {r[0]: r for r in rows}
    for stage in (exact_dedup.drop_copies, simhash.drop_near_copies, mixing.mixed_rows):
        got = stage(frame).collect()
        assert got and all(tuple(r) == whole[r.doc_id] for r in got), stage
        assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in stage(plain).collect()), stage
    shards = sharding.shuffle_into_shards(frame, 4)
    assert set(shards.columns) == {*frame.columns, "shard", "slot"}
    assert sorted(tuple(r) for r in shards.select(frame.columns).collect()) == sorted(rows)


def test_long_keys_in_short_documents(spark):
    ship(spark)
    rng = random.Random(6)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    key = lambda n: "".join(rng.choice(chars) for _ in range(n))
    prose = lambda n: " ".join("".join(rng.choice("abcdeiorstu") for _ in range(rng.randint(1, 7))) for _ in range(n))
    rows = [(i, f"{prose(200)} {key(40)} {prose(20)}") for i in range(60)]
    rows += [(100 + i, key(700)) for i in range(50)] + [(200 + i, "".join(prose(300).split())) for i in range(20)]
    find = lambda x: {r.doc_id: r.spans for r in secrets.find_secrets(spark.createDataFrame(x, "doc_id long, text string")).collect()}
    got = find(rows)
    assert sum("random:0:700" == got[100 + i] for i in range(50)) >= 48
    assert sum("random" in got[i] for i in range(60)) >= 54
    assert sum("random" in got[200 + i] for i in range(20)) <= 3
    alone = find(rows[60:])  # no prose at all: the tests themselves decide
    assert sum("random:0:700" == alone[100 + i] for i in range(50)) >= 45
    assert sum("random" in alone[200 + i] for i in range(20)) == 0
