"""The prefix trie and the fill-in-middle cuts against plain Python, awkward rows included."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from kreiswerk.llm import fill_middle, prefix_trie
from kreiswerk.llm.work import ship
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id long, turn int, role string, text string, depth string, c string, d string, length string, part string"


def conversations():
    rng = random.Random(5)
    rows = [(c, t, "user" if t % 2 == 0 else "model", rng.choice(["hi", "hi there", "Größe ß ok"])) for c in range(70) for t in range(rng.randint(1, 6))]
    rows = [r for r in rows if r[0] not in (20, 45)]  # no base for 21 to 39
    rows += [(c, t, "user", f"one of many {t}") for c in range(100, 140) for t in range(5)]  # copies
    rows += [(200, t, "user", f"long {t}") for t in range(60)]  # a deep one, with company to depth 40
    rows += [(220 + 20 * i, t, "user", f"long {t}") for i in range(2) for t in range(40)]
    rows += [(41, None, None, None), (41, None, "user", "null turn"), (42, 0, "user", "tie a"), (42, 0, "user", "tie b")]
    rows += [(43, 1, "user", "repeated"), (43, 1, "user", "repeated"), (None, 0, "user", "nobody's"), (44, 0, "user", "w " * 50_000)]
    rows += [(-3, 0, "user", "negative"), (-20, 0, "user", "negative base")]
    return rows


def brute(rows, every=20, most=4):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [(x[3], x[4]) for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % every) * (1 if c >= 0 else -1)
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, of in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(of) - 1) * len(WORD.findall(node[-1][1])) if node else 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (of[0], len(n), members[n[:-1]][0] if n else None, len(of), children.get(n, 0), leaves[n], saved[n], sha(ends[n]))
        for n, of in members.items()
    )


def built(frame, height):
    turns, convs = prefix_trie.with_shared_heads(*prefix_trie.numbered_turns(frame))
    nodes, ends = prefix_trie.prefix_trie(turns, convs, height)
    rows = nodes.join(prefix_trie.end_digests(ends), prefix_trie.KEY, "left")
    rows = rows.withColumn("ends_sha256", F.coalesce("ends_sha256", prefix_trie.no_ends()))
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted(tuple(r) for r in rows.select(*names).collect())


@pytest.mark.parametrize("height", [1, 7, 32])
def test_trie(spark, height, monkeypatch):
    ship(spark)
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 4)  # many blocks per conversation and per list of ends
    rows = conversations() if height > 1 else [r for r in conversations() if (r[0] or 0) < 200]
    frame = spark.createDataFrame([(*r, *"abcde") for r in rows], TURNS).repartition(5)
    assert built(frame, height) == brute(rows)


def test_trie_of_nothing(spark):
    ship(spark)
    assert built(spark.createDataFrame([], TURNS), 32) == []


DOCS = [
    (1, "a\nb\nc"),
    (2, "a\nb\nc\n"),
    (3, None),
    (4, ""),
    (None, "no id\nat all"),
    (5, "\n" * 9000),
    (6, "has <P> in it\n"),
    (7, "<\nP>\n<S\n>\n<<M\n>M>"),
    (8, "Größe ß\n日本語\n" * 3000),
    (8, "Größe ß\n日本語\n" * 3000),
    (9, "x" * 300_000),
    (10, "one line"),
    *[(100 + i, "".join(random.Random(i).choice("ab\né日<>PSM") for _ in range(50 * i))) for i in range(40)],
]


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_block_counts(block):
    for _, text in DOCS:
        text = (text or "")[:2000]
        lines, raw = re.findall("[^\n]*\n|[^\n]+", text), text.encode()
        counts = fill_middle.BlockCounts(raw, block)
        assert counts.units == len(lines)
        for u in {0, 1, len(lines) // 3, len(lines)} & set(range(len(lines) + 1)):
            head = "".join(lines[:u])
            assert counts.end_of(u) == len(head.encode())
            assert counts.code_points(counts.end_of(u)) == len(head)


def test_fill_in_middle(spark):
    ship(spark)
    frame = spark.createDataFrame([(*r, *"nfop") for r in DOCS], "doc_id long, text string, n string, form string, output string, _text string")
    made = fill_middle.fill_in_middle(frame.repartition(3))
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", fill_middle.restored()).collect()
    want = []
    for i, text in DOCS:
        text = text or ""
        lines = re.findall("[^\n]*\n|[^\n]+", text)
        g = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
        h = [int(g[8 * j : 8 * j + 8], 16) for j in range(4)]
        a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
        p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
        if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
            want.append((i, len(lines), "plain", None, None, text, text))
        elif h[3] % 100 < 50:
            want.append((i, len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text))
        else:
            want.append((i, len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(frame.limit(0)).count() == 0
    assert {r.form for r in fill_middle.fill_in_middle(frame, rate=0).collect()} == {"plain"}
