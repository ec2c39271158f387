"""Every operator against plain Python on small tables with the awkward rows."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from kreiswerk.llm import class_lm, exact_dedup, mixing, packing, quality, secrets, sharding, simhash, suffix_dedup, warc
from kreiswerk.llm.components import components
from kreiswerk.llm.suffix_array import permuted_lcp, suffix_array
from kreiswerk.llm.work import ship
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, length string, key string, n string, spans string, copies string, shard string"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeiorstu") for _ in range(rng.randint(1, 7))) for _ in range(n))


BASE = prose(1, 300)
TEXTS = [
    (1, BASE, "a"),
    (2, BASE.upper(), "a"),
    (3, BASE.replace("a", "e", 3), "b"),
    (4, BASE, "a"),
    (4, BASE, "a"),  # a repeated row
    (5, None, "b"),
    (6, "", None),
    (None, "No id, Größe ß É!", "b"),
    (7, " \t\n\x0b ", None),
    (8, prose(2, 20_000), "c"),  # very long
    (9, prose(3, 400) + "\n" + prose(1, 150) + "\nend", "c"),
    (10, "one two three", "a"),
    (11, "\n".join(["the same line again and again"] * 40), "c"),
    (12, "ä 　x <|endoftext|> it's 12 ²½ İ é ΑΣ Σ, don't", "b"),
    (13, "x" * 5000, "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.createDataFrame([(*row, *"lknscs"[:6]) for row in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def low(text):
    return (text or "").encode().lower()


def same(got, want):
    order = lambda rows: sorted(map(repr, rows))
    assert order(tuple(r) for r in got) == order(want)


# --- 1 quality ---------------------------------------------------------------------------------


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs, none):
    got = quality.judge(docs, None).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = []
    for doc, text, _ in TEXTS:
        c = counts(text)
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        want.append((doc, *c, failed, not failed))
    same(got, want)
    assert quality.judge(none, None).count() == 0
    kept = quality.keep_good(docs, None)
    assert kept.columns == docs.columns and kept.count() == sum(r[-1] for r in want)


def test_repeated_words():
    rng = random.Random(5)
    for _ in range(200):
        words = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 40))]
        ids = np.array([ord(w) for w in words], np.int64)
        assert quality.repeated_words(ids) == counts(" ".join(words))[4]


def test_classifier_held_out(spark):
    ship(spark)
    good = [(i, prose(i, 80), 1) for i in range(120)]
    bad = [(1000 + i, "".join(f"{w}$$$ " for w in prose(1000 + i, 80).split()), 0) for i in range(40)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    train = rows.filter("doc_id % 2 = 0")
    model = quality.train(rows, train.select("doc_id", "quality"))
    got = {r.doc_id: r for r in quality.judge(rows, model).collect()}
    assert all(got[i].kept == bool(y) for i, _, y in good + bad if i % 2)
    assert quality.train(rows, rows.filter("quality = 1")) is None
    assert quality.train(rows, rows.limit(0)) is None


# --- 2 mixing ----------------------------------------------------------------------------------


def water(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, open_, target = sum(sizes.values()), set(order), {}
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= set(over)
    return target


def test_mix(spark, docs, none):
    rows = [(i, prose(i, 20 + i % 90), ["a", "b", "Z", None, "tiny"][min(4, i % 60 // 13)]) for i in range(1500)]
    many = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(many).collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(text.split())
    target, source_of, taken = water(sizes), {i: s for i, _, s in rows}, defaultdict(int)
    for r in got:
        s = source_of[r.doc_id]
        assert (r.size, r.source_size) == (len(rows[r.doc_id][1].split()), sizes[s]) and r.taken <= 3 * r.size
        assert math.isclose(r.target, target[s], rel_tol=1e-9)
        taken[s] += r.taken
    assert all(abs(taken[s] / target[s] - 1) < 0.01 for s in sizes)
    same(mixing.mix(many.repartition(5)).collect(), [tuple(r) for r in got])
    twice = mixing.mixed_rows(many)
    assert twice.columns == many.columns
    assert Counter(r.doc_id for r in twice.collect()) == Counter({r.doc_id: r.copies for r in got if r.copies})
    edge = mixing.mix(docs).collect()
    assert Counter(r.doc_id for r in edge) == Counter(d for d, _, _ in TEXTS)
    assert all(r.size == counts(t)[0] for r in edge for d, t, _ in TEXTS if d == r.doc_id)
    assert mixing.mix(none).count() == 0 and mixing.mixed_rows(none).count() == 0


def test_mix_reaches_the_bound(spark):
    """A source whose target is three times its words takes every document three times."""
    rows = [(0, "w " * 10, "a"), (1, "w " * 20, "b"), *((i, "w " * 30, "c") for i in range(2, 40))]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert (got[0].taken, got[1].taken) == (30, 60) and got[0].target == 30


# --- 3 exact dedup -----------------------------------------------------------------------------


@pytest.mark.parametrize("first,wider", [(64, 8), (2, 3)])
def test_exact_dedup(docs, none, first, wider):
    groups = defaultdict(list)
    for doc, text, _ in TEXTS:
        groups[low(text)].append(doc)
    want = []
    for doc, text, _ in TEXTS:
        ids = groups[low(text)]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((doc, keep, len(ids), doc == keep, hashlib.sha256(low(text)).hexdigest()))
    same(exact_dedup.radix_groups(docs, first=first, wider=wider).collect(), want)
    assert exact_dedup.radix_groups(none).count() == 0


def test_drop_copies(docs, none):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(low(r.text) for r in kept.collect()) == Counter({low(t) for _, t, _ in TEXTS})
    assert exact_dedup.drop_copies(none).count() == 0


# --- 4 archives --------------------------------------------------------------------------------


def test_archives(spark, none):
    ship(spark)
    html = ["<p>a\r\n\r\nb</p>", "", None, "<p>a\r\n\r\nb</p>", "WARC/1.1\r\n\r\n", "Größe " * 5000, "", "z"]
    rows = [(i, f"http://www.Site{i % 3}.example/p a\r\nth?{i}" if i else None, h, "x") for i, h in enumerate(html)]
    rows += [(None, "", "null id", "x"), (7, rows[7][1], "z", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, offset string").repartition(3)
    got = warc.captures(pages).collect()
    best = {}
    for page, _, h, _ in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if page is None else page)
    want = []
    for page, _, h, _ in rows:
        data, first = (h or "").encode(), best[h or ""]
        revisit = first != (-1 if page is None else page)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((page, len(data), digest, "revisit" if revisit else "response", first if revisit else None))
    same([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], want)
    ordered = sorted(got, key=lambda r: (r.index_part, r.index_row))
    keys = [(r.urlkey, r.timestamp, -1 if r.page_id is None else r.page_id) for r in ordered]
    assert keys == sorted(keys)
    least = warc.captures(pages, least=3).filter("record_type = 'revisit'").collect()
    assert {r.page_id for r in least} == {0}
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.captures(empty).count() == 0


def test_loser_tree():
    rng = random.Random(2)
    for k in range(9):
        runs = [sorted(rng.choices(range(20), k=rng.randint(0, 9))) for _ in range(k)]
        assert list(warc.merge_runs(runs, lambda x: x)) == sorted(sum(runs, []))


# --- 5 secrets ---------------------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_of(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def test_secrets(spark, docs, none):
    ship(spark)
    rng = random.Random(4)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows, planted = [], {}
    for i in range(300):
        text = prose(i, 300) + " ßé "
        if i % 3 == 0:
            text += 'Password: "abcDEF123" paſſword=longenough12 api_key=short token=\tx AKIA' + "B7" * 8 + " AKIAX "
            text += "0123456789abcdef" * 2 + "," + "f" * 31 + " x" + "ab12" * 8 + "AKIAQ" * 4
        if i % 2:
            run = "".join(rng.choice(chars) for _ in range(48))
            planted[i] = f"random:{len(text) + 1}:{len(text) + 49}"
            text += " " + run
        if i % 5 == 0:
            text += " " + "".join(prose(i + 7, 8).split())[:44] + "-name-of-a-long-thing"
        rows.append((i, text))
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        base, r = base_of(text), got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
        listed = [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r.base == ",".join(listed)
        assert set(listed) <= set(r.spans.split(",")) or not listed
    found = {i for i, span in planted.items() if span in got[i].spans.split(",")}
    false = [s for r in got.values() for s in r.spans.split(",") if s.startswith("random") and s != planted.get(r.doc_id)]
    assert len(found) > 0.8 * len(planted) and len(false) <= 0.1 * len(found)
    edge = secrets.find_secrets(docs).collect()
    same([(r.doc_id, r.base) for r in edge], [(d, ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base_of(t or ""))) for d, t, _ in TEXTS])
    assert secrets.find_secrets(none).count() == 0


# --- 6 language model --------------------------------------------------------------------------


def test_class_model(spark, docs, none):
    ship(spark)
    rng = random.Random(3)
    nouns, verbs = [f"n{i}" for i in range(30)], [f"v{i}" for i in range(30)]
    said = lambda n: " ".join(w for _ in range(n) for w in ("The", rng.choice(nouns), rng.choice(verbs)))
    rows = [(i, said(30)) for i in range(200)] + [(900, None), (900, ""), (None, "the rareword"), (901, "unseen things only")]
    many = spark.createDataFrame(rows, "doc_id long, text string")
    train = Counter()
    for i, t in rows:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2:
            train.update([*low(t).split(), b""])
    n, v = sum(train.values()), len(train)
    for head, classes in ((200_000, 12), (20, 6)):
        got = class_lm.score_texts(many, head_words=head, classes=classes).collect()
        want = []
        for i, t in rows:
            words = [*low(t).split(), b""]
            held = zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
            base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words)
            want.append((i, held, len(words), sum(train[w] > 0 for w in words), n, round(base, 6)))
        same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], want)
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
        # Three classes tell the next word's class, so scores beat the unigram ones, and also where
        # most words are not frequent and have their class from their own contexts only.
        held = [r for r in got if r.held_out and r.n_tokens > 50]
        assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.3 * sum(r.n_tokens for r in held)
    assert class_lm.score_texts(docs).count() == len(TEXTS)
    assert class_lm.score_texts(none).count() == 0


# --- 7 suffix arrays ---------------------------------------------------------------------------


def removed(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(200):
        text = [rng.randint(1, rng.choice([1, 2, 9])) for _ in range(rng.randint(1, 90))] + [0]
        order = suffix_array(np.array(text, np.uint16))
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        lcp, before = permuted_lcp(np.array(text, np.uint16), order)
        for a, b in zip(order, order[1:], strict=False):
            n = next(k for k in range(len(text)) if text[a + k : a + k + 1] != text[b + k : b + k + 1])
            assert lcp[b] == n and before[b] == a


@pytest.mark.parametrize("length,hot", [(400, 2000), (40, 2), (12, 1)])
def test_remove_repeats(spark, docs, none, monkeypatch, length, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_PIECES", hot)
    passage = prose(50, 90)
    rows = [(d, t) for d, t, _ in TEXTS if d != 8 or length == 400]
    rows += [(100 + i, prose(200 + i, 30 + i) + passage + prose(300 + i, 40)) for i in range(12)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), length).collect()
    want = removed([(t or "").encode() for _, t in rows], length)
    same([tuple(r)[:5] for r in got], [(d, *w) for (d, _), w in zip(rows, want, strict=True)])
    assert suffix_dedup.remove_repeats(none).count() == 0


# --- 8 packing ---------------------------------------------------------------------------------


def test_pieces_and_packing(docs, none, monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    want = []
    for doc, text, _ in TEXTS:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((doc, k, at, len(part), zlib.crc32(part.tobytes())))
    pieces = packing.token_pieces(docs, path)
    same(pieces.collect(), want)
    packed = packing.best_fit(pieces)
    same([tuple(r)[:5] for r in packed.collect()], want)
    places = defaultdict(list)
    for r in packed.collect():
        places[r.sequence_id].append((r.offset, r.length))
    for rows in places.values():
        rows.sort()
        assert [o for o, _ in rows] == np.cumsum([0, *(n for _, n in rows[:-1])]).tolist() and sum(rows[-1]) <= 2048
    assert len(places) <= -(-sum(w[3] for w in want) // 2048) + 1
    assert packing.best_fit(packing.token_pieces(none, path)).count() == 0


def test_word_memory_keeps_ids():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    ids = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"), 20)
    for seed in (1, 2, 1, 3, 1):
        words = prose(seed, 30).encode().split()
        known = ids.learn([words, []])
        for w in words:
            found = ids.tokenizer.encode(w.decode(), add_special_tokens=False).ids
            assert known[w] == np.array(found, "<u4").tobytes()


def test_best_fit_plan():
    rng = random.Random(7)
    for _ in range(60):
        capacity = rng.choice([5, 16, 64])
        counts_ = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 400)))
        fill, seen = defaultdict(list), Counter()
        for length, a, b, first, offset in packing.best_fit_plan(counts_, capacity):
            seen[length] += b - a
            for i in range(b - a):
                fill[first + i].append((offset, length))
        assert seen == counts_
        for rows in fill.values():
            at = 0
            for offset, length in sorted(rows):
                assert offset == at
                at += length
            assert at <= capacity
        bins = []  # best-fit decreasing, one piece at a time
        for length in sorted(counts_.elements(), reverse=True):
            fits = [i for i, gap in enumerate(bins) if gap >= length]
            if fits:
                bins[min(fits, key=lambda i: bins[i])] -= length
            else:
                bins.append(capacity - length)
        assert len(fill) <= len(bins) + 1


# --- 9 sharding --------------------------------------------------------------------------------


def test_sharding(spark, docs, none):
    ship(spark)
    rows = spark.createDataFrame([(i, prose(i, 20) if i % 7 else None) for i in range(1000)], "doc_id long, text string")
    got = sharding.shuffle_into_shards(rows, 7, bucket_bytes=5000).collect()
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 7
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s in sorted(sizes) for i in range(sizes[s])]
    same([(r.doc_id, r.text) for r in got], [tuple(r) for r in rows.collect()])
    again = sharding.shuffle_into_shards(rows.repartition(4), 7, bucket_bytes=5000).collect()
    same(again, [tuple(r) for r in got])
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(order, range(1000))[0, 1]) < 0.15
    copies = spark.range(3000).selectExpr("CAST(5 AS long) AS doc_id", "repeat('one text ', 20) AS text", "id AS other")
    copied = sharding.shuffle_into_shards(copies, 7, bucket_bytes=5000).collect()
    assert sorted(r.other for r in copied) == list(range(3000)) and len({(r.shard, r.slot) for r in copied}) == 3000
    edge = sharding.shuffle_into_shards(docs, 4)
    same([(r.doc_id, r.text) for r in edge.collect()], [(d, t) for d, t, _ in TEXTS])
    assert sharding.shuffle_into_shards(none, 4).count() == 0


# --- 10 near copies ----------------------------------------------------------------------------


def simple_print(text):
    words = low(text).split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_groups(spark, docs, none, monkeypatch):
    ship(spark)
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 3)  # so that buckets are cut into chunks
    rows = [(d, t) for d, t, _ in TEXTS if d != 8]
    words = prose(77, 300).split()
    rng = random.Random(9)
    for i in range(60):
        edited = list(words)
        for _ in range(i % 6):
            edited[rng.randrange(300)] = "zz"
        rows.append((200 + i, " ".join(edited)))
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    prints = [simple_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    same(got, [(d, f"{prints[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)])
    assert len({r.component_id for r in got}) < len({r.fingerprint for r in got})
    assert simhash.near_groups(none).count() == 0


def test_exact_tables_miss_nothing():
    rng = random.Random(1)
    for rows in (10, 10**7, 10**9):
        tables = simhash.exact_tables(64, 4, rows)
        for _ in range(300):
            differing = set(rng.sample(range(64), 4))
            assert any(not differing & set(t) for t in tables)


def test_components(spark):
    rng = random.Random(6)
    links = [(f"{i:03}", f"{i + 1:03}") for i in range(0, 90)] + [("500", f"{i}") for i in range(501, 560)]
    links += [(f"{rng.randint(600, 699)}", f"{rng.randint(600, 699)}") for _ in range(70)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a string, b string"), "string").collect())
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        assert got.get(start, start) == min(seen)


def test_drop_near_copies(spark, docs, none):
    ship(spark)
    rows = [(i, prose(i, 200)) for i in range(40)]
    rows += [(100 + i, " ".join([*t.split()[:100], "changed", *t.split()[101:]])) for i, t in rows[:20]] + [(None, "x"), (None, None)]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same([(r.doc_id,) for r in kept], [(i,) for i in range(40)] + [(None,)] * 2)
    assert simhash.drop_near_copies(docs).columns == docs.columns
    assert simhash.drop_near_copies(none).count() == 0


def jaccard(a, b):
    sets = []
    for text in (a, b):
        words = text.lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_are_found_from_the_stated_similarity(spark):
    ship(spark)
    rows = []
    for i in range(300):
        words = prose(1000 + i, 150 + i).split()
        # Fresh words at the end: of n shingles of each text, about 1.9 n / 17 are its own.
        own = len(words) * (8 + i % 3) // 100
        rows += [(i, " ".join(words)), (1000 + i, " ".join(words[:-own] + [f"w{i}x{j}" for j in range(own)]))]
    text = dict(rows)
    similar = [jaccard(text[i], text[1000 + i]) for i in range(300)]
    assert all(0.8 <= s < 0.87 for s in similar)
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(300))


def test_nothing_goes_without_a_partner_of_the_stated_similarity(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 5)
    rows = []
    for i in range(60):
        words = prose(3000 + i, 200).split()
        rows.append((10 * i, " ".join(words)))
        for k in range(1, 9):  # 0.9 to 0.6 to the first, less to one another
            own = 8 + 5 * k
            rows.append((10 * i + k, " ".join(words[:-own] + [f"w{i}x{k}x{j}" for j in range(own)])))
    passage = prose(5, 12)  # one passage many times: fingerprints of repeats agree, sets do not
    rows += [(10_000 + i, " ".join([passage] * 30 + [prose(7000 + i, 40)])) for i in range(20)]
    text, ids = dict(rows), [i for i, _ in rows]
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and a // 10 == b // 10 and jaccard(text[a], text[b]) >= 0.8:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {i for i in ids if find(i) == i}
    assert 60 < len(kept) < len(ids)


def test_near_copies_are_first_found_by_fingerprints(spark):
    ship(spark)
    rows = []
    for i in range(20):  # twenty texts in three variants each
        words = prose(9000 + i, 300).split()
        rows += [(3 * i + k, " ".join(words[: 300 - k] + [f"w{j}" for j in range(k)])) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vertices = simhash.shingle_rows(docs, 5, "doc_id", "text").cache()
    v = {r.v: r._id for r in vertices.collect()}
    ints = {r.v: int.from_bytes(r.fp, "big") for r in vertices.collect()}
    within = {(a, b) for a in ints for b in ints if a < b and (ints[a] ^ ints[b]).bit_count() <= 4}
    found = {(r.a, r.b) for r in simhash.print_pairs(vertices, 4, 0.8).collect()}
    assert len(within) >= 20 and {v[a] // 3 == v[b] // 3 for a, b in found} == {True}
    # The links connect what brute force connects.
    reach = lambda pairs: {x: frozenset(closure(x, pairs)) for x in ints}
    assert reach(found) == reach(within)
    # Without any band in common the fingerprints' links remain, verified by the sets.
    apart = vertices.withColumn("bands", F.array(F.xxhash64("v")))
    texts_of = lambda wanted: wanted.join(vertices.select("v", "_id"), "v").join(
        docs.withColumnRenamed("text", "_text"), F.col("_id") == F.col("doc_id")
    ).select("v", "_text")
    links = {(r.a, r.b) for r in simhash.set_links(apart, texts_of, 5, 0.8, 4).collect()}
    assert links == found


def closure(x, pairs):
    seen, new = set(), {x}
    while new:
        seen |= new
        new = {b for p in pairs for a, b in (p, p[::-1]) if a in new} - seen
    return seen


def test_near_copies_by_id_and_text(spark):
    ship(spark)
    copy = lambda t: " ".join([*t.split()[:-1], "end"])
    one, two, three = (prose(i, 150) for i in (61, 62, 63))
    rows = [(7, one), (7, two), (9, copy(two)), (None, three), (None, copy(three)), (None, copy(one)), (7, one)]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == 3 and {(7, one), (7, two)} < {tuple(r) for r in kept}
    assert [r.text in (three, copy(three)) for r in kept if r.doc_id is None] == [True]


def test_runs_that_no_alphabet_holds_are_tried_in_parts():
    key, token = b"k3Jx9QpLm2Zt7VbN4cWd8RyS1fGh6TuA0eXo5iKq", b"Zq8Lw2Nv5Xc1Bm7Kj4Hg"
    text = b"see my-app/" + key + b" and a_b/" + token + b"+short, api_key=abcdefgh/" + b"x" * 9 + b"=" + token
    text += b" AKIA" + b"B7" * 8 + b"_" + token
    runs, base = secrets._runs([text])[0], secrets.base_spans(text, text.lower())
    tried = [text[a:b] for a, b, *_ in secrets._tried(text, runs, base)[0]]
    assert tried == [key, token, b"_" + token]
