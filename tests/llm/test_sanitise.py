"""Personal data and revealing terms against plain Python."""

import math
import random
import re
import unicodedata
from collections import defaultdict

import pytest
from kreiswerk.llm import sanitise
from kreiswerk.llm.work import ship

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = "email", "ip", "card", "phone", "removed", "general"
SCHEMA = "doc_id long, text string, spans string, _row string, entity string, term string, s string, n_t string"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(found)


def words(text):
    """(start, end, word) of letters only, between spaces or common punctuation."""
    i = 0
    while i < len(text):
        if not unicodedata.category(text[i]).startswith("L"):
            i += 1
            continue
        j = i
        while j < len(text) and unicodedata.category(text[j]).startswith("L"):
            j += 1
        k = j
        while k < len(text) and text[k] in ".,;:!?)\"'":
            k += 1
        opened = i == 0 or text[i - 1] in " \t\n\x0b\f\r\"'("
        if j - i >= 3 and opened and (k == len(text) or text[k] in " \t\n\x0b\f\r"):
            yield i, j, text[i:j].lower()
        i = j


def brute(docs):
    mentions, near, held, n_e = [], defaultdict(dict), defaultdict(set), defaultdict(set)
    spots = []
    for row, (_, text) in enumerate(docs):
        text = text or ""
        for _, _, w in words(text):
            held[w].add(row)
        for a, k, b in base(text):
            entity = (k, text[a:b].lower() if k < 2 else re.sub("[^0-9]", "", text[a:b]))
            n_e[entity].add(row)
            low = max([0, *(e for s, kk, e in all_matches(text) if kk == k and e <= a)])  # words before the last match of this kind are not read
            x = max(low, a - 161)
            before = [(s + x, e + x, w) for s, e, w in words(text[x:a]) if a - x <= 160 or s > 0][-8:]
            window = text[b : b + 161]
            nxt = [e for s, kk, e in all_matches(text) if kk == k and s >= b]
            window = text[b : min([b + 161, *nxt[:1]])]
            after = [(s + b, e + b, w) for s, e, w in words(window) if len(window) <= 160 or e < len(window)][:8]
            around = tuple(w for _, _, w in before + after)
            for s, e, w in before + after:
                spots.append((row, entity, w, s, e))
                near[entity, w].setdefault(row, set()).add(around)
            mentions.append((row, a, k, b))
    n, kind_of = len(docs), {}
    for (entity, w), rows in near.items():
        if len({min(x, key=hash) for x in rows.values()}) >= 3 and n > len(n_e[entity]):
            n_te, n_t = len(rows), max(len(held[w]), len(rows))
            share = math.log(n_te * n / (n_t * len(n_e[entity]))) / math.log(n / len(n_e[entity]))
            if share >= 0.7:
                kind_of[entity, w] = 4 if share >= 0.9 else 5
    added = defaultdict(lambda: 9)
    for row, entity, w, s, e in spots:
        if (entity, w) in kind_of:
            added[row, s, e] = min(added[row, s, e], kind_of[entity, w])
    spans = defaultdict(list)
    for row, a, k, b in mentions:
        spans[row].append((a, k, b))
    for (row, s, e), k in added.items():
        spans[row].append((s, k, e))
    return [sorted(spans[row]) for row in range(n)]


def all_matches(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)] + [(m.start(), 1, m.end()) for m in IP.finditer(text)]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]+(?:[\x20-][0-9]+)*", text)] + [(m.start(), 3, m.end()) for m in PHONE.finditer(text)])


def listed(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


AWKWARD = [
    "x a@b.c_d@e.f y a@b a@b.-x.9 %@1.2 a@@b.c é@b.c aé@b.cé z",
    "1.2.3.4.5.6.7.8 999.1.1.1 0000255.0.0.1 256.1.1.1 1.2.3 00001.02.03.04",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1111 1111 41111111111111110 4111111111111111111111",
    "+1 (017) 555-7713 +1 +12 +123456789 +1234567890 +1(2).3-4 5 6 7 8 9 0 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "+49 4111 1111 1111 1111 and 4111111111111111@example.com 10.0.0.1@x.y",
    None,
    "",
    " \n\t",
    "a." * 30_000 + "@b.c",
    "1" * 6_000,
    "1 " * 10_000,
    "+1" + " " * 50_000,
    "日本 größe@example.com 𝒳𝒴 x@y.z 𝒳",
    "mail a@b.c twice a@b.c here",
    "(Contact: joe@site.org)",
]


def planted():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeiorstuäß") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    docs = [prose(60) for _ in range(60)]
    docs += [f"{prose(20)} Annelore, +49 711 555 0120 office. {prose(30)}" for _ in range(12)]
    docs += [f"{prose(9)} sometimes ivy@example.org {prose(9)}" for _ in range(10)] + [f"{prose(5)} sometimes {prose(4)}" for _ in range(8)]
    docs += [f"{prose(9)} rarely ip 10.1.2.3 {prose(9)}"] * 6  # copies are no evidence
    docs += [f"{prose(9)} often ivy@example.org {prose(9)}" if i < 3 else f"{prose(3)} often {prose(3)}" for i in range(40)]
    docs.append(prose(3000) + " Annelore wrote IVY@example.org and sometimes " + prose(3000))
    return docs


def rows():
    docs = [*AWKWARD, *planted()]
    return [(None if i == 3 else i // 2, t) for i, t in enumerate(docs)]


def test_spans(spark):
    ship(spark)
    docs = rows()
    frame = spark.createDataFrame([(*d, *"sretsn"[:6]) for d in docs], SCHEMA).repartition(3)
    got = sanitise.find_personal(frame).collect()
    want = brute(docs)
    count = lambda s, k: sum(x[1] == k for x in s)
    full = [(d[0], *(count(s, k) for k in range(4)), listed([x for x in s if x[1] < 4]), listed(s)) for d, s in zip(docs, want, strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, full))
    assert sum(count(s, 4) for s in want) >= 12 and sum(count(s, 5) for s in want) >= 10
    assert sanitise.find_personal(frame.limit(0)).count() == 0


@pytest.mark.parametrize("block", [7, 4096])
def test_sanitised(spark, block, monkeypatch):
    ship(spark)
    monkeypatch.setattr(sanitise, "BLOCK", block)
    docs = [d for d in rows() if len(d[1] or "") < 30_000]
    frame = spark.createDataFrame([(*d, *"sretsn"[:6]) for d in docs], SCHEMA).repartition(3)
    want = []
    for (i, text), spans in zip(docs, brute(docs), strict=True):
        out, at = [], 0
        for a, k, b in spans:
            if a >= at:
                out += [(text or "")[at:a], sanitise.MARKS[k]]
            at = max(at, b)
        want.append((i, listed(spans), "".join(out) + (text or "")[at:]))
    got = sanitise.sanitised(frame).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert not any("ivy@" in r.text.lower() or "Annelore" in r.text for r in got)
