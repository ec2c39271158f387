"""Secrets in texts: fixed patterns, and a battery of randomness tests with false-discovery control."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import cut, per_slice, raw_bytes

# Matched in lower-cased text, which has the same offsets.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
ASSIGN_WORDS = b"passw", b"secret", b"token", b"api"
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
KINDS = "assign", "access", "hex", "random"

# Runs of these characters of this length are tried for randomness.
RUN_CHARS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
LEAST_RUN = 20
SIGNS = re.compile(rb"[+/_-]")
ALPHABETS = {
    "hex": b"0123456789abcdef",
    "HEX": b"0123456789ABCDEF",
    "base32": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
# Share of ordinary runs among those reported, and stretches of prose that make a null distribution;
# a band with fewer takes in those of shorter runs, which look random more often.
FALSE_SHARE = 0.05
FEWEST_NULLS = 200
LEVELS = 40
# Numbers of bands set aside for an alphabet.
BANDS = 1000
# A run that the tests reject as random at 2 to the minus this is never reported.
REJECTED = 10


def infer(run: bytes) -> str | None:
    """The smallest alphabet that holds all of ``run``; None if none does or it has one kind of sign."""
    for name, alphabet in ALPHABETS.items():
        if not run.translate(None, alphabet):
            return name
    return None


def battery(run: bytes, name: str) -> float:
    """P-value of ``run`` being uniform and independent symbols: three tests, Bonferroni.

    Chi-squared of as many equal parts of the alphabet as give five symbols each, the number of
    runs above and below its middle, and the correlation of neighbours.
    """
    alphabet = ALPHABETS[name]
    size, n = len(alphabet), len(run)
    at = np.frombuffer(run.translate(bytes.maketrans(alphabet, bytes(range(size)))), np.uint8).astype(np.int64)
    parts = min(size, 1 << max(1, int(math.log2(max(2, n // 5)))))
    seen, df = np.bincount(at * parts // size, minlength=parts), parts - 1
    chi = float(((seen - n / parts) ** 2).sum() * parts / n)
    # The cube root of chi-squared is nearly normal (Wilson and Hilferty).
    z = ((chi / df) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df))
    found = [math.erfc(z / math.sqrt(2)) / 2]
    high = at * 2 >= size
    a = int(high.sum())
    b = n - a
    if a and b:
        mean = 1 + 2 * a * b / n
        spread = 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
        runs = 1 + int((high[1:] != high[:-1]).sum())
        found.append(math.erfc(abs(runs - mean) / math.sqrt(2 * spread)) if spread > 0 else 0.0)
    else:
        found.append(0.0)
    off = at - at.mean()
    power = float((off**2).sum())
    found.append(math.erfc(abs(float((off[1:] * off[:-1]).sum()) / power) * math.sqrt(n / 2)) if power else 0.0)
    return min(1.0, 3 * min(found))


def level(p: float) -> int:
    """Steps of halves: 0 for a p-value over a half, LEVELS for one that is next to nothing."""
    return LEVELS if p <= 0 else min(LEVELS, int(-math.log2(p)))


def band(length: int) -> int:
    """Lengths of one band differ by at most a fifth or so."""
    return int(4 * math.log2(length))


def base_spans(text: bytes, low: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of assignments and access keys, in bytes."""
    spans = []
    if any(w in low for w in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(low) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return spans


def _runs(texts: list[bytes]) -> list[list[tuple[int, int]]]:
    """Runs of ``LEAST_RUN`` or more RUN_CHARS of each text."""
    inside = np.zeros(256, bool)
    inside[list(RUN_CHARS)] = True
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    outside = np.flatnonzero(~inside[joined])
    last = np.r_[-1, outside[:-1]]
    long = np.flatnonzero(outside - last > LEAST_RUN)
    ends = np.cumsum([len(t) + 1 for t in texts])
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    for a, b, i in zip(last[long] + 1, outside[long], np.searchsorted(ends, outside[long], side="left"), strict=True):
        first = int(ends[i]) - len(texts[i]) - 1
        found[i].append((int(a) - first, int(b) - first))
    return found


def find_secrets(docs: DataFrame, false_share: float = FALSE_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_assign, n_access, n_hex, base (string) and spans (string).

    The fixed patterns give the base spans. Every other long run of letters and digits is tested for
    randomness in the smallest alphabet that holds it; where none does, its parts between + / _ and -
    are, and of a run that a base span touches, the rest. Ordinary runs pass such tests the more often
    the shorter they are, so what passing is worth depends on length: all prose of the documents that
    hold such runs is cut into stretches of the shortest length of the run's band, read in the same
    alphabet and tested too, and a run's p-value is the share of them, over the whole corpus, that
    look as random. A band with fewer than ``FEWEST_NULLS`` stretches takes in those of the next
    shorter ones, then of longer ones and other alphabets; where there is no prose at all, the
    battery's own p-value decides. Benjamini and Hochberg's rule over all runs then bounds the share of ordinary runs among
    those reported by ``false_share``. Runs that the tests themselves reject are not reported.

    Texts are read once; what leaves that pass are spans and their test levels. Only the counts per
    alphabet, band and level, a few thousand numbers at most, reach the driver. A span is
    kind:start:end in code points, end exclusive, sorted by start, then kind. Null text is empty;
    null ids and repeated rows stay; other columns are ignored.
    """

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = raw_bytes(batch.column(1))
        base_column, runs_column, null_column = [], [], []
        for text, runs in zip(texts, _runs(texts), strict=True):
            base = base_spans(text, text.lower())
            for a, b in runs:
                base += [(a + m.start(), 2, a + m.end()) for m in HEX.finditer(text[a:b])]
            base.sort()
            tried, nulls = _tried(text, runs, base)
            place = _code_points(text) if base or tried else None
            base_column.append([{"at": place(a), "kind": k, "stop": place(b)} for a, k, b in base])
            runs_column.append([{"at": place(a), "stop": place(b), "band": n, "level": p} for a, b, n, p in tried])
            null_column.append([{"band": n, "level": p, "n": c} for (n, p), c in nulls.items()])
        columns = [batch.column(0)]
        columns += [pa.array(c, k) for c, k in zip((base_column, runs_column, null_column), kinds, strict=True)]
        return pa.record_batch(columns, names=["_id", "base", "runs", "nulls"])

    number = lambda *names: pa.list_(pa.struct([(n, pa.int64()) for n in names]))
    kinds = number("at", "kind", "stop"), number("at", "stop", "band", "level"), number("band", "level", "n")
    struct = lambda names: f"array<struct<{', '.join(f'{n}: long' for n in names.split())}>>"
    schema = f"_id long, base {struct('at kind stop')}, runs {struct('at stop band level')}, nulls {struct('band level n')}"
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    found = cut(texts.mapInArrow(per_slice(scan, "_text"), schema), "secrets")
    runs = found.select(F.explode("runs").alias("r")).select(F.lit("runs").alias("of"), "r.band", "r.level", F.lit(1).cast("long").alias("n"))
    nulls = found.select(F.explode("nulls").alias("r")).select(F.lit("nulls").alias("of"), "r.band", "r.level", "r.n")
    counts = runs.unionByName(nulls).groupBy("of", "band", "level").agg(F.sum("n").alias("n")).collect()
    accepted = discoveries({(r["of"], r["band"], r["level"]): r["n"] for r in counts}, false_share)

    def listed(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for base, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            base = [(s["at"], s["kind"], s["stop"]) for s in base]
            more = [(s["at"], 3, s["stop"]) for s in runs if s["level"] <= accepted.get(s["band"], -1)]
            text = [",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in x) for x in (base, sorted(base + more))]
            rows.append((*(sum(k == kind for _, k, _ in base) for kind in range(3)), *text))
        columns = zip(*rows, strict=True) if rows else [()] * 5
        arrays = [pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.string()] * 2, strict=True)]
        return pa.record_batch([batch.column(0), *arrays], names=names)

    names = ["_id", "n_assign", "n_access", "n_hex", "base", "spans"]
    out = found.select("_id", "base", "runs").mapInArrow(
        lambda batches: map(listed, batches), "_id long, n_assign long, n_access long, n_hex long, base string, spans string"
    )
    return out.withColumnRenamed("_id", id_col)


def _tried(text: bytes, runs: list[tuple[int, int]], base: list) -> tuple[list[tuple], Counter]:
    """(start, end, band, level) of the parts of runs outside base spans, counts of (band, level) of the prose."""
    tried, nulls, known, prose = [], Counter(), set(), None
    for a, b in _parts(text, runs, base):
        name = infer(text[a:b])
        of = BANDS * list(ALPHABETS).index(name) + band(b - a)
        tried.append((a, b, of, level(battery(text[a:b], name))))
        if of in known:
            continue
        known.add(of)
        if prose is None:
            at, pieces = 0, []
            for x, y in runs:
                pieces.append(text[at:x])
                at = y
            prose = re.sub(rb"[^A-Za-z0-9]+", b"", b" ".join([*pieces, text[at:]]))
        upper = name in ("HEX", "base32")
        letters = (prose.upper() if upper else prose.lower()) if name in ("hex", "HEX", "base32") else prose
        letters = letters.translate(None, bytes(set(range(256)).difference(ALPHABETS[name])))
        n = max(LEAST_RUN, math.ceil(2 ** (band(b - a) / 4)))
        nulls.update((of, level(battery(letters[i : i + n], name))) for i in range(0, len(letters) - n + 1, n))
    return tried, nulls


def _parts(text: bytes, runs: list[tuple[int, int]], base: list) -> list[tuple[int, int]]:
    """What base spans leave of the runs, split at signs where no alphabet holds all of it."""
    found = []
    spans, at = sorted((a, b) for a, _, b in base), 0
    for a, b in runs:
        while at < len(spans) and spans[at][1] <= a:
            at += 1
        rest, start = [], a
        for x, y in spans[at:]:
            if x >= b:
                break
            rest.append((start, x))
            start = max(start, y)
        for x, y in [*rest, (start, b)]:
            if y - x < LEAST_RUN:
                continue
            if infer(text[x:y]):
                found.append((x, y))
                continue
            signs = [m.start() for m in SIGNS.finditer(text, x, y)]
            ends = zip([x, *(i + 1 for i in signs)], [*signs, y], strict=True)
            found += [(u, v) for u, v in ends if v - u >= LEAST_RUN]
    return found


def _code_points(text: bytes):
    if text.isascii():
        return lambda i: i
    before = np.r_[0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)]
    return lambda i: int(before[i])


def nulls_of(band_: int, counts: dict[tuple[str, int, int], int]) -> list[int]:
    """Levels of the null of a band: its own and, while they are few, those of its neighbours."""
    bands = {b for of, b, _ in counts if of == "nulls"}
    same = [b for b in bands if b // BANDS == band_ // BANDS]
    order = sorted((b for b in same if b <= band_), reverse=True) + sorted(b for b in same if b > band_)
    order += sorted(bands.difference(same), key=lambda b: (abs(b % BANDS - band_ % BANDS), b))
    total = [0] * (LEVELS + 1)
    for b in order:
        if sum(total) >= FEWEST_NULLS:
            break
        for x in range(LEVELS + 1):
            total[x] += counts.get(("nulls", b, x), 0)
    return total


def discoveries(counts: dict[tuple[str, int, int], int], share: float) -> dict[int, int]:
    """The highest level accepted per band, by Benjamini and Hochberg over empirical p-values."""
    ranked = []
    for b in {b for of, b, _ in counts if of == "runs"}:
        nulls = nulls_of(b, counts)
        for x in range(LEVELS + 1):
            if n := counts.get(("runs", b, x), 0):
                p = (1 + sum(nulls[: x + 1])) / (1 + sum(nulls))
                if not sum(nulls):  # nothing to compare with: random unless the tests reject it
                    p = 0.0 if 2.0**-x > share else 1.0
                ranked.append((p, b, x, n))
    ranked.sort()
    every, so_far, cut_at = sum(r[3] for r in ranked), 0, 0.0
    for i, (p, _, _, n) in enumerate(ranked):
        so_far += n
        if (i + 1 == len(ranked) or ranked[i + 1][0] > p) and p <= share * so_far / every:
            cut_at = p
    accepted: dict[int, int] = {}
    for p, b, x, _ in ranked:
        if p <= cut_at and x <= REJECTED:
            accepted[b] = max(accepted.get(b, -1), x)
    return accepted

