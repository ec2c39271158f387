"""Quality rules: text statistics, and a hashed n-gram logistic regression trained on labelled rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import per_slice, raw_bytes

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
# Hashed features: weights of one table, shared by word and character n-grams.
FEATURE_BITS = 18
# Bound of the labelled rows the classifier is fitted on, and the share held out to calibrate it.
TRAIN_ROWS = 4000
HELD_OUT = 4
# A document is kept from this calibrated probability of good quality on.
THRESHOLD = 0.5


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words in runs of ``window`` words that occur at least twice; ``window`` is a power of two.

    Runs of 2, 4, 8 words are renamed in turn, so that equal numbers mean equal runs. Where no
    shorter run repeats no longer one does.
    """
    width = 1
    while width < window:
        if len(ids) <= width:
            return 0
        _, ids = np.unique(ids[:-width] * (int(ids.max()) + 1) + ids[width:], return_inverse=True)
        if int(ids.max()) + 1 == len(ids):
            return 0
        width *= 2
    often = np.bincount(ids)[ids] > 1
    edges = np.zeros(len(ids) + window, np.int64)
    np.add.at(edges, np.flatnonzero(often), 1)
    np.add.at(edges, np.flatnonzero(often) + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def statistics(text: bytes) -> tuple[list[bytes], np.ndarray, tuple[int, int, int, int, int]]:
    """Distinct words, the text as numbers of them, and the five counts of the rules."""
    words = text.split()
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    run = b"".join(words)
    chars = len(run) if run.isascii() else len(run.decode())
    symbols = len(run) - len(run.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip()]
    repeats = repeated_words(ids) if len(ids) > WINDOW and len(number) < len(ids) else 0
    return list(number), ids, (len(words), chars, symbols, len(lines) - len(set(lines)), repeats)


def features(text: bytes, distinct: list[bytes], ids: np.ndarray) -> list[np.ndarray]:
    """Table places of the words, word pairs, and runs of two and four bytes of a lower-cased text."""
    shift = np.uint32(32 - FEATURE_BITS)
    word = np.array([zlib.crc32(w.lower()) for w in distinct], np.uint32)[ids] if len(ids) else np.zeros(0, np.uint32)
    pair = (word[:-1] * np.uint32(2654435761) ^ word[1:]) * np.uint32(2246822519)
    byte = np.frombuffer(text.lower(), np.uint8).astype(np.uint32)
    two = byte[:-1] << np.uint32(8) | byte[1:]
    four = (two[:-2] << np.uint32(16) | two[2:]) * np.uint32(2654435761)
    return [word * np.uint32(2654435761) >> shift, pair >> shift, two * np.uint32(3266489917) >> shift, four >> shift]


@dataclass
class Model:
    """Weights, and the scale and offset that turn a score into a probability."""

    weights: np.ndarray
    bias: float
    scale: float
    offset: float

    def probability(self, parts: list[np.ndarray]) -> float:
        score = self.bias + sum(float(self.weights[p].mean()) for p in parts if len(p))
        return float(1 / (1 + np.exp(-np.clip(self.scale * score + self.offset, -30, 30))))


def shares(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The places a document uses, and the share of its n-grams of each kind that fall there."""
    used = [(*np.unique(p, return_counts=True), len(p)) for p in parts if len(p)]
    if not used:
        return np.zeros(0, np.uint32), np.zeros(0, np.float32)
    return np.concatenate([at for at, _, _ in used]), np.concatenate([n / size for _, n, size in used])


def fit(
    rows: list[tuple[np.ndarray, np.ndarray, int]], steps: int = 80, rate: float = 4.0, ridge: float = 1e-5
) -> Model:
    """Fit on all but every ``HELD_OUT``-th of the rows of (places, shares, label), and calibrate on those.

    Every kind of n-gram weighs one in a document, so a score is a sum of mean weights. Classes
    weigh alike; calibration brings back their true odds.
    """
    label = np.array([y for _, _, y in rows], float)
    place = np.concatenate([p for p, _, _ in rows]).astype(np.int32)
    value = np.concatenate([v for _, v, _ in rows]).astype(np.float32)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(p) for p, _, _ in rows])
    held = np.arange(len(rows)) % HELD_OUT == HELD_OUT - 1
    weight = np.where(label > 0, 1 / max(1, (label > 0)[~held].sum()), 1 / max(1, (label <= 0)[~held].sum())) * ~held
    weights, bias, past = np.zeros(1 << FEATURE_BITS), 0.0, np.full(1 << FEATURE_BITS, 1e-9)
    score = lambda: bias + np.bincount(row, weights[place] * value, minlength=len(rows))
    for _ in range(steps):
        error = weight * (1 / (1 + np.exp(-np.clip(score(), -30, 30))) - label)
        slope = np.bincount(place, error[row] * value, minlength=len(weights)) + ridge * weights
        past += slope**2
        weights -= rate * slope / np.sqrt(past)
        bias -= 0.5 * error.sum()
    # Scores of held-out rows against smoothed labels, so that separable classes stay finite.
    s, y = score()[held], label[held]
    good, bad = (y > 0).sum(), (y <= 0).sum()
    y = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    scale, offset = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(scale * s + offset, -30, 30)))
        bend = p * (1 - p) + 1e-6
        design = np.stack([s, np.ones_like(s)], axis=1)
        step = np.linalg.solve(design.T @ (design * bend[:, None]) + 1e-6 * np.eye(2), design.T @ (p - y))
        scale, offset = scale - float(np.clip(step[0], -2, 2)), offset - float(np.clip(step[1], -2, 2))
    return Model(weights.astype(np.float32), bias, scale, offset)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Fit on at most ``rows`` labelled documents, chosen by a hash of their ids.

    The choice is made among the labels, whose bounded sample then meets the documents without a
    shuffle of texts; one task fits the model. None if one of the classes is missing.
    """
    known = labels.filter("quality is not null and doc_id is not null").select("doc_id", "quality")
    known = known.orderBy(F.xxhash64("doc_id"), "quality").limit(rows)
    known = known.select(F.col("doc_id").alias("_of"), F.col("quality").cast("int").alias("_label"))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    sample = texts.join(F.broadcast(known), F.col("_id") == F.col("_of")).select("_id", "_label", "_text")

    def placed(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shares(features(t, *statistics(t)[:2])) for t in raw_bytes(batch.column("_text"))]
        places = pa.array([p.astype("<u4").tobytes() for p, _ in found], pa.binary())
        values = pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())
        return pa.record_batch([batch.column("_id"), batch.column("_label"), places, values], names=sample_names)

    def fitted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        found.sort()
        rows = [(np.frombuffer(p, "<u4"), np.frombuffer(v, "<f4"), label) for _, label, p, v in found]
        if len({label for _, _, label in rows}) == 2:
            m = fit(rows)
            yield pa.record_batch(
                [pa.array([m.weights.tobytes()], pa.binary()), *(pa.array([x]) for x in (m.bias, m.scale, m.offset))],
                names=["weights", "bias", "scale", "offset"],
            )

    sample_names = ["_id", "_label", "places", "shares"]
    parts = sample.mapInArrow(per_slice(placed, "_text"), "_id long, _label int, places binary, shares binary")
    best = parts.repartition(1).mapInArrow(fitted, "weights binary, bias double, scale double, offset double").first()
    if best is None:
        return None
    return Model(np.frombuffer(bytes(best["weights"]), np.float32), best["bias"], best["scale"], best["offset"])


def judge(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the counts, base_failed, the calibrated quality, and kept.

    A document fails the rules with fewer than 20 words or with over 30 % of its words in repeated
    runs of eight. Others are kept if their probability of good quality reaches ``threshold``;
    without a model it is 1. Null text counts as empty and fails. Null ids and repeated rows stay;
    other columns are ignored. Texts are scored whole, in batches.
    """

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for text in raw_bytes(batch.column(1)):
            distinct, ids, counts = statistics(text)
            quality = model.probability(features(text, distinct, ids)) if model else 1.0
            failed = fails(counts)
            found.append((*counts, failed, not failed and quality >= threshold, quality))
        columns = list(zip(*found, strict=True)) if found else [()] * 8
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
        return pa.record_batch(
            [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names
        )

    names = ["_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]
    schema = (
        "_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
        " base_failed boolean, kept boolean, quality double"
    )
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return texts.mapInArrow(per_slice(rows, "_text"), schema).withColumnRenamed("_id", id_col)


def keep_good(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, all columns, filtered where they are read."""

    def good(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for text in raw_bytes(batch.column(text_col)):
            distinct, ids, counts = statistics(text)
            failed = fails(counts)
            keep.append(not failed and (model is None or model.probability(features(text, distinct, ids)) >= threshold))
        return batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(per_slice(good, text_col), docs.schema)


def fails(counts: tuple[int, int, int, int, int]) -> bool:
    """Fewer than 20 words, or over 30 % of them in repeated runs."""
    return counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
