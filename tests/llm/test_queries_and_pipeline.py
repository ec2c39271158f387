"""Registered queries against their SQL, and the pipeline against plain Python."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import oracle
import pytest
from kreiswerk.llm.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    rows, difference = oracle.compare(spark, oracle.connect(SF), QUERIES[name], SQL[name], SF)
    assert difference is None and rows > 0, difference


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_covers_its_table(spark, name):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES[name](spark, SF)
    assert got.select("doc_id").distinct().count() == documents.count()


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stages(spark):
    """Each stage against what may leave it, from the rows that reached it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        held = Counter(r.doc_id for r in docs.collect())
        docs = corpus_pipeline.cut(stage(spark, docs, SF), "test")
        after = docs.collect()
        left[name] = len(after)
        if name != "best-fit packing":
            assert docs.columns == columns
        if name == "quality rules":
            gone = set(before) - {r.doc_id for r in after}
            good = [i for i in before if labels.get(i) == 1 and len(before[i].text.split()) >= 60]
            assert len(gone.intersection(good)) <= 0.05 * len(good)
            bad = [i for i, q in labels.items() if q == 0]
            assert len(gone.intersection(bad)) >= 0.9 * len(bad)
        if name == "exact dedup":
            best = defaultdict(int)
            for i, r in before.items():
                text = re.sub("[A-Z]", lambda m: m[0].lower(), r.text)
                best[text] = max(best[text], i)
            assert sorted(r.doc_id for r in after) == sorted(best.values())
        if name == "near dedup":
            ids = sorted(r.doc_id for r in after)
            sets = {i: shingles(before[i].text) for i in before}
            near = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            assert not [(i, j) for i in ids for j in ids if i < j and near(i, j) >= 0.8]
            for i in set(before) - set(ids):  # what went has a relative that was there
                assert max(near(i, j) for j in before if j != i) >= 0.8
        if name == "source mix":
            assert Counter(r.doc_id for r in after).most_common(1)[0][1] <= 3
        if name == "best-fit packing":
            pieces = Counter((r.doc_id, r.piece) for r in after)
            assert {i for i, _ in pieces} == set(before) and all(pieces[i, 0] == held[i] for i in before)
            fill = Counter()
            for r in after:
                fill[r.sequence_id] += r.length
            assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 2
    assert left["exact dedup"] < left["quality rules"] and corpus_pipeline.ORACLE_SQL is None


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
