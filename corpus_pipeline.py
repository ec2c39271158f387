"""From raw documents to packed training sequences, in stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kreiswerk.llm.exact_dedup import drop_copies
from kreiswerk.llm.mixing import mixed_rows
from kreiswerk.llm.packing import best_fit, token_pieces
from kreiswerk.llm.quality import keep_good, train
from kreiswerk.llm.queries import TOKENIZER
from kreiswerk.llm.simhash import drop_near_copies
from kreiswerk.llm.work import cut, ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and the classifier trained on the labelled ones."""
    ship(spark)
    return keep_good(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    ship(spark)
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the document with the smallest id."""
    ship(spark)
    return drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    ship(spark)
    return mixed_rows(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the pieces of all documents, repeated ones too, in sequences of 2048 tokens."""
    import public_tokenizers

    ship(spark)
    # Workers still hold what earlier stages needed, so they remember fewer words than they might.
    packed = best_fit(token_pieces(docs, public_tokenizers.path(TOKENIZER), remembered=200_000))
    return packed.withColumn("length", F.col("length").cast("long"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("source mix", source_mix),
    ("best-fit packing", best_fit_packing),
]

# A trained classifier, fingerprints and tokens are beyond SQL; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
