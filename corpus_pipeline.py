"""From documents to training pieces: filter, deduplicate, pseudonymise, mix and encode.

Each stage is written as a table in the shared folder and read again by the next one, so a lost executor costs no
earlier stage. Every stage works on all rows its predecessor kept.

Defined results: null and empty texts are not toxic and are near duplicates of each other, so one of them stays, has no
pieces, and is in the result if the mix takes it. Repeated rows are near duplicates, and one of them stays. Without labels nothing is rejected.
Other columns go through all stages but the last, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import mixing, near_dup, pieces, pseudonyms, quality_gam, toxicity
from panelspark.session import settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; without labels it rejects none."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, quality_gam.folds(F.col("doc_id"), 5) != 0)
    return docs.where(toxicity.score(docs, model) <= 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dup.keep_one(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with format-preserving pseudonyms for personal data."""
    return pseudonyms.pseudonymise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and whether they decode to its text."""
    machine = pieces.load()
    encoded = pieces.with_pieces(docs, name="pieces")
    return encoded.select(
        "doc_id", "lang", "source", "n_chars", F.size("pieces").cast("long").alias("n_pieces"), "pieces",
        (pieces.text_of(F.col("pieces"), machine) == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pseudonyms", hide_personal_data),
    ("mixing", mix_sources),
    ("pieces", to_pieces),
]

# Trained models, keyed permutations and Viterbi decoding are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
