"""The corpus pipeline: quality filter, exact and near dedup, mix of sources, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last
return the columns of documents; ``run`` writes each stage's rows as Parquet in the shared folder and
reads them again, so lost executors cost a stage at most.

Cases: an empty table passes every stage as an empty table; null texts count as empty; rows without doc_id are
rows like others, and lose to equal or similar ones that have a doc_id; rows that repeat a doc_id are judged by
their own texts, near copies excepted, where they are kept or dropped together; very long texts are read whole;
all columns of documents are carried, whatever their names, up to the last stage. Without labels all pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import exact_dedup, minhash, mixing, pieces, quality
from skein.llm.common import table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8)."""
    return minhash.kept_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 0 to 3 times."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row of the mix, as counts and digests, and whether they decode to its text."""
    return pieces.round_trip(docs, stored=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("minhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]

#: SQL cannot express the classifier, the sketches or the tilt; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
