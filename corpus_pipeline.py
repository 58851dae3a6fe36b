"""From raw documents to packed training sequences, in stages that each write a table for the next.

Every stage takes (spark, docs, sf_dir), works on all of docs, and returns the columns of documents, the
last one the packed pieces. A stage's table is in the shared folder, so a lost executor costs only the
tasks it ran, and a later stage can be run again by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckhand.llm import common, neardup, packing, pii, quality, suffixes


def _as_documents(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, with the number of characters that the text now has."""
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return df.select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line labelling and the plain rules keep.

    A null text has no words and goes; rows that repeat stay or go together; without labels only the plain
    rules decide; an empty table stays empty; all columns of docs stay, also those named as columns of the rules.
    """
    field = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.assess(docs, field).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id; rows that repeat its id stay with it.

    Null and empty texts are like nothing and stay; rows without an id stay only if no row with an id is
    like them; an empty table stays empty; all columns stay as they are.
    """
    kept = neardup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(kept.kept_id), "left_semi")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages of an earlier one; one that is nothing else stays, empty.

    A null text becomes an empty one; rows that repeat an id, and rows without one, keep what only they share;
    an empty table stays empty; other columns stay, but n_chars follows the text.
    """
    return _as_documents(suffixes.remove_repeats(docs), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to pseudonyms under the session's key (see pii.session_key).

    A null text stays null; equal texts stay equal; an empty table stays empty; other columns stay, but
    n_chars follows the text.
    """
    return _as_documents(pii.pseudonymize(docs), docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences.

    A null text is one end id; rows that repeat an id, or have none, are packed each; an empty table gives no
    pieces; only id and text count, whatever other columns there are.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("personal data", personal_data),
    ("packing", packed_sequences),
]
#: Trained labelling, signatures and tokenizers have no SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with common.temporary(spark) as keep:
            docs = keep(common.written(stage(spark, before, sf_dir), name.replace(" ", "-")))
        if before is not source:
            common.dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
