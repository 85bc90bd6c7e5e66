"""A corpus pipeline: five of the operators of ``stratum.llm``, each over all its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of ``documents``.

Defined results of every stage: an empty table gives an empty table; other columns are carried along,
whatever their names; a row without doc_id or with a repeated one is judged by its own text. Null and
empty texts have no letters and go at the first stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import decontam, jaccard_join, langid, packing, pii
from stratum.llm.shared import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text and host give a confident language. Those without letters go; of equal likelihoods the first language in order counts."""
    return langid.accepted_only(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of smallest doc_id; rows without doc_id stay, and of rows that share one the least text stays."""
    return jaccard_join.one_of_each(docs).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item. A null or empty text holds none."""
    return decontam.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets; a null text stays null."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into training sequences; a null text is the end id alone."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_copies),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("packing", sequences),
]

#: SQL expresses neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
