"""Retrieval benchmarks: read a dataset, index it, run its queries, measure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions.embed import EmbeddingConfig
from stratum.operators import metrics
from stratum.plans.search import only_ids
from stratum.schema import MAX_DATASET_BYTES, MAX_DATASET_DOCS

DOCS = "array<struct<id:string,wing:string,room:string,content:string,source_file:string>>"
ASKED = "array<struct<id:string,query:string,relevant_ids:array<string>>>"


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents and queries of a JSON file, or of JSON lines with a ``kind``."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    if size > MAX_DATASET_BYTES:
        raise ValueError(f"the dataset has {size} bytes; at most {MAX_DATASET_BYTES} are read")
    if path.endswith(".jsonl"):
        kinds = "kind string, id string, wing string, room string, content string, source_file string, query string, relevant_ids array<string>"
        rows = spark.read.schema(kinds).json(path)
        return rows.where("kind = 'document'").select("id", "wing", "room", "content", "source_file"), rows.where("kind = 'query'").select("id", "query", "relevant_ids")
    rows = spark.read.option("multiLine", "true").schema(f"documents {DOCS}, queries {ASKED}").json(path)
    docs, asked = rows.select(F.inline("documents")), rows.select(F.inline("queries"))
    if docs.limit(MAX_DATASET_DOCS + 1).count() > MAX_DATASET_DOCS:
        raise ValueError(f"the dataset has more than {MAX_DATASET_DOCS} documents")
    return docs, asked


def hashed_sources(docs: DataFrame) -> DataFrame:
    """source_file, source_hash, n: a digest of a source's documents, each by its digest, summed in any order, so
    that no source is gathered in one place."""
    line = F.md5(F.concat_ws(":", "id", "wing", "room", "content"))
    part = lambda at: F.sum(F.conv(F.substring("line", at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    sums = docs.select("source_file", line.alias("line")).groupBy("source_file").agg(part(1).alias("x"), part(18).alias("y"), F.count("*").alias("n"))
    return sums.select("source_file", F.md5(F.concat_ws(":", "x", "y", "n")).alias("source_hash"), "n")


def as_drawers(docs: DataFrame) -> DataFrame:
    own = docs.withColumn("source_file", F.coalesce("source_file", F.concat(F.lit("bench/"), "id", F.lit(".md"))))
    null = lambda kind: F.lit(None).cast(kind)
    return own.join(hashed_sources(own), "source_file").select(
        "id", "wing", "room", "source_file", F.lit(0).cast("long").alias("chunk_index"), F.lit("benchmark").alias("added_by"), F.current_timestamp().alias("filed_at"), "content",
        null("string").alias("hall"), null("string").alias("date"), F.lit("drawer").alias("drawer_type"), "source_hash", F.lit(True).alias("active"),
        *(null("double").alias(c) for c in ("importance", "emotional_weight", "weight")),
    )


def run(drawers: DataFrame, asked: DataFrame, backend: str = "hybrid", k: int = 5, config: EmbeddingConfig | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """One row: queries, recall_at_k, mrr, ndcg_at_k."""
    queries = asked.select(F.col("id").alias("qid"), "query")
    relevant = asked.select(F.col("id").alias("qid"), F.explode("relevant_ids").alias("id"))
    return metrics.evaluate(only_ids(drawers, queries, k, backend, config, vectors), relevant, queries, k)
