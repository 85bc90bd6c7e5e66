"""Retrieval quality: hit rate, reciprocal rank and NDCG at k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate(results: DataFrame, relevant: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """One row: queries, recall_at_k (share with a relevant hit in the first k), mrr, ndcg_at_k.
    ``results``: qid, id, rank from 1; ``relevant``: qid, id; ``queries``: qid."""
    hits = results.join(relevant.distinct(), ["qid", "id"]).groupBy("qid").agg(
        F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg")
    )
    ideal = relevant.distinct().groupBy("qid").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("m"))
    ideal = ideal.select("qid", F.aggregate(F.sequence(F.lit(1), F.col("m")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1)).alias("idcg"))
    rows = queries.select("qid").distinct().join(hits, "qid", "left").join(ideal, "qid", "left")
    n = F.greatest(F.count("*"), F.lit(1))
    per = lambda c: F.coalesce(F.sum(c), F.lit(0.0)) / n
    return rows.agg(
        F.count("*").alias("queries"), (F.count_if(F.col("first") <= k) / n).alias("recall_at_k"), per(1 / F.col("first")).alias("mrr"),
        per(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg"))).alias("ndcg_at_k"),
    )
