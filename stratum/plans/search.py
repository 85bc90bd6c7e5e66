"""Hybrid search: one plan from queries and drawers to ranked hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.functions import text as X
from stratum.functions.embed import EmbeddingConfig, embed_column, phrase_overlap, provider, stemmed_terms
from stratum.operators import lexical, semantic
from stratum.operators.drawers import scoped

MOST = 50


def _heuristic(pairs: DataFrame, rows: DataFrame, queries: DataFrame) -> DataFrame:
    """``pairs`` (qid, id) with heuristic_score against the text of ``rows`` (id, text), which is stemmed once a row."""
    own = rows.select("id", "text", stemmed_terms(F.col("text")).alias("_terms"))
    both = pairs.join(own, "id").join(queries.select("qid", "query", "terms"), "qid")
    score = 0.7 * phrase_overlap(F.col("query"), F.col("terms"), F.col("text"), F.col("_terms")) + 0.3 * X.name_boost(F.col("query"), F.col("text"))
    return both.withColumn("heuristic_score", score).drop("query", "terms", "text", "_terms")


def _local(df: DataFrame) -> DataFrame:
    """A few rows a query, computed once and kept with the driver."""
    found = df.toArrow()
    return df.sparkSession.createDataFrame(found, df.schema) if found.num_rows else df.sparkSession.createDataFrame([], df.schema)


def _embedded(rows: DataFrame, config: EmbeddingConfig | None, vectors: DataFrame | None) -> DataFrame:
    """id, embedding of ``rows`` (id, content): as stored, or where there is none of this backend, made from the content."""
    embed = embed_column(config)
    if vectors is None:
        return rows.select("id", embed(F.col("content")).alias("embedding"))
    stored = vectors.where(F.col("backend") == backend(config)).select(F.col("drawer_id").alias("id"), "embedding")
    bare = rows.join(stored.select("id"), "id", "left_anti").select("id", embed(F.col("content")).alias("embedding"))
    return rows.select("id").join(stored, "id").select("id", "embedding").union(bare)


def backend(config: EmbeddingConfig | None) -> str:
    return provider(config or EmbeddingConfig.resolve("local", "builtin")).label.value


def hybrid(drawers: DataFrame, queries: DataFrame, limit: int = 5, wing: str | None = None, room: str | None = None, config: EmbeddingConfig | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Hits of each query (qid, query): scores, rank, snippet and the drawer's columns. ``vectors`` are stored ones (drawer_id,
    embedding, backend) of whole contents; drawers without one of this backend get theirs from the content. Only the heuristic reads previews.

    Of a query with lexical hits only these are scored by vectors; a query without any is held against all drawers in scope,
    in one scan that keeps the best of each batch. Hits are at most ``depth`` a query and list, and are kept with the driver."""
    k = min(limit, MOST)
    depth = max(20, 5 * k)
    embed = embed_column(config)
    own = _local(queries.where(X.strip(F.col("query")) != "").select("qid", "query", stemmed_terms(F.col("query")).alias("terms"), embed(F.col("query")).alias("vector")))
    active = scoped(drawers, wing, room)
    found = _local(lexical.search(drawers, own.select("qid", "query"), depth, wing, room))
    texts = active.join(F.broadcast(found.select("id").distinct()), "id").select("id", "content")
    lex = _heuristic(found, texts.select("id", F.col("content").alias("text")), own)
    lex = _local(lex.select("qid", "id", "lexical_rank", lexical.lexical_score(F.col("bm25")).alias("lexical_score"), "heuristic_score"))

    preview = F.substring("content", 1, 300)
    pairs = found.select("qid", "id").join(_embedded(texts, config, vectors), "id").join(own.select("qid", "vector"), "qid")
    pairs = pairs.select("qid", "id", X.cosine(F.col("embedding"), F.col("vector")).alias("semantic_score"))
    scored = _heuristic(pairs, texts.select("id", preview.alias("text")), own).select("qid", "id", "semantic_score", "heuristic_score")
    alone = own.join(found.select("qid").distinct(), "qid", "left_anti")
    if not alone.isEmpty():
        rows = _embedded(active.select("id", "content"), config, vectors).join(active.select("id", preview.alias("preview")), "id")
        if vectors is None:
            rows = active.select("id", embed(F.col("content")).alias("embedding"), preview.alias("preview"))
        scored = scored.union(semantic.scan(rows, alone, depth))
    sem = semantic.top_k(scored, semantic.semantic_order(), depth, "semantic_rank")
    sem = _local(sem.select("qid", "id", "semantic_rank", "semantic_score", "heuristic_score"))

    hits = semantic.resolved(semantic.fuse(lex, sem, drawers.where("active")), drawers)
    top = semantic.top_k(hits, F.col("fused_score"), k, "rank")
    out = top.join(own.select("qid", "query"), "qid").join(drawers.select("id", "wing", "room", "source_file", "chunk_index", "content", "added_by", "filed_at"), "id")
    return out.select(
        "qid", "rank", "id", "wing", "room", "source_file", "chunk_index", lexical.snippet(F.col("content"), F.col("query")).alias("snippet"), "drawer_type",
        *(F.round(c, 6).alias(c) for c in ("lexical_score", "semantic_score", "heuristic_score", "fused_score")), "parent_drawer_id",
        F.lit(backend(config)).alias("embedding_backend"), "added_by", "filed_at",
    )


def duplicates(drawers: DataFrame, contents: DataFrame, threshold: float = 0.85, config: EmbeddingConfig | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Stored drawers that a new content (qid, query) repeats."""
    return semantic.duplicates(hybrid(drawers, contents, 5, config=config, vectors=vectors), threshold)


def only_ids(drawers: DataFrame, queries: DataFrame, k: int, backend: str, config: EmbeddingConfig | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """qid, id, rank by one method: fts, local, onnx, openai or hybrid. Vector methods score whole contents of all drawers."""
    if backend == "fts":
        return lexical.search(drawers, queries, k).select("qid", "id", F.col("lexical_rank").alias("rank"))
    if backend == "hybrid":
        return hybrid(drawers, queries, k, config=config, vectors=vectors).select("qid", "id", "rank")
    embed = embed_column(config)
    rows = _embedded(drawers.where("active").select("id", "content"), config, vectors)
    scored = semantic.cosine_scores(rows, queries.select("qid", embed(F.col("query")).alias("vector")), k)
    return semantic.top_k(scored, F.col("semantic_score"), k, "rank").select("qid", "id", "rank")
