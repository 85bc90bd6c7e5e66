"""Filters, roll-ups and ranked reads of drawers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions import text as X
from stratum.functions.names import slug
from stratum.schema import DEFAULT_IMPORTANCE, DIARY, DRAWER


def scoped(drawers: DataFrame, wing: str | None = None, room: str | None = None) -> DataFrame:
    """Active drawers of a wing and a room, where given."""
    out = drawers.where("active")
    if wing is not None:
        out = out.where(F.col("wing") == wing)
    return out.where(F.col("room") == room) if room is not None else out


def recent_first() -> list[Column]:
    return [F.desc("filed_at"), F.asc("chunk_index"), F.asc("id")]


def recall(drawers: DataFrame, wing: str | None = None, room: str | None = None, n: int = 10) -> DataFrame:
    """The n newest drawers in scope."""
    return scoped(drawers, wing, room).orderBy(*recent_first()).limit(n)


def is_derived(kind: Column) -> Column:
    return ~kind.isin(DRAWER, DIARY)


def taxonomy(drawers: DataFrame) -> DataFrame:
    return scoped(drawers).groupBy("wing", "room").agg(F.count("*").alias("n"))


def taxonomy_map(drawers: DataFrame) -> DataFrame:
    """One row per wing: wing, map from room to count. (Rooms of a wing, not its drawers, are gathered.)"""
    return taxonomy(drawers).groupBy("wing").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("room", "n")))).alias("rooms"))


def by_type(drawers: DataFrame) -> DataFrame:
    return scoped(drawers).groupBy("drawer_type").agg(F.count("*").alias("n"))


def top_wings(drawers: DataFrame, n: int = 100) -> DataFrame:
    return scoped(drawers).groupBy("wing").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "wing").limit(n)


def importance() -> Column:
    return F.coalesce("importance", "emotional_weight", "weight", F.lit(DEFAULT_IMPORTANCE))


def most_important(drawers: DataFrame, wing: str | None = None, n: int = 15) -> DataFrame:
    return scoped(drawers, wing).withColumn("rank_importance", importance()).orderBy(F.desc("rank_importance"), *recent_first()).limit(n)


def budget_cut(rows: DataFrame, size: Column, order: list, budget: int, by: list[str] | None = None) -> DataFrame:
    """Rows in order up to the first that takes the running total over the budget; ``cumulative`` is the total.
    Without ``by`` all rows share one budget: let them be few."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("cumulative", F.sum(size).over(w))
    return out.where(F.col("cumulative") <= budget)  # totals only grow, so nothing after the first overflow fits


def first_chunks(drawers: DataFrame) -> DataFrame:
    """source_file, parent (struct of id, wing, room, chunk_index): the first raw chunk of each source."""
    raw = drawers.where(F.col("active") & (F.col("drawer_type") == DRAWER))
    return raw.groupBy("source_file").agg(F.min_by(F.struct("id", "wing", "room", "chunk_index"), F.struct("chunk_index", "id")).alias("parent"))


def newest_compressed(drawers: DataFrame) -> DataFrame:
    """raw_id, compressed id and content: the newest compressed artifact of each raw drawer."""
    own = drawers.where(F.col("active") & (F.col("drawer_type") == "compressed")).withColumn("raw_id", F.regexp_extract("id", "^aaak_(.*)_[0-9a-f]{12}$", 1))
    best = F.max_by(F.struct(F.col("id").alias("compressed_id"), F.col("content").alias("compressed")), F.struct("filed_at", "id"))
    return own.where("raw_id <> ''").groupBy("raw_id").agg(best.alias("c")).select("raw_id", "c.*")


def compact_context(drawers: DataFrame, wing: str | None = None, room: str | None = None, n: int = 10) -> DataFrame:
    """The newest drawers in scope with their compressed form, if any."""
    rows = recall(drawers, wing, room, n)
    return rows.join(newest_compressed(drawers), F.col("id") == F.col("raw_id"), "left").drop("raw_id")


def diary(drawers: DataFrame, agent: str, n: int = 10) -> DataFrame:
    """Diary entries among the agent's n newest drawers (the limit comes before the filter)."""
    return recall(drawers, f"wing_{slug(agent)}", None, n).where(F.col("room") == "diary")


def compression_totals(pairs: DataFrame) -> DataFrame:
    """Bytes, tokens and ratio over pairs of ``content`` and ``compressed``."""
    sums = pairs.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("original_chars"), F.coalesce(F.sum(F.octet_length("compressed")), F.lit(0)).alias("compressed_chars"))
    return sums.select(
        "original_chars", "compressed_chars", F.floor(F.col("original_chars") / 4).alias("original_tokens"), F.floor(F.col("compressed_chars") / 4).alias("compressed_tokens"),
        (F.col("original_chars") / F.greatest("compressed_chars", F.lit(1))).alias("ratio"),
    )


def compressed_artifacts(raw: DataFrame) -> DataFrame:
    """A compressed artifact of each raw drawer; the id names the drawer and the content's digest."""
    body = X.compressed(F.col("content"), F.col("wing"), F.col("room"), F.col("date"), F.col("source_file"))
    out = raw.where(F.col("drawer_type") == DRAWER).select("*", body.alias("_c"))
    digest = F.md5("_c")
    return out.select(
        F.concat(F.lit("aaak_"), "id", F.lit("_"), F.substring(digest, 1, 12)).alias("id"), "wing", "room", F.concat("source_file", F.lit("#aaak")).alias("source_file"), "chunk_index",
        F.lit("compress").alias("added_by"), "filed_at", F.col("_c").alias("content"), "hall", "date", F.lit("compressed").alias("drawer_type"), digest.alias("source_hash"),
        F.lit(True).alias("active"), F.coalesce("importance", F.lit(6.5)).alias("importance"), "emotional_weight", F.coalesce("weight", F.lit(6.0)).alias("weight"),
    )
