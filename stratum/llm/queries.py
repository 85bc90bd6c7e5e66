"""The queries of this subpackage: an operator each, applied to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import decontam, jaccard_join, langid, licenses, lm_score, packing, pii, quality_rules, substring_dedup, warc_store
from stratum.llm.oracle import ORACLE  # noqa: F401
from stratum.llm.shared import spread


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_store.round_trip(read(spark, sf_dir, "pages")).drop("url")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(read(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(n(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)),
        F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.concat("base", "learned")).alias("spans"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", decontam.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontam.is_contaminated().alias("contaminated"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.of_documents(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "declared", "language", F.round("confidence", 6).alias("confidence"), "n_letters", F.col("accepted").alias("kept"))


def page_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "lang", "text")
    found = langid.of_pages(read(spark, sf_dir, "pages"), docs)
    return found.select(F.col("id").alias("page_id"), "declared", "language", F.round("confidence", 6).alias("confidence"), "n_letters", F.col("accepted").alias("kept"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(read(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.get("matches", 0)
    found = licenses.scan(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.size("matches").cast("long").alias("n_matches"), best["license"].alias("license"),
        F.coalesce(best["template"].cast("long"), F.lit(-1)).alias("template"), F.coalesce(best["dice"], F.lit(0.0)).alias("dice"), best["word"].cast("long").alias("word"),
    )


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_warc": op3_warc,
    "op4_pii": op4_pii,
    "op5_decontamination": op5_decontamination,
    "op6_language_id": op6_language_id,
    "page_language_id": page_language_id,
    "op7_packing": op7_packing,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_license_scan": op9_license_scan,
    "op10_lm_score": op10_lm_score,
}
