"""Scans of project and chat folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions import vocab
from stratum.schema import MAX_FILE_BYTES, MAX_FILE_CHARS


def within_limits(n_bytes: Column, text: Column) -> Column:
    return (n_bytes <= MAX_FILE_BYTES) & (F.char_length(text) <= MAX_FILE_CHARS)


def _files(spark: SparkSession, root: str, extensions: list[str], skip_dirs: list[str], skip_files: list[str], limit: int | None) -> DataFrame:
    """source_file (relative), n_bytes, content. Files that are not UTF-8 are left out; files over the limits have ``skipped`` set."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    base = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/") + "/"
    bare = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/*", "/")
    relative = F.substr(bare(F.col("path")), F.length(bare(F.lit(base))) + 1)
    rows = raw.select(relative.alias("source_file"), F.col("length").alias("n_bytes"), "content")
    parts = F.split("source_file", "/")
    name = F.element_at(parts, -1)
    kept = rows.where(
        ~F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, skip_dirs))) & F.concat(F.lit("."), F.regexp_extract(name, r"[^.]\.([^.]*)$", 1)).isin(*extensions) & ~name.isin(*(skip_files or [""]))
    )
    kept = kept.orderBy("source_file").limit(limit) if limit is not None else kept
    text = F.try_validate_utf8(F.col("content").cast("string"))
    small = F.col("n_bytes") <= MAX_FILE_BYTES
    out = kept.select("source_file", "n_bytes", F.when(small, text).alias("content"), (~small).alias("_big"))
    out = out.where(F.col("_big") | F.col("content").isNotNull())
    return out.select("source_file", "n_bytes", "content", (F.col("_big") | (F.char_length("content") > MAX_FILE_CHARS)).alias("skipped"))


def project_files(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    return _files(spark, root, vocab.TEXT_EXTENSIONS, vocab.SKIP_DIRS, vocab.SKIP_FILES, limit)


def chat_files(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    return _files(spark, root, vocab.CHAT_EXTENSIONS, vocab.CHAT_SKIP_DIRS, [], limit)
