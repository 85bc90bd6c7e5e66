"""Incremental mining: each micro-batch of changed files goes through the same plans as a batch run.

A batch is merged by source and hash, so one that is delivered twice changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratum.functions.embed import EmbeddingConfig
from stratum.plans.ingest import commit, project_plan
from stratum.sources.config import ProjectConfig
from stratum.store import Store, changed


def refresh(store: Store, batch: DataFrame, config: ProjectConfig, embedding: EmbeddingConfig | None = None) -> int:
    """Mine the files of a batch (source_file, content) that are not at their stored revision; of several versions of one the greatest hash counts."""
    one = batch.groupBy("source_file").agg(F.max_by("content", F.md5("content")).alias("content")).withColumn("source_hash", F.md5("content"))
    new = changed(one, store.read("revisions")).select("source_file", "content").cache()
    try:
        return 0 if new.isEmpty() else commit(store, *project_plan(new, config), embedding)
    finally:
        new.unpersist()


def watch(files: DataFrame, store: Store, config: ProjectConfig, checkpoint: str, embedding: EmbeddingConfig | None = None, **trigger) -> StreamingQuery:
    """Start mining a stream of (source_file, content)."""
    writer = files.writeStream.foreachBatch(lambda batch, _: refresh(store, batch, config, embedding) and None).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
