"""A store of Parquet snapshots under numbered manifests.

A change writes the tables that it touches anew beside the old ones, then one manifest that names the
snapshot of every table, and so takes effect for all of them at once. A manifest is written under another
name, closed, and renamed to a number that none has; what is there is never moved or deleted before. The
current one is the complete manifest of the highest number, so a crash at any step leaves the store as it
was. Readers keep the snapshots they opened: those of the manifest before stay until the next change.
One writer at a time: of two the later finds its number taken, and fails."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum import schema

TABLES = {"drawers": schema.DRAWERS, "revisions": schema.REVISIONS, "vectors": schema.VECTORS, "entities": schema.ENTITIES, "triples": schema.TRIPLES}


# ---- plans: old rows and a batch in, new rows out ---------------------------------------------------


def retired(drawers: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of the planned sources (source_file, source_hash) become inactive unless they have the planned hash; a null hash differs."""
    own = plan.select("source_file", F.col("source_hash").alias("_hash"), F.lit(True).alias("_planned"))
    out = drawers.join(own, "source_file", "left")
    stays = F.col("_planned").isNull() | F.col("source_hash").eqNullSafe(F.col("_hash"))
    return out.withColumn("active", F.col("active") & stays).select(drawers.columns)


def retired_source(drawers: DataFrame, source_file: str) -> DataFrame:
    """All rows of a source become inactive."""
    return drawers.withColumn("active", F.col("active") & ~F.col("source_file").eqNullSafe(F.lit(source_file)))


def merged(drawers: DataFrame, batch: DataFrame) -> DataFrame:
    """Old rows, retired as the batch's sources ask, with rows of the same id replaced by the batch's."""
    plan = batch.groupBy("source_file").agg(F.max("source_hash").alias("source_hash"))
    return retired(without(drawers, batch.select("id")), plan).unionByName(batch)


def without(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_anti").select(rows.columns)


def latest_revisions(log: DataFrame) -> DataFrame:
    """The newest hash of each source."""
    return log.groupBy("source_file").agg(F.max_by("source_hash", F.struct("updated_at", "source_hash")).alias("source_hash"), F.max("updated_at").alias("updated_at"))


def changed(files: DataFrame, revisions: DataFrame) -> DataFrame:
    """Files that are not stored at their present hash."""
    return files.join(revisions.select("source_file", "source_hash"), ["source_file", "source_hash"], "left_anti").select(files.columns)


# ---- the snapshots --------------------------------------------------------------------------------


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _manifests(self) -> list[int]:
        """Numbers of the complete manifests, ascending."""
        fs, folder = self._fs(f"{self.path}/manifests")
        if not fs.exists(folder):
            return []
        found = [re.fullmatch(r"([0-9]+)\.json", status.getPath().getName()) for status in fs.listStatus(folder)]
        return sorted(int(m[1]) for m in found if m)

    def _tables(self, number: int) -> dict[str, str]:
        """The snapshot of every table under a manifest."""
        fs, p = self._fs(f"{self.path}/manifests/{number}.json")
        reader = fs.open(p)
        try:
            return json.loads(bytes(reader.readAllBytes()).decode())
        finally:
            reader.close()

    def read(self, table: str) -> DataFrame:
        """The current snapshot; an empty table before the first write."""
        numbers = self._manifests()
        name = self._tables(numbers[-1]).get(table) if numbers else None
        if name is None:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.path}/{table}/{name}")

    def write(self, table: str, rows: DataFrame) -> None:
        self.write_all({table: rows})

    def write_all(self, changed_tables: dict[str, DataFrame]) -> None:
        """Make these rows the current snapshots of their tables, all at once. Drawers are laid out by wing, so that a wing's scan reads that wing."""
        numbers = self._manifests()
        tables = self._tables(numbers[-1]) if numbers else {}
        for table, rows in changed_tables.items():
            tables[table] = self._snapshot(table, rows)
        self._publish(numbers[-1] + 1 if numbers else 1, tables)
        self._prune()

    def _snapshot(self, table: str, rows: DataFrame) -> str:
        name = f"snapshot-{uuid.uuid4().hex}"
        rows = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[table]))
        if table == "drawers":  # rows of a wing meet in few tasks; adaptive execution splits a large wing
            rows.hint("rebalance", "wing").write.partitionBy("wing").parquet(f"{self.path}/{table}/{name}")
        else:
            rows.write.parquet(f"{self.path}/{table}/{name}")
        return name

    def _publish(self, number: int, tables: dict[str, str]) -> None:
        fs, draft = self._fs(f"{self.path}/manifests/draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        _, final = self._fs(f"{self.path}/manifests/{number}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"another writer has changed the store {self.path}")

    def _prune(self) -> None:
        """Once a manifest stands, what neither it nor the one before names is deleted."""
        numbers = self._manifests()
        keep = [self._tables(n) for n in numbers[-2:]]
        for table in TABLES:
            fs, folder = self._fs(f"{self.path}/{table}")
            for status in fs.listStatus(folder) if fs.exists(folder) else ():
                if status.getPath().getName() not in {tables.get(table) for tables in keep}:
                    fs.delete(status.getPath(), True)
        for n in numbers[:-2]:
            fs, p = self._fs(f"{self.path}/manifests/{n}.json")
            fs.delete(p, False)

    def refresh(self, batch: DataFrame, vectors: DataFrame | None = None, more: dict[str, DataFrame] | None = None) -> int:
        """Upsert a batch of planned rows, retire what it supersedes and record the revisions, with ``more`` tables in one
        change. Returns the rows of the batch."""
        batch = batch.withColumn("active", F.lit(True)).cache()
        n = batch.count()
        log = batch.where("source_hash is not null").select("source_file", "source_hash", F.col("filed_at").alias("updated_at")).distinct()
        tables = {"drawers": merged(self.read("drawers"), batch.select(schema.DRAWERS.names)), "revisions": latest_revisions(self.read("revisions").unionByName(log))}
        if vectors is not None:
            tables["vectors"] = without(self.read("vectors"), vectors, "drawer_id").unionByName(vectors.select(schema.VECTORS.names))
        self.write_all(tables | (more or {}))
        batch.unpersist()
        return n

    def retire_source(self, source_file: str) -> None:
        self.write("drawers", retired_source(self.read("drawers"), source_file))

    def delete(self, ids: list[str]) -> int:
        rows = self.read("drawers")
        n = rows.where(F.col("id").isin(ids)).count()
        gone = self.spark.createDataFrame([(i,) for i in ids], "id string")
        self.write_all({"drawers": without(rows, gone), "vectors": without(self.read("vectors"), gone.withColumnRenamed("id", "drawer_id"), "drawer_id")})
        return n

    def views(self) -> None:
        """Tables as temporary views, for SQL of the user's own."""
        for table in TABLES:
            self.read(table).createOrReplaceTempView(table)
