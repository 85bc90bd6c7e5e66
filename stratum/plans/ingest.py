"""Mining: files and chats become drawers, artifacts and facts, a batch per run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum import schema
from stratum.functions import text as X
from stratum.functions.chunk import chunk_text
from stratum.functions.embed import EmbeddingConfig, embed_column, provider
from stratum.functions.passages import exchanges_of
from stratum.operators import artifacts, kg
from stratum.sources import chats, files
from stratum.sources.config import ProjectConfig, Room
from stratum.store import Store, changed

LEAST_CONFIDENCE = 0.8


@dataclass
class Summary:
    seen: int
    skipped: int
    added: int
    rooms: dict[str, int]


def file_room(source_file: Column, content: Column, rooms: list[Room]) -> Column:
    """By folder from the outermost, then by file name, then by the most words in the first 2,000 characters."""
    path = F.lower(source_file)
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    stem, head = F.lower(X.file_stem(source_file)), F.lower(F.substring(content, 1, 2000))
    meets = lambda part, name: F.lit(name).contains(part) | part.contains(F.lit(name))
    own = [(r, r.name.lower()) for r in rooms]
    by_folder = F.transform(folders, lambda p: F.coalesce(*(F.when(meets(p, name), F.lit(r.name)) for r, name in own)))
    first_folder = F.try_element_at(F.array_compact(by_folder), F.lit(1))
    by_stem = F.coalesce(*(F.when(meets(stem, name), F.lit(r.name)) for r, name in own))
    count = lambda word: (F.length(head) - F.length(F.replace(head, F.lit(word), F.lit("")))) / F.lit(max(len(word), 1))
    scores = [(r, sum((count(w.lower()) for w in [r.name, *r.keywords] if w), F.lit(0.0))) for r, _ in own]
    best = F.greatest(*(s for _, s in scores), F.lit(0.0))
    by_words = F.coalesce(*(F.when((s == best) & (best > 0), F.lit(r.name)) for r, s in scores))
    return F.coalesce(first_folder, by_stem, by_words, F.lit("general"))


def _drawers(rows: DataFrame, wing: Column, agent: str) -> DataFrame:
    """Rows with source_file, source_hash, chunk_index, room, hall, date, content, drawer_type, importance, weight, id as drawers."""
    return rows.select(
        "id", wing.alias("wing"), "room", "source_file", F.col("chunk_index").cast("long").alias("chunk_index"), F.lit(agent).alias("added_by"), F.current_timestamp().alias("filed_at"), "content", "hall", "date",
        "drawer_type", "source_hash", F.lit(True).alias("active"), "importance", F.lit(None).cast("double").alias("emotional_weight"), "weight",
    )


def _raw(rows: DataFrame, suffix: str = "") -> DataFrame:
    return rows.withColumns({
        "id": X.drawer_id(F.col("source_file"), F.col("chunk_index"), F.col("source_hash"), suffix), "importance": F.lit(None).cast("double"), "weight": F.lit(None).cast("double"),
    })


def _artifacts(rows: DataFrame, made: Column) -> DataFrame:
    own = rows.select("source_file", "source_hash", "date", F.posexplode(made).alias("place", "x"))
    own = own.select("source_file", "source_hash", "date", (F.col("place") + schema.ARTIFACT_OFFSET).alias("chunk_index"), "x.*")
    key = F.concat_ws(":", "source_file", F.lit("artifact"), F.col("chunk_index").cast("string"), "source_hash")
    return own.withColumn("id", F.substring(F.md5(key), 1, 16))


def project_plan(found: DataFrame, config: ProjectConfig, agent: str = "stratum") -> tuple[DataFrame, DataFrame]:
    """Drawers and facts of files (source_file, content)."""
    own = found.where(F.octet_length(X.strip(F.col("content"))) >= schema.MIN_CHUNK).withColumn("source_hash", F.md5("content"))
    own = own.withColumn("room", file_room(F.col("source_file"), F.col("content"), config.rooms)).withColumn("date", X.infer_date(F.col("content"), F.col("source_file")))
    own = own.withColumn("hall", X.file_hall(F.col("room"), F.col("content"), F.col("source_file")))
    chunks = own.select("source_file", "source_hash", "room", "hall", "date", F.posexplode(chunk_text("content")).alias("chunk_index", "content"))
    raw = _raw(chunks.withColumn("drawer_type", F.lit(schema.DRAWER)))
    made = _artifacts(own, artifacts.of_text(F.col("content"), F.col("room"), F.col("date"), F.col("source_file")))
    wing = F.lit(config.wing)
    return _drawers(raw, wing, agent).unionByName(_drawers(made, wing, agent)), _facts(own)


def chat_plan(found: DataFrame, wing: str, agent: str = "stratum", general: bool = False) -> tuple[DataFrame, DataFrame]:
    """Drawers and facts of chats (source_file, content): exchanges, or with ``general`` typed memories."""
    own = found.withColumn("source_hash", F.md5("content")).withColumn("content", chats.normalised(F.col("source_file"), F.col("content")))
    own = own.where(F.octet_length(X.strip(F.col("content"))) >= schema.MIN_CHAT_CHUNK).withColumn("date", X.infer_date(F.col("content"), F.col("source_file")))
    base = ["source_file", "source_hash", "date"]
    if general:
        rows = own.select(*base, F.posexplode(artifacts.memories(F.col("content"))).alias("chunk_index", "m"))
        rows = rows.select(*base, "chunk_index", F.col("m.content").alias("content"), F.col("m.memory_type").alias("room"), F.lit("derived_memory").alias("drawer_type"))
        raw = _raw(rows.withColumn("hall", X.chat_hall(F.col("room"), F.col("content"), F.col("source_file"), True)), "general")
    else:
        rows = own.select(*base, F.posexplode(exchanges_of(F.col("content"))).alias("chunk_index", "content"))
        rows = rows.withColumn("room", X.chat_room(F.col("content"))).withColumn("drawer_type", F.lit(schema.DRAWER))
        raw = _raw(rows.withColumn("hall", X.chat_hall(F.col("room"), F.col("content"), F.col("source_file"))))
    made = _artifacts(own, artifacts.of_text(F.col("content"), X.chat_room(F.col("content")), F.col("date"), F.col("source_file"), chat=True))
    return _drawers(raw, F.lit(wing), agent).unionByName(_drawers(made, F.lit(wing), agent)), _facts(own)


def _facts(own: DataFrame) -> DataFrame:
    found = own.select("source_file", F.inline(X.facts(F.col("content")))).where(F.col("confidence") >= LEAST_CONFIDENCE)
    return found.select("subject", "predicate", "object", F.lit(None).cast("string").alias("valid_from"), "confidence", F.lit(None).cast("string").alias("source_closet"), "source_file")


def commit(store: Store, drawers: DataFrame, facts: DataFrame, config: EmbeddingConfig | None = None) -> int:
    """Write a batch in one change: drawers, vectors, revisions, entities and triples."""
    drawers = drawers.cache()
    embed = embed_column(config)
    label = provider(config or EmbeddingConfig.resolve("local", "builtin")).label.value
    vectors = drawers.select(F.col("id").alias("drawer_id"), embed(F.col("content")).alias("embedding"), F.lit(label).alias("backend"))
    facts = facts.cache()
    now = F.current_timestamp()
    names = facts.select(F.col("subject").alias("name")).union(facts.select("object"))
    more = {"entities": kg.with_entities(store.read("entities"), names, now), "triples": kg.add(store.read("triples"), facts, now)}
    added = store.refresh(drawers, vectors, more)
    for df in (drawers, facts):
        df.unpersist()
    return added


def mine(store: Store, root: str, config: ProjectConfig, chat: bool = False, agent: str = "stratum", limit: int | None = None, general: bool = False, dry_run: bool = False, force: bool = False, embedding: EmbeddingConfig | None = None) -> Summary:
    """Mine a folder. Files at their stored revision are passed over (unless forced); a dry run writes nothing."""
    spark = store.spark
    found = (files.chat_files if chat else files.project_files)(spark, root, limit).cache()
    good = found.where("not skipped").select("source_file", "content")
    if not (dry_run or force):
        keyed = changed(good.withColumn("source_hash", F.md5("content")), store.read("revisions"))
        good = keyed.select("source_file", "content")
    drawers, facts = chat_plan(good, config.wing, agent, general) if chat else project_plan(good, config, agent)
    counted = drawers.where(F.col("chunk_index") < schema.ARTIFACT_OFFSET)
    per_room = counted.groupBy("room").agg(F.count("*").alias("n")) if chat else counted.select("source_file", "room").distinct().groupBy("room").agg(F.count("*").alias("n"))
    rooms = {r.room: r.n for r in per_room.orderBy(F.desc("n"), "room").collect()}
    seen, skipped = found.count(), found.where("skipped").count()
    added = drawers.count() if dry_run else commit(store, drawers, facts, embedding)
    found.unpersist()
    return Summary(seen, skipped, added, rooms)


def compress(store: Store, wing: str | None = None, dry_run: bool = False) -> dict:
    """Add a compressed artifact for every raw drawer in scope that has none of its present content. Returns the totals."""
    from stratum.operators import drawers as D

    rows = store.read("drawers")
    raw = D.scoped(rows, wing).where(F.col("drawer_type") == schema.DRAWER)
    made = D.compressed_artifacts(raw)
    new = made.join(rows.select("id"), "id", "left_anti").select(made.columns)
    sizes = raw.select(F.col("id").alias("_raw"), F.col("content").alias("raw"))
    pairs = made.withColumn("_raw", F.regexp_extract("id", "^aaak_(.*)_[0-9a-f]{12}$", 1)).select("_raw", F.col("content").alias("compressed")).join(sizes, "_raw")
    totals = D.compression_totals(pairs.withColumnRenamed("raw", "content")).first().asDict()
    if not dry_run:
        new = new.cache()
        totals["added"] = new.count()
        old = rows.where(F.col("drawer_type") == "compressed").select("id", F.regexp_extract("id", "^aaak_(.*)_[0-9a-f]{12}$", 1).alias("_raw"))
        fresh = new.select(F.regexp_extract("id", "^aaak_(.*)_[0-9a-f]{12}$", 1).alias("_raw")).distinct()
        stale = old.join(fresh, "_raw").select("id")
        store.write("drawers", rows.join(stale.withColumn("_stale", F.lit(True)), "id", "left").withColumn("active", F.col("active") & F.col("_stale").isNull()).select(rows.columns).unionByName(new))
        new.unpersist()
    return totals
