"""The temporal knowledge graph: triples valid between two dates, closed at both ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions.text import entity_id

KEY = ["subject", "predicate", "object"]


def valid_at(day: Column | str | None) -> Column:
    if day is None:
        return F.lit(True)
    day = F.lit(day) if isinstance(day, str) else day
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day))


def query(triples: DataFrame, entities: DataFrame, entity: str, as_of: str | None = None, direction: str = "both") -> DataFrame:
    """Facts about an entity. ``subject`` and ``object`` are names; ``current``: not ended."""
    own = triples.where(valid_at(as_of))
    me = entity.lower().replace(" ", "_").replace('"', "")
    name = entities.select(F.col("id").alias("_id"), F.col("name").alias("_name"))
    shape = ["direction", "subject", "predicate", "object", "valid_from", "valid_to", "confidence", "source_closet", (F.col("valid_to").isNull()).alias("current")]
    out = own.where(F.col("subject") == me).join(name, F.col("object") == F.col("_id")).withColumn("direction", F.lit("outgoing"))
    out = out.withColumn("subject", F.lit(entity)).withColumn("object", F.col("_name")).select(*shape)
    into = own.where(F.col("object") == me).join(name, F.col("subject") == F.col("_id")).withColumn("direction", F.lit("incoming"))
    into = into.withColumn("subject", F.col("_name")).withColumn("object", F.lit(entity)).select(*shape)
    return {"outgoing": out, "incoming": into, "both": out.unionByName(into)}.get(direction, out.limit(0))


def timeline(triples: DataFrame, entities: DataFrame, entity: str | None = None, n: int = 100) -> DataFrame:
    """Facts by start; of one entity all of them, without an entity the first n."""
    s, o = (entities.select(F.col("id").alias(f"{c}_id"), F.col("name").alias(f"{c}_name")) for c in ("s", "o"))
    out = triples
    if entity is not None:
        me = entity.lower().replace(" ", "_").replace('"', "")
        out = out.where((F.col("subject") == me) | (F.col("object") == me))
    out = out.join(s, F.col("subject") == F.col("s_id")).join(o, F.col("object") == F.col("o_id"))
    out = out.select("id", F.col("s_name").alias("subject"), "predicate", F.col("o_name").alias("object"), "valid_from", "valid_to", "confidence", F.col("valid_to").isNull().alias("current"))
    out = out.orderBy(F.coalesce("valid_from", F.lit("")), "id")
    return out if entity is not None else out.limit(n)


def stats(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: entities, triples, current and expired facts, sorted relationship types."""
    e = entities.agg(F.count("*").alias("entities"))
    t = triples.agg(
        F.count("*").alias("triples"), F.count_if(F.col("valid_to").isNull()).alias("current_facts"), F.count_if(F.col("valid_to").isNotNull()).alias("expired_facts"),
        F.sort_array(F.collect_set("predicate")).alias("relationship_types"),
    )
    return e.join(F.broadcast(t))  # one row each


def with_entities(entities: DataFrame, names: DataFrame, now: Column) -> DataFrame:
    """``entities`` and those of ``names`` (name) that it lacks; the first name of an id, in order, wins."""
    new = names.select(entity_id(F.col("name")).alias("id"), "name").groupBy("id").agg(F.min("name").alias("name"))
    new = new.join(entities.select("id"), "id", "left_anti")
    return entities.unionByName(new.select("id", "name", F.lit("unknown").alias("type"), F.lit("{}").alias("properties"), now.alias("created_at")))


def add(triples: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Add facts (subject, predicate, object as names, valid_from, confidence, source_closet, source_file). A fact that
    is open already keeps its row with the greater confidence and the sources it has; others get a row."""
    rows = new.select(
        entity_id(F.col("subject")).alias("subject"), F.lower(F.replace("predicate", F.lit(" "), F.lit("_"))).alias("predicate"), entity_id(F.col("object")).alias("object"),
        "valid_from", "confidence", "source_closet", "source_file",
    )
    rows = rows.groupBy(*KEY).agg(
        F.min("valid_from").alias("_from"), F.max("confidence").alias("_confidence"), F.min("source_closet").alias("_closet"), F.min("source_file").alias("_file")
    )
    old = triples.join(rows, KEY, "left")
    hit = F.col("valid_to").isNull() & F.col("_confidence").isNotNull()
    old = old.select(
        "id", *KEY, "valid_from", "valid_to", F.when(hit, F.greatest("confidence", "_confidence")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(hit, F.coalesce("source_closet", "_closet")).otherwise(F.col("source_closet")).alias("source_closet"),
        F.when(hit, F.coalesce("source_file", "_file")).otherwise(F.col("source_file")).alias("source_file"), "extracted_at",
    )
    fresh = rows.join(triples.where("valid_to is null").select(*KEY).distinct(), KEY, "left_anti")
    before = triples.groupBy(*KEY).agg(F.count("*").alias("_before"))
    fresh = fresh.join(before, KEY, "left")
    key = F.md5(F.concat_ws(":", *KEY, F.coalesce("_from", F.lit("")), F.coalesce("_before", F.lit(0)).cast("string")))
    fresh = fresh.select(
        F.concat(F.lit("t_"), F.col("subject"), F.lit("_"), F.col("predicate"), F.lit("_"), F.col("object"), F.lit("_"), F.substring(key, 1, 8)).alias("id"), *KEY, F.col("_from").alias("valid_from"),
        F.lit(None).cast("string").alias("valid_to"), F.col("_confidence").alias("confidence"), F.col("_closet").alias("source_closet"), F.col("_file").alias("source_file"), now.alias("extracted_at"),
    )
    return old.unionByName(fresh)


def invalidate(triples: DataFrame, which: DataFrame) -> DataFrame:
    """Close the open facts named by ``which`` (subject, predicate, object as names, ended)."""
    ends = which.select(entity_id(F.col("subject")).alias("subject"), F.lower(F.replace("predicate", F.lit(" "), F.lit("_"))).alias("predicate"), entity_id(F.col("object")).alias("object"), "ended")
    ends = ends.groupBy(*KEY).agg(F.coalesce(F.max("ended"), F.date_format(F.current_date(), "yyyy-MM-dd")).alias("_ended"))
    out = triples.join(ends, KEY, "left")
    return out.withColumn("valid_to", F.when(F.col("valid_to").isNull(), F.col("_ended")).otherwise(F.col("valid_to"))).drop("_ended").select(triples.columns)


def best_facts(candidates: DataFrame) -> DataFrame:
    """Each triple once, with its best confidence."""
    return candidates.groupBy(*KEY).agg(F.max("confidence").alias("confidence"))


def intervals(events: DataFrame, by: list[str], at: str) -> DataFrame:
    """Each row is valid from its time to the next one of the same keys."""
    return events.withColumn("valid_to", F.lead(at).over(Window.partitionBy(*by).orderBy(at)))
