"""Derived rows: anchors, bridges, compressed lines and typed memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.functions import text as X
from stratum.functions.passages import memories_of


def memories(content: Column) -> Column:
    """array of struct(content, memory_type, confidence) of a text's segments, in order."""
    return memories_of(content)


def of_text(content: Column, context_room: Column, date: Column, source_file: Column, chat: bool = False) -> Column:
    """All artifacts of a text, each (type, room, content) once, in order."""

    def part(room: Column, kind: str, own: Column, importance: float, weight: float) -> Column:
        return F.struct(room.alias("room"), F.lit(kind).alias("drawer_type"), own.alias("content"), F.lit(importance).alias("importance"), F.lit(weight).alias("weight"))

    low = F.lower(content)
    found = {
        "terms": X.anchor_terms(content), "summary": X.anchor_summary(content), "prefers": X.contains_any(low, ["prefer", "always", "never"]),
        "decides": X.contains_any(low, ["decided", "chose", "switched", "because"]), "line": X.compressed(content, room=context_room, date=date, source_file=source_file),
    } | ({"memories": memories(content)} if chat else {})

    def parts(x: Column) -> Column:
        made = [
            F.transform(x["terms"], lambda t: part(F.lit("anchors"), "anchor_doc", F.concat(F.lit("ANCHOR "), t, F.lit("\n"), x["summary"]), 5.0, 5.0)),
            F.array_compact(F.array(
                F.when(x["prefers"], part(F.lit("preferences"), "preference_bridge", F.concat(F.lit("PREFERENCE BRIDGE\n"), x["summary"]), 7.0, 7.0)),
                F.when(x["decides"], part(F.lit("decisions"), "decision_bridge", F.concat(F.lit("DECISION BRIDGE\n"), x["summary"]), 8.0, 8.0)),
                part(context_room, "compressed", x["line"], 7.5, 7.0),
            )),
        ]
        if chat:
            made.append(F.transform(x["memories"], lambda m: F.struct(
                m["memory_type"].alias("room"), F.lit("derived_memory").alias("drawer_type"), m["content"].alias("content"), F.lit(6.0).alias("importance"), F.lit(6.0).alias("weight"))))
        return F.array_distinct(F.concat(*made))  # a type has one importance and weight, so rows alike in type, room and content are alike

    # what is read several times is bound, so it is computed once a row
    made = X.let(F.struct(*(c.alias(n) for n, c in found.items())), parts)
    return F.transform(made, lambda a: F.struct(
        a["room"].alias("room"), X.artifact_hall(a["room"], a["drawer_type"], a["content"], context_room).alias("hall"), a["drawer_type"].alias("drawer_type"),
        a["content"].alias("content"), a["importance"].alias("importance"), a["weight"].alias("weight")))


def expand(rows: DataFrame, artifacts: Column) -> DataFrame:
    """One row per artifact, with its place. (Exploded as an expression: of a column the optimizer would infer that it is
    not empty, and compute it again for that.)"""
    return rows.select(*rows.columns, F.posexplode(artifacts).alias("place", "artifact"))
