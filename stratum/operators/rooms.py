"""The graph of rooms: wings meet where they share a room."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(drawers: DataFrame) -> DataFrame:
    return drawers.where(F.col("active") & (F.col("room") != "") & (F.col("room") != "general") & (F.col("wing") != ""))


def nodes(drawers: DataFrame) -> DataFrame:
    """room, wings, halls, drawer_types, dates (the last five), n, wing_halls (map). Values are made distinct before they are gathered."""
    rows = usable(drawers)
    seen = rows.groupBy("room").agg(
        F.sort_array(F.collect_set("wing")).alias("wings"), F.sort_array(F.collect_set(F.when(F.col("hall") != "", F.col("hall")))).alias("halls"),
        F.sort_array(F.collect_set("drawer_type")).alias("drawer_types"), F.count("*").alias("n"),
    )
    by_wing = rows.groupBy("room", "wing").agg(F.sort_array(F.collect_set(F.when(F.col("hall") != "", F.col("hall")))).alias("h"))
    by_wing = by_wing.groupBy("room").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("wing", "h")))).alias("wing_halls"))
    dates = rows.where("date <> ''").select("room", "date").distinct()
    w = F.expr("row_number() over (partition by room order by date desc)")
    dates = dates.withColumn("_n", w).where("_n <= 5").groupBy("room").agg(F.sort_array(F.collect_list("date")).alias("dates"))
    return seen.join(by_wing, "room").join(dates, "room", "left").withColumn("dates", F.coalesce("dates", F.array().cast("array<string>")))


def edges(graph: DataFrame) -> DataFrame:
    """room, wing_a < wing_b, hall, n, drawer_types, recent: a row per pair of wings and hall of a shared room."""
    a = graph.select("room", "n", "drawer_types", "halls", F.try_element_at("dates", F.lit(-1)).alias("recent"), F.explode("wings").alias("wing_a"))
    b = graph.select(F.col("room").alias("_room"), F.explode("wings").alias("wing_b"))
    pairs = a.join(b, (F.col("room") == F.col("_room")) & (F.col("wing_a") < F.col("wing_b")))
    return pairs.select("room", "wing_a", "wing_b", F.explode("halls").alias("hall"), "n", "drawer_types", "recent")


def tunnels(graph: DataFrame, wing_a: str | None = None, wing_b: str | None = None) -> DataFrame:
    out = graph.where(F.size("wings") >= 2)
    for wing in (wing_a, wing_b):
        out = out.where(F.array_contains("wings", wing)) if wing is not None else out
    return out.orderBy("room")


def traverse(graph: DataFrame, start: str, max_hops: int = 2) -> DataFrame:
    """room, hop, connected_via: rooms within ``max_hops`` steps of the start, a step being a shared wing, each at its first hop,
    with the wings it shares with the room it was first reached from (null for the start).
    Hops go through wings: every wing is entered once, so a step is two equality joins and no pair of rooms is listed twice.
    Rooms of a hop are taken in the order of their ways, room names from the start on, so the least way is the first to reach a room."""
    at = graph.select("room", F.explode("wings").alias("wing"))
    seen = graph.where(F.col("room") == start).select("room", F.lit(0).alias("hop"), F.array("room").alias("way"))
    front, used = seen, at.limit(0).select("wing")
    for hop in range(1, max_hops + 1):
        wings = at.join(front.select("room", "way"), "room").groupBy("wing").agg(F.min("way").alias("way")).join(used, "wing", "left_anti")
        reached = at.join(wings, "wing").groupBy("room").agg(F.min("way").alias("way")).join(seen.select("room"), "room", "left_anti")
        front = reached.select("room", F.lit(hop).alias("hop"), F.array_append("way", F.col("room")).alias("way"))
        seen, used = seen.union(front), used.union(wings.select("wing"))
    before = graph.select(F.col("room").alias("_before"), F.col("wings").alias("_wings"))
    found = seen.withColumn("_before", F.try_element_at("way", F.lit(-2))).join(graph.select("room", "wings"), "room").join(before, "_before", "left")
    return found.select("room", "hop", F.sort_array(F.array_intersect("wings", "_wings")).alias("connected_via"))


def suggestions(graph: DataFrame, name: str, n: int = 5) -> DataFrame:
    """Rooms whose name holds the given one or is held by it."""
    low = name.lower()
    return graph.where(F.lower("room").contains(low) | F.lit(low).contains(F.lower("room"))).select("room").orderBy("room").limit(n)


def stats(graph: DataFrame) -> DataFrame:
    """One row: rooms, tunnel rooms, edges, rooms per wing (map), the first ten tunnels by name."""
    e = edges(graph).agg(F.count("*").alias("total_edges"))
    per_wing = graph.select(F.explode("wings").alias("wing")).groupBy("wing").agg(F.count("*").alias("n"))
    per_wing = per_wing.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("wing", "n")))).alias("rooms_per_wing"))
    top = tunnels(graph).select("room").limit(10).agg(F.sort_array(F.collect_list("room")).alias("top_tunnels"))
    out = graph.agg(F.count("*").alias("total_rooms"), F.count_if(F.size("wings") >= 2).alias("tunnel_rooms"))
    for part in (e, per_wing, top):  # one row each
        out = out.join(F.broadcast(part))
    return out
