"""Connected components of a graph of links, in tables throughout.

Each task first replaces its links by the stars of its own components (union-find over at
most ``TASK_LINKS`` links). If one task held all links, that is the answer; otherwise
alternating large-star and small-star rounds over the contracted links run until nothing
changes, each round written to the shared folder."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.shared import drop, materialize, table

TASK_LINKS = 1_000_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for at in range(0, len(nodes), 100_000):
        some = nodes[at : at + 100_000]
        yield table(a=pa.array([root(x) for x in some], pa.int64()), b=pa.array(some, pa.int64()))


def _round(edges: DataFrame, large: bool) -> DataFrame:
    """Links (a < b): of each node the neighbours on one side are linked to its least neighbour."""
    seen = edges.union(edges.select("b", "a")) if large else edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = materialize(seen.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    joined = seen.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("m").alias("a"), "b")
    else:
        out = joined.select(F.col("m").alias("a"), "b").union(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
    return materialize(out.where("a < b").distinct(), "round")


def components(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """node, component (the least node it is linked with, over any way) of every node in ``links`` (a, b)."""
    links = materialize(links.where("a <> b").select("a", "b"), "links")
    parts = max(1, math.ceil(links.count() / task_links))
    stars = materialize(links.repartition(parts).mapInArrow(_stars, "a long, b long"), "stars")
    if parts > 1:
        edges, before = materialize(stars.where("a < b").distinct(), "edges"), None
        while True:
            edges = _round(_round(edges, large=True), large=False)
            state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if state == before:
                break
            before = state
        roots = edges.select(F.col("a").alias("b")).distinct().select(F.col("b").alias("a"), "b")
        stars = materialize(edges.union(roots), "stars")
    drop(links)
    return stars.select(F.col("b").alias("node"), F.col("a").alias("component"))
