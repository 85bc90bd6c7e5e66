"""The memory stack as text: identity, story, recall and search results.

Rows come from DataFrames and are few (a report's length); the text is joined on the driver."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.functions import text as X
from stratum.functions.embed import EmbeddingConfig
from stratum.operators import drawers as D
from stratum.plans.search import hybrid
from stratum.sources.config import identity

STORY_BYTES, STORY_ROWS, STORY_SNIPPET, SNIPPET = 3_200, 15, 200, 300
EMPTY, MORE = "## L1 — No memories yet.", "  ... (more in L3 search)"


def _suffix(source: str | None) -> str:
    name = (source or "").rstrip("/").rsplit("/", 1)[-1]
    return f"  ({name})" if name else ""


def story_rows(drawers: DataFrame, wing: str | None = None, prefer_compressed: bool = False) -> DataFrame:
    """The most important drawers, by room; ``snippet`` is what is shown of each."""
    rows = D.most_important(drawers, wing, STORY_ROWS).join(D.newest_compressed(drawers), F.col("id") == F.col("raw_id"), "left")
    shown = X.preferred_snippet(X.strip(F.col("content")), F.col("compressed"), prefer_compressed, STORY_SNIPPET)
    return rows.select("id", "room", "source_file", shown.alias("snippet"), "rank_importance", "filed_at", "chunk_index").orderBy("room", F.desc("rank_importance"), *D.recent_first())


def story(drawers: DataFrame, wing: str | None = None, prefer_compressed: bool = False) -> str:
    """The first rows whose lines fit the budget of bytes; room lines count, the title does not."""
    rows = story_rows(drawers, wing, prefer_compressed).collect()
    if not rows:
        return EMPTY
    out, used, room = ["## L1 — ESSENTIAL STORY"], 0, None
    for r in rows:
        if r.room != room:
            room = r.room
            out.append(f"\n[{room}]")
            used += len(out[-1].encode())
        line = f"  - {r.snippet}{_suffix(r.source_file)}"
        used += len(line.encode())
        if used > STORY_BYTES:
            return "\n".join([*out, MORE])
        out.append(line)
    return "\n".join(out)


def recall(drawers: DataFrame, wing: str | None = None, room: str | None = None, n: int = 10) -> str:
    rows = D.recall(drawers, wing, room, n).select("room", "source_file", X.shortened(F.replace(X.strip(F.col("content")), F.lit("\n"), F.lit(" ")), SNIPPET).alias("s")).collect()
    if not rows:
        label = " ".join(f"{k}={v}" for k, v in (("wing", wing), ("room", room)) if v is not None)
        return f"No drawers found for {label}."
    return "\n".join([f"## L2 — ON-DEMAND ({len(rows)} drawers)", *(f"  [{r.room}] {r.s}{_suffix(r.source_file)}" for r in rows)])


def search_report(query: str, hits: Iterable) -> str:
    lines = []
    for h in hits:
        text = h.snippet.replace("\n", " ")
        text = text if len(text) <= SNIPPET else text[: SNIPPET - 3] + "..."
        lines += [f"  [{h.rank}] {h.wing}/{h.room} (sim={max(h.semantic_score, h.fused_score):.3f})", f"      {text}"]
        if name := _suffix(h.source_file).strip(" ()"):
            lines.append(f"      src: {name}")
    return "\n".join([f'## L3 — SEARCH RESULTS for "{query}"', *lines]) if lines else "No results found."


def search(drawers: DataFrame, query: str, wing: str | None = None, room: str | None = None, n: int = 5, config: EmbeddingConfig | None = None, vectors: DataFrame | None = None) -> str:
    asked = drawers.sparkSession.createDataFrame([(1, query)], "qid long, query string")
    return search_report(query, hybrid(drawers, asked, n, wing, room, config, vectors).orderBy("rank").collect())


def wake_up(drawers: DataFrame, identity_file: str, wing: str | None = None, prefer_compressed: bool = False) -> str:
    return identity(identity_file) + "\n\n" + story(drawers, wing, prefer_compressed)
