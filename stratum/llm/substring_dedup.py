"""Exact substring deduplication by seed and extend.

Seeds: of the hashes of all runs of ``SEED`` words inside a window of ``window`` words the
least is the window's anchor, so equal windows have equal anchors wherever they stand. An
anchor's row carries a 128-bit hash of its context: all words that windows around it can
reach to either side.

Extension: only anchors that occur in documents of different ids go on. Occurrences whose
whole contexts agree extend as far as windows reach, and all but the one of smallest doc_id
are repeats. That one occurrence of each context is compared with the other contexts of its
anchor window by window, by a 128-bit hash of the window. So an anchor in millions of
documents costs a row per occurrence and no pairs. Overlapping windows merge into maximal
repeats.

Aggregates are written before they are joined, so that both sides of each join are plain
exchanges, whose hot keys adaptive execution splits.

Defined results: null and empty texts have no words; documents under ``window`` words lose
nothing; rows without doc_id have no smaller one and are no source, so they stay whole; rows
that share a doc_id do not remove each other's words; other columns are ignored; an empty
table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm import kernel
from stratum.llm.kernel import U
from stratum.llm.shared import drop, longs, materialize, small_batches, table, text_slices

WINDOW = 50
ANCHORS = "a long, c1 long, c2 long, doc_id long, t long, pos long, back int, ahead int"


class Winnowed:
    """Words of a slice of texts and the anchor that each window selects."""

    def __init__(self, data: np.ndarray, at: np.ndarray, window: int):
        self.start, self.end, self.first = kernel.words(data, at)
        self.h = [kernel.word_hashes(data, self.start, self.end, lane) for lane in (0, 1)]
        self.doc = kernel.doc_of(self.first)
        seed = window // 2
        grams = kernel.gram_hashes(self.h[0], seed)
        reach = window - seed + 1
        n = len(self.h[0]) - window + 1
        if n <= 0:
            self.window_at = self.anchor = self.seed_hash = np.zeros(0, np.int64)
            return
        at_least = np.lib.stride_tricks.sliding_window_view(grams, reach).argmin(axis=1)
        windows = np.flatnonzero(self.doc[:n] == self.doc[window - 1 :])
        self.window_at, self.anchor, self.grams = windows, windows + at_least[windows], grams

    def runs(self, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
        return [kernel.runs(kernel.prefix(h, lane + 2), lo, hi, lane + 2) for lane, h in enumerate(self.h)]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in text_slices(batches, "text"):
            w = Winnowed(data, at, window)
            if not len(w.anchor):
                continue
            p = w.anchor[np.flatnonzero(np.diff(w.anchor, prepend=-1))]
            d = w.doc[p]
            reach = window - window // 2
            lo, hi = np.maximum(w.first[d], p - reach), np.minimum(w.first[d + 1], p + window)
            shape = U(0x9E3779B97F4A7C15) * ((p - lo) * 4096 + (hi - p)).astype(np.uint64)
            c1, c2 = (kernel.mix(c ^ shape) for c in w.runs(lo, hi))
            yield table(
                a=_signed(w.grams[p]), c1=_signed(c1), c2=_signed(c2), doc_id=longs(rows, "doc_id")[d], t=longs(rows, "t")[d],
                pos=p - w.first[d], back=(p - lo).astype(np.int32), ahead=(hi - p).astype(np.int32),
            )

    return run


def _windows(window: int):
    """Windows that select one of the anchors listed with each text, and their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in text_slices(batches, "text"):
            w = Winnowed(data, at, window)
            lists = rows.column(rows.schema.get_field_index("pos"))
            wanted = np.zeros(len(w.doc) + 1, bool)
            wanted[np.asarray(lists.flatten()) + np.repeat(w.first[:-1], np.asarray(lists.value_lengths()))] = True
            s = w.window_at[wanted[w.anchor]]
            w1, w2 = w.runs(s, s + window)
            d = w.doc[s]
            yield table(w1=_signed(w1), w2=_signed(w2), doc_id=longs(rows, "doc_id")[d], t=longs(rows, "t")[d], pos=s - w.first[d])

    return run


def find_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, t (xxhash64 of the text) and ``repeats``: intervals of words, some overlapping,
    that are covered by windows which also start in a document with a smaller doc_id."""
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    rows = materialize(texts.select("doc_id", "t", "text").mapInArrow(_anchors(window), ANCHORS), "anchors")
    shared = materialize(
        rows.groupBy("a").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), (F.min("c1") != F.max("c1")).alias("several"))
        .where("least < most").select("a", "several"),
        "shared",
    )
    seeds = materialize(rows.join(shared, "a"), "seeds")
    drop(rows)
    contexts = materialize(seeds.groupBy("a", "c1", "c2").agg(F.min("doc_id").alias("owner")), "contexts")
    owned = materialize(seeds.join(contexts, ["a", "c1", "c2"]).select("doc_id", "t", "pos", "back", "ahead", "owner", "several"), "owned")
    copies = owned.where("doc_id > owner").select("doc_id", "t", F.struct((F.col("pos") - F.col("back")).alias("start"), (F.col("pos") + F.col("ahead")).alias("end")).alias("run"))
    firsts = owned.where("doc_id = owner and several").groupBy("doc_id", "t").agg(F.collect_set("pos").alias("pos"))
    windows = materialize(
        texts.join(firsts, ["doc_id", "t"]).select("doc_id", "t", "text", "pos").mapInArrow(_windows(window), "w1 long, w2 long, doc_id long, t long, pos long"), "windows"
    )
    owners = materialize(windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("most")).where("owner < most").drop("most"), "owners")
    more = windows.join(owners, ["w1", "w2"]).where("doc_id > owner").select("doc_id", "t", F.struct(F.col("pos").alias("start"), (F.col("pos") + window).alias("end")).alias("run"))
    return copies.union(more).groupBy("doc_id", "t").agg(F.collect_set("run").alias("repeats"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        out = {"doc_id": batch.column(0).to_pylist(), "n_words": [], "n_removed": [], "text": [], "repeats": []}
        for text, runs in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            words = (text.as_py() or "").encode().split()
            n, removed, merged, kept, at = len(words), 0, [], [], 0
            if runs:
                for run in sorted((r["start"], r["end"]) for r in runs):
                    if merged and run[0] <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], run[1])
                    else:
                        merged.append({"start": run[0], "end": run[1]})
                for r in merged:
                    kept += words[at : r["start"]]
                    at, removed = r["end"], removed + r["end"] - r["start"]
                words = kept + words[at:]
            out["n_words"].append(n)
            out["n_removed"].append(removed)
            out["text"].append(b" ".join(words).decode())
            out["repeats"].append(merged)
        yield pa.RecordBatch.from_arrays([
            pa.array(out["doc_id"], pa.int64()), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()),
            pa.array(out["text"], pa.string()), pa.array(out["repeats"], pairs),
        ], names=list(out))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every document with n_words, n_removed, the words it keeps joined by spaces (``text``)
    and its maximal repeats as intervals of words (``repeats``)."""
    small_batches(docs.sparkSession)
    found = find_repeats(docs, window)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    joined = texts.join(found, ["doc_id", "t"], "left").select("doc_id", "text", "repeats")
    return joined.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, text string, repeats array<struct<start:long,end:long>>")
