"""Packing documents into sequences as a cutting-stock problem solved by column generation.

Each document's token ids, with an end id, are cut into pieces of ``size`` ids and a rest.
Lengths are counted in units of ``GRID`` ids, so the histogram has at most size / GRID entries
however large the corpus is; pieces of up to ``SHORT`` ids are taken by their exact length, as many
at a time as fill whole units. On the driver a linear program over filling patterns
is solved by column generation: a knapsack dynamic program over the dual values prices the
next pattern, until no pattern helps. Patterns are used a whole number of times each, the
few pieces left over go to greedily filled patterns, and every pattern's places are given to
the documents of each class by their rank, which Spark computes per class and salt. Equal pieces
are counted first and ranked as one row, so copies of a document load no task.

Defined results: null text is empty (the end id alone); repeated rows are packed each; an
empty table gives no pieces; other columns are ignored; rows without doc_id are packed."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.llm.shared import longs, materialize, small_batches, table

SIZE = 2048
GRID = 8
SHORT = 64
END_ID = 1
SPECIAL = "<|endoftext|>"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

_loaded: dict = {}


def encoder(json_path: str, ranks_path: str):
    """A function from a text to its ids as uint32. The merge ranks are those of the JSON file,
    run by the faster of two libraries; texts that spell a special token go to the other."""
    if (json_path, ranks_path) not in _loaded:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        full = Tokenizer.from_file(json_path)

        def encode(text: str) -> np.ndarray:
            if SPECIAL in text:
                return np.array(full.encode(text, add_special_tokens=False).ids, np.uint32)
            return np.array(quick.encode_ordinary(text), np.uint32)

        _loaded[json_path, ranks_path] = encode
    return _loaded[json_path, ranks_path]


def public_paths() -> tuple[str, str]:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def cut(docs: DataFrame, paths: tuple[str, str], size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``size`` ids of every document, with a checksum of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*paths)
        for batch in batches:
            docs_, starts, lengths, sums, totals = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), size):
                    piece = ids[at : at + size]
                    docs_.append(doc)
                    starts.append(at)
                    lengths.append(len(piece))
                    sums.append(zlib.crc32(piece.tobytes()))
                    totals.append(len(ids))
            yield table(**{n: pa.array(x, pa.int64()) for n, x in zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens"), (docs_, starts, lengths, sums, totals), strict=True)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def best_pattern(value: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The most valuable filling of ``size`` with lengths 1, 2, ... of the given values, each as often as wanted."""
    best, took = np.zeros(size + 1), np.zeros(size + 1, int)
    for room in range(1, size + 1):
        n = min(room, len(value))
        with_one = best[room - n : room][::-1] + value[:n]
        k = int(np.argmax(with_one))
        if with_one[k] > best[room - 1]:
            best[room], took[room] = with_one[k], k + 1
        else:
            best[room], took[room] = best[room - 1], 0
    pattern, room = np.zeros(len(value), int), size
    while room > 0:
        if took[room]:
            pattern[took[room] - 1] += 1
            room -= took[room]
        else:
            room -= 1
    return float(best[size]), pattern


def solve(counts: dict[int, int], size: int, gap: float = 1e-4, most: int = 20_000) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: number}) so that every length is placed as often as counted and no
    pattern is over ``size``. The linear program ends when Farley's bound is within ``gap``."""
    lengths = sorted(k for k, n in counts.items() if n > 0)
    if not lengths:
        return []
    m = len(lengths)
    need = np.array([counts[k] for k in lengths], float)
    patterns = [{i: size // k} for i, k in enumerate(lengths)]
    inverse = np.diag([k // size if k >= size else 1 / (size // k) for k in lengths]).astype(float)
    x = inverse @ need
    for _ in range(most):
        dual = inverse.sum(axis=0)
        value = np.full(max(lengths), -np.inf)
        value[np.array(lengths) - 1] = dual
        worth, full = best_pattern(value, size)
        if worth <= 1 / (1 - gap):
            break
        column = full[np.array(lengths) - 1].astype(float)
        step = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, np.maximum(x, 0) / step, np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        x = x - ratio[out] * step
        x[out] = ratio[out]
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        patterns[out] = {i: int(n) for i, n in enumerate(column) if n}
    left = {k: counts[k] for k in lengths}
    plan = []
    for times, pattern in zip(np.floor(x + 1e-7).astype(int), patterns, strict=True):
        own = {lengths[i]: n for i, n in pattern.items()}
        times = max(0, min([int(times), *(left[k] // n for k, n in own.items())]))
        if times:
            plan.append((times, own))
            for k, n in own.items():
                left[k] -= times * n
    while any(left.values()):
        room, own = size, {}
        for k in reversed(lengths):
            if n := min(left[k], room // k):
                own[k] = n
                room -= n * k
        times = min(left[k] // n for k, n in own.items())
        plan.append((times, own))
        for k, n in own.items():
            left[k] -= times * n
    return plan


def places(plan: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows of class, first rank, first sequence, places per sequence, by class and rank."""
    rows, at, sequence = [], {}, 0
    for times, own in plan:
        for k, n in own.items():
            rows.append((k, at.get(k, 0), sequence, n))
            at[k] = at.get(k, 0) + times * n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def assign(pieces: DataFrame, size: int = SIZE, grid: int = GRID) -> DataFrame:
    """``pieces`` with sequence_id and the offset of each there. ``pieces`` is read three times: let it be a table."""
    spark = pieces.sparkSession
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    short = min(SHORT, size)
    kind = F.when(F.col("length") <= short, F.col("length")).otherwise(short + F.ceil(F.col("length") / grid))
    ranked = pieces.withColumn("class", kind.cast("long"))
    counts = {int(r[0]): int(r[1]) for r in ranked.groupBy("class").count().collect()}  # at most short + size / grid rows
    each_time = np.ones(short + size // grid + 2, np.int64)  # of each class: pieces taken at a time, their units, and rank among those of as many
    units, first_rank, needed = np.zeros_like(each_time), np.zeros_like(each_time), {}
    for k, n in sorted(counts.items()):
        each_time[k] = grid // math.gcd(grid, k) if k <= short and k * grid <= size else 1
        units[k] = -(-k * int(each_time[k]) // grid) if k <= short else k - short
        first_rank[k] = needed.get(int(units[k]), 0)
        needed[int(units[k])] = int(first_rank[k]) + -(-n // int(each_time[k]))
    plan = places(solve(needed, size // grid))
    ranked = materialize(ranked.groupBy("class", *names).agg(F.count("*").alias("copies")), "equal-pieces")
    total, parts = sum(counts.values()), int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = max(1, min(math.ceil(total / (4 * parts)), 1_000_000))
    salts = spark.createDataFrame([(k, math.ceil(n / each)) for k, n in counts.items()] or [(0, 1)], "class long, salts long")
    ranked = ranked.join(F.broadcast(salts), "class").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("salts")))
    offsets = (
        ranked.groupBy("class", "salt").agg(F.sum("copies").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("class").orderBy("salt")) - F.col("n")).drop("n")
    )
    own = Window.partitionBy("class", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens", "length").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("rank", F.coalesce(F.sum("copies").over(own), F.lit(0)))
    # as many rows as salts: at most four per shuffle partition and one per class
    ranked = ranked.join(F.broadcast(offsets), ["class", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.select(*names, "class", F.explode(F.sequence("rank", F.col("rank") + F.col("copies") - 1)).alias("rank"))
    keys = plan[:, 0] * (1 << 44) + plan[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, r = longs(batch, "class"), longs(batch, "rank")
            r = first_rank[k] + r // each_time[k]
            row = plan[np.searchsorted(keys, units[k] * (1 << 44) + r, side="right") - 1]
            sequence = row[:, 2] + (r - row[:, 1]) // np.maximum(row[:, 3], 1)
            yield table(**{n: batch.column(batch.schema.get_field_index(n)) for n in names}, sequence_id=sequence)

    placed = ranked.select(*names, "class", "rank").mapInArrow(place, f"{PIECES}, sequence_id long")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32")
    before = F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("offset", F.coalesce(before, F.lit(0)).cast("long"))


def pack(docs: DataFrame, paths: tuple[str, str] | None = None, size: int = SIZE) -> DataFrame:
    """Pieces of all documents with their sequence and offset; ``paths`` are the vocabulary's JSON and rank files."""
    small_batches(docs.sparkSession)
    return assign(materialize(cut(docs, paths or public_paths(), size), "pieces"), size)
