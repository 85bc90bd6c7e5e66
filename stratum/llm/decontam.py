"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark.

Texts are lower-cased (A-Z) and read as words of ASCII letters, digits and characters beyond
ASCII. A window is ``window`` words of an item, or a whole item of fewer. A key for every
window would cost the automaton ``window`` times the benchmark; instead its keys are the runs
of ``SEED`` words at every (window - SEED + 1)th place of an item, of which every window holds
one whole, and short items as they are. It reads each document once, word by word (a word of
the benchmark is three letters of its alphabet, any other word one that no key has). The
windows that can stand around a key found are looked up in the sorted hashes of all windows and
compared word by word. Offsets refer to the original text.

The automaton takes some 100 bytes of memory a word. A benchmark of more than ``block_bytes``
of text is read in several blocks of whole items, each by an automaton and a pass of its own,
so neither the driver nor a worker ever holds more than a block (an item of more than a block is
one by itself).

Defined results: a null or empty text has no words and no hits; benchmark rows without
item_id or without words match nothing; repeated items count once; repeated documents give
one row each; an empty benchmark hits nothing; other columns of the inputs are ignored."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm import kernel
from stratum.llm.shared import materialize, small_batches

WINDOW = 13
SEED = 5
BLOCK_BYTES = 16 << 20
SCHEMA = "doc_id long, n_words long, hit_words array<struct<start:long,end:long>>, spans array<struct<start:long,end:long>>, items array<string>"
CLEAN = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))
DIGIT = 128  # three digits name a word; each place has letters of its own, so keys match at words only

_built: dict = {}


def normalised(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(CLEAN).split()


def letters(i: int) -> str:
    return chr(1 + i % DIGIT) + chr(1 + DIGIT + i // DIGIT % DIGIT) + chr(1 + 2 * DIGIT + i // DIGIT**2)


class Benchmark:
    """The automaton of a block of items and its table of windows."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        import ahocorasick

        self.window, self.seed = window, min(SEED, window)
        self.ids: dict[bytes, int] = {}
        self.code = [letters(0)]  # 0 is any word that the benchmark lacks
        named: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            own = tuple(self._id(w) for w in normalised(text))
            if own:
                named.setdefault(own, set()).add(item)
        self.names = [sorted(x) for x in named.values()]
        self.keys = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        flat, starts, owners = [], [], []
        for n, own in enumerate(named):
            line = "".join([self.code[i] for i in own])
            if len(own) < window:
                self.keys.add_word(line, (len(own), n))
                continue
            for at in range(0, len(own) - self.seed + 1, window - self.seed + 1):
                key = line[3 * at : 3 * (at + self.seed)]
                if key not in self.keys:  # a short item can be the same words; its own entry also proposes windows
                    self.keys.add_word(key, (self.seed, None))
            starts.append(np.arange(len(own) - window + 1) + len(flat))
            owners.append(np.full(len(own) - window + 1, n))
            flat += own
        if len(self.keys):
            self.keys.make_automaton()
        self.flat = np.array(flat, np.int32)
        starts, owners = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (starts, owners))
        hashes = self.hashes(self.flat, starts)
        order = np.lexsort((owners, hashes))
        hashes, owners, starts = hashes[order], owners[order], starts[order]
        first = np.ones(len(order), bool)  # of the windows of one item that are alike
        first[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
        self.table, self.owner, self.start = hashes[first], owners[first].astype(np.int32), starts[first].astype(np.int32)

    def _id(self, word: bytes) -> int:
        i = self.ids.setdefault(word, len(self.ids) + 1)
        if i == len(self.code):
            self.code.append(letters(i))
        return i

    def hashes(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return kernel.runs(kernel.prefix(kernel.mix(ids.astype(np.uint64)), 2), starts, starts + self.window, 2)

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The windows in a text as intervals of words, and the items that have them."""
        get, code = self.ids.get, self.code
        own = [get(w, 0) for w in words]
        seen = [(end // 3 + 1, n, item) for end, (n, item) in self.keys.iter("".join([code[i] for i in own]))] if len(self.keys) else []
        if not seen:
            return [], set()
        hits, items = [(end - n, end) for end, n, item in seen if item is not None], set()
        for item in {item for *_, item in seen if item is not None}:
            items |= set(self.names[item])
        ends = np.array([end for end, n, _ in seen if n == self.seed], np.int64)
        about = (ends[:, None] - self.seed - np.arange(self.window - self.seed + 1)).reshape(-1)
        about = np.unique(about[(about >= 0) & (about + self.window <= len(own))])
        if len(about) and len(self.table):
            ids = np.array(own, np.int32)
            h = self.hashes(ids, about)
            lo, hi = np.searchsorted(self.table, h, "left"), np.searchsorted(self.table, h, "right")
            about, h, lo, hi = (x[hi > lo] for x in (about, h, lo, hi))
            for k in np.unique(h, return_index=True)[1].tolist():  # each distinct window once
                run = ids[about[k] : about[k] + self.window]
                entries = np.arange(lo[k], hi[k])
                same = (self.flat[self.start[entries][:, None] + np.arange(self.window)] == run).all(axis=1)
                if same.any():
                    hits += [(int(a), int(a) + self.window) for a in about[h == h[k]] if (ids[a : a + self.window] == run).all()]
                    for item in set(self.owner[entries[same]].tolist()):
                        items |= set(self.names[item])
        return hits, items


def merged(intervals: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(intervals):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def spans_of(text: str, intervals: list[list[int]]) -> list[list[int]]:
    """Character offsets in the original text of runs of words."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    start, end, _ = kernel.words(data, np.array([0, len(data)]), kernel.ALNUM)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [[int(chars[start[a]]), int(chars[end[b - 1]])] for a, b in intervals]


def _benchmark(key: str, items: list[tuple[str, str]], window: int) -> Benchmark:
    """Built once by each worker, which holds one at a time."""
    if key not in _built:
        _built.clear()
        _built[key] = Benchmark(items, window)
    return _built[key]


def _scan(items: list[tuple[str, str]], window: int, first: bool, last: bool):
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _benchmark(key, items, window)
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                text = row["text"] or ""
                words = normalised(text)
                row["n_words"] = len(words)
                hits, names = found.find(words)
                if not first:
                    hits += [(x["start"], x["end"]) for x in row["hit_words"]]
                    names |= set(row["items"])
                hits = merged(hits)
                row["hit_words"] = [{"start": a, "end": b} for a, b in hits]
                row["items"] = sorted(names)
                row["spans"] = [{"start": a, "end": b} for a, b in spans_of(text, hits)] if last and hits else []
                if last:
                    del row["text"]
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow(last))

    return run


def _arrow(last: bool) -> pa.Schema:
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    text = [] if last else [("text", pa.string())]
    return pa.schema([("doc_id", pa.int64()), *text, ("n_words", pa.int64()), ("hit_words", pairs), ("spans", pairs), ("items", pa.list_(pa.string()))])


def _clean(items: list[tuple[str, str]], window: int):
    """Rows whose text holds no window."""
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _benchmark(key, items, window)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([not found.find(normalised(x.as_py() or ""))[0] for x in texts], pa.bool_()))

    return run


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list[tuple[str, str]], bool]]:
    """Blocks of items, one at a time, and whether each is the last."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    for k in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r[0], r[1]) for r in own.collect()], k == n - 1


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, the runs of words inside benchmark windows
    (``hit_words``), the same as character offsets of the original text (``spans``) and the
    items whose windows occur (``items``, as strings)."""
    small_batches(docs.sparkSession)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = True
    for block, last in blocks(benchmark, block_bytes):
        out = out.mapInArrow(_scan(block, window, first, last), SCHEMA if last else SCHEMA.replace("n_words", "text string, n_words", 1))
        out, first = out if last else materialize(out, "leaks"), False
    return out


def n_hit() -> Column:
    return F.aggregate("hit_words", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])


def is_contaminated() -> Column:
    """At least a twentieth of the words are inside benchmark windows."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def remove_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the documents that hold a window of any item, in the scan that finds them: no shuffle, no join."""
    small_batches(docs.sparkSession)
    out = docs
    for block, last in blocks(benchmark, block_bytes):
        out = out.mapInArrow(_clean(block, window), docs.schema)
        out = out if last else materialize(out, "clean")
    return out
