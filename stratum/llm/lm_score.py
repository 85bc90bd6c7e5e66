"""Language-model scores by deleted interpolation.

P(w | v) = a2 * c(v w) / c(v) + a1 * c(w) / N + a0 / (V + 1)

The weights depend on the bucket of c(v), its binary logarithm, and are learned by
expectation-maximisation on held-out counts: documents of one training fold give the tokens,
the other training folds the counts. Scores then use the counts of all training documents.

The text is read once, into blocks of about ``block_tokens`` tokens that name their words by
places in a sorted list of word hashes. Blocks ask for counts and get them back: a block's
distinct words and bigrams go, sorted, to the part that owns their range of hashes; the part
adds up all blocks and answers each, in the order asked, with what other blocks have of it,
which is mostly nothing. So what travels is a hash per distinct bigram of a block and few numbers
back, both compressed, no table of counts is ever held whole by a task or the driver, and both
the parts and the blocks are of bounded size. A message goes to a part only if the block has a key
there, so there are never more of them than distinct keys of blocks, however many the parts. To
the driver come totals and, for the weights, a histogram over buckets and quarter-octave ratios.

Words are lower-cased (A-Z) runs without ASCII white space; a document is its words and an
end. Words and bigrams are 64-bit hashes. Defined results: a null or empty text is the end
alone; a null doc_id counts as an empty text in the fold's checksum; repeated rows count each;
without training documents every score is that of an unknown word; an empty table gives no
rows; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm import kernel
from stratum.llm.kernel import U
from stratum.llm.shared import longs, materialize, release, small_batches, table, text_slices

FOLDS, HELD_OUT, TUNING = 7, 2, 3
BLOCK_TOKENS = 1_000_000
PART_KEYS = 4_000_000
BUCKETS = 24
BINS = 4  # per octave
NONE = -9999  # the bin of a ratio of 0
END, BEGIN = U(0xE0D0E0D0E0D0E0D1), U(0xB0E0B0E0B0E0B0E3)
BLOCK = "block long, n_tokens long, doc_id array<long>, n array<int>, fold array<int>, ids binary, words binary"


def pack(x: np.ndarray) -> bytes:
    """An array of integers, compressed plane by plane of its bytes."""
    import zstandard

    size = x.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, size).T).tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys, by their differences."""
    return pack(np.diff(keys, prepend=keys.dtype.type(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "<u8"), dtype=np.uint64)


def _block(number: int, docs: list[tuple]) -> pa.RecordBatch:
    tokens = np.concatenate([x[3] for x in docs])
    words, ids = np.unique(tokens, return_inverse=True)
    one = lambda x, kind: pa.array([x], pa.list_(kind))
    return table(
        block=pa.array([number]), n_tokens=pa.array([len(tokens)]), doc_id=one([d for x in docs for d in x[0]], pa.int64()),
        n=one(np.concatenate([x[1] for x in docs]).astype(np.int32), pa.int32()), fold=one(np.concatenate([x[2] for x in docs]).astype(np.int32), pa.int32()),
        ids=pa.array([pack(ids.astype("<u4"))], pa.binary()), words=pa.array([pack_keys(words)], pa.binary()),
    )


def _blocks(block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for rows, data, at in text_slices(batches, "text"):
            start, end, first = kernel.words(data, at)
            n = np.diff(first) + 1
            tokens = np.empty(int(n.sum()), np.uint64)
            ends = np.cumsum(n) - 1
            inner = np.ones(len(tokens), bool)
            inner[ends] = False
            tokens[ends] = END
            tokens[inner] = kernel.word_hashes(data, start, end, lower=True)
            held.append((rows.column(0).to_pylist(), n, longs(rows, "fold"), tokens))
            size += len(tokens)
            if size >= block_tokens:
                yield _block(number, held)
                number, held, size = number + 1, [], 0
        if held:
            yield _block(number, held)

    return run


class Block:
    """A block as read back: ids, folds per token, its words and its distinct bigrams."""

    def __init__(self, row: dict):
        self.number, self.docs = row["block"], row["doc_id"]
        self.n, self.fold = np.array(row["n"], np.int64), np.array(row["fold"], np.int64)
        self.ids = unpack(row["ids"], "<u4").astype(np.int64)
        self.words = unpack_keys(row["words"])
        self.starts = np.concatenate([[0], np.cumsum(self.n)[:-1]])
        before = np.empty_like(self.ids)
        before[1:] = self.ids[:-1]
        before[self.starts] = len(self.words)  # the begin
        base = len(self.words) + 1
        codes, inverse = np.unique(before * base + self.ids, return_inverse=True)
        self.v, self.w = codes // base, codes % base
        hashes = np.append(self.words, BEGIN)
        keys = kernel.mix(hashes[self.v] * U(0x9E3779B97F4A7C15) + kernel.mix(hashes[self.w] ^ U(0xD1B54A32D192ED03)))
        order = np.argsort(keys, kind="stable")
        self.bigrams, self.v, self.w = keys[order], self.v[order], self.w[order]
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.bigram_of = rank[inverse]
        fold = np.repeat(self.fold, self.n)
        self.tuning, self.kept = fold == TUNING, (fold != TUNING) & (fold != HELD_OUT)

    def asked(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Keys of words and of bigrams, with counts in the kept and in the tuning documents."""
        out = []
        for keys, of in ((self.words, self.ids), (self.bigrams, self.bigram_of)):
            out.append((keys, *(np.bincount(of[x], minlength=len(keys)) for x in (self.kept, self.tuning))))
        return out


def edges(parts: int) -> np.ndarray:
    return np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)


def _ask(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.slice(i, 1).to_pylist()[0])
                out = []
                for kind, (keys, kept, tuning) in enumerate(block.asked()):
                    cuts = [0, *np.searchsorted(keys, edges(parts)).tolist(), len(keys)]
                    for part, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        if b > a:
                            out.append((kind, part, block.number, pack_keys(keys[a:b]), pack(kept[a:b].astype("<u4")), pack(tuning[a:b].astype("<u4"))))
                yield table(
                    kind=pa.array([x[0] for x in out], pa.int32()), part=pa.array([x[1] for x in out], pa.int32()), block=pa.array([x[2] for x in out], pa.int64()),
                    **{c: pa.array([x[i + 3] for x in out], pa.binary()) for i, c in enumerate(("keys", "kept", "tuning"))},
                )

    return run


CELLS = pa.schema([(c, pa.int64()) for c in ("bucket", "r2", "r1", "n")])
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
ANSWER = "block long, kind int, part int, kept binary, tuning binary, n_kept long, n_tuning long, v_kept long, v_all long"


def _answer(group: pa.Table) -> pa.Table:
    """What other blocks have of the keys of one part, to each block that asked; a row without block has the part's sums."""
    col = {c: group.column(c).combine_chunks() for c in group.column_names}
    lists = [unpack_keys(x) for x in col["keys"].to_pylist()]
    _, inverse = np.unique(np.concatenate(lists), return_inverse=True)
    cuts = np.cumsum([len(x) for x in lists])[:-1]
    totals, back = [], []
    for c in ("kept", "tuning"):
        own = np.concatenate([unpack(x, "<u4") for x in col[c].to_pylist()])
        totals.append(np.bincount(inverse, weights=own.astype(np.float64)).astype(np.int64))
        back.append([pack(x) for x in np.split((totals[-1][inverse] - own).astype("<u4"), cuts)])
    kind, part, n = group.column("kind")[0].as_py(), group.column("part")[0].as_py(), len(lists)
    sums = (int(totals[0].sum()), int(totals[1].sum()), int((totals[0] > 0).sum()), int((totals[0] + totals[1] > 0).sum()))
    return pa.table({
        "block": pa.array([*col["block"].to_pylist(), None], pa.int64()), "kind": pa.array([kind] * (n + 1), pa.int32()), "part": pa.array([part] * (n + 1), pa.int32()),
        "kept": pa.array([*back[0], None], pa.binary()), "tuning": pa.array([*back[1], None], pa.binary()),
        **{c: pa.array([None] * n + [x], pa.int64()) for c, x in zip(("n_kept", "n_tuning", "v_kept", "v_all"), sums, strict=True)},
    })


def _counts(answers: pa.Table, block: Block) -> dict[tuple[int, str], np.ndarray]:
    """Counts of all documents, of the block's words (0) and bigrams (1): its own and what the answers add."""
    rows = sorted(answers.select(["kind", "part", "kept", "tuning"]).to_pylist(), key=lambda r: (r["kind"], r["part"]))
    out = {}
    for kind, (_, *own) in enumerate(block.asked()):
        for c, x in zip(("kept", "tuning"), own, strict=True):
            out[kind, c] = x + np.concatenate([np.zeros(0, "<u4"), *(unpack(r[c], "<u4") for r in rows if r["kind"] == kind)]).astype(np.int64)
    return out


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context + 1.0).astype(int), BUCKETS - 1)


def _tune(totals: dict):
    """The histogram of the tuning tokens over bucket and both ratios to the uniform probability."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in blocks.to_pylist():
            b = Block(row)
            c = _counts(answers, b)
            context = np.append(c[0, "kept"], totals["docs_kept"])[b.v]
            seen = np.bincount(b.bigram_of[b.tuning], minlength=len(b.bigrams))
            at = np.flatnonzero(seen)
            uniform = 1 / (totals["v_kept"] + 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                r2 = np.log2(np.where(context[at] > 0, c[1, "kept"][at] / context[at], 0) / uniform)
                r1 = np.log2(c[0, "kept"][b.w[at]] / max(totals["n_kept"], 1) / uniform)
            code = np.stack([bucket(context[at]), *(np.where(np.isfinite(r), np.round(np.nan_to_num(r, neginf=0) * BINS), NONE) for r in (r2, r1))]).astype(np.int64)
            cells, inverse = np.unique(code, axis=1, return_inverse=True)
            n = np.bincount(inverse.reshape(-1), weights=seen[at], minlength=cells.shape[1]).astype(np.int64)
            out.append(table(bucket=cells[0], r2=cells[1], r1=cells[2], n=n))
        return pa.Table.from_batches(out, CELLS)

    return run


def learn(cells: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights (bigram, unigram, uniform) per bucket from rows of bucket, r2, r1, count.
    A bucket without tuning tokens has the weights of all of them."""

    def fit(own: np.ndarray) -> np.ndarray:
        ratio = np.where(own[:, 1:3] == NONE, 0.0, 2.0 ** (own[:, 1:3] / BINS))
        p = np.column_stack([ratio, np.ones(len(own))])
        a, n = np.full(3, 1 / 3), own[:, 3].astype(float)
        for _ in range(rounds):
            share = p * a
            share /= share.sum(axis=1, keepdims=True)
            a = np.maximum(share.T @ n / n.sum(), 1e-7)
            a /= a.sum()
        return a

    every = fit(cells) if len(cells) else np.full(3, 1 / 3)
    return np.array([fit(own) if len(own := cells[cells[:, 0] == k]) else every for k in range(BUCKETS)])


def _score(totals: dict, weights: np.ndarray):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        n, v, out = totals["n_kept"] + totals["n_tuning"], totals["v_all"], []
        for row in blocks.to_pylist():
            b = Block(row)
            c = _counts(answers, b)
            words, pairs = c[0, "kept"] + c[0, "tuning"], c[1, "kept"] + c[1, "tuning"]
            context = np.append(words, totals["docs"])[b.v]
            a = weights[bucket(context)]
            p = a[:, 0] * pairs / np.maximum(context, 1) + a[:, 1] * words[b.w] / max(n, 1) + a[:, 2] / (v + 1)
            base = np.log10((words + 1) / (n + (v + 1)))
            add = lambda x: np.add.reduceat(x, b.starts)  # noqa: B023, E731
            out.append(table(
                doc_id=pa.array(b.docs, pa.int64()), held_out=b.fold == HELD_OUT, n_tokens=b.n, n_known=add((words > 0)[b.ids].astype(np.int64)),
                train_tokens=np.full(len(b.docs), n, np.int64), base_score=add(base[b.ids]), score=add(np.log10(p)[b.bigram_of]),
            ))
        return pa.Table.from_batches(out, SCORES)

    return run


def score(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Every document with its base-10 log probability under the model (``score``) and under
    add-one unigrams (``base_score``)."""
    spark = docs.sparkSession
    small_batches(spark)
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("fold"), "text")
    blocks = materialize(rows.mapInArrow(_blocks(block_tokens), BLOCK), "blocks")
    tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // PART_KEYS))
    asked = blocks.mapInArrow(_ask(parts), "kind int, part int, block long, keys binary, kept binary, tuning binary")
    answers = materialize(asked.groupBy("kind", "part").applyInArrow(_answer, ANSWER), "answers")
    release(spark)
    sums = answers.where("block is null and kind = 0").agg(*(F.sum(c).alias(c) for c in ("n_kept", "n_tuning", "v_kept", "v_all"))).first().asDict()
    folds = blocks.select(F.explode("fold").alias("fold")).groupBy("fold").count().collect()  # one row per fold
    totals = {k: int(x or 0) for k, x in sums.items()} | {
        "docs": sum(r[1] for r in folds if r[0] != HELD_OUT), "docs_kept": sum(r[1] for r in folds if r[0] not in (HELD_OUT, TUNING)),
    }
    replies = answers.where("block is not null").select("block", "kind", "part", "kept", "tuning")
    both = lambda f, schema: blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(f, schema)
    cells = both(_tune(totals), "bucket long, r2 long, r1 long, n long").groupBy("bucket", "r2", "r1").agg(F.sum("n").alias("n"))
    cells = np.array([tuple(r) for r in materialize(cells, "cells").collect()], np.int64).reshape(-1, 4)  # bounded by its bins
    release(spark)
    return both(_score(totals, learn(cells)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
