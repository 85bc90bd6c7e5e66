"""Similarity join of documents on their sets of word shingles, with connected components.

A pair of documents links when 100 * shared >= 75 * all of their distinct 5-word shingles.

1. Documents with one set (equal size and 128-bit sum) are one: the smallest doc_id stands
   for the others, which are linked to it without comparison.
2. Shingles are ordered by estimated document frequency, rare ones first. The estimate comes
   from exact counts within tasks, and only the most frequent ``HEAVY`` shingles are kept, so
   what is broadcast is bounded. Any common order is correct; a good one is fast.
3. Multi-match prefixes: two linked sets of n shingles share at least l of their first
   n - ceil(3n/4) + l shingles in that order. Each document takes the l that makes its
   estimated cost least: longer prefixes cost rows, but demand more matches of a candidate.
   The place of a match bounds what can follow it in both, which must suffice for the overlap.
4. Rows of shingles that two documents have in their prefixes are kept, sorted by size. First
   each is compared with its predecessor alone, so thousands of near copies chain up with
   as many comparisons as copies. Then one row of each component is compared per shingle, and
   last all pairs of different components that have enough
   matches are compared: no link between components is missed, and no pair within one is made.
5. A candidate must pass a bound on its common shingles from two parity bitmaps of about two
   bits a shingle. Then comparisons are exact, over the whole sets; links make components.

Shingles are compared by 64-bit hashes. Defined results: documents without words (null,
empty or blank) have an empty set and link with nothing; a document under 5 words has its
whole sequence as one shingle; rows that share a doc_id pool their links; rows without
doc_id have no component; repeated rows are returned each; other columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.llm import kernel
from stratum.llm.components import components
from stratum.llm.kernel import U
from stratum.llm.shared import drop, longs, materialize, release, small, small_batches, table, text_slices

SHINGLE = 5
PERCENT = 75
#: Most shingles whose frequency is estimated and sent to the executors.
HEAVY = 250_000
#: Rows of one shingle that a task gets at most, of those known to be frequent.
ROWS_PER_TASK = 200_000
#: Most prefix matches asked for.
MOST_MATCHES = 4
#: Partners of one document that a task compares.
PARTNERS = 2_000


def sets(data: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    start, end, first = kernel.words(data, at)
    h = kernel.word_hashes(data, start, end, lower=True)
    sums, n = kernel.prefix(h, 2), np.diff(first)
    grams = kernel.gram_hashes(h, k)
    out = []
    for i, count in enumerate(n.tolist()):
        a = int(first[i])
        if count >= k:
            g = np.sort(grams[a : a + count - k + 1])
            out.append(g[np.flatnonzero(np.diff(g, prepend=g[0] - U(1)))])
        elif count:
            own = kernel.runs(sums, np.array([a]), np.array([a + count]), 2)
            out.append(kernel.mix(own ^ U(count)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in text_slices(batches, "text"):
            found = sets(data, at, k)
            every = np.concatenate([*found, np.zeros(1, np.uint64)])
            n = np.array([len(x) for x in found])
            edge = np.concatenate([[0], np.cumsum(n)])
            lanes = []
            for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(kernel.mix(every ^ U(salt)))])
                lanes.append((s[edge[1:]] - s[edge[:-1]]).view(np.int64))
            yield table(doc_id=rows.column(0), t=rows.column(1), n=n.astype(np.int64), s1=lanes[0], s2=lanes[1])

    return run


def _local_counts(k: int, flush: int = 4_000_000):
    """Shingles that a task meets twice or more, with their counts. A lot of them is one array,
    sorted in place, so that a worker holds little more than the lot itself."""

    def counted(lot: np.ndarray) -> pa.RecordBatch:
        lot.sort()
        same = np.zeros(len(lot) + 1, bool)  # as the one before
        np.equal(lot[1:], lot[:-1], out=same[1:-1])
        first, last = np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(same[:-1] & ~same[1:])
        return table(token=lot[first].view(np.int64), n=last - first + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, size = np.empty(flush + flush // 16, np.uint64), 0
        for _, data, at in text_slices(batches, "text"):
            for x in sets(data, at, k):
                if size + len(x) > len(lot):
                    lot = np.concatenate([lot[:size], np.empty(len(x) + flush // 16, np.uint64)])
                lot[size : size + len(x)] = x
                size += len(x)
            if size >= flush:
                yield counted(lot[:size])
                size = 0
        if size:
            yield counted(lot[:size])

    return run


def heavy_tokens(texts: DataFrame, k: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` of the most frequent shingles, ascending, and their estimated frequencies."""
    counts = materialize(texts.select("text").mapInArrow(_local_counts(k), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "counts")
    by_power = {int(r[0]): r[1] for r in counts.groupBy(F.floor(F.log2("n")).alias("p")).count().collect()}
    least, taken = 64, 0
    while least > 1 and taken + by_power.get(least - 1, 0) <= most:
        least -= 1
        taken += by_power.get(least, 0)
    found = counts.where(F.col("n") >= F.lit(2**least if least < 63 else 2**63 - 1)).toArrow()
    drop(counts)
    tokens, n = found.column("token").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], n[order]


def matches_wanted(cost: np.ndarray, base: int, most: int = MOST_MATCHES) -> int:
    """The number l of prefix matches with the least estimated cost. ``cost``: documents that
    share each shingle, in order; a prefix costs its rows, and its candidates a comparison each,
    which are at most the rows that meet it divided by l."""
    best, out = math.inf, 1
    for matches in range(1, most + 1):
        n = base + matches - 1
        if n > len(cost):
            break
        met = float(cost[:n].sum())
        estimate = n + met + 20 * met / matches
        if estimate < best * 0.95:
            best, out = estimate, matches
    return out


def _prefixes(k: int, percent: int, tokens, n_docs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, often = tokens.value, n_docs.value
        for rows, data, at in text_slices(batches, "text"):
            ids = longs(rows, "doc_id")
            out: list[tuple] = []
            for doc, own in zip(ids, sets(data, at, k), strict=True):
                n = len(own)
                if not n:
                    continue
                base = n - -(-percent * n // 100) + 1
                matches, salts = 1, 1
                if len(heavy):
                    place = np.minimum(np.searchsorted(heavy, own), len(heavy) - 1)
                    level = np.where(heavy[place] == own, often[place], 0)
                    order = np.lexsort((own, level))
                    own, level = own[order], level[order]
                    if level[base - 1]:
                        matches = matches_wanted(level, base)
                    top = level[: base + matches - 1]
                    salts = np.maximum(1, top // ROWS_PER_TASK)
                own = own[: base + matches - 1]
                salts = np.broadcast_to(salts, len(own))
                # 0 is for shingles that are not salted, so each row tells whether others of its shingle may stand elsewhere
                salt = np.where(salts > 1, 1 + (int(doc) * 0x9E3779B1 & 0x7FFFFFFF) % salts, 0)
                out.append((own, *(np.full(len(own), x) for x in (doc, n, matches)), np.arange(len(own)), salt))
            if out:
                token, doc, *others = (np.concatenate(x) for x in zip(*out, strict=True))
                yield table(token=token.view(np.int64), doc_id=doc.astype(np.int64), **{c: x.astype(np.int32) for c, x in zip(("n", "l", "pos", "salt"), others, strict=True)})

    return run


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shingle, salt, size and document those with a neighbour of the same
    shingle and salt (any, of a salted shingle), and the document before each of them."""
    names = ["token", "salt", "n", "doc_id", "l", "pos"]

    def emitted(x: dict, had: dict | None, upto: int) -> pa.RecordBatch:
        size = len(x["token"])
        same = np.zeros(size + 1, bool)
        same[1:-1] = (x["token"][1:] == x["token"][:-1]) & (x["salt"][1:] == x["salt"][:-1])
        if had is not None:
            same[0] = had["token"] == x["token"][0] and had["salt"] == x["salt"][0]
        before = np.concatenate([[had["doc_id"] if had is not None else 0], x["doc_id"][:-1]])
        keep = np.flatnonzero((same[:-1] | same[1:] | (x["salt"] > 0))[:upto])
        return table(**{c: x[c][keep] for c in ("token", "doc_id", "n", "l", "pos")}, before=pa.array(before[keep], mask=~same[:-1][keep]))

    held, had = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = {c: longs(batch, c) for c in names}
        if held is not None:
            x = {c: np.concatenate([held[c], x[c]]) for c in names}
        size = len(x["token"])
        if size > 1:
            yield emitted(x, had, size - 1)
            had = {c: x[c][size - 2] for c in names}
        held = {c: x[c][size - 1 :] for c in names}
    if held is not None:
        yield emitted(held, had, 1)


def _compare(k: int, percent: int):
    """Rows of a, salt, b and a text, sorted: first the texts of a (b null), then its partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for rows, data, at in text_slices(batches, "text"):
            linked_a, linked_b, linked = [], [], []
            bs = rows.column(rows.schema.get_field_index("b")).to_pylist()
            for a, salt, b, x in zip(longs(rows, "a").tolist(), longs(rows, "salt").tolist(), bs, sets(data, at, k), strict=True):
                if (a, salt) != key:
                    key, own = (a, salt), []
                if b is None:
                    own.append(x)
                    continue
                yes = False
                for y in own:
                    lo, hi = sorted((len(x), len(y)))
                    if lo and 100 * lo >= percent * hi:
                        both = np.sort(np.concatenate([x, y]))
                        shared = int((both[1:] == both[:-1]).sum())
                        yes |= 100 * shared >= percent * (lo + hi - shared)
                linked_a.append(a)
                linked_b.append(b)
                linked.append(yes)
            yield table(a=pa.array(linked_a, pa.int64()), b=pa.array(linked_b, pa.int64()), linked=pa.array(linked, pa.bool_()))

    return run


def _bitmaps(k: int):
    """Per text the parities of how many of its shingles fall on each of 2n to 4n places (64 at least), and on each of 256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in text_slices(batches, "text"):
            found, bits, folds = sets(data, at, k), [], np.zeros((len(at) - 1, 32), np.uint8)
            for i, x in enumerate(found):
                folds[i] = np.packbits((np.bincount((kernel.mix(x) & U(255)).astype(np.int64), minlength=256) & 1).astype(np.uint8))
                places = 64 << max(0, (len(x) - 1) // 32).bit_length()
                odd = np.bincount((kernel.mix(x) & U(places - 1)).astype(np.int64), minlength=places) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).tobytes())
            yield table(doc_id=rows.column(0), n=pa.array([len(x) for x in found], pa.int64()), bits=pa.array(bits, pa.binary()), **{f"f{i}": c for i, c in enumerate(folds.view(np.int64).T)})

    return run


def most_shared(x: bytes, y: bytes, n: int, m: int) -> int:
    """A bound on the common elements of sets of n and m elements: where parities differ, the sets do."""
    short, long = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    if len(long) > len(short):  # twice the places: those that differ by the highest bit fall together
        long = np.bitwise_xor.reduce(long.reshape(-1, len(short)), axis=0)
    return (n + m - int(np.bitwise_count(short ^ long).sum())) // 2


def _plausible(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, n, m in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                shared = most_shared(x, y, n, m)
                keep.append(100 * shared >= percent * (n + m - shared))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def plausible(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    one, other = (bitmaps.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")) for c in "ab")
    rows = materialize(pairs.join(one, "a"), "half").join(other, "b").select("a", "b", "bitsa", "bitsb", "na", "nb")
    return rows.mapInArrow(_plausible(percent), "a long, b long").distinct()


def compare(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """``pairs`` (a, b) with ``linked``; a text is sent once per pair, and once per PARTNERS pairs for a."""
    own = materialize(pairs.select("a").union(pairs.select("b")).distinct().select(F.col("a").alias("doc_id")), "own")
    texts = materialize(texts.join(small(own), "doc_id").select("doc_id", "text"), "texts")
    release(texts.sparkSession)
    sizes = small(materialize(pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("salts")), "sizes"))
    firsts = texts.join(sizes, texts.doc_id == sizes.a).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "text")
    salted = small(materialize(pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b"), "salted"))
    seconds = texts.join(salted, texts.doc_id == salted.b).select("a", "salt", "b", "text")
    rows = firsts.union(seconds).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    found = rows.mapInArrow(_compare(k, percent), "a long, b long, linked boolean")
    return found.groupBy("a", "b").agg(F.max("linked").alias("linked"))


def candidates(shared: DataFrame, bitmaps: DataFrame, labels: DataFrame, percent: int, one_each: bool = False) -> DataFrame:
    """Pairs (a, b) of different components that share enough prefix shingles and may be similar enough.
    ``one_each``: among one row of each component per shingle, whatever the number of matches."""
    rows = shared.join(small(labels), shared.doc_id == labels.node, "left").withColumn("component", F.coalesce("component", "doc_id"))
    rows = materialize(rows.select("token", "doc_id", "n", "l", "pos", "component"), "rows")
    mixed = materialize(rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token"), "mixed")
    rows = materialize(rows.join(mixed, "token"), "mixed-rows")
    if one_each:
        rows = rows.groupBy("token", "component").agg(F.min(F.struct("n", "doc_id", "l", "pos")).alias("r")).select("token", "component", "r.*")
        rows = materialize(rows, "one-each")
    rows = materialize(rows.join(bitmaps.drop("n", "bits"), "doc_id"), "marked-rows")
    x, y = rows.alias("x"), rows.alias("y")
    # what follows a shared shingle in both, and the matches before it, must suffice for the overlap that the sizes ask for
    enough = f"{100 + percent} * (least(x.n - x.pos, y.n - y.pos) + least(x.l, y.l) - 1) >= {percent} * (x.n + y.n)"
    apart = " + ".join(f"bit_count(x.f{i} ^ y.f{i})" for i in range(4))  # sets differ where parities do
    enough += f" and {100 + percent} * (x.n + y.n - ({apart})) >= {2 * percent} * (x.n + y.n)"
    ordered = "(x.n < y.n or x.n = y.n and x.doc_id < y.doc_id)"
    met = x.join(y, F.expr(f"x.token = y.token and x.component <> y.component and {ordered} and 100 * x.n >= {percent} * y.n and {enough}"))
    found = met.groupBy(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).agg(F.count("*").alias("matches"), F.min(F.least("x.l", "y.l")).alias("wanted"))
    return (found if one_each else found.where("matches >= wanted")).select("a", "b")


def similar_documents(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, heavy: int = HEAVY) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    small_batches(spark)
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    signed = materialize(every.mapInArrow(_signatures(k), "doc_id long, t long, n long, s1 long, s2 long"), "signatures")
    usable = signed.where("doc_id is not null and n > 0")
    groups = materialize(usable.groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "t")).alias("first")), "groups")
    copies = materialize(
        usable.join(groups, ["n", "s1", "s2"]).where("doc_id <> first.doc_id or t <> first.t").select("doc_id", "t", F.col("first.doc_id").alias("first")).distinct(), "copies"
    )
    texts = every.where("doc_id is not null and text is not null").join(small(copies.select("doc_id", "t").distinct()), ["doc_id", "t"], "left_anti")
    texts = texts.select("doc_id", "text")

    tokens, often = heavy_tokens(texts, k, heavy)
    sent = spark.sparkContext.broadcast(tokens), spark.sparkContext.broadcast(often)  # at most ``heavy`` entries
    prefixes = texts.mapInArrow(_prefixes(k, percent, *sent), "token long, doc_id long, n int, l int, pos int, salt int")
    shared = materialize(
        prefixes.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "doc_id")
        .mapInArrow(_shared_rows, "token long, doc_id long, n int, l int, pos int, before long"),
        "shared",
    )
    release(spark)
    involved = materialize(shared.select("doc_id").distinct(), "involved")
    bitmaps = materialize(texts.join(small(involved), "doc_id").select("doc_id", "text").mapInArrow(_bitmaps(k), "doc_id long, n long, bits binary, f0 long, f1 long, f2 long, f3 long"), "bitmaps")
    chained = materialize(shared.where("before <> doc_id").select(F.col("before").alias("a"), F.col("doc_id").alias("b")).distinct(), "chained")
    chained = materialize(plausible(chained, bitmaps, percent), "plausible")
    first = materialize(compare(chained, texts, k, percent), "first")
    release(spark)
    same = copies.where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    links = first.where("linked").select("a", "b").union(same)
    labels = components(links)

    # one row of each component for each shingle first: where components belong together, a link between them mostly
    # shows here, and all pairs of their members need not be listed below
    bridges = candidates(shared, bitmaps, labels, percent, one_each=True)
    bridges = materialize(plausible(bridges.join(first, ["a", "b"], "left_anti"), bitmaps, percent), "bridges")
    second = materialize(compare(bridges, texts, k, percent), "second")
    links = links.union(second.where("linked").select("a", "b"))
    labels = components(links)

    seen = first.select("a", "b").union(second.select("a", "b"))
    pairs = candidates(shared, bitmaps, labels, percent).join(seen, ["a", "b"], "left_anti")
    pairs = materialize(plausible(materialize(pairs, "pairs"), bitmaps, percent), "plausible")
    release(spark)
    third = materialize(compare(pairs, texts, k, percent), "third")
    labels = components(links.union(third.where("linked").select("a", "b")))
    out = signed.select("doc_id", F.col("n").alias("n_shingles"))
    return out.join(small(labels), out.doc_id == labels.node, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with the document of smallest doc_id of each component; rows without doc_id stay,
    and of rows that share a doc_id the one of least text."""
    found = similar_documents(docs).where("component_id <> doc_id").select("doc_id").distinct()
    left = docs.join(small(found), "doc_id", "left_anti").select(docs.columns)
    again = materialize(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    if again.isEmpty():
        return left
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    repeated = left.join(small(again), "doc_id", "left_semi").withColumn("_near_place", order).where("_near_place = 1").select(docs.columns)
    return left.join(small(again), "doc_id", "left_anti").select(docs.columns).union(repeated)
