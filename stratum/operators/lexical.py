"""Full-text search with bm25.

Every word of a query must occur as a prefix; a word with - or _ is a phrase whose last part
is a prefix. Statistics are over all active rows, whatever the scope of a search."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions import text as X

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Queries that are sent to the rows at a time, and words whose phrases a task remembers.
MOST_QUERIES, MOST_WORDS = 10_000, 200_000
WORD, NO_MARK = re.compile(r"[^\W_]+"), re.compile(r"[^\W_]")


def _accents() -> tuple[str, str]:
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x250)]
    pairs = [(a, d[0]) for a, d in pairs if len(d) > 1 and d[0].isascii()]
    return "".join(a for a, _ in pairs), "".join(d for _, d in pairs)


def folded(text: Column) -> Column:
    """Lower-case without the accents of Latin letters."""
    return F.translate(F.lower(text), *_accents())


def words(text: Column) -> Column:
    """Runs of letters and digits of any script, folded."""
    return F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def doc_stats(drawers: DataFrame) -> DataFrame:
    """id and number of words."""
    return drawers.where("active").select("id", F.size(words(F.col("content"))).alias("dl"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """One row: number of rows and mean length."""
    return stats.agg(F.count("*").alias("n_rows"), F.avg("dl").alias("avgdl"))


def query_phrases(queries: DataFrame) -> DataFrame:
    """qid, phrase number, parts: the search words of each query, split where the index splits them."""
    own = queries.select("qid", F.posexplode(X.query_tokens(F.col("query"))).alias("i", "word"))
    parts = own.select("qid", "word", words(F.col("word")).alias("parts"))
    return parts.where(F.size("parts") > 0).select("qid", "parts").distinct()


class Phrases:
    """Distinct phrases (lists of parts), found in one pass over the words of a text. The last part matches as a prefix."""

    def __init__(self, phrases: list[list[str]]):
        self.prefixes = {p[0]: i for i, p in enumerate(phrases) if len(p) == 1}
        self.starts: dict[str, set[int]] = {}  # of the first three letters, how long the phrases are
        for p in self.prefixes:
            self.starts.setdefault(p[:3], set()).add(len(p))
        self.several: dict[str, list[tuple[int, list[str]]]] = {}
        for i, p in enumerate(phrases):
            if len(p) > 1:
                self.several.setdefault(p[0], []).append((i, p))

        self._known: dict[str, tuple[int, ...]] = {}

    def _of(self, word: str) -> tuple[int, ...]:
        """The phrases of one part that a word begins with."""
        if (found := self._known.get(word)) is None:
            if len(self._known) >= MOST_WORDS:
                self._known.clear()
            sizes = {n for k in range(1, min(len(word), 3) + 1) for n in self.starts.get(word[:k], ()) if n <= len(word)}
            found = self._known[word] = tuple(i for n in sizes if (i := self.prefixes.get(word[:n])) is not None)
        return found

    def counts(self, words: list[str]) -> dict[int, int]:
        """How often each phrase occurs, of those that do."""
        out: dict[int, int] = {}
        for word, n in Counter(words).items():
            for i in self._of(word):
                out[i] = out.get(i, 0) + n
        if self.several:
            for at, word in enumerate(words):
                for i, p in self.several.get(word, ()):
                    end = at + len(p) - 1
                    if end < len(words) and words[at:end] == p[:-1] and words[end].startswith(p[-1]):
                        out[i] = out.get(i, 0) + 1
        return out


ACCENTS = str.maketrans(*_accents())


def words_in(text: str | None) -> list[str]:
    """The words of a lower-case text, folded. (Folding changes letters into letters, so it changes no word's bounds.)"""
    found = WORD.findall(text or "")
    return found if not text or text.isascii() else [w if w.isascii() else w.translate(ACCENTS) for w in found]


def _active(drawers: DataFrame) -> DataFrame:
    return drawers.where("active").select("id", F.lower("content").alias("text"))


def statistics(drawers: DataFrame, phrases: list[list[str]]) -> tuple[int, float, dict[int, int]]:
    """The number of active rows, their mean number of words, and of each phrase the number of rows that have it.
    Every batch of rows is counted where it is; what is gathered is a number for each phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Phrases(phrases)
        for batch in batches:
            n, total = Counter(), 0
            for text in batch.column(1).to_pylist():
                found = words_in(text)
                total += len(found)
                n.update(own.counts(found).keys())
            n[-1] = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64()), pa.array([total if i < 0 else 0 for i in n], pa.int64())], ["phrase", "n", "words"])

    sums = _active(drawers).mapInArrow(run, "phrase int, n long, words long").groupBy("phrase").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect()
    rows = {r.phrase: r for r in sums}
    n_rows = rows[-1].n if -1 in rows else 0
    return n_rows, rows[-1].words / n_rows if n_rows else 1.0, {i: r.n for i, r in rows.items() if i >= 0}


def search(drawers: DataFrame, queries: DataFrame, k: int, wing: str | None = None, room: str | None = None) -> DataFrame:
    """qid, id, bm25 (negative, least first), lexical_rank (from 1) of the best k rows for each query (qid, query).

    Queries are a stated set that is sent to the rows, in blocks. The rows are scanned twice for a block: for the statistics,
    and for the scores of those that have all phrases of a query, for which its rarest phrase is looked up first."""
    asked = query_phrases(queries).groupBy("qid").agg(F.collect_list("parts").alias("phrases"))
    schema = f"qid {dict(queries.dtypes)['qid']}, id {dict(drawers.dtypes)['id']}, bm25 double"
    table, out = asked.toArrow(), None
    for at in range(0, max(1, table.num_rows), MOST_QUERIES):
        ids, lists = table.column(0).combine_chunks().slice(at, MOST_QUERIES), table.column(1).to_pylist()[at : at + MOST_QUERIES]
        number: dict[tuple[str, ...], int] = {}
        wanted = [sorted({number.setdefault(tuple(p), len(number)) for p in own}) for own in lists]
        phrases = [list(p) for p in number]
        n_rows, mean, df = statistics(drawers, phrases)
        idf = {i: max(math.log((n_rows - n + 0.5) / (n + 0.5)), 0.0) or LEAST_IDF for i, n in df.items()}
        by_rarest: dict[int, list[tuple[int, list[int]]]] = {}
        for q, own in enumerate(wanted):
            if all(i in df for i in own):
                by_rarest.setdefault(min(own, key=lambda i: (df[i], i)), []).append((q, own))
        found = _active(drawers).mapInArrow(_scores(phrases, ids, by_rarest, idf, mean), schema)
        out = found if out is None else out.union(found)
    if wing is not None or room is not None:
        from stratum.operators.drawers import scoped

        out = out.join(scoped(drawers, wing, room).select("id"), "id", "left_semi")
    order = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("bm25", 9), "id"))
    return out.select("qid", "id", "bm25", order.alias("lexical_rank")).where(F.col("lexical_rank") <= k)


def _scores(phrases: list[list[str]], ids: pa.Array, by_rarest: dict, idf: dict[int, float], mean: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Phrases(phrases)
        for batch in batches:
            queries, rows, scores = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = words_in(text)
                f = own.counts(words)
                length = K1 * (1 - B + B * len(words) / mean) if mean else K1
                for rarest in f.keys() & by_rarest.keys():
                    for q, wanted in by_rarest[rarest]:
                        if all(p in f for p in wanted):
                            queries.append(q)
                            rows.append(i)
                            scores.append(-sum(idf[p] * f[p] * (K1 + 1) / (f[p] + length) for p in wanted))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(queries, pa.int64())), batch.column(0).take(pa.array(rows, pa.int64())), pa.array(scores, pa.float64())], ["qid", "id", "bm25"])

    return run


def lexical_score(bm25: Column) -> Column:
    """1 / (1 + |bm25|): a stronger match adds less to the fused score; the order is by bm25 itself."""
    return 1 / (1 + F.abs(bm25))


SPACES = re.compile(" +")


@lru_cache(maxsize=10_000)
def _beginnings(query: str | None) -> tuple[str, ...]:
    """The search words of a query in lower case; none that begins with a mark, as tokens are compared behind theirs."""
    found = (w for w in re.findall("[A-Za-z0-9_-]+", query or "") if len(w) >= 2)
    return tuple(dict.fromkeys(w.lower() for w in found if w[0].isalnum()))


def _fold(text: str) -> str:
    low = text.lower()
    return low if low.isascii() else low.translate(ACCENTS)


@lru_cache(maxsize=10_000)
def _beginning(wanted: tuple[str, ...]) -> re.Pattern:
    """A wanted beginning of a word with no letter or digit before it."""
    return re.compile(f"(?<![^\\W_])(?:{'|'.join(map(re.escape, wanted))})")


def _first_hit(text: str, wanted: tuple[str, ...]) -> int:
    """Where in a text without line ends the first token begins that has a wanted beginning behind its marks; 0 without any."""
    low = _fold(text)
    if len(low) == len(text):
        for m in _beginning(wanted).finditer(low):
            start = low.rfind(" ", 0, m.start()) + 1
            if not WORD.search(low, start, m.start()):
                return start
        return 0
    at = 0  # letters that are longer in lower case: token by token
    for token in text.split(" "):
        if _hit(token, wanted):
            return at
        at += len(token) + 1
    return 0


def _hit(token: str, wanted: tuple[str, ...]) -> bool:
    low = _fold(token)
    return (m := NO_MARK.search(low)) is not None and low.startswith(wanted, m.start())


def snippet_of(text: str, query: str | None, size: int = 20) -> str:
    wanted, flat = _beginnings(query), text.replace("\n", " ")
    start = _first_hit(flat, wanted) if wanted else 0
    part = SPACES.split(flat[start:], size)
    more = " … " if len(part) > size else ""
    return (" … " if start > 0 else "") + " ".join(f"[{t}]" if wanted and _hit(t, wanted) else t for t in part[:size]) + more


def snippet(text: Column, query: Column, size: int = 20) -> Column:
    """Up to ``size`` words from the first match on, matches in brackets, ellipses where text is left out.
    (The window starts at the first match instead of the densest stretch.) A text is read up to its first match."""

    def run(texts: pa.Array, queries: pa.Array) -> pa.Array:
        return pa.array([None if t is None else snippet_of(t, q, size) for t, q in zip(texts.to_pylist(), queries.to_pylist(), strict=True)], pa.string())

    run.__annotations__ = {"texts": pa.Array, "queries": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(text, query)
