"""Language identification by Bayesian fusion of evidence.

posterior(l) ~ text(l) * P(declared | l) * P(suffix | l) * P(l | host)

* text: hashed byte trigrams of the lower-cased text under a naive Bayes model per language.
  The model is fitted on a bounded sample of each language's labelled rows (about ``TRAIN_DOCS``
  different ones, by hash of key and text, whole texts), so no language is left out; a text's mean
  log-likelihood counts as at most ``STRENGTH`` trigrams, which are far from independent. The
  labels serve this alone: a row's own label is no evidence about it.
* declared markup language and address suffix: how often each goes with each language, from
  all rows' first verdicts (the best by text alone), by grouped counts with add-``SMOOTH``.
* host: grouped counts of the first verdicts, smoothed towards those of the host's suffix, and
  these towards all rows', with ``HOST_WEIGHT`` pseudo-rows at each level.

Missing evidence is neutral. A row is accepted if it has letters and the best language's
posterior is ``CONFIDENT`` or more.

Defined results: a null, empty or letterless text has no language and is rejected; a null or
unseen declaration, suffix or host adds nothing; of equal posteriors the first language in
order wins; repeated rows are judged each, and of a host with several suffixes the first in order
is the one it is smoothed towards; without labelled rows there is no language and
nothing is accepted; other columns are ignored; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.shared import materialize, small, small_batches, text_slices

TRAIN_DOCS = 4096
PLACES = 1 << 13
STRENGTH = 48
SMOOTH = 1.0
HOST_WEIGHT = 20.0
CONFIDENT = 0.5

#: Bytes: letters as lower case, bytes beyond ASCII as they are, all others 0.
LETTER = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint32)


def trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of every trigram that has a letter in its middle, and the text it is in."""
    x = np.concatenate([[0], LETTER[data], [0]]).astype(np.uint32)
    middle = np.flatnonzero(x[1:-1])
    doc = np.searchsorted(at, middle, side="right") - 1
    left, right = np.where(middle > at[doc], x[middle], 0), np.where(middle + 1 < at[doc + 1], x[middle + 2], 0)
    code = (left.astype(np.uint32) * 65536 + x[middle + 1] * 256 + right.astype(np.uint32)) * np.uint32(2654435761)
    return (code >> np.uint32(32 - 13)).astype(np.int64), doc


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for rows, data, at in text_slices(batches, "text"):
        place, doc = trigrams(data, at)
        for i, lang in enumerate(rows.column(0).to_pylist()):
            totals.setdefault(lang, np.zeros(PLACES, np.int64))
            totals[lang] += np.bincount(place[np.searchsorted(doc, i) : np.searchsorted(doc, i + 1)], minlength=PLACES)
    for lang, n in totals.items():
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own), pa.array(n[own])], ["lang", "place", "n"])


class Model:
    """Languages in order and the log-probability of each trigram place in each."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        self.log = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * PLACES))


def fit(labelled: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """The model of (key, lang, text) rows: of about ``most`` different ones of each language, those whose
    key and text have the least hash, or all where there are no more; never none. Equal rows count once."""
    rows = labelled.where("lang is not null and text is not null").withColumn("h", F.xxhash64("key", "text"))
    share = F.least(F.lit(1.0), F.lit(float(most)) / F.approx_count_distinct("h"))  # of the range of hashes
    last = rows.groupBy("lang").agg(F.greatest(share * 2.0**64 - 2.0**63, F.min("h").cast("double")).alias("last"))
    own = rows.join(small(materialize(last, "last")), "lang").where(F.col("h").cast("double") <= F.col("last"))
    own = own.groupBy("lang", "h").agg(F.max("text").alias("text")).select("lang", "text")
    counts = own.mapInArrow(_count, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counts.column("lang").to_pylist()))  # as many as the sample has, with PLACES rows each at most
    table = np.zeros((len(names), PLACES))
    at = {x: i for i, x in enumerate(names)}
    table[[at[x] for x in counts.column("lang").to_pylist()], counts.column("place").to_numpy()] = counts.column("n").to_numpy()
    return Model(names, table)


def _score(model: Model, strength: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in text_slices(batches, "text"):
            n_docs = len(at) - 1
            place, doc = trigrams(data, at)
            n = np.bincount(doc, minlength=n_docs)
            mean = np.stack([np.bincount(doc, weights=x[place], minlength=n_docs) for x in model.log], axis=1) / np.maximum(n, 1)[:, None] if len(model.langs) else np.zeros((n_docs, 0))
            text = (mean - mean.max(axis=1, keepdims=True, initial=-1e9)) * np.minimum(n, strength)[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n_docs + 1) * len(model.langs), pa.int32()), pa.array(text.reshape(-1)))
            names = [c for c in rows.schema.names if c != "text"]
            columns = [rows.column(rows.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n), lists], [*names, "n_letters", "text"])

    return run


def _first(scores: Column) -> Column:
    """The place of the greatest of an array, the first of equal ones."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def _add(x: Column, y: Column) -> Column:
    return F.coalesce(F.zip_with(x, y, lambda a, b: a + b), x)


def identify(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """``rows``: id, text, declared, suffix, host. ``labelled``: key, lang, text. Returns id, t (xxhash64
    of the text), declared, language, confidence, accepted and the number of letters."""
    small_batches(rows.sparkSession)
    model = fit(labelled)
    size = len(model.langs)
    kept = rows.select("id", F.xxhash64("text").alias("t"), "declared", "suffix", "host", "text")
    schema = f"id {dict(rows.dtypes)['id']}, t long, declared string, suffix string, host string, n_letters long, text array<double>"
    scored = materialize(kept.mapInArrow(_score(model, STRENGTH), schema), "scored")
    judged = scored.where(f"n_letters > 0 and {size} > 0").withColumn("first", _first(F.col("text")))
    numbers = F.array(*(F.count_if(F.col("first") == i).cast("double") for i in range(size))) if size else F.array().cast("array<double>")

    def likelihood(column: str) -> DataFrame:
        """Of each value of ``column``: log P(value | language) for every language."""
        counts = judged.where(F.col(column).isNotNull()).groupBy(column).agg(numbers.alias("n"))
        counts = materialize(counts, f"{column}-counts")
        *every, values = counts.agg(*(F.sum(F.get("n", i)) for i in range(size)), F.count("*")).first()
        own = F.array(*(F.log((F.get("n", i) + SMOOTH) / F.lit((x or 0.0) + SMOOTH * values)) for i, x in enumerate(every)))
        return counts.select(F.col(column).alias("_value"), own.alias(f"_{column}"))

    def smoothed(n: Column, above: Column) -> Column:
        total = F.aggregate(n, F.lit(0.0), lambda s, x: s + x)
        return F.zip_with(n, above, lambda x, p: (x + HOST_WEIGHT * p) / (total + HOST_WEIGHT))

    out = scored
    if size:
        uniform = F.array(*[F.lit(1.0 / size)] * size)
        every = F.array(*map(F.lit, judged.agg(numbers.alias("n")).select(smoothed(F.col("n"), uniform)).first()[0]))
        by_suffix = judged.groupBy(F.coalesce("suffix", F.lit("")).alias("_suffix")).agg(numbers.alias("n"))
        by_suffix = by_suffix.select("_suffix", smoothed(F.col("n"), every).alias("p"))
        by_host = judged.where("host is not null").groupBy("host").agg(numbers.alias("n"), F.min(F.coalesce("suffix", F.lit(""))).alias("_suffix"))
        by_host = by_host.join(small(materialize(by_suffix, "suffixes")), "_suffix").select(
            F.col("host").alias("_value"), F.transform(smoothed(F.col("n"), F.col("p")), lambda p: F.log(p)).alias("_host")
        )
        for column, table in (("declared", likelihood("declared")), ("suffix", likelihood("suffix")), ("host", by_host)):
            table = small(materialize(table, column))
            out = out.join(table, F.col(column) == F.col("_value"), "left").drop("_value")
        posterior = F.col("text")
        for column in ("declared", "suffix", "host"):
            posterior = _add(posterior, F.col(f"_{column}"))
        out = out.withColumn("posterior", posterior)
    else:
        out = out.withColumn("posterior", F.col("text"))
    top = F.array_max("posterior")
    share = 1 / F.aggregate("posterior", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    found = (F.col("n_letters") > 0) & F.lit(size > 0)
    names = F.array(*map(F.lit, model.langs)) if size else F.array(F.lit(None).cast("string"))
    return out.select(
        "id", "t", "declared", F.when(found, F.get(names, _first(F.col("posterior")))).alias("language"),
        F.when(found, share).otherwise(F.lit(0.0)).alias("confidence"), F.coalesce(found & (share >= CONFIDENT), F.lit(False)).alias("accepted"), "n_letters",
    )


def markup_language(text: Column) -> Column:
    """What the lang attribute of an html element declares."""
    return F.nullif(F.lower(F.regexp_extract(text, r"(?i)<html[^>]*\slang=[\"']?([A-Za-z]+)", 1)), F.lit(""))


def of_documents(docs: DataFrame) -> DataFrame:
    """Documents: what markup in the text declares, the host that ``source`` names, and its suffix if it
    has one. ``lang`` is the label that the classifier is fitted on, and no evidence about its own row."""
    host = F.lower(F.regexp_extract(F.col("source"), r"^(?:[A-Za-z]+://)?([^/?#:]+)", 1))
    suffix = F.nullif(F.regexp_extract(host, r"\.([a-z]{2,})$", 1), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text", markup_language(F.col("text")).alias("declared"), suffix.alias("suffix"), F.nullif(host, F.lit("")).alias("host"))
    return identify(rows, docs.select(F.col("doc_id").alias("key"), "lang", "text"))


def of_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """Pages: the lang attribute of the markup, the last label of the host's name, the host."""
    host = F.nullif(F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/?#:]+)", 1)), F.lit(""))
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    rows = pages.select(F.col("page_id").cast("long").alias("id"), bare.alias("text"), markup_language(F.col("html")).alias("declared"), F.substring_index(host, ".", -1).alias("suffix"), host.alias("host"))
    return identify(rows, labelled)


def accepted_only(docs: DataFrame) -> DataFrame:
    """``docs`` without those that have no confident language."""
    out = of_documents(docs).where(~F.col("accepted"))
    out = small(materialize(out.select(F.col("id").alias("_lang_doc"), F.col("t").alias("_lang_t")).distinct(), "rejected"))
    return docs.join(out, docs.doc_id.eqNullSafe(F.col("_lang_doc")) & (F.xxhash64(docs.text) == F.col("_lang_t")), "left_anti")
