"""Personal data: fixed patterns, and contextual extraction bootstrapped from what they find.

One scan of the texts finds the spans of the fixed patterns (kinds email, ip, card, phone) and
the other tokens that look like identifiers (with an @ or four digits or more) and maximal runs
of tokens of digits, brackets and hyphens (four digits or more), each with its lexical patterns:
the two words before it and the word on either side of it. From there Spark works on a table of
those finds alone:

1. Spans of the fixed patterns are the seeds; they give each pattern its instances.
2. A pattern's confidence for a kind is the share of its instances known to be of that kind,
   with ``PRIOR`` instances of doubt, and nothing under ``MIN_SUPPORT`` distinct ones.
3. An instance's confidence is that at least one of its patterns is right. Instances at
   ``ACCEPT`` or more become known; 2 and 3 are repeated until no instance is new, which ends
   as a round without a new one is the last and instances are finite.
4. Occurrences of accepted instances that the fixed patterns missed become spans, without
   those inside a longer one of their kind.

Counts are summed per pattern and instance before anything is joined, and each round is
written, so both sides of its joins are plain exchanges that can be split at hot keys.

Defined results: null and empty texts have no spans; equal rows find the same spans; rows
without doc_id are searched like others; spans of different kinds may overlap; a learned span
never overlaps one of the fixed patterns; an instance that the fixed patterns find as two kinds is
known as the first of them in the order listed, and of kinds that patterns suggest equally the
first is taken; words and texts are read whole, however long, in time in proportion to their
length; other columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.shared import materialize, small, small_batches

KINDS = ["email", "ip", "card", "phone"]
MIN_SUPPORT, PRIOR, ACCEPT = 5, 1.0, 0.8

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
PIECE = re.compile(r"[\"'\[{<]*+[+(]*+[0-9][0-9().+-]*+[.,;:!?\"')\]}>]*+")
LOCALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their @, so that a long word costs its length once."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCALS:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
                out.append((1, *m.span()))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= len(DIGIT.findall(m.group())) <= 15:
                    out.append((3, *m.span()))
    return out


def _shape(word: str) -> str:
    return re.sub("[0-9]+", "0", word.lower().strip(".,;:!?\"'()[]{}<>"))


def runs(text: str, taken: list[list[int]]) -> list[tuple[int, int]]:
    """Maximal runs of two or more tokens of digits, brackets and hyphens on a line, outside of ``taken`` (sorted). Other punctuation ends a run."""
    out: list[tuple[int, int]] = []
    own: list[tuple[int, int]] = []

    def close() -> None:
        while own and text[own[-1][0] : own[-1][1]] == "-":
            own.pop()
        if len(own) > 1:
            start, end = own[0][0], own[-1][1]
            while text[start] in "\"'[{<(":
                start += 1
            while text[end - 1] in ".,;:!?\"')]}>-":
                end -= 1
            # a bracket whose partner is inside belongs to the run
            if text[start:end].count(")") > text[start:end].count("(") and start > own[0][0] and text[start - 1] == "(":
                start -= 1
            if text[start:end].count("(") > text[start:end].count(")") and text[end : end + 1] == ")":
                end += 1
            if len(DIGIT.findall(text, start, end)) >= 4:
                out.append((start, end))
        own.clear()

    past = 0
    for m in TOKEN.finditer(text):
        start, end = m.span()
        joins = bool(own) and text[own[-1][1] - 1] in "0123456789)-" and not text[own[-1][1] : start].strip(" \t")
        if PIECE.fullmatch(m.group()):
            while past < len(taken) and taken[past][1] <= start:
                past += 1
            if past < len(taken) and taken[past][0] < end:
                close()
                continue
            if not joins or text[start] in "\"'[{<":
                close()
            own.append((start, end))
        elif joins and m.group() == "-":
            own.append((start, end))
        elif own:
            close()
    close()
    return out


def finds(text: str, base: list[tuple[int, int, int]]) -> list[tuple]:
    """(kind or None, start, end, pattern, instance) for every pattern around every find."""
    if "@" not in text and not DIGIT.search(text):
        return []
    taken: list[list[int]] = []
    for _, a, b in sorted(base, key=lambda x: x[1:]):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    past = [b for _, b in taken]
    others, firsts, lasts = [], [], []
    for m in TOKEN.finditer(text):
        start, end = m.span()
        firsts.append(start)
        lasts.append(end)
        word = m.group()
        if "@" not in word[1:-1] and sum(map(word.count, "0123456789")) < 4:
            continue
        while start < end and text[start] in ".,;:!?\"'()[]{}<>":
            start += 1
        while start < end and text[end - 1] in ".,;:!?\"'()[]{}<>":
            end -= 1
        i = bisect_right(past, start)
        if start < end and not (i < len(taken) and taken[i][0] < end):
            others.append((None, start, end))
    several = set(runs(text, taken))
    others += [(None, start, end) for start, end in sorted(several - {(a, b) for _, a, b in others})]
    out = []
    for kind, start, end in [*base, *others]:
        i, j = bisect_left(firsts, start), bisect_right(lasts, end)
        left = [text[firsts[k] : min(lasts[k], start)] for k in range(max(0, i - 2), i)]
        right = [text[max(firsts[j], end) : lasts[j]]] if j < len(lasts) else []
        instance = re.sub(r"[\x20\t().-]", "", text[start:end].lower()) if kind in (2, 3) or (kind is None and (start, end) in several) else text[start:end].lower()
        if len(left) == 2:
            out.append((kind, start, end, f"< {_shape(left[0])} {_shape(left[1])}", instance))
        if left and right:
            out.append((kind, start, end, f"<> {_shape(left[-1])} {_shape(right[0])}", instance))
        if not left and not right:
            out.append((kind, start, end, "", instance))
    return out


SCAN = "doc_id long, t long, base array<struct<kind:int,start:long,end:long>>, finds array<struct<kind:int,start:long,end:long,pattern:string,instance:string>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = [("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]
    base_type, find_type = pa.list_(pa.struct(span)), pa.list_(pa.struct([*span, ("pattern", pa.string()), ("instance", pa.string())]))
    for batch in batches:
        bases, found = [], []
        for text in batch.column(2):
            text = text.as_py() or ""
            base = base_spans(text)
            bases.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in base])
            found.append([dict(zip(("kind", "start", "end", "pattern", "instance"), x, strict=True)) for x in finds(text, base)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bases, base_type), pa.array(found, find_type)], ["doc_id", "t", "base", "finds"])


def learn(edges: DataFrame) -> DataFrame:
    """instance, kind of what the patterns discover. ``edges``: pattern, instance, kind (null: unknown), one row each."""
    known = materialize(edges.where("kind is not null").groupBy("instance").agg(F.min("kind").alias("known")), "known")
    while True:
        sums = edges.select("pattern", "instance").distinct().join(known, "instance", "left").groupBy("pattern").agg(
            F.count("*").alias("n"), *(F.count_if(F.col("known") == k).alias(f"n{k}") for k in range(len(KINDS)))
        ).where((F.col("n") >= MIN_SUPPORT) & (F.col("pattern") != ""))
        best = F.greatest(*(F.struct(F.col(f"n{k}").alias("hits"), F.lit(-k).alias("minus")) for k in range(len(KINDS))))
        patterns = sums.select("pattern", best["hits"].alias("hits"), (-best["minus"]).alias("kind"), (best["hits"] / (F.col("n") + PRIOR)).alias("confidence"))
        patterns = materialize(patterns.where("hits > 0"), "patterns")
        open_ = edges.where("kind is null").select("pattern", "instance").distinct()
        doubt = open_.join(patterns, "pattern").groupBy("instance", "kind").agg(F.exp(F.sum(F.log1p(-F.col("confidence")))).alias("doubt"))
        new = doubt.where(F.col("doubt") <= 1 - ACCEPT).groupBy("instance").agg(F.min(F.struct("doubt", "kind"))["kind"].alias("known"))
        new = materialize(new.join(known.select("instance"), "instance", "left_anti"), "new")
        if new.isEmpty():
            break
        known = materialize(known.union(new), "known")
    return known.select("instance", F.col("known").alias("kind"))


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, t (xxhash64 of the text), ``base`` and ``learned``: spans as kind, start, end in characters."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    scanned = materialize(texts.mapInArrow(_scan, SCAN), "scanned")
    found = scanned.select("doc_id", "t", F.explode("finds").alias("x")).select("doc_id", "t", "x.*")
    edges = materialize(found.groupBy("pattern", "instance", "kind").agg(F.count("*").alias("n")), "edges")
    known = learn(edges)
    news = found.where("kind is null").select("doc_id", "t", "start", "end", "instance").join(known, "instance")
    learned = news.groupBy("doc_id", "t").agg(F.collect_set(F.struct("kind", "start", "end")).alias("learned"))
    inside = lambda x, y: (x["kind"] == y["kind"]) & (y["start"] <= x["start"]) & (x["end"] <= y["end"]) & (x != y)
    learned = learned.withColumn("learned", F.filter("learned", lambda x: ~F.exists("learned", lambda y: inside(x, y))))
    learned = small(materialize(learned, "learned"))
    out = scanned.select("doc_id", "t", "base").alias("s").join(learned.alias("l"), F.expr("s.doc_id <=> l.doc_id and s.t = l.t"), "left")
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    return out.select("s.doc_id", "s.t", "s.base", F.coalesce(F.array_sort("l.learned"), none).alias("learned"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined, by kind and start."""
    name = F.array(*map(F.lit, KINDS))
    one = lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("_pii_spans").to_pylist(), strict=True):
            if text and spans:
                parts, at = [], 0
                for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                    if s["end"] > at:
                        if s["start"] >= at:
                            parts.append(text[at : s["start"]] + f"[{KINDS[s['kind']].upper()}]")
                        at = s["end"]
                text = "".join(parts) + text[at:]
            texts.append(text)
        i = batch.schema.get_field_index("text")
        batch = batch.set_column(i, batch.schema.field(i), pa.array(texts, pa.string()))
        yield batch.select([n for n in batch.schema.names if n != "_pii_spans"])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets. An overlapping span joins the one before."""
    found = find_spans(docs).withColumn("_pii_spans", F.concat("base", "learned")).where(F.size("_pii_spans") > 0)
    found = materialize(found.select(F.col("doc_id").alias("_pii_doc"), F.col("t").alias("_pii_t"), "_pii_spans").dropDuplicates(["_pii_doc", "_pii_t"]), "spans")
    keys = docs.doc_id.eqNullSafe(F.col("_pii_doc")) & (F.xxhash64(docs.text) == F.col("_pii_t"))
    rows = docs.join(small(found), keys, "left").select(*(docs[c] for c in docs.columns), "_pii_spans")
    return rows.mapInArrow(_redact, docs.schema)
