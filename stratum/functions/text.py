"""Scalars as column expressions. All but the dialect line stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratum.functions import vocab
from stratum.functions.passages import dialect_of, marker_counts_of
from stratum.schema import GROUP_LINES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def strip(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def lines(text: Column) -> Column:
    """Lines without their ends; no empty one after a last newline."""
    parts = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n", -1)
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def query_tokens(query: Column) -> Column:
    """Search words: runs of [A-Za-z0-9_-] of two characters or more."""
    return F.filter(F.regexp_extract_all(query, F.lit("[A-Za-z0-9_-]+"), F.lit(0)), lambda t: F.length(t) >= 2)


def match_expression(query: Column) -> Column:
    """The words as quoted prefixes joined by AND; null without words."""
    parts = F.transform(query_tokens(query), lambda t: F.concat(F.lit('"'), t, F.lit('"*')))
    return F.when(F.size(parts) > 0, F.array_join(parts, " AND "))


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(ascii_lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def entity_id(name: Column) -> Column:
    return F.replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), F.lit('"'), F.lit(""))


def content_hash(text: Column) -> Column:
    return F.md5(text)


def drawer_id(source: Column, index: Column, digest: Column, suffix: str = "") -> Column:
    parts = [source, index.cast("string"), digest, *([F.lit(suffix)] if suffix else [])]
    return F.substring(F.md5(F.concat_ws(":", *parts)), 1, 16)


def infer_date(content: Column, source_file: Column | None = None) -> Column:
    """The first date of the content by order of patterns, else of the file's name, as YYYY-MM-DD or YYYY-MM."""
    found = [F.nullif(F.regexp_extract(content, p, 1), F.lit("")) for p in vocab.CONTENT_DATES]
    if source_file is not None:
        name = F.element_at(F.split(source_file, "/"), -1)
        found += [F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for p in vocab.NAME_DATES]
    return F.translate(F.coalesce(*found), "/_.", "---")


def file_hall(room: Column, content: Column, source_file: Column) -> Column:
    low, path = F.lower(content), F.lower(source_file)
    out = F.when(room.contains("diary") | path.contains("diary") | path.contains("journal"), "hall_events")
    for in_room, in_content, hall in vocab.FILE_HALLS:
        out = out.when(contains_any(room, in_room) | contains_any(low, in_content), hall)
    return out.when(room == "general", "hall_events").otherwise("hall_facts")


def chat_hall(room: Column, content: Column, source_file: Column, derived: Column | bool = False) -> Column:
    low, path = F.lower(content), F.lower(source_file)
    out = F.when(path.contains("diary") | path.contains("journal"), "hall_events")
    for name, hall in vocab.CHAT_ROOM_HALLS.items():
        out = out.when(room == name, hall)
    for words, hall in vocab.CHAT_TECHNICAL_HALLS:
        out = out.when((room == "technical") & contains_any(low, words), hall)
    out = out.when((room == "technical") & (F.lit(derived) if isinstance(derived, bool) else derived), "hall_facts")
    for words, hall in vocab.CHAT_HALLS:
        out = out.when(contains_any(low, words), hall)
    return out.otherwise("hall_events")


def artifact_hall(room: Column, kind: Column, content: Column, context_room: Column) -> Column:
    low = F.lower(content)
    return (
        F.when((kind == "preference_bridge") | room.contains("preference"), "hall_preferences")
        .when((kind == "decision_bridge") | room.contains("decision"), "hall_facts")
        .when((kind == "anchor_doc") & contains_any(context_room, ["architecture", "design"]), "hall_facts")
        .when((kind == "anchor_doc") & contains_any(low, ["issue", "fix"]), "hall_events")
        .when(kind == "anchor_doc", "hall_facts")
        .when(contains_any(low, ["learned", "realized", "insight"]), "hall_discoveries")
        .when(contains_any(low, ["problem", "failed", "resolved"]), "hall_events")
        .when(contains_any(context_room, ["planning", "timeline"]), "hall_events")
        .otherwise("hall_facts")
    )


def chat_room(content: Column) -> Column:
    """The room with most of its terms in the content; the first of equal ones; general without any."""
    def scores(low: Column) -> Column:
        return F.array(*(sum(low.contains(t).cast("int") for t in terms) for terms in vocab.CHAT_ROOMS.values()))

    def best(s: Column) -> Column:
        return F.when(F.array_max(s) == 0, "general").otherwise(F.get(F.array(*map(F.lit, vocab.CHAT_ROOMS)), (F.array_position(s, F.array_max(s)) - 1).cast("int")))

    return let(let(F.lower(content), scores), best)


def wing_name(path: Column, fallback: str = "default") -> Column:
    """The last part of a path, or the one before it if the last is a generic name and that one isn't."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    last, before = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(fallback)), F.try_element_at(parts, F.lit(-2))
    generic = lambda x: x.isin(*vocab.GENERIC_NAMES)
    return F.when(generic(last) & before.isNotNull() & ~generic(before), before).otherwise(last)


def anchor_terms(content: Column) -> Column:
    """The first ten distinct terms in order."""
    return F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(content, F.lit(vocab.ANCHOR), F.lit(1)))), 1, 10)


def shortened(text: Column, limit: int) -> Column:
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def anchor_summary(content: Column) -> Column:
    return shortened(F.replace(content, F.lit("\n"), F.lit(" ")), 180)


def preferred_snippet(raw: Column, compressed: Column, prefer_compressed: bool, limit: int) -> Column:
    chosen = F.coalesce(compressed, raw) if prefer_compressed else raw
    return shortened(F.replace(chosen, F.lit("\n"), F.lit(" ")), limit)


def marker_scores(text: Column) -> Column:
    """A struct of how often the patterns of each memory type occur in the lower-case text."""
    return marker_counts_of(F.lower(text))


def line_groups(text: Column, size: int = GROUP_LINES) -> Column:
    return let(lines(text), lambda own: F.when(F.size(own) == 0, F.array().cast("array<string>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.floor((F.size(own) - 1) / size).cast("int")), lambda i: F.array_join(F.slice(own, i * size + 1, size), "\n"))))


def facts(content: Column) -> Column:
    """array of struct(subject, predicate, object, confidence): each triple once, with its best confidence."""
    def rule(predicate: str, pattern: str, confidence: float) -> Column:
        subjects, objects = (F.regexp_extract_all(content, F.lit(pattern), F.lit(g)) for g in (1, 2))
        return F.zip_with(subjects, objects, lambda s, o: F.struct(
            F.coalesce(F.nullif(s, F.lit("")), F.lit(vocab.DEFAULT_SUBJECT)).alias("subject"), F.lit(predicate).alias("predicate"),
            o.alias("object"), F.lit(confidence).alias("confidence")))

    return F.array_distinct(F.concat(*(rule(*f) for f in vocab.FACTS)))


def name_boost(query: Column, text: Column) -> Column:
    """The share of the query's capitalised words of more than two bytes that the text contains, in any case."""
    names = F.filter(F.split(query, r"(?U)\s+"), lambda w: w.rlike(r"^\p{Lu}") & (F.octet_length(w) > 2))
    return let(names, lambda n: F.when(F.size(n) == 0, F.lit(0.0)).otherwise(
        F.size(F.filter(n, lambda w: F.lower(text).contains(F.lower(w)))) / F.size(n)))


def cosine(x: Column, y: Column) -> Column:
    """In double precision; 0 where either vector is all but zero."""
    add = lambda s, v: s + v
    dot = F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), add)
    norm = lambda v: F.aggregate(F.transform(v, lambda a: a.cast("double") * a.cast("double")), F.lit(0.0), add)
    tiny = 1.1920929e-7
    return let(F.struct(dot.alias("d"), norm(x).alias("x"), norm(y).alias("y")), lambda s: F.when((s["x"] <= tiny) | (s["y"] <= tiny), F.lit(0.0)).otherwise(s["d"] / F.sqrt(s["x"] * s["y"])))


def l2_normalised(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(F.transform(v, lambda a: a.cast("double") * a.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return let(norm, lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda a: (a / n).cast("float"))))


def fitted(v: Column, size: int) -> Column:
    """Cut or padded with zeros to ``size`` entries, then normalised."""
    return l2_normalised(F.slice(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), size)), 1, size))


def ngrams(words: Column, n: int) -> Column:
    return F.when(F.size(words) < n, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), "::"))
    )


def first_codes(text: Column, signals: list[tuple[str, str]], most: int = 3) -> Column:
    """The first distinct codes whose words the lower-case text contains, in list order."""
    codes = F.array(*(F.when(F.lower(text).contains(word), F.lit(code)) for word, code in signals))
    return F.slice(F.array_distinct(F.array_compact(codes)), 1, most)


def compressed(text: Column, wing: Column | None = None, room: Column | None = None, date: Column | None = None, source_file: Column | None = None) -> Column:
    """The compact dialect line of a text, under a header line if any of its parts is given."""
    body = dialect_of(text)
    if all(x is None for x in (wing, room, date, source_file)):
        return body
    known = lambda x: F.lit("?") if x is None else F.coalesce(x, F.lit("?"))
    stem = F.lit("?") if source_file is None else F.coalesce(F.nullif(file_stem(source_file), F.lit("")), F.lit("?"))
    return F.concat(F.concat_ws("|", known(wing), known(room), known(date), stem), F.lit("\n"), body)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]*$", "$1")


def token_estimate(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4).cast("long")
