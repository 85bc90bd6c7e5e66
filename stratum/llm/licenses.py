"""Licence scans in DataFrame functions only: Dice coefficients of word bigrams.

A document's units are its lines, its paragraphs and the whole text, and for a template that none of
these matches, the windows of as many words as the template has, at every eighth of that length and
at the end: they find a licence laid out over lines or paragraphs amid other text, and only the best
of them counts. Each unit is lower-cased and reduced to words of ASCII letters and digits; its
distinct word pairs are compared with every template whose number of pairs lies within the bounds
that a coefficient of ``threshold`` or more leaves: t / (2 - t) to (2 - t) / t of the unit's.
Everything happens inside a document's row, so nothing is shuffled and no key can be hot.

Documents that cannot match are passed over in two steps. A text without any of a template's
telling words lacks so many of its pairs that no unit reaches the threshold. And as a unit's pairs
are among its text's, a text must share t / (2 - t) of a template's pairs for any unit to match it.

Defined results: null and empty texts have no match; of equal coefficients the earlier template
counts, and of equal windows the first; repeated rows and rows without doc_id are scanned each; other
columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.license_texts import TEMPLATES
from stratum.llm.shared import ascii_lower

THRESHOLD = 0.8
#: Words that are telling only where no others are left (fixed values).
COMMON = set("a and any are as at be by can for if in is it may not of on or that the this to was with you".split())


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def template_pairs(text: str) -> list[str]:
    words = template_words(text)
    return list(dict.fromkeys(" ".join(x) for x in zip(words, words[1:], strict=False)))


def telling_words(pairs: list[str], threshold: float) -> set[str]:
    """Words, rather long ones, one of which a text must have to reach the threshold: without them all it
    shares under t / (2 - t) of the template's pairs, and 2s / (a + b) <= 2s / (s + b) < t."""
    gone: set[str] = set()
    out: set[str] = set()
    for word in sorted({w for p in pairs for w in p.split()}, key=lambda w: (w in COMMON, -len(w), w)):
        if 2 * (len(pairs) - len(gone)) < threshold * (2 * len(pairs) - len(gone)) - 1e-9:
            break
        out.add(word)
        gone |= {p for p in pairs if word in p.split()}
    return out


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def pairs_of(words: Column) -> Column:
    """Distinct pairs of neighbouring words. (A pair is two words around a space.)"""
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
    return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def pairs_of_text(text: Column) -> Column:
    return _let(words_of(text), pairs_of)


def stride(n_words: int) -> int:
    return max(1, n_words // 8)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and ``matches``: unit text, template number, license, dice, and of windows the number of the first word; the best first."""
    known = [(n, name, template_pairs(text), len(template_words(text))) for n, (name, text) in enumerate(templates)]
    lo, hi = threshold / (2 - threshold), (2 - threshold) / threshold

    def against(unit: Column, pairs: Column, at: Column, n: int, name: str, own: list[str]) -> Column:
        fits = (F.size(pairs) >= lo * len(own) - 1e-9) & (F.size(pairs) <= hi * len(own) + 1e-9)
        dice = F.when(fits, 2.0 * F.size(F.array_intersect(pairs, F.array(*map(F.lit, own)))) / (F.size(pairs) + len(own))).otherwise(F.lit(0.0))
        return F.struct((-dice).alias("minus"), F.lit(n).alias("template"), F.lit(name).alias("license"), at.alias("word"), unit.alias("unit"))

    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<minus:double,template:int,license:string,word:int,unit:string>>")

    def of_template(x: Column, n: int, name: str, own: list[str], size: int) -> Column:
        """The matches of one template: units, or else the best window."""
        good = lambda found: F.filter(found, lambda m: m["minus"] <= -threshold)
        by_unit = good(F.transform(x["units"], lambda u: _let(pairs_of_text(u), lambda p: against(u, p, F.lit(None).cast("int"), n, name, own))))
        starts = F.array_distinct(F.array_append(F.sequence(F.lit(0), F.size(x["words"]) - size, F.lit(stride(size))), F.size(x["words"]) - size))
        window = lambda i: _let(F.slice(x["words"], i + 1, size), lambda w: against(F.array_join(w, " "), pairs_of(w), i.cast("int"), n, name, own))
        by_window = F.when(F.size(x["words"]) >= size, F.slice(F.array_sort(good(F.transform(starts, window))), 1, 1)).otherwise(none)
        shared = F.size(F.array_intersect(x["pairs"], F.array(*map(F.lit, own))))
        return F.when(shared < lo * len(own) - 1e-9, none).otherwise(_let(by_unit, lambda found: F.when(F.size(found) > 0, found).otherwise(by_window)))

    units = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, r"\n[\x20\x09\x0B-\x0D]*\n"), F.array(text)))
    parts = _let(words_of(text), lambda w: F.struct(w.alias("words"), pairs_of(w).alias("pairs"), units.alias("units")))
    telling = sorted(set().union(*(telling_words(own, threshold) for _, _, own, _ in known)))
    words = F.regexp_extract_all(ascii_lower(text), F.lit("[a-z0-9]{%d,}" % min(map(len, telling))), F.lit(0))
    may = F.arrays_overlap(words, F.array(*map(F.lit, telling)))
    found = F.when(may, F.array_sort(_let(parts, lambda x: F.flatten(F.array(*(of_template(x, *k) for k in known))))))
    shown = F.transform(found, lambda x: F.struct(x["unit"].alias("unit"), x["template"].alias("template"), x["license"].alias("license"), (-x["minus"]).alias("dice"), x["word"].alias("word")))
    empty = F.array().cast("array<struct<unit:string,template:int,license:string,dice:double,word:int>>")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(shown, empty).alias("matches"))
