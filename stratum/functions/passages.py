"""Segments, memories and dialect parts of texts, as Arrow kernels: logic that runs through the
lines or words of a text in order, in time in proportion to its length. A null text gives null."""

from __future__ import annotations

import heapq
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from stratum.functions import vocab
from stratum.schema import GROUP_LINES, MIN_CHAT_CHUNK

#: Characters of the Unicode property White_Space (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
TURN, CODE = re.compile(vocab.TURN_LINE), re.compile(vocab.CODE_LINE)

def beginnings(pattern: str) -> list[str]:
    """Texts one of which every match of a pattern of the vocabulary begins with."""
    body = pattern.removeprefix(r"\b")
    if body.startswith("("):
        return body[1 : body.index(")")].split("|")
    own = re.match("[a-z' -]*", body)[0]
    return [own[:-1] if body[len(own) :].startswith("?") else own]


#: Of each memory type the patterns, and the texts without which they cannot match.
MARKERS = {kind: [(beginnings(p), re.compile(p)) for p in patterns] for kind, patterns in vocab.MARKERS.items()}
POSITIVE, NEGATIVE, STOP = frozenset(vocab.POSITIVE), frozenset(vocab.NEGATIVE), frozenset(vocab.STOP_WORDS)
WORD, TOPIC, NAME = re.compile(r"\w+"), re.compile(vocab.TOPIC), re.compile(r"\b[A-Z][a-z]+\b")
SENTENCE = re.compile(r"[.!?\n]+")
LEAST_MEMORY, LEAST_CONFIDENCE, MOST_REPLY = 20, 0.3, 8


def size(text: str) -> int:
    return len(text.encode("utf-8", "replace"))


def lines(text: str) -> list[str]:
    """Lines without their ends; no empty one after a last newline."""
    out = text.replace("\r\n", "\n").split("\n")
    return out[:-1] if out[-1] == "" else out


def paragraphs(text: str) -> list[str]:
    return [p for p in (x.strip(WHITE) for x in text.split("\n\n")) if p]


def line_groups(text: str) -> list[str]:
    own = lines(text)
    return ["\n".join(own[i : i + GROUP_LINES]) for i in range(0, len(own), GROUP_LINES)]


def turns(own: list[str], opens: list[bool]) -> list[list[str]]:
    """Lines grouped from each that opens a turn on; lines before the first are a group of their own."""
    out: list[list[str]] = []
    for line, new in zip(own, opens, strict=True):
        if new or not out:
            out.append([])
        out[-1].append(line)
    return out


def _by_blank_lines(text: str) -> list[str]:
    own = paragraphs(text)
    return [g for g in line_groups(text) if g.strip(WHITE)] if len(own) <= 1 and len(lines(text)) > 20 else own


def segments(text: str) -> list[str]:
    """Turns where three lines or more open one, else paragraphs, else groups of 25 lines."""
    own = lines(text)
    opens = [bool(TURN.search(x.strip(WHITE))) for x in own]
    return ["\n".join(g) for g in turns(own, opens)] if sum(opens) >= 3 else _by_blank_lines(text)


def _reply(group: list[str]) -> str:
    rest: list[str] = []
    for line in group[1:]:
        if line.startswith("---") or len(rest) == MOST_REPLY:
            break
        if line:
            rest.append(line)
    return " ".join(rest)


def exchanges(text: str) -> list[str]:
    """Chunks of a chat: quoted lines with up to eight lines of reply, else paragraphs, else groups of lines."""
    own = [x.strip(WHITE) for x in lines(text)]
    quoted = [x.startswith(">") for x in own]
    if sum(quoted) >= 3:
        groups = [g for g in turns(own, quoted) if g[0].startswith(">")]
        found = [f"{g[0]}\n{reply}" if (reply := _reply(g)) else g[0] for g in groups]
    else:
        found = _by_blank_lines(text)
    return [x for x in found if size(x.strip(WHITE)) > MIN_CHAT_CHUNK]


def prose(text: str) -> str:
    """The text without fenced code and lines that look like commands or code; the whole text if nothing is left."""
    kept, code = [], False
    for line in lines(text):
        own = line.strip(WHITE)
        if own.startswith("```"):
            code = not code
        elif not code and not CODE.search(own):
            kept.append(line)
    return "\n".join(kept).strip(WHITE) or text


def marker_counts(low: str) -> dict[str, int]:
    """How often the patterns of each memory type occur; one is looked for only from where a beginning of it is first met."""
    return {kind: sum(_count(low, first, p) for first, p in patterns) for kind, patterns in MARKERS.items()}


def _count(low: str, first: list[str], pattern: re.Pattern) -> int:
    at = [i for x in first if (i := low.find(x)) >= 0]
    return sum(1 for _ in pattern.finditer(low, min(at))) if at else 0


def memory(segment: str) -> tuple[str, float] | None:
    """Type and confidence of a segment; None where no marker is found."""
    low = prose(segment).lower()
    scores = marker_counts(low)
    kind = max(scores, key=scores.get)  # of equal ones the first
    if not scores[kind]:
        return None
    if kind == "problem":
        known = set(WORD.findall(low))
        positive = len(known & POSITIVE) > len(known & NEGATIVE)
        if any(x in low for x in vocab.RESOLUTIONS):
            kind = "emotional" if positive and scores["emotional"] else "milestone"
        elif positive:
            kind = next((k for k in ("milestone", "emotional") if scores[k]), kind)
    n = size(segment)
    return kind, min(1.0, (scores[kind] + (2 if n > 500 else 1 if n > 200 else 0)) / 5.0)


def memories(text: str) -> list[dict]:
    """The typed segments of a text, in order."""
    out = []
    for segment in segments(text):
        own = segment.strip(WHITE)
        if size(own) >= LEAST_MEMORY and (found := memory(segment)) and found[1] >= LEAST_CONFIDENCE:
            out.append({"content": own, "memory_type": found[0], "confidence": found[1]})
    return out


def topics(text: str, most: int = 3) -> list[str]:
    """The most frequent words, capitalised and compound ones counting more; of equal ones the first in order."""
    scores: dict[str, int] = {}
    for word, n in Counter(TOPIC.findall(text)).items():
        low = word.lower()
        if low not in STOP:  # compound: with a mark, or a capital behind the first letter
            scores[low] = scores.get(low, 0) + n * (1 + 2 * (word[0] != low[0]) + 2 * (word[1:] != low[1:] or "-" in word or "_" in word))
    return heapq.nsmallest(most, scores, key=lambda w: (-scores[w], w))


def key_sentence(text: str) -> str:
    """The sentence with most cue words, short ones preferred; the first of equal ones."""
    best, found = None, ""
    for part in SENTENCE.split(text):
        own = part.strip(WHITE)
        n = size(own)
        if n > 10:
            low = own.lower()
            score = 2 * sum(c in low for c in vocab.CUES) + (n < 80) + (n < 40) - 2 * (n > 150)
            if best is None or score > best:
                best, found = score, own
    return f"{found[:52]}..." if size(found) > 55 else found


def codes(low: str, signals: list[tuple[str, str]], most: int = 3) -> list[str]:
    """The first distinct codes whose words the lower-case text contains, in list order."""
    out: list[str] = []
    for word, code in signals:
        if code not in out and word in low:
            out.append(code)
            if len(out) == most:
                break
    return out


def entities(text: str, most: int = 3) -> list[str]:
    out: dict[str, None] = {}
    for m in NAME.finditer(text):
        out.setdefault(m.group()[:3].upper())
        if len(out) == most:
            break
    return list(out)


def dialect(text: str) -> str:
    """The compact line of a text."""
    low, sentence = text.lower(), key_sentence(text)
    parts = [f"0:{'+'.join(entities(text)) or '???'}", "_".join(topics(text)) or "misc", f'"{sentence}"' if sentence else "", *("+".join(codes(low, s)) for s in (vocab.EMOTIONS, vocab.FLAGS))]
    return "|".join([*parts[:2], *(p for p in parts[2:] if p)])


def _kernel(function, kind: T.DataType):
    arrow = to_arrow_type(kind)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else function(x) for x in texts.to_pylist()], arrow)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)


_STRING = T.StringType()
_MEMORY = T.StructType([T.StructField("content", _STRING), T.StructField("memory_type", _STRING), T.StructField("confidence", T.DoubleType())])
topics_of = _kernel(topics, T.ArrayType(_STRING))
key_sentence_of = _kernel(key_sentence, _STRING)
dialect_of = _kernel(dialect, _STRING)
exchanges_of = _kernel(exchanges, T.ArrayType(_STRING))
memories_of = _kernel(memories, T.ArrayType(_MEMORY))
segments_of = _kernel(segments, T.ArrayType(_STRING))
prose_of = _kernel(prose, _STRING)
marker_counts_of = _kernel(marker_counts, T.StructType([T.StructField(kind, T.LongType()) for kind in vocab.MARKERS]))
memory_of = _kernel(lambda text: dict(zip(("memory_type", "confidence"), memory(text) or (None, None), strict=True)), T.StructType(_MEMORY.fields[1:]))
