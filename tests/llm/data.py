"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeats."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = "[^\\x20\\x09-\\x0D]+"


def words(text: str | None) -> list[str]:
    return re.findall(SPACE, text or "")


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "é", ",", "."]) for _ in range(n)]


def documents(spark: SparkSession, rows: list[tuple], extra: bool = False) -> DataFrame:
    """rows: (doc_id, text) or with lang and source after them."""
    full = [(*r, *("en", "src0")[len(r) - 2 :], len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    if extra:  # names that operators use inside
        for name in ("n_words", "text2", "length", "key", "digest", "component_id", "start", "score"):
            df = df.selectExpr("*", f"doc_id as {name}")
    return df


AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "a b c"), (5, "Ünï côdé " * 3), (6, "x" * 50_000), (7, "a " * 30_000)]
