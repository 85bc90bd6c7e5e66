import random
import re
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from stratum.llm import quality_rules as q
from tests.llm.data import AWKWARD, documents, prose, words


def counts(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    again = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def corpus():
    rng = random.Random(8)
    rows = [*AWKWARD, (8, "a b c a b c a b c"), (9, "x\nx\n\nx y\nx"), (10, "#*$%&|<> \x0b\x0c\r #")]
    for i in range(100, 200):
        lines = [" ".join(prose(rng, rng.randrange(1, 12), rng.choice([5, 400]))) for _ in range(rng.randrange(1, 15))]
        rows.append((i, rng.choice(["\n", "\n\n", " | "]).join(lines + lines[: rng.randrange(3)])))
    return rows


@pytest.mark.parametrize("bits", [24, 60])
def test_counts_against_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(q, "POSITION_BITS", bits)  # 60: four bits of hash, so different windows meet
    got = q.features(documents(spark, corpus(), extra=True)).collect()
    found = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=str)
    assert found == sorted(((d, *counts(t)) for d, t in corpus()), key=str)


def test_binomial_tail(spark):
    cases = [(0, 10), (0, 600), (3, 50), (10, 100), (15, 1000), (150, 1000), (0, 0), (4, 4)]
    for p in (0.004, 0.2):
        got = spark.createDataFrame(cases, "k long, n long").select(q.binomial_tail(F.col("k"), F.col("n"), p)).collect()
        for (k, n), r in zip(cases, got, strict=True):
            want = float(sum(comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1)))
            assert r[0] == pytest.approx(want if k < n * p else 1.0, rel=1e-8)
            assert k < n * p or n == 0 or want > 0.25  # what is given as 1 is never small


def test_cutoffs_hold_and_are_strict(spark):
    rng = random.Random(9)
    texts = [(i, " ".join(prose(rng, 60) + ["#"] * rng.choice([0, 0, 0, 1])), "en") for i in range(400)] + [(0, "doc 0 once more " + " ".join(prose(rng, 60)), "en")] * 300
    bad = [(i, "#!# " * 3 + " ".join(f"{w} |" for w in prose(rng, 60)), "en") for i in range(800, 900)]
    few = [(i, " ".join(prose(rng, 60)), "fr") for i in range(900, 1000)]
    docs = documents(spark, texts + bad + few)
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in texts + few] + [(i, 0, 0) for i, *_ in bad] + [(None, 1, 0), (5, None, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    got = q.judge(docs, labels).collect()
    kept = {r.doc_id for r in got if r.kept}
    assert len({i for i, *_ in texts if i not in kept}) <= q.ALPHA * 400
    assert not any(i in kept for i, *_ in bad)
    assert all(i in kept for i, *_ in few)  # too few labels to certify anything
    assert len(got) == 900
    c = {r.lang: r for r in q.certificates(q.features(docs), labels).collect()}
    assert (c["en"].good, c["en"].base_rejected, c["en"].n) == (400, 0, 400) and c["en"].step > 0  # a doc_id counts once
    assert c["fr"].n == 100 and c["fr"].step is None
    assert 0.05 / 2 >= sum(comb(400, i) * q.ALPHA**i * (1 - q.ALPHA) ** (400 - i) for i in range(c["en"].rejected + 1))


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.judge(documents(spark, []), labels).count() == 0
    got = {r.doc_id: r.kept for r in q.judge(documents(spark, [(1, "a " * 20), (2, " ".join(f"w{i}" for i in range(60)))]), labels).collect()}
    assert got == {1: False, 2: True}
