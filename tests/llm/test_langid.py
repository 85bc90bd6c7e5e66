import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.llm import langid
from tests.llm.data import AWKWARD, documents

SOUNDS = {"aa": "kai mo tu ra", "bb": "ché lè une qué", "cc": "schtz ü wer pf"}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus():
    rng = random.Random(14)
    rows = [(i, text(rng, lang := rng.choice(list(SOUNDS)), rng.randrange(1, 60)), lang, f"{lang}{rng.randrange(3)}") for i in range(100, 500)]
    rows = [(i, t, lang if rng.random() < 0.9 else rng.choice(list(SOUNDS)), s) for i, t, lang, s in rows]
    return rows, {i: s[:2] for i, _, _, s in rows}


def test_held_out_accuracy_and_rejection(spark):
    rows, truth = corpus()
    awkward = [(d, t, None, None) for d, t in AWKWARD] + [(50, "123 ...", "aa", "aa0")]
    got = langid.of_documents(documents(spark, rows + awkward, extra=True)).collect()
    assert len(got) == len(rows) + len(awkward)
    right = sum(r.language == truth[r.id] for r in got if r.id in truth)
    assert right >= 0.99 * len(rows)
    assert all(r.accepted for r in got if r.id in truth and r.language == truth[r.id])
    for r in got:
        if r.n_letters == 0:
            assert not r.accepted and r.language is None and r.confidence == 0.0
    assert {r.id for r in got if r.n_letters == 0} == {1, 2, 3, 50}
    kept = langid.accepted_only(documents(spark, rows + awkward))
    assert kept.count() == sum(r.accepted for r in got) and kept.columns == documents(spark, []).columns


@pytest.mark.parametrize("fold", [0, 1])
def test_accuracy_on_documents_outside_of_the_sample(spark, fold):
    """Documents of the table judged by a model of the others, their labels unknown to it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null").withColumn("fold", F.expr("pmod(xxhash64(text), 2)"))
    rows = docs.where(F.col("fold") == fold).selectExpr("doc_id as id", "text", "cast(null as string) as declared", "cast(null as string) as suffix", "source as host")
    found = langid.identify(rows, docs.where(F.col("fold") != fold).selectExpr("doc_id as key", "lang", "text"))
    right, n, kept = found.join(docs.select(F.col("doc_id").alias("id"), "lang"), "id").where("n_letters >= 20").selectExpr("count_if(language = lang)", "count(*)", "count_if(accepted)").first()
    assert n > 400 and right >= 0.98 * n and kept >= 0.99 * n


def test_labels_are_no_evidence(spark):
    rng = random.Random(18)
    rows = [(i, text(rng, list(SOUNDS)[i % 3], 30), list(SOUNDS)[i % 3], "https://h.example.de/x") for i in range(300)]
    rows += [(900, text(rng, "aa", 30), "bb", "h2"), (901, "<html lang='cc'>" + text(rng, "aa", 30), "cc", None)]
    got = {r.id: r for r in langid.of_documents(documents(spark, rows)).collect()}
    assert got[900].language == "aa" and got[901].language == "aa" and got[901].declared == "cc"


def test_a_sample_of_equal_rows_is_bounded(spark):
    rng = random.Random(19)
    same = [(1, "aa", "kai mo")] * 3000
    rows = same + [(None, "aa", "tu ra")] * 3000 + [(i, "bb", text(rng, "bb", 5)) for i in range(100)]
    model = langid.fit(spark.createDataFrame(rows, "key long, lang string, text string"), most=20)
    counts = np.exp(model.log[0])
    assert model.langs == ["aa", "bb"] and counts.max() * langid.PLACES / 2 < 20  # a count or two, not thousands


def test_posterior_against_brute_force(spark):
    rng = random.Random(15)
    rows = []
    for i in range(200):
        lang = rng.choice(list(SOUNDS))
        rows.append((i, text(rng, lang, rng.randrange(1, 4)), rng.choice([lang, "cc", None]), rng.choice(["x", "y", None]), rng.choice(["h1", "h2", f"{lang}", None])))
    labels = [(i, lang, text(rng, lang, 40)) for i, lang in enumerate(list(SOUNDS) * 5)]
    df = spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string")
    train = spark.createDataFrame(labels, "key long, lang string, text string")
    model = langid.fit(train)

    def by_text(t):
        place, _ = langid.trigrams(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        mean = [sum(m[p] for p in place) / len(place) for m in model.log]
        return [(m - max(mean)) * min(len(place), langid.STRENGTH) for m in mean]

    scores = [by_text(r[1]) for r in rows]
    first = [s.index(max(s)) for s in scores]
    k = len(model.langs)

    def likelihood(c):
        n = Counter((r[c], f) for r, f in zip(rows, first, strict=True) if r[c] is not None)
        values = {v for v, _ in n}
        total = [sum(n[v, i] for v in values) for i in range(k)]
        return {v: [math.log((n[v, i] + 1) / (total[i] + len(values))) for i in range(k)] for v in values}

    def smooth(own, above):
        return [(own.count(i) + 20 * above[i]) / (len(own) + 20) for i in range(k)]

    every = smooth(first, [1 / k] * k)
    suffix = {s: smooth([f for r, f in zip(rows, first, strict=True) if (r[3] or "") == s], every) for s in {r[3] or "" for r in rows}}
    host = {h: smooth([f for r, f in zip(rows, first, strict=True) if r[4] == h], suffix[min(r[3] or "" for r in rows if r[4] == h)]) for h in {r[4] for r in rows} - {None}}
    tables = [(2, likelihood(2)), (3, likelihood(3)), (4, {h: [math.log(x) for x in p] for h, p in host.items()})]
    want = {}
    for r, s in zip(rows, scores, strict=True):
        post = list(s)
        for c, t in tables:
            if r[c] in t:
                post = [a + b for a, b in zip(post, t[r[c]], strict=True)]
        share = [math.exp(x - max(post)) for x in post]
        want[r[0]] = (model.langs[post.index(max(post))], 1 / sum(share))
    for r in langid.identify(df, train).collect():
        assert r.language == want[r.id][0] and r.confidence == pytest.approx(want[r.id][1]) and r.accepted == (want[r.id][1] >= langid.CONFIDENT)


def test_rare_languages_stay_in_the_model(spark):
    rng = random.Random(17)
    rows = [(i, "aa", text(rng, "aa", 5)) for i in range(2000)] + [(3000 + i, f"r{i:02d}", text(rng, "cc", 5)) for i in range(30)]
    model = langid.fit(spark.createDataFrame(rows, "key long, lang string, text string"), most=20)
    assert model.langs == sorted({x for _, x, _ in rows})


def test_pages(spark):
    rng = random.Random(16)
    labels = spark.createDataFrame([(i, lang, text(rng, lang, 40)) for i, lang in enumerate(list(SOUNDS) * 5)], "key long, lang string, text string")
    pages = [(i, f"https://www.{lang}.example/p", f"<html lang='{lang}'><script>aa bb</script><p>{text(rng, lang, 9)}</p>") for i, lang in enumerate(list(SOUNDS) * 4)]
    pages += [(90, None, None), (91, "u", "<p></p>")]
    got = langid.of_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), labels).collect()
    assert {r.id: r.language for r in got} == {**{i: u.split(".")[1] for i, u, _ in pages if i < 90}, 90: None, 91: None}


def test_empty_tables(spark):
    assert langid.of_documents(documents(spark, [])).count() == 0
    got = langid.of_documents(documents(spark, [(1, "kai mo", None, None)])).collect()
    assert [(r.language, r.accepted) for r in got] == [(None, False)]
