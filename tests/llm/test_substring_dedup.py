import random

import pytest

from stratum.llm import substring_dedup
from tests.llm.data import AWKWARD, documents, prose, words


def brute(rows, size):
    first = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - size + 1):
            if doc is not None:
                key = tuple(w[i : i + size])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w, gone = words(text), set()
        for i in range(len(w) - size + 1):
            if doc is not None and first[tuple(w[i : i + size])] < doc:
                gone |= set(range(i, i + size))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    rows = [*AWKWARD, (None, " ".join(["a"] * 70)), (8, "a " * 60)]
    base = [prose(rng, 300) for _ in range(4)]
    for i in range(20, 90):
        w = prose(rng, rng.randrange(1, 150))
        for _ in range(rng.randrange(3)):
            b = rng.choice(base)
            at, n = rng.randrange(200), rng.choice([20, 49, 50, 51, 75, 100])
            w[rng.randrange(len(w) + 1) : 0] = b[at : at + n]
        rows.append((i, rng.choice(["  ", " ", "\n"]).join(w)))
    rows += [(i, rows[-1][1]) for i in range(200, 230)]  # exact copies
    for i in range(300, 320):  # near copies
        w = list(base[0])
        w[rng.randrange(300)] = "changed"
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,size", [(1, 50), (2, 50), (3, 9)])
def test_against_brute_force(spark, seed, size):
    rows = corpus(seed)
    got = substring_dedup.remove_repeats(documents(spark, rows, extra=True), size)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got.collect()), key=str)
    assert got == brute(rows, size)


def thue_morse(n):
    """Two words of 2**n letters that polynomials modulo 2**64 hash alike."""
    s = "a"
    for _ in range(n):
        s += s.translate({97: 98, 98: 97})
    return s, s.translate({97: 98, 98: 97})


def test_long_words_of_like_form(spark):
    for n in (10, 11, 12):
        x, y = thue_morse(n)
        rows = [(1, " ".join([x] * 50)), (2, " ".join([y] * 50)), (3, " ".join([y] * 50))]
        got = substring_dedup.remove_repeats(documents(spark, rows)).collect()
        assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (2, 0), (3, 50)]


def test_empty_table(spark):
    assert substring_dedup.remove_repeats(documents(spark, [])).count() == 0


def test_a_short_corpus_loses_nothing(spark):
    rows = [(1, "a b c"), (2, "a b c")]
    assert {r.n_removed for r in substring_dedup.remove_repeats(documents(spark, rows)).collect()} == {0}
