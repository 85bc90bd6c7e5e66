import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from stratum.llm import lm_score
from tests.llm.data import AWKWARD, documents, prose, words
from tests.llm.test_substring_dedup import thue_morse

LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return [*(w.translate(LOWER) for w in words(text)), None]


def fold(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7


def corpus():
    rng = random.Random(7)
    return [*AWKWARD, *((i, " ".join(prose(rng, rng.randrange(1, 80), 60)).title()) for i in range(100, 400))]


@pytest.mark.parametrize("block_tokens", [1000, 2_000_000])
def test_against_brute_force(spark, block_tokens):
    rows = corpus()
    got = lm_score.score(documents(spark, rows, extra=True), block_tokens=block_tokens).collect()
    train = [tokens(t) for d, t in rows if fold(d) != 2]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    kept = [tokens(t) for d, t in rows if fold(d) not in (2, 3)]
    tuning = [tokens(t) for d, t in rows if fold(d) == 3]
    model = lambda docs: (Counter(w for t in docs for w in t), Counter(x for t in docs for x in zip(["^", *t], t)), len(docs))  # noqa: E731, B905
    uni, bi, n_docs = model(kept)
    cells = Counter()
    for t in tuning:
        for a, b in zip(["^", *t], t):  # noqa: B905
            context = n_docs if a == "^" else uni[a]
            p = (bi[a, b] / context if context else 0, uni[b] / sum(uni.values()))
            cells[min(int(math.log2(context + 1)), 23), *(round(4 * math.log2(x * (len(uni) + 1))) if x else -9999 for x in p)] += 1
    weights = lm_score.learn(np.array([(*k, m) for k, m in cells.items()]))
    # weights from binned ratios are as good as those from the exact ones
    exact, binned = [], []
    for t in tuning:
        for a, b in zip(["^", *t], t):  # noqa: B905
            context = n_docs if a == "^" else uni[a]
            exact.append((min(int(math.log2(context + 1)), 23), bi[a, b] / context if context else 0, uni[b] / sum(uni.values()), 1 / (len(uni) + 1)))
    exact = np.array(exact)
    for k in np.unique(exact[:, 0]):
        p, w = exact[exact[:, 0] == k, 1:], np.full(3, 1 / 3)
        for _ in range(60):
            share = p * w
            w = (share / share.sum(axis=1, keepdims=True)).mean(axis=0)
        binned.append((np.log2(p @ weights[int(k)]).sum(), np.log2(p @ w).sum()))
    assert sum(x for x, _ in binned) == pytest.approx(sum(y for _, y in binned), rel=1e-3)
    uni, bi, n_docs = model(train)
    want = []
    for d, t in rows:
        t = tokens(t)
        s = 0.0
        for a, b in zip(["^", *t], t):  # noqa: B905
            context = n_docs if a == "^" else uni[a]
            w = weights[min(int(math.log2(context + 1)), 23)]
            s += math.log10(w[0] * (bi[a, b] / context if context else 0) + w[1] * uni[b] / n + w[2] / (v + 1))
        want.append((d, fold(d) == 2, len(t), sum(c[x] > 0 for x in t), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), 3), round(s, 3)))
    assert sorted(((*tuple(r)[:5], round(r.base_score, 3), round(r.score, 3)) for r in got), key=str) == sorted(want, key=str)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # the model is the better one on unseen text


def test_weights_by_brute_force():
    """One bucket: no weights on a fine grid are more likely than those learned."""
    cells = np.array([(0, 12, 8, 30), (0, -9999, 8, 50), (0, -9999, -9999, 20)])
    p = np.column_stack([np.where(cells[:, 1:3] == -9999, 0, 2.0 ** (cells[:, 1:3] / 4)), np.ones(3)])
    likelihood = lambda a: float((cells[:, 3] * np.log(p @ a)).sum())
    best = max(likelihood(np.array([i, j, 100 - i - j]) / 100) for i in range(1, 99) for j in range(1, 100 - i))
    assert likelihood(lm_score.learn(cells, 2000)[0]) >= best - 1e-3


def test_long_words_of_like_form(spark):
    x, y = thue_morse(11)
    train, held = [i for i in range(100) if fold(i) not in (2, 3)][:3], next(i for i in range(100) if fold(i) == 2)
    rows = [*((i, x) for i in train), (held, y)]
    got = {r.doc_id: r for r in lm_score.score(documents(spark, rows)).collect()}
    assert got[held].n_known == 1  # the end alone
    assert got[train[0]].n_known == 2


def test_no_training_and_empty_tables(spark):
    held = next(i for i in range(100) if fold(i) == 2)
    r = lm_score.score(documents(spark, [(held, "a b")])).collect()
    assert [(x.n_tokens, x.n_known, x.train_tokens, x.base_score) for x in r] == [(3, 0, 0, 0.0)]
    assert lm_score.score(documents(spark, [])).count() == 0
