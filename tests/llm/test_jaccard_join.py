import random

import pytest

from stratum.llm import jaccard_join
from stratum.llm.components import components
from tests.llm.data import AWKWARD, documents, prose, words
from tests.llm.test_substring_dedup import thue_morse


def shingles(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def least_reachable(nodes, links):
    label = {x: x for x in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


def brute(rows):
    have = [(d, shingles(t)) for d, t in rows]
    links = [(d, e) for i, (d, x) in enumerate(have) for e, y in have[:i] if d is not None and e is not None and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    label = least_reachable({d for d, _ in rows}, links)
    return sorted(((d, len(x), label[d]) for d, x in have), key=str)


def corpus(seed):
    rng = random.Random(seed)
    rows = [*AWKWARD, (9, "A b C d"), (10, "a b c d"), (11, "a b c d e"), (12, "A b c d e f")]
    passage = prose(rng, 30)
    ids = iter(rng.sample(range(100, 2000), 900))
    for _ in range(25):  # groups of near copies, some near the threshold
        base = prose(rng, rng.randrange(8, 200))
        for _ in range(rng.randrange(1, 8)):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 25))):
                w[rng.randrange(len(w))] = f"new{rng.random()}"
            rows.append((next(ids), " ".join(w)))
    drift = prose(rng, 120)
    for _ in range(40):  # a chain whose ends are not alike
        drift[rng.randrange(120)] = f"drift{rng.random()}"
        rows.append((next(ids), " ".join(drift)))
    for i in range(40):  # a passage that many share
        rows.append((next(ids), " ".join(passage + prose(rng, rng.choice([3, 8, 60])))))
    rows += [(next(ids), rows[20][1].upper()) for _ in range(30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,heavy", [(1, 250_000), (2, 10), (3, 0), (4, 3000)])
def test_against_brute_force(spark, seed, heavy):
    rows = corpus(seed)
    got = jaccard_join.similar_documents(documents(spark, rows, extra=True), heavy=heavy).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def salted_corpus(seed):
    """Pairs that share nothing but shingles which many others have, too."""
    rng = random.Random(seed)
    common, ids, rows = prose(rng, 24), iter(rng.sample(range(10, 5000), 400)), []
    for _ in range(40):
        a = rng.randrange(0, 10)
        rows += [(next(ids), " ".join(common[a : a + n])) for n in (13, 14)]
    for _ in range(60):
        rows.append((next(ids), " ".join(common[: rng.randrange(5, 24)] + prose(rng, rng.choice([1, 4, 40])))))
    return rows


@pytest.mark.parametrize("seed,per_task", [(3, 1), (4, 7)])
def test_a_row_alone_in_any_salt_stays(spark, monkeypatch, seed, per_task):
    monkeypatch.setattr(jaccard_join, "ROWS_PER_TASK", per_task)
    rows = salted_corpus(seed)
    got = jaccard_join.similar_documents(documents(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_rows_of_salted_shingles_all_pass(monkeypatch):
    """Two documents alone in two salts of each shingle: no row of theirs may be dropped."""
    import types

    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(jaccard_join, "ROWS_PER_TASK", 1)
    texts = ["a b c d e f g h", "a b c d e f g h i"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    heavy = np.unique(np.concatenate(jaccard_join.sets(data, np.cumsum([0, *map(len, texts)]), 5)))
    sent = types.SimpleNamespace(value=heavy), types.SimpleNamespace(value=np.full(len(heavy), 2))
    batch = pa.RecordBatch.from_arrays([pa.array([2, 3]), pa.array(texts)], ["doc_id", "text"])
    rows = pa.Table.from_batches(jaccard_join._prefixes(5, 75, *sent)(iter([batch]))).sort_by([(c, "ascending") for c in ("token", "salt", "n", "doc_id")])
    assert len({(t, s) for t, s in zip(*rows.select(["token", "salt"]).to_pydict().values(), strict=True)}) == rows.num_rows  # each is alone
    kept = pa.Table.from_batches(jaccard_join._shared_rows(iter(rows.combine_chunks().to_batches())))
    assert kept.num_rows == rows.num_rows


def test_one_of_each_group_stays(spark):
    rows = corpus(5)
    kept = [r.doc_id for r in jaccard_join.one_of_each(documents(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted({d for d, _, c in brute(rows) if c == d}, key=str)


def test_empty_table(spark):
    assert jaccard_join.similar_documents(documents(spark, [])).count() == 0


def test_the_bitmaps_bound_what_sets_share():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(10)
    base = prose(rng, 400)
    texts = [" ".join(base[rng.randrange(200) : rng.randrange(200, 400)]) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts)], ["doc_id", "text"])
    rows = next(iter(jaccard_join._bitmaps(5)(iter([batch])))).to_pylist()
    data = "".join(texts).encode()
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    own = jaccard_join.sets(np.frombuffer(data, np.uint8), at, 5)
    for x, a in zip(rows, own, strict=True):
        for y, b in zip(rows, own, strict=True):
            assert jaccard_join.most_shared(x["bits"], y["bits"], x["n"], y["n"]) >= len(np.intersect1d(a, b))
        assert jaccard_join.most_shared(x["bits"], x["bits"], x["n"], x["n"]) == len(a)


def test_components_in_several_tasks(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(0, 300) if i % 50] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(7, 7)]
    nodes = {x for e in links for x in e if e[0] != e[1]}
    want = least_reachable(nodes, [e for e in links if e[0] != e[1]])
    for size in (50, 1_000_000):
        got = components(spark.createDataFrame(links, "a long, b long"), task_links=size)
        assert {r.node: r.component for r in got.collect()} == want and got.count() == len(want)


def test_long_words_of_like_form(spark):
    x, y = thue_morse(11)
    rows = [(1, f"a b {x} c d e"), (2, f"a b {y} c d e"), (3, f"a b {y} c d e")]
    assert sorted(tuple(r) for r in jaccard_join.similar_documents(documents(spark, rows)).collect()) == brute(rows) == [(1, 2, 1), (2, 2, 2), (3, 2, 2)]


@pytest.mark.parametrize("flush", [1, 700, 200_000])
def test_counts_in_lots_hold_little_more_than_a_lot(flush):
    import tracemalloc
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    rng = random.Random(12)
    n = 400 if flush < 1000 else 30_000
    texts = [*(f"w{rng.randrange(40)} w{rng.randrange(40)} c d e f" for _ in range(n)), "", None, "a b", " ".join(f"x{i}" for i in range(3000))]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 300])], ["text"]) for i in range(0, len(texts), 300)]
    if flush > 1000:  # different shingles nearly all, as most are
        words = (pa.array([" ".join(f"y{i}_{j}" for j in range(504))]) for i in range(800))
        batches += [pa.RecordBatch.from_arrays([w], ["text"]) for w in words]
    run = jaccard_join._local_counts(5, flush)
    list(run(iter(batches[:1])))  # what is kept for later calls is in place
    tracemalloc.start()
    lots = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in run(iter(batches))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want, found, open_ = Counter(), Counter(), Counter()
    for at, batch in enumerate(batches):  # each batch is one slice
        data = [(t or "").encode() for t in batch.column(0).to_pylist()]
        for x in jaccard_join.sets(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), 5):
            open_.update(x.view(np.int64).tolist())
        if open_.total() >= flush or at == len(batches) - 1:
            want.update({t: c for t, c in open_.items() if c > 1})
            open_.clear()
    for tokens, counts in lots:
        assert (np.diff(tokens.view(np.uint64)) > 0).all() and (counts > 1).all()
        found.update(dict(zip(tokens.tolist(), counts.tolist(), strict=True)))
    assert found == want and found
    assert flush < 1000 or peak < 3 * 8 * flush
