import random
import re

from pyspark.sql import functions as F

from stratum.llm import decontam
from tests.llm.data import AWKWARD, documents, prose

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return re.findall(WORD, (text or "").translate(LOWER))


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = tokens(text)
        if item is not None:
            for i in range(max(1, len(w) - 12) if w else 0):
                windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    out = []
    for doc, text in rows:
        w, hit, own = tokens(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    own |= windows[key]
        out.append((doc, len(w), len(hit), ",".join(sorted(own))))
    return sorted(out, key=str)


def case():
    rng = random.Random(5)
    items = [(i, " ".join(prose(rng, rng.choice([3, 13, 20, 40]), 40))) for i in range(30)]
    items += [(3, items[3][1]), (50, None), (51, "..."), (None, "w1 w2"), (52, "one")]
    rows = list(AWKWARD)
    for i in range(100, 160):
        text = prose(rng, 60, 40)
        if i % 2:
            own = items[rng.randrange(30)][1].split()
            text[10:10] = own[: rng.randrange(1, len(own) + 1)]
        rows.append((i, "  ".join(w.upper() if rng.random() < 0.2 else w for w in text) + "!"))
    return rows, items


def test_against_brute_force(spark):
    rows, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n_words", F.lit(1))
    docs = documents(spark, rows, extra=True)
    for block in (decontam.BLOCK_BYTES, 800):
        found = decontam.find_leaks(docs, bench, block_bytes=block).withColumn("n_hit", decontam.n_hit()).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in found), key=str) == brute(rows, items)
    texts = dict(rows)
    for r in found:
        for (a, b), s in zip(r.hit_words, r.spans, strict=True):
            assert tokens(texts[r.doc_id][s.start : s.end]) == tokens(texts[r.doc_id])[a:b]


def test_removal_and_empty_tables(spark):
    rows, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    bad = {d for d, _, h, _ in brute(rows, items) if h}
    for block in (decontam.BLOCK_BYTES, 800):
        kept = decontam.remove_leaks(documents(spark, rows, extra=True), bench, block_bytes=block)
        assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(d) for d, _ in rows if d not in bad)
        assert not any(h for *_, h, _ in brute([(r.doc_id, r.text) for r in kept.collect()], items))  # no window is left
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.remove_leaks(documents(spark, rows), none).count() == len(rows)
    assert decontam.find_leaks(documents(spark, []), bench).count() == 0


def test_windows_at_every_place_and_periodic_texts(spark):
    """Windows cut out of an item at each place, of items that repeat themselves or share words with short ones."""
    rng = random.Random(9)
    items = [(1, " ".join(prose(rng, 60, 9))), (2, "a " * 200), (3, "a b " * 40), (4, "a a a a a"), (5, " ".join(prose(rng, 13, 9))), (6, "w1 w2 w3 w4 w5"), (7, "w1 w2 w3 w4 w5 " * 4)]
    own = items[0][1].split()
    rows = [(i, " ".join(["x", *own[i : i + 13], "y"])) for i in range(48)] + [(100 + i, " ".join(own[i : i + 12])) for i in range(48)]
    rows += [(200, "a " * 5000), (201, "b a " * 30), (202, "a " * 12), (203, "w1 w2 w3 w4 w5 " * 9), (204, "w2 w3 w4 w5 w1 " * 3)]
    found = decontam.find_leaks(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    found = found.withColumn("n_hit", decontam.n_hit()).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in found), key=str) == brute(rows, items)


def test_a_large_benchmark_stays_small_in_memory():
    """4 MB of text: a 32 MB benchmark, in its two blocks, then takes under a GB of a worker."""
    import subprocess
    import sys

    code = """
import random, resource
from stratum.llm import decontam
rng = random.Random(1)
vocabulary = [f"{rng.randrange(1 << 40):x}"[:rng.randrange(2, 9)] for _ in range(50_000)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
items = [(str(i), " ".join(rng.choices(vocabulary, k=1000))) for i in range(650)]
size = sum(len(t) for _, t in items)
found = decontam.Benchmark(items, 13)
words = decontam.normalised(items[7][1])
assert found.find([*words[100:200], b"x", *words[500:512]])[1] == {"7"}
print(size, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300).stdout.split()
    size, grown = map(int, out[-2:])
    assert size > 3_500_000
    assert grown * decontam.BLOCK_BYTES / size < 1_000_000_000
