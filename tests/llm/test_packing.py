import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from stratum.llm import packing
from tests.llm.data import AWKWARD, documents, prose


def check(rows, texts):
    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert set(by_doc) == set(texts)
    for doc, copies in texts.items():
        ids = np.array([*tok.encode(copies[0] or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(by_doc[doc], key=lambda r: r.start)
        assert sum(r.length for r in own) == len(ids) * len(copies)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids)
    return sum(r.length for r in rows) / (2048 * len(by_sequence))


def test_pieces_and_sequences(spark):
    import random

    rng = random.Random(1)
    rows = [*AWKWARD, (8, "a <|endoftext|> b"), *((i, " ".join(prose(rng, int(rng.lognormvariate(5, 1))))) for i in range(100, 400))]
    texts = defaultdict(list)
    for doc, text in rows:
        texts[doc].append(text)
    assert check(packing.pack(documents(spark, rows, extra=True)).collect(), texts) > 0.95


def test_ids_are_those_of_the_other_library_for_every_document(spark):
    """Both libraries over all texts of a table, and texts made to be hard."""
    import random

    rng = random.Random(2)
    encode = packing.encoder(*packing.public_paths())
    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    texts = [r[0] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(1, 0x250), rng.randrange(0x3000, 0x3100), 0x1F600, 10, 32])) for _ in range(rng.randrange(80))) for _ in range(500)]
    for text, want in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(text).tolist() == want.ids


def test_copies_are_ranked_as_one(spark):
    rows = [(1, "a b c d")] * 5000 + [(None, None)] * 3000 + [(2, "x " * 3000)] * 10
    texts = {1: ["a b c d"] * 5000, None: [None] * 3000, 2: ["x " * 3000] * 10}
    assert check(packing.pack(documents(spark, rows)).collect(), texts) > 0.9


def test_empty_table(spark):
    assert packing.pack(documents(spark, [])).count() == 0


def test_plan_places_every_length_once():
    rng = np.random.default_rng(3)
    counts = {int(k): int(n) for k, n in zip(*np.unique(rng.integers(1, 65, 5000), return_counts=True), strict=True)}
    plan = packing.solve(counts, 64)
    placed = defaultdict(int)
    for times, own in plan:
        assert sum(k * n for k, n in own.items()) <= 64
        for k, n in own.items():
            placed[k] += times * n
    assert placed == counts
    least = -(-sum(k * n for k, n in counts.items()) // 64)
    assert sum(t for t, _ in plan) <= least * 1.01 + 2


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(20):
        value = rng.random(6)
        best = packing.best_pattern(value, 9)[0]

        def brute(room):
            return max([0.0, *(value[k - 1] + brute(room - k) for k in range(1, min(room, 6) + 1))])

        assert abs(best - brute(9)) < 1e-9
