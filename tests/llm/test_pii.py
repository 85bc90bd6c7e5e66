import hashlib
import random
import re
import time

from stratum.llm import pii
from tests.llm.data import AWKWARD, documents, prose


def brute(text):
    text = text or ""
    out = []
    for kind, pattern in enumerate([
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    ]):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            s = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1]))
            if [True, kind == 1 and max(map(int, m.group().split("."))) <= 255, 16 <= len(digits) <= 19 and s % 10 == 0, 8 <= len(digits) <= 15][kind]:
                out.append((kind, *m.span()))
    return out


def noise(rng):
    return "".join(rng.choice("a9.@+- (é%_1234567890") for _ in range(rng.randrange(60)))


def test_fixed_patterns_against_brute_force():
    rng = random.Random(12)
    texts = [noise(rng) for _ in range(3000)] + ["a@b.c_d@e.f.g@h.i", "1.2.3.4.5.6.7.8", "0001.2.3.255 0.0.0.256", "4111 1111-1111 1111", "+1 (415) 555-2671)", "@a.b", "a@@b.c", "x@y", ""]
    for text in texts:
        assert pii.base_spans(text) == brute(text), text


def test_long_words_cost_their_length():
    began = time.process_time()
    for text in ("x" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" + "(" * 200_000, "@" * 200_000):
        pii.base_spans(text)
    assert time.process_time() - began < 20


CASES = [*AWKWARD, *((100 + i, f"{'w%d' % i} please mail to u{i}@example.com now and call +1 (415) 555-2{i:03d} today") for i in range(30)),
         (200, "é please mail to someone-at-home@nowhere now ok"), (201, "see build 20240101 here"), (201, "see build 20240101 here")]


def spans(spark, rows):
    got = pii.find_spans(documents(spark, rows, extra=True))
    return got.select("doc_id", pii.written("base").alias("base"), pii.written("learned").alias("learned")).collect()


def test_contexts_discover_unseen_identifiers(spark):
    texts = dict(CASES)
    found = spans(spark, CASES)
    assert len(found) == len(CASES)
    for r in found:
        want = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in brute(texts[r.doc_id]))
        assert r.base == want and hashlib.sha256(r.base.encode()).digest() == hashlib.sha256(want.encode()).digest()
    learned = {r.doc_id: r.learned for r in found if r.learned}
    at = texts[200].index("someone")
    assert learned == {200: f"email:{at}:{at + len('someone-at-home@nowhere')}"}


def test_finds_in_long_texts_cost_their_length():
    one = "w mail to u1@example.com now, or call +1 415 555 2000 and 0171 555 123 with number 20240101 today "
    for n in (1000, 20_000):
        text = one * n
        began = time.process_time()
        found = pii.finds(text, pii.base_spans(text))
        assert time.process_time() - began < 0.001 * n
        assert len(found) >= 8 * n
    word = "é" * 300
    assert {p for *_, p, _ in pii.finds(f"{word}a {word}b a@b.c {' ' * 500}{word}c", [(0, 604, 609)])} == {f"< {word}a {word}b", f"<> {word}b {word}c"}


def test_runs_of_tokens_are_candidates():
    for text, want in {
        "and call (415) 555-2671 today": ["(415) 555-2671"], "call 0171 555 123, or 0171 - 555 124.": ["0171 555 123", "0171 - 555 124"],
        "(call 0171 555 123)": ["0171 555 123"], "(4111 1111) x 12": ["4111 1111"], "a1 22 33\n44 55": ["44 55", "22 33"], "in 1999. 2004 was 1 2": [], "12 \"34 56\"": ["34 56"], "": [],
    }.items():
        assert sorted(text[a:b] for a, b in pii.runs(text, [])) == sorted(want), text
    assert pii.runs("call +1 (415) 555-2000 44 55", [(5, 22)]) == [(23, 28)]
    began = time.process_time()
    for text in ("1 " * 100_000, "- " * 100_000, "1 - " * 50_000, "(" * 200_000, "1" + "." * 200_000 + "x", "1 " + "- " * 100_000 + "x"):
        pii.runs(text, [])
    assert time.process_time() - began < 20


def test_identifiers_of_several_tokens_are_found_whole(spark):
    more = [(300, "w please mail me and call (415) 555-2671 today"), (301, "w and call 0171 555 123 today")]
    texts = dict(more)
    rows = {r.doc_id: r for r in pii.redact(documents(spark, CASES + more)).collect()}
    assert rows[300].text == "w please mail me and call [PHONE] today" and rows[301].text == "w and call [PHONE] today"
    at = texts[301].index("0171")
    assert {r.doc_id: r.learned for r in spans(spark, CASES + more)}[301] == f"phone:{at}:{at + len('0171 555 123')}"


def test_learning_goes_on_until_nothing_is_new(spark):
    """Each group is accepted a round after the one before it."""
    edges = [("p0", f"s0.{i}", 0) for i in range(30)]
    for j in range(1, 7):
        edges += [(p, f"x{j}.{i}", None) for i in range(4) for p in (f"p{j - 1}", f"p{j}")] + [(f"p{j}", f"s{j}.{i}", 0) for i in range(7)]
    got = {r.instance for r in pii.learn(spark.createDataFrame(edges, "pattern string, instance string, kind int")).collect()}
    assert got == {i for _, i, _ in edges}


def test_learning_against_brute_force(spark):
    rng = random.Random(13)
    edges = list({(f"p{rng.randrange(12)}", f"i{i}", (None, None, 0, 3)[i % 4]) for _ in range(300) for i in [rng.randrange(80)] if i % 4 < 2 or rng.random() < 0.9})
    known = {}
    for _, i, k in edges:
        if k is not None:
            known[i] = min(k, known.get(i, 9))
    while True:
        patterns = {}
        for p in {p for p, *_ in edges}:
            own = {i for q, i, _ in edges if q == p}
            hits, minus = max((sum(known.get(i) == k for i in own), -k) for k in range(4))
            if len(own) >= pii.MIN_SUPPORT and hits:
                patterns[p] = (-minus, hits / (len(own) + 1))
        new = {}
        for i in {i for _, i, k in edges if k is None} - set(known):
            doubt = {}
            for p in {p for p, j, _ in edges if j == i} & set(patterns):
                k, c = patterns[p]
                doubt[k] = doubt.get(k, 1) * (1 - c)
            if doubt and min(doubt.values()) <= 0.2:
                new[i] = min((d, k) for k, d in doubt.items())[1]
        known |= new
        if not new:
            break
    got = pii.learn(spark.createDataFrame(edges, "pattern string, instance string, kind int"))
    assert {r.instance: r.kind for r in got.collect()} == known


def test_redaction(spark):
    rows = {r.doc_id: r for r in pii.redact(documents(spark, CASES)).collect()}
    assert rows[105].text == "w5 please mail to [EMAIL] now and call [PHONE] today" and rows[200].text == "é please mail to [EMAIL] now ok"
    assert rows[1].text is None and rows[201].text == "see build 20240101 here" and rows[105].lang == "en"
    assert pii.redact(documents(spark, CASES)).count() == len(CASES)
    assert pii.redact(documents(spark, [])).count() == 0
