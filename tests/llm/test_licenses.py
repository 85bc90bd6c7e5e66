import random
import re

from stratum.llm import licenses
from stratum.llm.license_texts import TEMPLATES
from tests.llm.data import AWKWARD, documents, prose

LOWER = {c: c + 32 for c in range(65, 91)}


def pairs(text):
    w = re.findall("[a-z0-9]+", text.translate(LOWER))
    return set(zip(w, w[1:], strict=False))


def brute(text):
    text = text or ""
    out = []
    for unit in {*text.split("\n"), *re.split(r"\n[\x20\x09\x0B-\x0D]*\n", text), text}:
        own = pairs(unit)
        for n, (name, template) in enumerate(TEMPLATES):
            b = pairs(template)
            if own and (dice := 2 * len(own & b) / (len(own) + len(b))) >= 0.8:
                out.append((-dice, n, name, None, unit))
    whole = re.findall("[a-z0-9]+", text.translate(LOWER))
    for n, (name, template) in enumerate(TEMPLATES):
        size, windows = len(re.findall("[a-z0-9]+", template.translate(LOWER))), []
        if len(whole) >= size and not any(m[1] == n for m in out):
            for i in {*range(0, len(whole) - size + 1, max(1, size // 8)), len(whole) - size}:
                unit = " ".join(whole[i : i + size])
                own, b = pairs(unit), pairs(template)
                if (dice := 2 * len(own & b) / (len(own) + len(b))) >= 0.8:
                    windows.append((-dice, n, name, i, unit))
        out += sorted(windows)[:1]
    return sorted(out, key=lambda m: (m[:3], m[3] is not None, m[3:]))


def corpus():
    rng = random.Random(11)
    rows = list(AWKWARD)
    for i in range(100, 220):
        lines = [" ".join(prose(rng, rng.randrange(1, 40))) for _ in range(4)]
        words = rng.choice(TEMPLATES)[1].split()
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = rng.choice(["the", "other", "and, or", words[0].upper()])
        own = " ".join(words) if i % 3 else "\n".join(" ".join(words[a : a + 9]) for a in range(0, len(words), 9))
        rows.append((i, rng.choice(["\n", "\n \n"]).join([*lines[:2], own, *lines[2:]])))
    return rows


def test_against_brute_force(spark):
    got = licenses.scan(documents(spark, corpus(), extra=True)).collect()
    found = sorted(((r.doc_id, [(-m.dice, m.template, m.license, m.word, m.unit) for m in r.matches]) for r in got), key=str)
    assert found == sorted(((d, brute(t)) for d, t in corpus()), key=str)
    assert sum(bool(m) for _, m in found) > 50


def test_licences_in_their_usual_layout(spark):
    """Whole licences over lines and paragraphs amid other text, wrapped at any place, are found as windows."""
    rng = random.Random(21)
    rows, want = [], {}
    for n, (name, template) in enumerate(TEMPLATES):
        words = template.split()
        if len(words) >= 40:
            lines = [" ".join(words[a : a + 11]) for a in range(0, len(words), 11)]
            lines[len(lines) // 2 : len(lines) // 2] = [""]
            rows.append((n, "\n".join([" ".join(prose(rng, 200)), "", *lines, "", " ".join(prose(rng, rng.randrange(100)))])))
            want[n] = name
    got = {r.doc_id: r.matches[0] for r in licenses.scan(documents(spark, rows)).collect()}
    assert len(want) >= 6 and {d: m.license for d, m in got.items()} == want and all(m.word > 100 for m in got.values())


def test_empty_table(spark):
    assert licenses.scan(documents(spark, [])).count() == 0


def test_telling_words_are_needed():
    """Without its telling words a template keeps too few pairs to match itself."""
    for _, text in TEMPLATES:
        own = licenses.template_pairs(text)
        told = licenses.telling_words(own, 0.8)
        left = {p for p in own if not told & set(p.split())}
        assert 2 * len(left) < 0.8 * (len(left) + len(own))
