import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.functions import embed, passages, stem, vocab
from stratum.functions import text as X
from stratum.functions.chunk import split_text
from stratum.operators import artifacts, lexical


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["_"])
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("word,want", [
    ("consistency", "consist"), ("knightly", "knight"), ("generously", "generous"), ("skies", "sky"), ("dying", "die"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"),
    ("national", "nation"), ("communism", "communism"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("this", "this"), ("luxuriated", "luxuri"), ("controlling", "control"),
    ("rational", "ration"), ("early", "earli"), ("news", "news"), ("proceed", "proceed"), ("youth", "youth"), ("boy", "boy"), ("say", "say"), ("happy", "happi"), ("archaeology", "archaeolog"),
])
def test_stems(word, want):
    assert stem.stem(word) == want


def test_builtin_vectors():
    v = embed.builtin_vector("the quick brown fox")
    assert abs(float((v * v).sum()) - 1) < 1e-5 and not embed.builtin_vector("?? !!").any()
    assert np.allclose(embed.decode_vector(embed.encode_vector(v)), v)


def test_builtin_vectors_by_the_byte():
    """Features hashed a byte at a time, as defined."""
    def feature(name):
        one, two, mask = embed.FNV_START, embed.SECOND_START, (1 << 64) - 1
        for b in name.encode():
            one = (one ^ b) * embed.FNV_PRIME & mask
            two ^= b * embed.SECOND_XOR & mask
            two = (two << 7 | two >> 57) & mask
            two = two * embed.SECOND_MULTIPLY & mask
        return one % 512, two % 512, 1 if (one ^ two) % 2 == 0 else -1

    texts = ["the quick brown fox jumps", "", "a b", "quick", "snake_case-words and more words " * 40, "é ü", "x" * 3000 + " yy"]
    for text, got in zip(texts, embed.builtin_vectors(texts), strict=True):
        words, want = stem.terms(text), np.zeros(512)
        for n, weight in ((1, 1.0), (2, 1.75), (3, 2.25)):
            for i in range(len(words) - n + 1):
                a, b, sign = feature("::".join(words[i : i + n]))
                want[a] += weight
                want[b] += 0.5 * weight * sign
        assert np.allclose(got, want / (np.sqrt((want * want).sum()) or 1), atol=1e-6)


def test_embedding_configuration():
    env = {"STRATUM_EMBEDDING_BACKEND": "openai", "OPENAI_API_KEY": "k", "STRATUM_EMBEDDING_MODEL": "m"}
    c = embed.EmbeddingConfig.resolve(env=env)
    assert (c.preference, c.model, c.api_key) == (embed.Preference.REMOTE, "m", "k")
    assert embed.EmbeddingConfig.resolve("local", "builtin", "x", env=env).model == "x"
    with pytest.raises(ValueError, match="API key"):
        embed.EmbeddingConfig.resolve("openai", env={}).validate()
    assert embed.preference("fastembed") is embed.Preference.LOCAL and embed.local_provider("strong_local") is embed.LocalProvider.BUILTIN
    assert isinstance(embed.provider(embed.EmbeddingConfig.resolve("local", "onnx", env={})), embed.Builtin)


def test_chunks_cover_and_overlap():
    text = "".join(f"line {i} of the text\n" + ("\n" if i % 9 == 0 else "") for i in range(300))
    chunks = split_text(text)
    assert all(50 <= len(c) <= 800 for c in chunks) and text.startswith(chunks[0])
    at = 0
    for c in chunks:
        found = text.find(c, max(0, at - 200))
        assert 0 <= found <= at + 2
        at = found + len(c)
    assert at >= len(text.strip())
    assert split_text("short") == [] and split_text(None) == [] and len(split_text("x" * 1600)) == 3


def test_dialect(spark):
    text = "Kai decided to use Rust because it is fast. The API server is a breakthrough! Kai loves Rust"
    got = one(spark, X.compressed(F.lit(text), F.lit("w"), None, None, F.lit("a/notes.v1.md")))
    head, body = got.split("\n")
    assert head == "w|?|?|notes.v1"
    assert body == '0:KAI+RUS+THE|kai_rust_api|"Kai decided to use Rust because it is fast"|determ+love|DECISION+PIVOT+TECHNICAL'
    assert one(spark, X.compressed(F.lit(""))) == "0:???|misc"


def test_memories(spark):
    df = spark.createDataFrame([(
        "I prefer tabs, and we always use them in code we own.\n\nWe decided to go with Kafka because of the architecture; a trade-off.\n\n"
        "the bug and the error were bad, then I fixed it: it works, finally solved\n\n```\nfixed fixed fixed\n```\nnothing here at all but prose",
    )], ["t"])
    got = [(m.memory_type, round(m.confidence, 2)) for m in df.select(artifacts.memories(F.col("t")).alias("m")).first().m]
    assert got == [("preference", 0.6), ("decision", 0.8), ("milestone", 0.8)]


def test_segments_and_exchanges():
    chat = "intro\n> one question here that is long enough\nanswer a\n\nanswer b\n---\nignored\n> two is long enough to be kept on its own\n> three\n"
    assert passages.exchanges(chat) == ["> one question here that is long enough\nanswer a answer b", "> two is long enough to be kept on its own"]
    lines = "\n".join(f"line number {i}" for i in range(60))
    assert [len(s.split("\n")) for s in passages.exchanges(lines)] == [25, 25, 10]
    assert passages.segments("Human: hi\nAI: yes\nmore\nUser: bye") == ["Human: hi", "AI: yes\nmore", "User: bye"]
    assert passages.segments("a\n\n b \n\n") == ["a", "b"] and passages.segments("") == []


def test_beginnings_of_patterns():
    """Every match begins with one of the texts found for its pattern."""
    for patterns in vocab.MARKERS.values():
        for p in patterns:
            first = passages.beginnings(p)
            assert all(first) and not any(re.search("[^a-z' -]", x) for x in first)
    assert passages.beginnings(r"\blet'?s (use|try)\b") == ["let"] and passages.beginnings(r"\b(bug|error)\b") == ["bug", "error"] and passages.beginnings(r"\bdon'?t x") == ["don"]
    everything = "let's use lets try we should trade-off tradeoff i like to figured it out figured out the fix was doesn't work doesnt work i'm sorry"
    for patterns in passages.MARKERS.values():
        for first, p in patterns:
            assert not p.search(everything) or any(x in everything for x in first)


def test_nulls_and_long_texts(spark):
    df = spark.createDataFrame([(None,), ("",), ("> a\r\n" * 30_000,), ("x" * 200_000,)], "t string")
    for f in (passages.exchanges_of, passages.memories_of, passages.topics_of, passages.key_sentence_of, passages.dialect_of):
        got = [r[0] for r in df.select(f("t")).collect()]
        assert got[0] is None and all(x is not None for x in got[1:])


def test_artifacts_of_a_decision(spark):
    text = "We always test. Kai decided to use Rust because snake-case-name wins on 2024-01-02"
    df = spark.createDataFrame([(text,)], ["t"])
    made = df.select(F.inline(artifacts.of_text(F.col("t"), F.lit("design"), X.infer_date(F.col("t")), F.lit("x.md")))).collect()
    kinds = [r.drawer_type for r in made]
    assert kinds == ["anchor_doc"] * 3 + ["preference_bridge", "decision_bridge", "compressed"]
    assert [r.content.split("\n")[0] for r in made[:3]] == ["ANCHOR Kai", "ANCHOR Rust", "ANCHOR snake-case-name"]
    assert [(r.importance, r.weight) for r in made] == [(5.0, 5.0)] * 3 + [(7.0, 7.0), (8.0, 8.0), (7.5, 7.0)]
    assert made[-1].content.startswith("?|design|2024-01-02|x\n0:WE+KAI+RUS") and {r.hall for r in made[:3]} == {"hall_facts"}


def test_facts(spark):
    got = one(spark, X.facts(F.lit("Kai prefers Rust. Kai prefers Rust. decided to use kafka. Bo works on Stratum")))
    assert {(f.subject, f.predicate, f.object, f.confidence) for f in got} == {
        ("Kai", "prefers", "Rust", 0.85), ("team", "decided_to_use", "kafka", 0.75), ("Bo", "works_on", "Stratum", 0.8),
    }


def test_snippets(spark):
    text = "zero one two three four five six seven eight nine ten " * 4
    got = one(spark, lexical.snippet(F.lit(text.strip()), F.lit("thr fou")))
    assert got.startswith(" … [three] [four] five") and got.endswith(" … ") and len(re.findall(r"\S+", got.replace("…", ""))) == 20
    assert one(spark, lexical.snippet(F.lit("Réseau ouvert"), F.lit("reseau"))) == "[Réseau] ouvert"


def test_snippets_are_those_of_tokens_one_by_one(spark):
    """The kernel, which reads up to the first match, against every token folded and compared."""
    texts = ["", " ", "  the", "other (the) x", "foo-the the", "İİ Ândré the", "a\nthe\r\nend ", "_the", "..., of,the", "no match " * 12, "x " * 30 + "OFten " + "and  so " * 20, "ὈΔΟΣ the", "\tand b", "--- the"]
    queries = ["the and of", "_the --", "", None, "and-so İ x"]

    def want(text, query):
        tokens, words = re.split(" +", text.replace("\n", " ")), [w.lower() for w in re.findall("[A-Za-z0-9_-]{2,}", query or "")]
        hit = lambda t: any(re.sub(r"^[\W_]+", "", t.lower().translate(lexical.ACCENTS)).startswith(w) for w in words)
        start = next((i for i, t in enumerate(tokens) if hit(t)), 0)
        return (" … " if start else "") + " ".join(f"[{t}]" if hit(t) else t for t in tokens[start : start + 20]) + (" … " if start + 20 < len(tokens) else "")

    df = spark.createDataFrame([(t, q) for t in texts for q in queries] + [(None, "the")], "t string, q string")
    for r in df.select("t", "q", lexical.snippet(F.col("t"), F.col("q")).alias("s")).collect():
        assert r.s == (None if r.t is None else want(r.t, r.q)), (r.t, r.q)


def test_a_snippet_reads_up_to_its_first_match(monkeypatch):
    seen = []
    monkeypatch.setattr(lexical, "_hit", lambda t, wanted, own=lexical._hit: (seen.append(t), own(t, wanted))[1])
    assert lexical.snippet_of("no " * 5000 + "the end " * 5000, "the").startswith(" … [the] end [the]")
    assert len(seen) == 20  # and not each of the 15,000 tokens


def test_phrases_and_prefixes(spark):
    rows = [("a", "the snake-cased names", True), ("b", "snakes and cases", True), ("c", "snake case, snake cased", True), ("d", "snake", False)]
    phrases = lexical.query_phrases(spark.createDataFrame([(1, "snake-case"), (2, "cas"), (3, "?")], "qid long, query string"))
    own = [r.parts for r in phrases.collect()]
    drawers = spark.createDataFrame(rows, "id string, content string, active boolean")
    found = {r.id: lexical.Phrases(own).counts(lexical.words_in(r.text)) for r in lexical._active(drawers).collect()}
    got = {(tuple(own[i]), id_): f for id_, counts in found.items() for i, f in counts.items()}
    assert got == {(("snake", "case"), "a"): 1, (("snake", "case"), "c"): 2, (("cas",), "a"): 1, (("cas",), "b"): 1, (("cas",), "c"): 2}
    n, mean, df = lexical.statistics(drawers, own)
    assert (n, round(mean, 6), {tuple(own[i]): x for i, x in df.items()}) == (3, round(11 / 3, 6), {("snake", "case"): 2, ("cas",): 3})


def test_a_word_is_held_against_phrases_that_begin_alike():
    """Only the lengths of phrases with its first letters are tried, whatever lengths others have."""
    own = lexical.Phrases([["a"], ["ab"], ["abc"], ["abcdef"], ["xyz" * 9], ["abd"]])
    assert [sorted(own._of(w)) for w in ("a", "ab", "abcde", "abcdefg", "b", "abd", "")] == [[0], [0, 1], [0, 1, 2], [0, 1, 2, 3], [], [0, 1, 5], []]
    assert own.starts["abc"] == {3, 6} and own.starts["xyz"] == {27}


def test_folded_words_are_those_of_the_expression(spark):
    texts = ["Réseau ÜBER straße naïve_x ñ-Ñ", "plain Words 12", "", "ŁÓDŹ œuvre 漢字かな ₂ ½"]
    df = spark.createDataFrame([(t,) for t in texts], ["t"]).select(F.lower("t").alias("low"), lexical.words(F.col("t")).alias("w"))
    for r in df.collect():
        assert lexical.words_in(r.low) == r.w


def test_scan_has_the_scores_of_the_expressions(spark):
    """The kernel's cosine and heuristic against the column expressions, over every pair."""
    from stratum.operators import semantic
    from stratum.plans import search

    texts = ["The Quick brown fox", "quick foxes, Brown bears", "", "  ", "nothing", "ÜBER den Wolken Über alles", "the quick brown fox the quick brown fox"]
    rows = spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(texts)], "id string, preview string").withColumn("embedding", embed.embed_column()("preview"))
    asked = spark.createDataFrame([(1, "Quick Brown fox"), (2, "über Wolken"), (3, "The The bears"), (4, "?")], "qid long, query string")
    asked = asked.withColumn("vector", embed.embed_column()("query")).withColumn("terms", embed.stemmed_terms("query"))
    got = {(r.qid, r.id): (round(r.semantic_score, 6), round(r.heuristic_score, 6)) for r in semantic.scan(rows, asked, 100).collect()}
    pairs = rows.select("id", "embedding").crossJoin(asked.select("qid", "vector")).select("qid", "id", X.cosine(F.col("embedding"), F.col("vector")).alias("s"))
    want = search._heuristic(pairs, rows.select("id", F.col("preview").alias("text")), asked).collect()
    assert got == {(r.qid, r.id): (round(r.s, 6), round(r.heuristic_score, 6)) for r in want} and len(got) == 28
    few = semantic.scan(rows.repartition(1), asked, 2).collect()
    best = semantic.top_k(semantic.scan(rows, asked, 100), semantic.semantic_order(), 2, "n").collect()
    assert {(r.qid, r.id) for r in few} == {(r.qid, r.id) for r in best}


def test_name_boosts_in_one_pass(spark):
    """Every pair against the expression; names within words, repeated, with accents and marks; no join and no shuffle."""
    from stratum.operators import semantic

    texts = ["anna met Bert", "ANNABERT\nüBER", "x\tÜberAll Anna\u2003bert", "", None, "a" * 300 + "anna", "(Anna)", "ber ann"]
    queries = ["Anna Bert Anna", "Über all", "nothing here", "", None, "(Anna) Xy Ber Annab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(queries)), "item_id long, query string")
    found = semantic.name_boosts(docs, asked)
    got = {(r.item_id, r.doc_id): round(r.boost, 9) for r in found.collect()}
    both = asked.crossJoin(docs).select("item_id", "doc_id", X.name_boost(F.col("query"), F.col("text")).alias("boost"))
    assert got == {(r.item_id, r.doc_id): round(r.boost, 9) for r in both.collect() if r.boost} and len(got) > 10
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_marker_counts_in_one_kernel(spark, monkeypatch):
    """As every pattern searched through the whole text; patterns without a beginning in the text are not searched at all."""
    texts = ["", "unfixed fixed FIXED", "we we always we never", "let's use it, lets use it, xlet's use it", "don't mock; dont ever use; don't like to do", "i feel sad, sadly i'm sorry; the fix is; broken bug_ bug"]
    rows = spark.createDataFrame([(t,) for t in texts], ["t"]).select("t", X.marker_scores(F.col("t")).alias("m")).collect()
    for r in rows:
        assert r.m.asDict() == {k: sum(len(re.findall(p, r.t.lower())) for p in ps) for k, ps in vocab.MARKERS.items()}
    monkeypatch.setattr(passages, "MARKERS", {"a": [(["x"], None)]})
    assert passages.marker_counts("no such letter") == {"a": 0}


def test_topics_by_the_pattern(monkeypatch):
    """As with a search for marks and inner capitals in every word, which is no longer made, nor are all words sorted."""
    texts = ["", "Foo fooBar foo-bar FOO foo foo_ Barn barn baR", "the The and-the of zeta Zeta alpha_one alphaOne beta", "x-1 ab abc Abc aBc abC ABC"]
    for text in texts:
        scores: dict[str, int] = {}
        for w in re.findall(vocab.TOPIC, text):
            if w.lower() not in vocab.STOP_WORDS:
                scores[w.lower()] = scores.get(w.lower(), 0) + 1 + 2 * w[0].isupper() + 2 * bool(re.search("[_-]|^.+[A-Z]", w))
        assert passages.topics(text) == sorted(scores, key=lambda w: (-scores[w], w))[:3]
    assert not hasattr(passages, "COMPOUND")


def test_vocabularies_are_complete():
    sizes = [len(x) for x in (vocab.SKIP_DIRS, vocab.TEXT_EXTENSIONS, vocab.SKIP_FILES, vocab.CHAT_SKIP_DIRS, vocab.CHAT_EXTENSIONS, vocab.EMOTIONS, vocab.FLAGS, vocab.CUES, vocab.GENERIC_NAMES)]
    assert sizes == [12, 20, 6, 11, 4, 20, 20, 16, 12] and [len(v) for v in vocab.MARKERS.values()] == [9, 8, 14, 8, 17]
