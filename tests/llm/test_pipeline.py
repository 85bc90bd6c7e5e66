import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from stratum.llm import langid
from stratum.llm.shared import materialize, new_path
from tests.llm import test_decontam, test_jaccard_join, test_pii
from tests.llm.data import AWKWARD, documents


def test_stages_against_brute_force(spark):
    rows, items = test_decontam.case()
    near = test_jaccard_join.corpus(7)[:150]
    rows = [*AWKWARD, *((d, t) for d, t in rows if d and d >= 100), *((d + 5000, t) for d, t in near if d and d >= 100)]
    rows += [(9000 + d, t) for d, t in test_pii.CASES[len(AWKWARD) :]]
    folder = new_path(spark, "sf")
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, folder), name)
        kept[name] = docs
        if name != "packing":
            assert docs.columns == before.columns
    accepted = {(r.id, r.t) for r in langid.of_documents(documents(spark, rows)).where("accepted").collect()}
    assert {(r[0], r[1]) for r in kept["language_id"].selectExpr("doc_id", "xxhash64(text)").collect()} == accepted
    texts = lambda name: [(r.doc_id, r.text) for r in kept[name].collect()]
    first = {d for d, _, c in test_jaccard_join.brute(texts("language_id")) if d == c}
    assert sorted(texts("jaccard_join"), key=str) == sorted({x for x in texts("language_id") if x[0] in first}, key=str)
    bad = {d for d, _, h, _ in test_decontam.brute(texts("jaccard_join"), items) if h}
    assert bad and sorted(texts("decontamination"), key=str) == sorted((x for x in texts("jaccard_join") if x[0] not in bad), key=str)
    clean = dict(texts("pii"))
    assert sorted(map(str, clean)) == sorted({str(d) for d, _ in texts("decontamination")})
    for d, text in texts("decontamination"):
        spans = sorted((a, b, k) for k, a, b in test_pii.brute(text))
        if not spans:
            assert clean[d] == text or "[" in clean[d]
        for a, b, _ in spans:
            assert text[a:b] not in clean[d]
    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    got = {}
    for r in kept["packing"].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == {d: len(tok.encode(t, add_special_tokens=False).ids) + 1 for d, t in clean.items()}
    assert corpus_pipeline.run(spark, folder).count() == kept["packing"].count()


def test_empty_tables_and_clashing_columns(spark):
    folder = new_path(spark, "sf")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for rows in ([], AWKWARD):
        docs = documents(spark, rows, extra=True)
        for _, stage in corpus_pipeline.STAGES:
            before, docs = docs, materialize(stage(spark, docs, folder), "stage")
            assert docs.columns == before.columns or "sequence_id" in docs.columns
