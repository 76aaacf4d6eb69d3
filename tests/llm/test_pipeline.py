"""The pipeline's stages one by one on a small table, against what each operator's plain counterpart says."""

import random

import corpus_pipeline
from tastemill.llm import packing, quality, repeats, secrets, shingle_join

ROOT = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "suffix_array_dedup", "secret_scan", "best_fit_packing"]
    stage = dict(corpus_pipeline.STAGES)

    good = stage["quality_rules"](spark, docs, ROOT).cache()
    assert good.columns == columns and {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.assess(docs).where("kept").collect()}
    single = stage["ngram_jaccard_join"](spark, good, ROOT).cache()
    wanted = shingle_join.classify(good).where("n_shingles = 0 OR doc_id = component_id")
    assert single.columns == columns and {r.doc_id for r in single.collect()} == {r.doc_id for r in wanted.collect()}
    cut = stage["suffix_array_dedup"](spark, single, ROOT).cache()
    removed = {r.doc_id: r.n_removed for r in repeats.report(single, corpus_pipeline.PASSAGE).collect()}
    before = {r.doc_id: r.text for r in single.collect()}
    assert cut.columns == columns and cut.count() == single.count()
    assert all((r.text == before[r.doc_id]) == (removed[r.doc_id] == 0) and r.n_chars == len(r.text) for r in cut.collect())
    clean = stage["secret_scan"](spark, cut, ROOT).cache()
    assert clean.columns == columns and clean.count() == cut.count()
    assert secrets.report(clean).where("spans <> ''").count() == 0
    packed = stage["best_fit_packing"](spark, clean, ROOT)
    assert packed.selectExpr("sum(n_tokens)").first()[0] == packing.pack(clean).selectExpr("sum(n_tokens)").first()[0] == quality.features(clean).selectExpr("sum(n_words)").first()[0]


def test_run_is_the_stages_in_order(spark):
    got = corpus_pipeline.run(spark, ROOT)
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, ROOT)
    same = ["doc_id", "piece", "piece_start", "n_tokens"]
    assert sorted(map(tuple, got.select(*same).collect())) == sorted(map(tuple, docs.select(*same).collect()))


def test_passages_of_over_fifty_words_go(spark):
    """A passage that two documents share, and one that stands twice in the same; a shared sentence stays."""
    rng = random.Random(6)
    word = lambda least, most: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(least, most)))
    text = lambda n, least=2, most=9: " ".join(word(least, most) for _ in range(n))
    short, long, sentence = text(51, 3, 8), text(51, 4, 12), text(20)
    rows = [(1, f"{text(40)} {short} {text(40)}"), (2, f"{text(10)} {short} {text(70)}"), (3, f"{long} {text(30)} {long}"), (4, f"{text(60)} {sentence} {text(30)}"), (5, f"{sentence} {text(60)}"), (6, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, extra string")
    kept = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["suffix_array_dedup"](spark, docs, ROOT).collect()}
    assert len(short) > corpus_pipeline.PASSAGE
    assert all(short[20:-20] not in kept[i] for i in (1, 2)) and long[20:-20] not in kept[3]
    assert kept[4] == rows[3][1] and kept[5] == rows[4][1] and set(kept) == set(range(1, 8))


def test_stages_on_an_empty_table_and_odd_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, bin_id string, H int, kept int"
    text = " ".join(f"word{i}" for i in range(60))
    odd = [(1, text, "en", "a", 3, "b", 1, 1), (1, text, "en", "a", 3, "b", 1, 1), (None, text, None, None, None, None, None, None), (3, None, "en", "a", 0, "", 0, 0), (4, "", "en", "a", 0, "", 0, 0)]
    for rows, left in ((odd, 1), ([], 0)):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, ROOT)
            assert docs.schema.names == schema_names(schema), name
        assert docs.count() == left and corpus_pipeline.STAGES[-1][1](spark, docs, ROOT).count() == left


def schema_names(schema):
    return [field.strip().split()[0] for field in schema.split(",")]
