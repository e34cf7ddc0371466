import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from cratewise.llm import quality
from cratewise.llm.inputs import language_model, quality_model
from tests.llm.test_near import kept_of_groups
from tests.llm.test_packing import check_packing
from tests.llm.test_suffix import plain

FOLDER = "/root/testdata/sf0.001"


def read(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_each_stage_against_brute_force(spark):
    docs = read(spark)
    given = {r.doc_id: r for r in docs.collect()}
    good = pipeline.good_quality(spark, docs, FOLDER)
    model = quality_model(spark, FOLDER)
    want = {i for i, r in given.items() if model.scores([r.text])[0] >= quality.GOOD}
    assert {r.doc_id: r for r in good.collect()} == {i: given[i] for i in want} and good.columns == docs.columns and 0 < len(want) < len(given)

    clear = pipeline.clear_language(spark, docs, FOLDER)
    languages = language_model(spark, FOLDER)
    want = {i for i, r in given.items() if (p := languages.predict([r.text])[0])[0] != "und" and p[1] >= 0.5}
    assert {r.doc_id: r for r in clear.collect()} == {i: given[i] for i in want}

    single = pipeline.one_of_each_group(spark, docs, FOLDER)
    want, _ = kept_of_groups([(i, r.text) for i, r in given.items()])
    assert {r.doc_id: r for r in single.collect()} == {i: given[i] for i in want} and single.count() < len(given)

    cut = pipeline.without_repeats(spark, docs, FOLDER)
    assert cut.columns == docs.columns
    want = plain({i: r.text for i, r in given.items()})
    for r in cut.collect():
        assert (r.lang, r.source, r.n_chars) == (given[r.doc_id].lang, given[r.doc_id].source, len(r.text))
        n_bytes, n_removed, _, kept = want[r.doc_id]
        if hashlib.sha256(r.text.encode()).hexdigest() != kept:  # letters cut in two are gone
            assert n_bytes - n_removed - 6 < len(r.text.encode()) < n_bytes - n_removed


def test_run_packs_what_the_stages_keep(spark):
    rows = pipeline.run(spark, FOLDER).collect()
    docs = read(spark)
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    kept = {r.doc_id: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0] for r in docs.collect()}
    assert check_packing(rows, kept, 2048) and 0 < len(kept) < 200


def test_odd_rows(spark, docs_of, folder_of):
    rows = [(1, None), (2, ""), (3, "x"), (3, "w"), (None, "y"), (4, "the cat of the house and the dog " * 20), (5, "123 456")]
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    folder = folder_of(documents=docs_of(rows), labels=labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        ids = [r.doc_id for r in out.collect()]
        assert len(ids) == len(set(ids)) and 4 in ids and None not in ids
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert [r.doc_id for r in pipeline.run(spark, folder).collect() if r.doc_id == 4] == [4]
