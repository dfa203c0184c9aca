"""The language stage of the pipeline turns junk away, and only junk."""

import random

import corpus_pipeline

STOCK = {"en": "the and of that with this have from they which would there their".split(), "fr": "le la les des est dans pour que qui avec sur une plus".split(), "de": "der die und das nicht mit ist auch auf eine sich wird".split()}


def test_junk_goes_and_clean_documents_stay(spark):
    rng = random.Random(7)
    langs = [rng.choice(list(STOCK)) for _ in range(200)]
    clean = [" ".join(rng.choice(STOCK[g]) for _ in range(rng.randrange(40, 120))) for g in langs]
    junk = ["".join(rng.choice("bcdfghjklmnpqrstvwxz ") for _ in range(400)) for _ in range(10)]
    rows = [(i, t, g) for i, (t, g) in enumerate(zip(clean + junk + ["123 !?"], langs + ["en"] * 5 + [None] * 6, strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.keep_known_languages(spark, docs, "").collect()} == set(range(200))


def test_without_labels_nothing_but_letterless_texts_goes(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 34", None), (3, None, None), (4, "été", None)], "doc_id long, text string, lang string")
    kept = corpus_pipeline.keep_known_languages(spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == {1, 4} and kept.columns == docs.columns
