"""Language identification with more languages than one block holds."""

import numpy as np

from splatloom.llm import language_id

SF = "/root/testdata/sf0.001"


def test_blocks_of_languages_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language_id.identify(docs, language_id.train(docs)).collect())
    for languages, grams in ((1, 1 << 22), (3, 1 << 22), (64, 1)):
        monkeypatch.setattr(language_id, "BLOCK_LANGUAGES", languages)
        monkeypatch.setattr(language_id, "BLOCK_GRAMS", grams)
        model = language_id.train(docs)
        assert model.blocks > 1
        assert sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language_id.identify(docs, model).collect()) == whole


def test_two_thousand_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "BLOCK_LANGUAGES", 500)
    r = np.random.default_rng(4)
    words = ["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(4000)]
    rows = [(i, f"l{i:04d}", f"{words[2 * i]} {words[2 * i + 1]} {words[2 * i]}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language_id.train(docs)
    assert model.blocks == 4
    got = {x["doc_id"]: x for x in language_id.identify(docs.where("doc_id % 5 = 0"), model).collect()}
    assert len(got) == 400 and np.mean([x["lang_pred"] == f"l{i:04d}" for i, x in got.items()]) > 0.99
    assert all(0 <= x["score"] <= 1 for x in got.values())
