import random

import numpy as np
from pyspark.sql import functions as F

from pairjudge.llm import language as L


def test_held_out_accuracy(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(L.training_rows(documents), per_language=150)
    found = {r.doc_id: r for r in L.predict(documents, model).collect()}
    truth = {r.doc_id: r.lang for r in documents.collect()}
    held = [d for d, r in found.items() if r.held_out]
    assert len(held) > 150 and np.mean([found[d].lang_pred == truth[d] for d in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in found.values())
    assert (model.weights == 0).mean() > 0.2  # L1 leaves weights at zero


def test_held_out_is_crc32(spark):
    import zlib
    rows = spark.range(50).select("id", L.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


def test_counts_of_long_texts_do_not_depend_on_the_cut(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["Été", "a1b", "x", "?!", "straße"]) for _ in range(3000))
    whole = L.counts(text)
    assert L.counts("12 ?!") is None and L.counts("") is None and L.counts(None) is None and whole.sum() > 0


def test_odd_rows(docs):
    say = {"aa": "lorem ipsum dolor", "bb": "zwölf kraxx wyvern"}
    rows = [(i, " ".join([say[lang]] * (1 + i % 5)), lang) for i in range(80) for lang in ("aa", "bb")]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "123 !!", "bb"), (903, "lorem ipsum", None), (None, "wyvern kraxx", "bb"), (904, "zwölf " * 200_000, None)]
    source = docs(rows)
    model = L.fit(L.training_rows(source))
    found = {r.doc_id: r for r in L.predict(source, model).collect()}
    assert [found[i].lang_pred for i in (900, 901, 902, 903, None, 904)] == ["und", "und", "und", "aa", "bb", "bb"]
    kept = L.keep_identified(source, model, 0.4)
    assert kept.columns == source.columns and kept.count() == len(rows) - 3


def test_nothing_to_learn_from(docs):
    model = L.fit(L.training_rows(docs([])))
    assert [tuple(r)[2:] for r in L.predict(docs([(1, "some text")]), model).collect()] == [("und", 0.0)]
    assert L.predict(docs([]), model).count() == 0


def test_sample_is_bounded_where_rows_share_an_id(spark):
    rows = [(7, f"text number {i}", ("en", "fr")[i % 2]) for i in range(900)] + [(8, "again and again", "en")] * 300 + [(None, "none", "en")]
    found = L.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 100).collect()
    by = {}
    for r in found:
        by.setdefault(r["lang"], []).append(r["text"])
    assert {k: len(v) for k, v in by.items()} == {"en": 100, "fr": 100} and all(len(set(v)) == 100 for v in by.values())
