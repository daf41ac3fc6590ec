import unicodedata
import zlib

import numpy as np
from pyspark.sql import functions as F

from priorview.llm import language

SCHEMA = "doc_id long, text string, lang string, source string, words int"
SF = "/root/testdata/sf0.01"


def rows():
    return [(1, "the cat and the dog", "en", "s", 1), (2, "le chat et le chien", "fr", "s", 1), (3, None, "en", "s", 1),
            (4, "", "fr", "s", 1), (5, "12 345 ²½ _ !", "en", "s", 1), (None, "the dog", None, None, None), (7, "日本語", None, "s", 1),
            (8, "le " * 100_000, "fr", "s", 1), (1, "the cat and the dog", "en", "s", 1), (9, "İstanbul ﬁ ǅ", None, "s", 1)]


def test_cases(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    model = language.fit(docs)
    assert model.languages == ["en", "fr"]
    got = {(r.doc_id, r.words): (r.lang_pred, r.score) for r in language.predict(docs, model, ["doc_id", "words"]).collect()}
    assert got[1, 1][0] == got[None, None][0] == "en" and got[2, 1][0] == got[8, 1][0] == "fr"
    assert got[3, 1] == got[4, 1] == got[5, 1] == ("und", 0.0)
    assert got[7, 1][1] == 0.5
    assert language.predict(docs, model, ["doc_id"]).count() == len(rows())
    assert all(0 <= s <= 1 for _, s in got.values())


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    model = language.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.predict(docs, model, ["doc_id"]).collect()} == {"und"}
    assert language.predict(docs.where("false"), model, ["doc_id"]).count() == 0


def test_word_first_then_shorter_grams():
    model = language.Model.of([("a", "hello", 3), ("b", "jelly", 1)])
    row = lambda size, g: model.logs[model.grams[language.LONGEST - size][g]]
    assert np.allclose(model.word("hello"), model.logs[model.words["hello"]])
    assert np.allclose(model.word("ehello"), np.mean([row(5, "hello"), row(5, "ello$")], axis=0))
    assert np.allclose(model.word("xhx"), row(1, "h"))
    assert not language.Model(["a"]).word("x").any()


def test_scores_do_not_depend_on_the_cache():
    model = language.Model.of([("a", "hello", 3), ("a", "world", 2), ("b", "jelly", 1)])
    texts = ["hello world!", "jelly-hello 7", "unknown words here", "JELLY"] * 3
    assert [language.Scorer(model, cache=1)(t) for t in texts] == list(map(language.Scorer(model), texts))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", language.held_out())
    model = language.fit(docs.where("not held_out"), sample=400)
    got = language.predict(docs, model, ["doc_id", "lang", "held_out"]).where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98


def test_letters_are_a_category():
    model = language.Model.of([("a", "hello", 3), ("b", "一二", 1)])
    score = language.Scorer(model)
    for text in ("一。", "一", "(一)x²", "一²"):
        assert score(text)[0] == "b" or "x" in text
    assert score("Ⅷ ² ½ 7")[0] == "und"  # numbers that are no letters
    assert language.words_of("a²b ⅷ一x") == ["a", "b", "一x"]


def test_names_that_are_taken(spark):
    docs = spark.createDataFrame([(1, "the cat", "en", 7, "x")], "doc_id long, text string, lang string, score int, lang_pred string")
    got = language.predict(docs, language.fit(docs), ["doc_id", "score", "lang_pred"])
    assert got.columns == ["doc_id", "score", "lang_pred", "lang_pred_", "score_"]
    assert tuple(got.first())[:4] == (1, 7, "x", "en")


def test_sample_of_a_text_that_is_half_the_table(spark):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'same words' ELSE translate(id, '0123456789', 'abcdefghij') END AS text", "'en' AS lang")
    sizes = [len(language.fit(docs.withColumn("text", F.concat("text", F.lit(f" v{k}"))), sample=1000).words) for k in range(4)]
    assert all(350 < n < 700 for n in sizes)  # about 500 rows of distinct words, whichever way the hash falls


def slow(model, text):
    words, run = [], ""
    for c in (text or "").lower() + " ":
        if unicodedata.category(c)[0] == "L":
            run += c
        elif run:
            words.append(run)
            run = ""
    if not words:
        return "und", 0.0
    total = np.sum([np.asarray(model.word(w), np.float64) for w in words], axis=0) / len(words) * min(len(words), language.EVIDENCE)
    return model.languages[int(np.argmax(total))], float(1 / np.exp(total - total.max()).sum())


def test_against_a_slow_scorer_on_every_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs, sample=300)
    for r in language.predict(docs, model, ["doc_id", "text"]).collect():
        lang, score = slow(model, r.text)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-3
