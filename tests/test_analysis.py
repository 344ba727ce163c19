"""Analyses read tokens where the row is; small bounds change nothing."""

import random

from pyspark.sql import functions as F

from airwave.functions import text
from airwave.operators import lexicon, stats, texts

G = texts.Gazetteers(titles=["mr"], organisations=["uni"], places=["in"], known_places=["rome"], patterns=texts.PATTERNS)
WORDS = ["the", "not", "very", "good", "bad", "mr", "anna", "uni", "university", "in", "rome", "river", "12", "5 km", "É", "Σας", "x", "☀", "␤", "a.b", "end!", "9:30", "so"]


def _docs(spark):
    rnd = random.Random(7)
    said = lambda n: " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "", ".", "\n"]) for _ in range(n))
    rows = [(i, said(rnd.randint(0, 4)), said(rnd.choice([0, 3, 30, 90]))) for i in range(60)] + [(60, None, None), (0, "again", "the same number")]
    return spark.createDataFrame(rows, "doc_id long, title string, content string").repartition(3)


def test_an_analysis_does_not_hang_on_its_bounds(spark, monkeypatch):
    docs = _docs(spark)
    terms = spark.createDataFrame([("good", 2, 1.0, 0.7), ("bad", 4, 2.0, -0.9), ("good", 3, 0.5, 0.1), ("a b", 5, 1.0, 0.3), ("river", 5, 1.0, 0.4)], "term string, topic_ord int, weight double, polarity double")
    idf = stats.text_idf(docs.select(F.col("content").alias("text")))
    told = lambda: sorted(map(str, texts.analyse_documents(docs, terms, ["the"], G, idf, 62, k=4).collect()))
    want = told()
    monkeypatch.setattr(texts, "COMMON", 3)  # other terms meet their weights in a join
    monkeypatch.setattr(texts, "WORDS", 50)
    assert told() == want
    monkeypatch.setattr(lexicon, "MOST_TERMS", 0)  # terms meet the tokens in joins
    assert told() == want
    # keywords are those of the operator that scores every candidate
    rows = docs.select(F.monotonically_increasing_id().alias("i"), text.clean_text(F.coalesce("title", F.lit(""))).alias("t"), text.clean_text(F.coalesce("content", F.lit(""))).alias("b"))
    tokens = lambda c: text.keyword_candidates(text.tokenize(c), ["the"])
    rows = rows.select("i", tokens(F.concat_ws(" ", "t", "b")).alias("tokens"), text.kept_tokens(text.tokenize(F.col("t")), ["the"]).alias("title_tokens"))
    best = stats.tfidf_keywords(rows, idf, 62, 4, key="i").select("token", "score").collect()
    got = [k for r in texts.analyse_documents(docs, terms, ["the"], G, idf, 62, k=4).collect() for k in r["keywords"] or []]
    assert sorted(map(tuple, best)) == sorted(map(tuple, got)) and len(best) > 100


def test_summaries_and_entities_stay_in_their_rows(spark):
    docs = _docs(spark).select("doc_id", F.col("content").alias("text")).cache()
    docs.count()
    for out in (texts.extractive_summary(docs, ["the"]), texts.entities(docs, G)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan and "Window" not in plan
    twice = texts.extractive_summary(docs.where("doc_id = 0"), ["the"]).collect()
    assert len(twice) == 2  # a key that stands twice is summarised twice
    docs.unpersist()


def test_kept_words_are_kept_tokens(spark):
    import pyarrow as pa

    words = sorted({*WORDS, "", "1", "12a", "½", "á", "٣٤", "nicht", "中", "ab"})
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    for protected in ([], ["x", "12"]):
        want = {r[0] for r in frame.select(F.explode(text.kept_tokens(F.array("w"), ["the"], protected))).collect()}
        assert {w for w, k in zip(words, text.kept_words(pa.array(words), ["the"], protected)) if k} == want
    want = {r[0] for r in frame.select(F.explode(text.keyword_candidates(F.array("w"), ["the"]))).collect()}
    assert {w for w, k in zip(words, text.kept_words(pa.array(words), ["the"], letters="a-zA-Z")) if k} == want


def test_texts_are_cut_once_for_their_idf(spark):
    docs = spark.createDataFrame([("a a b",), ("b c",), (None,), ("",)], "text string")
    rows = stats.text_idf(docs)
    assert sorted(map(tuple, rows.collect())) == [("a", 1), ("b", 2), ("c", 1)]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
