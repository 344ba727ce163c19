import pyarrow as pa
from pyspark.sql import functions as F

from airwave.functions import text
from airwave.operators import lexicon


def test_matches_are_the_same_in_stretches_of_any_size(monkeypatch):
    """Rows are looked at a few together, and found alike."""
    matcher = lexicon.Matcher(["aa", "bb cc", "ddddd"], 2, 5, " ")
    lists = pa.array([["aa", "bb", "cc"], [], None, ["xdddddx", "aa"], ["bb"]], pa.list_(pa.string()))
    want = matcher(lists).to_pylist()
    monkeypatch.setattr(lexicon, "TOGETHER", 1)
    assert [*lexicon.stretches(lists, 3)] == [(0, 3), (3, 5)] and matcher(lists).to_pylist() == want and len(want) == 5
    assert matcher(lists.slice(0, 0)).to_pylist() == []


def test_matching_runs_once(spark):
    """Leaving out rows without matches does not run the matcher a second time."""
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "doc_id long, tokens array<string>")
    found = lexicon.term_matches(rows, spark.createDataFrame([("a",)], "term string"))
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [r["doc_id"] for r in found.collect()] == [1]


def test_dictionary_cuts_a_few_rows_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(text, "ROWS", 1)
    rows = spark.createDataFrame([("abcd",), (None,), ("cdab",)], "t string").coalesce(1)
    cut = text.dictionary_tokenizer(["ab", "cd"], "\\p{L}")
    assert {r["t"]: r["ts"] for r in rows.select("t", cut(F.col("t")).alias("ts")).collect()} == {"abcd": ["ab", "cd"], None: None, "cdab": ["cd", "ab"]}
