"""Statistics over documents and messages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import Tokenizer, tokenize, window_title

SENTIMENTS = ("positive", "neutral", "negative")


def zero_fill(dimension: DataFrame, facts: DataFrame, on: str) -> DataFrame:
    """Counts per label of a fixed dimension; absent labels show 0."""
    counts = facts.groupBy(on).agg(F.count("*").alias("n"))
    return dimension.join(counts, dimension["ord"] == counts[on], "left").select("ord", "slug", F.coalesce("n", F.lit(0)).alias("n"))


def by_sentiment(docs: DataFrame) -> DataFrame:
    """Count and share of every sentiment, absent ones as 0; shares are of all documents, 0 without any."""
    row = docs.agg(F.count("*").alias("total"), *(F.count_if(F.col("sentiment") == s).alias(s) for s in SENTIMENTS))
    each = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(s).alias("sentiment"), F.col(s).alias("n")) for i, s in enumerate(SENTIMENTS)))
    share = F.when(F.col("total") > 0, F.round(F.col("x.n") * 100.0 / F.col("total"), 1)).otherwise(0.0)
    return row.select("total", F.explode(each).alias("x")).select("x.ord", "x.sentiment", "x.n", share.alias("percentage"))


def topic_sentiment(docs: DataFrame) -> DataFrame:
    parts = [F.count_if(F.col("sentiment") == s).alias(s) for s in SENTIMENTS]
    return docs.groupBy("topic_ord").agg(*parts, F.count("*").alias("total"))


def dashboard_totals(docs: DataFrame, messages: DataFrame) -> DataFrame:
    """One row of totals; averages are 0 without documents; the commonest topic goes to the smaller number on a tie."""
    d = docs.agg(
        F.count("*").alias("documents"), *(F.count_if(F.col("sentiment") == s).alias(s) for s in SENTIMENTS),
        F.count_if(F.col("source_type") == "chat_window").alias("chat_windows"), F.count_if(F.col("source_type") == "article").alias("articles"),
        F.round(F.coalesce(F.avg("topic_confidence"), F.lit(0.0)), 4).alias("avg_topic_confidence"),
        F.round(F.coalesce(F.avg("sentiment_confidence"), F.lit(0.0)), 4).alias("avg_sentiment_confidence"),
    )
    m = messages.agg(F.count("*").alias("messages"), F.count("sentiment").alias("scored"), F.count_if("is_spam").alias("noise"), F.countDistinct("stream_id").alias("streams"))
    top = docs.groupBy("topic_ord").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", -F.col("topic_ord"))).alias("t")).select((-F.col("t.col2")).alias("top_topic"), F.col("t.n").alias("top_count"))
    return d.crossJoin(F.broadcast(m)).crossJoin(F.broadcast(top))


def period(ts: Column, granularity: str) -> Column:
    """Day, week (%Y-W%W: weeks begin on Monday, days before the first Monday are week 00) or month."""
    if granularity == "weekly":
        week = F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7)
        return F.concat(F.date_format(ts, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))
    return F.date_format(ts, "yyyy-MM" if granularity == "monthly" else "yyyy-MM-dd")


def trend(docs: DataFrame, granularity: str = "daily") -> DataFrame:
    """Documents per period by sentiment; no period, no row; an unknown sentiment counts as neutral."""
    s = F.when(F.col("sentiment").isin("positive", "negative"), F.col("sentiment")).otherwise("neutral")
    rows = docs.where(F.col("published_at").isNotNull()).select(period(F.col("published_at"), granularity).alias("period"), s.alias("s"))
    return rows.groupBy("period").agg(F.count("*").alias("total"), *(F.count_if(F.col("s") == x).alias(x) for x in SENTIMENTS))


def window_sentiment(messages: DataFrame, membership: DataFrame, share: float = 0.15, gap: float = 0.04) -> DataFrame:
    """Verdict of every window from its scored messages: neutral if opinions are few or balanced, else the leading polarity."""
    rows = membership.join(messages.select("stream_id", "message_id", "sentiment", "us"), ["stream_id", "message_id"])
    n = F.count("sentiment")
    c = rows.groupBy("stream_id", "window_index").agg(
        F.count("*").alias("messages"), n.alias("scored"), F.min("us").alias("start_us"), F.max("us").alias("end_us"),
        *(F.count_if(F.col("sentiment") == s).alias(s) for s in SENTIMENTS),
    )
    pos, neg, neu = (F.col(s) / F.col("scored") for s in ("positive", "negative", "neutral"))
    flat = (F.col("scored") == 0) | (pos + neg < share) | (F.abs(pos - neg) < gap)
    label = F.when(flat, "neutral").when(pos > neg, "positive").otherwise("negative")
    sure = F.when(F.col("scored") == 0, 1.0).when(flat, neu).otherwise(F.greatest(pos, neg) / (pos + neg))
    return c.select("stream_id", "window_index", "messages", "scored", "start_us", "end_us", label.alias("sentiment"), F.round(sure, 6).alias("confidence"))


def window_documents(messages: DataFrame, membership: DataFrame, streams: DataFrame | None = None, keywords: DataFrame | None = None) -> DataFrame:
    """Each window as one document: title with its time and size, texts in order, bounds, span, count and hash. The title
    has the stream's (``streams``: stream_id, title) and opens with the window's keywords (``keywords``: stream_id,
    window_index, keywords) where they are given; a table of streams is small beside their windows, and the optimizer
    broadcasts it where it is."""
    rows = membership.join(messages, ["stream_id", "message_id"])
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("us", F.col("message_id").try_cast("bigint").alias("i"), "message_id", "text"))), lambda x: x["text"]), "\n")
    d = rows.groupBy("stream_id", "window_index").agg(texts.alias("content"), F.count("*").alias("message_count"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))
    d = d.join(keywords.select("stream_id", "window_index", F.col("keywords").alias("_words")), ["stream_id", "window_index"], "left") if keywords is not None else d.withColumn("_words", F.array().cast("array<string>"))
    d = d.join(streams.select("stream_id", F.col("title").alias("_title")), "stream_id", "left") if streams is not None else d.withColumn("_title", F.lit(None).cast("string"))
    title = window_title(F.timestamp_micros("start_us"), F.col("_title"), F.col("_words"), F.col("message_count"))
    d = d.withColumn("title", title).withColumn("span_ms", F.floor((F.col("end_us") - F.col("start_us")) / 1000))
    return d.withColumn("content_hash", F.sha2("content", 256)).drop("_title", "_words")


def stream_rates(messages: DataFrame, membership: DataFrame) -> DataFrame:
    """Per stream: messages, minutes, messages a minute (null for no time), windows and messages a window."""
    w = membership.groupBy("stream_id").agg(F.countDistinct("window_index").alias("windows"), F.count("*").alias("_kept"))
    minutes = (F.col("last_us") - F.col("first_us")) / 60_000_000
    rows = stream_counters(messages).join(w, "stream_id", "left").withColumn("windows", F.coalesce("windows", F.lit(0)))
    rate = F.when(minutes > 0, F.round(F.col("message_count") / minutes, 4))
    mean = F.when(F.col("windows") > 0, F.round(F.col("_kept") / F.col("windows"), 4)).otherwise(0.0)
    return rows.select("stream_id", F.col("message_count").alias("messages"), F.round(minutes, 4).alias("minutes"), rate.alias("per_minute"), "windows", mean.alias("per_window"))


def stream_counters(messages: DataFrame) -> DataFrame:
    return messages.groupBy("stream_id").agg(F.count("*").alias("message_count"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def ingest_report(messages: DataFrame, membership: DataFrame) -> DataFrame:
    """Messages, scored and skipped ones, streams and windows, per stream and overall in the row without a stream."""
    w = membership.groupBy("stream_id").agg(F.countDistinct("window_index").alias("windows"))
    per = messages.groupBy("stream_id").agg(F.count("*").alias("messages"), F.count_if(~F.col("is_spam")).alias("scored"), F.count_if("is_spam").alias("skipped"))
    per = per.join(w, "stream_id", "left").withColumn("windows", F.coalesce("windows", F.lit(0))).withColumn("streams", F.lit(1).cast("long"))
    return per.rollup("stream_id").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("messages", "scored", "skipped", "windows", "streams")))


def keyword_cloud(keywords: DataFrame, limit: int = 40, topic: int | None = None) -> DataFrame:
    """(word, count, score) of rows (word, score, topic_ord), of one topic if given: documents per word and best
    score, a missing score counting 0; the top words, ties to the smaller."""
    rows = keywords.where("trim(word) <> ''")
    rows = rows if topic is None else rows.where(F.col("topic_ord") == topic)
    return rows.groupBy("word").agg(F.count("*").alias("count"), F.max(F.coalesce("score", F.lit(0.0))).alias("score")).orderBy(F.desc("count"), "word").limit(limit)


def fit_idf(tokens: DataFrame) -> DataFrame:
    """(term, df) over rows (doc_id, token)."""
    return tokens.groupBy("token").agg(F.countDistinct("doc_id").alias("df")).withColumnRenamed("token", "term")


def text_idf(docs: DataFrame, tokenizer: Tokenizer = tokenize) -> DataFrame:
    """As ``fit_idf`` over rows (text), each a document of its own: a row's terms are made distinct where it is, and counts of
    terms are all that is shuffled."""
    terms = docs.select(F.array_distinct(tokenizer(F.col("text"))).alias("terms"))
    # an inner explode would have the optimizer look for empty rows first, and cut texts twice
    return terms.select(F.explode_outer("terms").alias("term")).where(F.col("term").isNotNull()).groupBy("term").agg(F.count("*").alias("df"))


def idf_weight(n: Column, df: Column) -> Column:
    return F.log((1 + n) / (1 + df).cast("double")) + 1


def tfidf_keywords(docs: DataFrame, idf: DataFrame | None, documents: int = 0, k: int = 10, boost: float = 1.6, key: str = "doc_id") -> DataFrame:
    """The k candidates of each document with most tf-idf, over rows (key, tokens array, title_tokens array).

    tf is a term's share of the document's candidates, idf ln((1+N)/(1+df)) + 1 over ``documents`` with an unseen
    term at df 0; without ``idf`` (term, df) longer terms weigh more, 1 + min(length, 12) / 12. A term of the title
    weighs ``boost`` times."""
    marked = F.transform("tokens", lambda t: F.struct(t.alias("token"), F.coalesce(F.array_contains("title_tokens", t), F.lit(False)).alias("title")))
    rows = docs.select(key, F.size("tokens").alias("_total"), F.explode(marked).alias("x"))
    rows = rows.groupBy(key, "_total", F.col("x.token").alias("token"), F.col("x.title").alias("_title")).agg(F.count("*").alias("occ"))
    if idf is None:
        weight = 1 + F.least(F.length("token"), F.lit(12)) / 12
    else:
        rows = rows.join(idf.withColumnRenamed("term", "token"), "token", "left")
        weight = idf_weight(F.lit(documents), F.coalesce("df", F.lit(0)))
    score = F.col("occ") / F.col("_total") * weight * F.when(F.col("_title"), boost).otherwise(1.0)
    scored = rows.select(key, "token", F.round(score, 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "token"))).where(F.col("rank") <= k)


def weightiest(tokens: Column, k: int) -> Column:
    """As ``tfidf_keywords`` without idf and title, inside the row: the k ``tokens`` with the greatest share of them all times
    1 + min(length, 12) / 12, the first first."""

    def count(lists: pa.Array) -> pa.Array:
        coded = lists.flatten().dictionary_encode()
        wide = max(len(coded.dictionary), 1)
        row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        cells, n = np.unique(row * wide + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        row, code = np.divmod(cells, wide)
        total = np.bincount(row, n, len(lists)).astype(np.int64)[row]
        values = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(code)), pa.array(n.astype(np.int64)), pa.array(total)], ["token", "n", "total"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(lists) + 1)), pa.int32()), values)

    counts = F.arrow_udf(count, "array<struct<token:string,n:bigint,total:bigint>>")(tokens)
    share = lambda x: F.round(x["n"] / x["total"] * (1 + F.least(F.length(x["token"]), F.lit(12)) / 12), 6)
    best = F.array_sort(F.transform(counts, lambda x: F.struct((-share(x)).alias("score"), x["token"].alias("token"))))
    return F.transform(F.slice(best, 1, k), lambda x: x["token"])


def gazetteer_topic(docs: DataFrame, counts: DataFrame, terms: DataFrame, topics: int = 15, floor: float = 0.02, least: float = 0.9, fallback: int = 14, key: str = "doc_id") -> DataFrame:
    """(key, topic_ord, confidence) of every row of ``docs``: weights of the matched terms, each as often
    as ``counts`` (key, term, n) says or once a row without n, summed per topic, as decimals and so in any order the same, and smoothed. Below ``least`` the fallback takes over with its own probability; without evidence it is
    certain. Ties go to the earlier topic."""
    weight = F.col("weight").cast("decimal(18,6)") * (F.col("n") if "n" in counts.columns else F.lit(1)).cast("decimal(18,0)")
    hits = counts.join(terms, "term").groupBy(key, "topic_ord").agg(F.sum(weight.cast("decimal(28,6)")).alias("score"))
    own = F.sum(F.when(F.col("topic_ord") == fallback, F.col("score")).otherwise(F.lit(0).cast("decimal(18,6)")))
    best = hits.groupBy(key).agg(F.sum("score").alias("total"), own.alias("own"), F.max(F.struct("score", -F.col("topic_ord"))).alias("b"))
    rows = docs.select(key).join(best, key, "left")
    weak, none = F.col("b.score") < least, F.col("b").isNull() | (F.col("b.score") <= 0)
    share = lambda c: (F.col(c).cast("double") + floor) / (F.col("total").cast("double") + floor * topics)
    topic = F.when(none | weak, fallback).otherwise(-F.col("b.col2"))
    sure = F.when(none, 1.0).when(weak, share("own")).otherwise(share("b.score"))
    return rows.select(key, topic.cast("int").alias("topic_ord"), sure.alias("confidence"))
