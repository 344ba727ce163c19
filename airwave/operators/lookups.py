"""Lookups, evidence tables and reports over documents, tokens and chat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean_headline

from .joins import enrichment_plan

def class_balance(docs: DataFrame, sentiments: list[str]) -> DataFrame:
    """Documents per topic and sentiment with a totals row (topic null), and the sizes of the smallest and largest topic."""
    parts = [F.count_if(F.col("sentiment") == s).alias(s) for s in sentiments]
    rows = docs.rollup("topic_ord").agg(*parts, F.count("*").alias("total"))
    sizes = docs.groupBy("topic_ord").agg(F.count("*").alias("n")).agg(F.min("n").alias("smallest"), F.max("n").alias("largest"))
    return rows.crossJoin(F.broadcast(sizes))


def documents_with_analysis(docs: DataFrame, analyses: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Documents with their analysis, null where there is none; ``ids`` restricts to chosen documents."""
    docs = docs if ids is None else docs.join(ids, "id", "left_semi")
    return docs.join(analyses, "id", "left")


def programme_overview(segments: DataFrame, chat_counts: DataFrame, facts: DataFrame) -> DataFrame:
    """Per stream: segments, segments with chat, chat on air, headlines and reactions still to be written, and the
    transcript's facts (video_id, ...), null where there is no transcript."""
    plan = enrichment_plan(segments, chat_counts).groupBy("segment_id").agg(F.count_if(F.col("kind") == "headline").alias("h"), F.count_if(F.col("kind") == "reaction").alias("r"))
    rows = segments.select("segment_id", "stream_id").join(chat_counts, "segment_id").join(plan, "segment_id", "left")
    per = rows.groupBy("stream_id").agg(
        F.count("*").alias("segment_count"), F.count_if(F.col("chat_count") > 0).alias("chat_segments"), F.sum("chat_count").alias("chat_messages"),
        F.coalesce(F.sum("h"), F.lit(0)).alias("pending_headlines"), F.coalesce(F.sum("r"), F.lit(0)).alias("pending_reactions"),
    )
    return per.join(facts.withColumnRenamed("video_id", "stream_id"), "stream_id", "left")


def window_membership(messages: DataFrame, membership: DataFrame) -> DataFrame:
    """Messages with the index of their window by identity, null outside every window."""
    return messages.join(membership, ["stream_id", "message_id"], "left").select("stream_id", "message_id", "window_index")


def filter_tokens(tokens: DataFrame, stop: DataFrame, protected: list[str], min_len: int = 2, drop_numbers: bool = True) -> DataFrame:
    """Tokens (doc_id, pos, token) without stop words, short ones, numbers and what holds no letter or digit;
    protected words stay whatever else holds."""
    kept = F.col("token").isin(protected)
    listed = stop.select(F.col("term").alias("token"), F.lit(True).alias("_stop")).distinct()
    fine = F.col("_stop").isNull() & (F.length("token") >= min_len) & F.rlike("token", F.lit(r"[\p{L}\p{N}]"))
    fine = fine & ~F.rlike("token", F.lit(r"^\p{Nd}+$")) if drop_numbers else fine
    return tokens.join(listed, "token", "left").where(kept | fine).select("doc_id", "pos", "token")


def topic_evidence(matches: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per match and topic: how the term matched, topic and weight."""
    return matches.join(terms, "term").select("doc_id", "pos", "term", "via", "topic_ord", "weight")


def _after_titles(rows: DataFrame, titles: list[str], letters: str, weight: int) -> DataFrame:
    """(name, support) of what may be a name right after a title in rows (tokens array), found inside the row."""
    tokens = F.col("tokens")
    after = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
    fits = lambda t, n: t.isin(titles) & (F.length(n) >= 2) & F.rlike(n, F.lit(f"[{letters}]")) & ~n.isin(titles)
    names = F.filter(F.zip_with(tokens, after, lambda t, n: F.when(fits(t, n), n)), lambda n: n.isNotNull())
    return rows.select(F.explode(names).alias("name")).groupBy("name").agg((F.count("*") * weight).alias("support"))


def name_lexicon(chat: DataFrame, speech: DataFrame, titles: list[str], blocked: DataFrame, letters: str = "a-zA-Z", weights: tuple[int, int] = (3, 1)) -> DataFrame:
    """(name, support): tokens right after a title in rows (tokens array) of chat, where a person typed them, and of speech,
    at three to one; of two characters or more, in script, no title themselves and not ``blocked`` (term)."""
    both = _after_titles(chat, titles, letters, weights[0]).unionByName(_after_titles(speech, titles, letters, weights[1]))
    found = both.groupBy("name").agg(F.sum("support").alias("support"))
    return found.join(blocked.select(F.col("term").alias("name")), "name", "left_anti")


def content_key(text: Column) -> Column:
    """Identity of a text whatever its white space."""
    return F.sha2(F.trim(F.regexp_replace(text, "[ \t\n\r]+", " ")), 256)


def enrichment_lookup(docs: DataFrame, cache: DataFrame, model: str, version: int, **rules) -> DataFrame:
    """Documents with the cached headline of their content by one model in the present shape: ``cache`` has
    content_key, model, version and headline; a headline that cleaning (by ``rules`` of ``clean_headline``) leaves
    nothing of is a miss, and so is null."""
    usable = cache.where((F.col("model") == model) & (F.col("version") == version)).withColumn("headline", clean_headline(F.col("headline"), **rules))
    usable = usable.where("headline is not null").groupBy("content_key").agg(F.max("headline").alias("headline"))
    return docs.withColumn("content_key", content_key(F.col("content"))).join(usable, "content_key", "left")


def split_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Contents that occur in both splits, which should have none in common."""
    key = content_key(F.col("content")).alias("content_key")
    return a.select(key).intersect(b.select(key))
