"""Range joins between points and intervals, and the joins around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import Tokenizer, clean_text, keyword_candidates, tokenize


def bucketed_range_join(points: DataFrame, intervals: DataFrame, key: str, at: str, bucket_ms: int) -> DataFrame:
    """Points with the intervals [start_ms, end_ms) they lie in. Both sides shuffle on (key, bucket), so one
    hot stream splits; an interval is repeated once per bucket it touches."""
    p = points.where(F.col(at).isNotNull()).withColumn("_bucket", F.floor(F.col(at) / bucket_ms))
    i = intervals.where("start_ms < end_ms").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor((F.col("end_ms") - 1) / bucket_ms))))
    return p.join(i, [key, "_bucket"]).where((F.col(at) >= F.col("start_ms")) & (F.col(at) < F.col("end_ms"))).drop("_bucket")


DAY = 86_400_000


def segment_messages(messages: DataFrame, segments: DataFrame, bucket_ms: int = DAY) -> DataFrame:
    """Chat on air during each segment, spam left out."""
    return bucketed_range_join(messages.where(~F.col("is_spam")), segments.drop("topic_ord"), "stream_id", "offset_ms", bucket_ms)


def chat_count_by_segment(messages: DataFrame, segments: DataFrame) -> DataFrame:
    """(segment_id, chat_count) of every segment, 0 included."""
    counts = segment_messages(messages, segments).groupBy("segment_id").agg(F.count("*").alias("n"))
    return segments.select("segment_id").join(counts, "segment_id", "left").select("segment_id", F.coalesce("n", F.lit(0)).alias("chat_count"))


def enrichment_plan(segments: DataFrame, chat_counts: DataFrame, least: int = 5) -> DataFrame:
    """(segment_id, kind): work still to do. A headline where ``enriched_by`` is not the model; a reaction where no
    chat summary says anything and at least ``least`` messages were on air."""
    rows = segments.join(chat_counts, "segment_id")
    headline = F.when(~F.coalesce(F.col("enriched_by") == "llm", F.lit(False)), "headline")
    reaction = F.when((F.trim(F.coalesce("chat_summary", F.lit(""))) == "") & (F.col("chat_count") >= least), "reaction")
    kinds = F.filter(F.array(headline, reaction), lambda k: k.isNotNull())
    return rows.select("segment_id", F.explode(kinds).alias("kind"))


def reaction_overview(messages: DataFrame, segments: DataFrame) -> DataFrame:
    """Totals and sentiment mix per segment; a null sentiment counts in the total only; mood is the leading
    label, ``mixed`` on a tie of the first two, null without scored messages."""
    parts = [F.count_if(F.col("sentiment") == s).alias(s) for s in ("positive", "neutral", "negative")]
    mix = segment_messages(messages, segments).groupBy("segment_id").agg(F.count("*").alias("total"), *parts)
    names = ("total", "positive", "neutral", "negative")
    out = segments.select("segment_id").join(mix, "segment_id", "left").select("segment_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in names))
    ranked = F.sort_array(F.array(*(F.struct(F.col(c).alias("n"), F.lit(c).alias("label")) for c in names[1:])), asc=False)
    mood = F.when(ranked[0]["n"] == 0, None).when(ranked[0]["n"] == ranked[1]["n"], "mixed").otherwise(ranked[0]["label"])
    return out.withColumn("mood", mood)


def reaction_words(messages: DataFrame, segments: DataFrame, k: int = 8, stop: list[str] = (), exclude: list[str] = (), letters: str = "a-zA-Z", tokenizer: Tokenizer = tokenize) -> DataFrame:
    """The k most frequent words of each segment's chat that can be keywords, of cleaned text; ties to the smaller word.
    A message is cleaned and cut once, before it meets its segment."""
    from pyspark.sql import Window as W

    words = keyword_candidates(tokenizer(clean_text(F.coalesce("text", F.lit("")))), [*stop], [*exclude], letters)
    said = segment_messages(messages.withColumn("text", F.array_join(words, " ")), segments)
    said = said.select("segment_id", F.explode(F.filter(F.split("text", " "), lambda t: t != "")).alias("word"))
    counts = said.groupBy("segment_id", "word").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy("segment_id").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= k)


def cue_block_overlap(cues: DataFrame, block_ms: int = 30_000) -> DataFrame:
    """Cues with the grid blocks they touch: start < block end and end > block start. A cue without length is in
    the block around it, and in none if it lies on the grid."""
    first, last = F.floor(F.col("start_ms") / block_ms), F.floor((F.col("end_ms") - 1) / block_ms)
    return cues.where(first <= last).withColumn("block", F.explode(F.sequence(first, last)))


def interval_lookup(points: DataFrame, fragments: DataFrame, key: str, bucket_ms: int = DAY) -> DataFrame:
    """Points with the fragment, of fragments laid end to end, in which they fall; past the end the last one."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy("fragment")
    bounds = fragments.withColumn("end_ms", F.sum("duration").over(w)).withColumn("start_ms", F.col("end_ms") - F.col("duration"))
    ends = bounds.groupBy(key).agg(F.max("end_ms").alias("_end"), F.max_by("fragment", "fragment").alias("_last"))
    rows = points.join(ends, key)
    late = rows.where(F.col("at") >= F.col("_end")).withColumn("fragment", F.col("_last")).drop("_end", "_last")
    within = rows.where(F.col("at") < F.col("_end")).drop("_end", "_last")
    found = bucketed_range_join(within, bounds.select(key, "fragment", "start_ms", "end_ms"), key, "at", bucket_ms).drop("start_ms", "end_ms")
    return found.unionByName(late)
