"""Registered round trips through sources, sinks and streams over what the given tables hold, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from airwave.plans.catalog import _ENDS, _WINDOWS, _cues, register
from airwave.sources import files, merge
from airwave.streaming import jobs

_ALL = 1 << 40


def _snapshots(v):
    """The messages as snapshots, one a stream, in the shared folder."""
    m = v("t_messages").select(F.col("stream_id").cast("string").alias("video_id"), F.concat(F.lit("Stream "), F.col("stream_id").cast("string")).alias("title"), F.lit("events").alias("channel"), "message_id", "author", "text", F.timestamp_micros("us").alias("published_at"), "offset_ms")
    path = files.scratch(m.sparkSession, "snapshots")
    files.write_chat_snapshots(m, path)
    return m.sparkSession, path


@register("read_chat_snapshots", "SELECT CAST(stream_id AS VARCHAR) AS video_id, message_id, author, text, us, offset_ms FROM t_messages")
def _(v):
    rows = files.read_chat_snapshots(*_snapshots(v), _ALL)
    return rows.select("video_id", "message_id", "author", "text", F.unix_micros("published_at").alias("us"), "offset_ms")


@register("write_chat_snapshots", "SELECT CAST(stream_id AS VARCHAR) AS video_id, count(*) + 1 AS lines FROM t_messages GROUP BY 1")
def _(v):
    spark, path = _snapshots(v)
    return files.read_packs(spark, path).groupBy("video_id").agg(F.count("*").alias("lines"))


@register("snapshot_inventory", "SELECT CAST(stream_id AS VARCHAR) AS video_id, 'Stream ' || CAST(stream_id AS VARCHAR) AS title, 'events' AS channel, count(*) AS message_count, true AS sized FROM t_messages GROUP BY ALL")
def _(v):
    return files.snapshot_inventory(*_snapshots(v)).select("video_id", "title", "channel", "message_count", (F.col("size_kb") > 0).alias("sized"))


@register("read_raw_live_chat", """SELECT CAST(stream_id AS VARCHAR) AS video_id, message_id, CASE WHEN event_id % 5 <> 0 THEN author END AS author, CASE event_id % 3 WHEN 0 THEN text WHEN 1 THEN text || ':wave:' ELSE text || '☺' END AS text, us, CASE WHEN event_id % 2 = 0 THEN offset_ms END AS offset_ms FROM t_messages WHERE event_id % 7 <> 0""")
def _(v):
    """Messages as a platform would send them: plain, paid and membership ones, wrapped or bare, and stickers between."""
    m = v("t_messages")
    emoji = F.when(F.col("event_id") % 3 == 1, F.struct(F.struct(F.lit("x").alias("emojiId"), F.lit(True).alias("isCustomEmoji"), F.array(F.lit(":wave:")).alias("shortcuts")).alias("emoji"))).when(F.col("event_id") % 3 == 2, F.struct(F.struct(F.lit("☺").alias("emojiId"), F.lit(False).alias("isCustomEmoji"), F.array(F.lit(":smile:")).alias("shortcuts")).alias("emoji")))
    runs = F.concat(F.lit('{"runs":['), F.to_json(F.struct("text")), F.when(emoji.isNotNull(), F.concat(F.lit(","), F.to_json(emoji))).otherwise(F.lit("")), F.lit("]}"))
    author = F.when(F.col("event_id") % 5 != 0, F.concat(F.lit(',"authorName":'), F.to_json(F.struct(F.col("author").alias("simpleText"))))).otherwise(F.lit(""))
    kind = F.when(F.col("event_id") % 7 == 0, "liveChatPaidStickerRenderer").when(F.col("event_id") % 4 == 0, "liveChatPaidMessageRenderer").when(F.col("event_id") % 4 == 1, "liveChatMembershipItemRenderer").otherwise("liveChatTextMessageRenderer")
    field = F.when(F.col("event_id") % 4 == 1, "headerSubtext").otherwise("message")
    body = F.concat(F.lit('{"id":"'), "message_id", F.lit('","timestampUsec":"'), F.col("us").cast("string"), F.lit('"'), author, F.lit(',"'), field, F.lit('":'), runs, F.lit("}"))
    action = F.concat(F.lit('{"addChatItemAction":{"item":{"'), kind, F.lit('":'), body, F.lit("}}}"))
    line = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"replayChatItemAction":{"videoOffsetTimeMsec":"'), F.col("offset_ms").cast("string"), F.lit('","actions":[{"tick":1},'), action, F.lit("]}}"))).otherwise(action)
    path = files.scratch(m.sparkSession, "raw")
    files.write_packs(m.select(F.col("stream_id").alias("video_id"), line.alias("value")), path)
    return files.read_raw_live_chat(m.sparkSession, path).select("video_id", "message_id", "author", "text", F.unix_micros("published_at").alias("us"), "offset_ms")


_SPOKEN = r"SELECT video_id, cue_idx, start_ms, text FROM (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY start_ms) - 1 AS cue_idx, start_ms, text FROM (SELECT video_id, cue_idx, start_ms, non_speech, trim(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '^[ \t\n\f\r]*>>[ \t\n\f\r]*', ''), '\[[^\]]{1,24}\]', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM t_cues) WHERE text <> '' OR non_speech)"


def _captions(v):
    c = v("t_cues").where("text <> '' or non_speech")
    said = F.when(F.col("non_speech"), "[music]").otherwise(F.col("text"))
    event = F.struct("start_ms", F.struct(F.col("start_ms").alias("tStartMs"), F.col("duration_ms").alias("dDurationMs"), F.array(F.struct(said.alias("utf8"))).alias("segs")).alias("e"))
    path = files.scratch(c.sparkSession, "captions")
    rows = c.groupBy("video_id").agg(F.transform(F.sort_array(F.collect_list(event)), lambda x: x["e"]).alias("events"))
    files.write_packs(rows.select("video_id", F.to_json(F.struct("events")).alias("value")), path)
    return files.read_captions(c.sparkSession, path)


@register("read_captions", _SPOKEN.replace("SELECT video_id, cue_idx, start_ms, text FROM (", "SELECT CAST(video_id AS VARCHAR) AS video_id, cue_idx, start_ms, text FROM (", 1))
def _(v):
    return _captions(v).select("video_id", "cue_idx", "start_ms", "text")


@register("clean_cue_text", r"""SELECT video_id, cue_idx, trim(regexp_replace(regexp_replace(CASE cue_idx % 3 WHEN 0 THEN text WHEN 1 THEN regexp_replace(text, '^[ \t\n\x0B\f\r]*>>[ \t\n\x0B\f\r]*', '') ELSE text END, '\[[^\]]{1,24}\]', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text, cue_idx % 3 = 1 AS speaker_change FROM (SELECT video_id, cue_idx, regexp_replace(replace(text, chr(160), ' '), '^[ \t\n\x0B\f\r]*>>[ \t\n\x0B\f\r]*', '') AS text FROM t_cues)""")
def _(v):
    from airwave.functions.text import clean_cue_text

    said = F.when(F.col("cue_idx") % 3 == 0, F.concat(F.lit("[la, la]"), "text")).when(F.col("cue_idx") % 3 == 1, F.concat(F.lit(" >> "), "text")).otherwise(F.col("text"))
    plain = F.regexp_replace(F.regexp_replace("text", " ", " "), r"^\s*>>\s*", "")
    return v("t_cues").withColumn("text", plain).select("video_id", "cue_idx", clean_cue_text(said).alias("c")).select("video_id", "cue_idx", "c.text", "c.speaker_change")


@register("read_transcript_snapshots", _ENDS + "SELECT CAST(video_id AS VARCHAR) AS video_id, cue_idx, start_ms, end_ms, text, non_speech, speaker_change FROM e")
def _(v):
    cues = _cues(v)
    path = files.scratch(cues.sparkSession, "transcripts")
    files.write_transcript_snapshots(cues, path)
    return files.read_transcript_snapshots(cues.sparkSession, path).select("video_id", "cue_idx", "start_ms", "end_ms", "text", "non_speech", "speaker_change")


_CSV = "sha256(trim(content)) AS content_sha256"


def _parts(v):
    d = v("t_documents").select("title", "content", F.col("topic_ord").alias("topic"), "sentiment")
    path = files.scratch(d.sparkSession, "labelled")
    files.write_labelled_dataset(d, path)
    return files.read_labelled_parts(d.sparkSession, path, "\n")


@register("read_labelled_parts", f"SELECT {_CSV}, CAST(topic_ord AS VARCHAR) AS topic, sentiment, count(*) AS n FROM t_documents GROUP BY ALL")
def _(v):
    return _parts(v).groupBy(F.sha2("content", 256).alias("content_sha256"), "topic", "sentiment").agg(F.count("*").alias("n"))


@register("write_labelled_dataset", "SELECT count(*) AS rows, count(DISTINCT topic_ord) AS topics, count(DISTINCT trim(title)) AS titles FROM t_documents")
def _(v):
    return _parts(v).agg(F.count("*").alias("rows"), F.countDistinct("topic").alias("topics"), F.countDistinct("title").alias("titles"))


@register("read_articles_csv", "SELECT sha256(content) AS content_sha256, CASE WHEN id % 2 = 0 THEN 'sample' ELSE coalesce(nullif(source, ''), 'sample') END AS source, CASE WHEN id % 3 <> 0 THEN 'https://a.example/' || CAST(id AS VARCHAR) END AS url, CASE WHEN id % 5 <> 0 THEN epoch_us(published_at) // 1000000 END AS seconds FROM t_documents")
def _(v):
    d = v("t_documents")
    when = F.when(F.col("id") % 5 == 0, "some day").otherwise(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"))
    rows = d.select("title", "content", F.when(F.col("id") % 2 == 0, " ").otherwise(F.col("source")).alias("source"), F.when(F.col("id") % 3 != 0, F.concat(F.lit("https://a.example/"), F.col("id").cast("string"))).otherwise("").alias("url"), when.alias("published_at"))
    path = files.scratch(d.sparkSession, "articles")
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return files.read_articles_csv(d.sparkSession, path).select(F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_sha256"), "source", "url", F.unix_seconds("published_at").alias("seconds"))


@register("read_category_corpus", "SELECT CASE id % 5 WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' WHEN 2 THEN 'negative' ELSE 'neutral' END AS sentiment, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM t_documents WHERE id % 5 < 4 AND trim(content) <> '' GROUP BY 1")
def _(v):
    d = v("t_documents").select(F.col("content").alias("texts"), (F.col("id") % 5).cast("int").alias("category"))
    path = files.scratch(d.sparkSession, "categories")
    d.write.parquet(path)
    rows = files.read_category_corpus(d.sparkSession, path, keep_questions=True)
    return rows.groupBy("sentiment").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@register("replace_stream_results", "SELECT stream_id, CASE WHEN stream_id % 3 = 0 THEN 'new' ELSE 'old' END AS run, count(*) AS n FROM t_messages WHERE stream_id % 3 <> 0 OR event_id % 2 = 0 GROUP BY ALL")
def _(v):
    m = v("t_messages").select("stream_id", "message_id", "event_id")
    path = files.scratch(m.sparkSession, "results")
    files.replace_stream_results(m.withColumn("run", F.lit("old")), path)
    files.replace_stream_results(m.where("stream_id % 3 = 0 and event_id % 2 = 0").withColumn("run", F.lit("new")), path)
    return merge.read(m.sparkSession, path).groupBy("stream_id", "run").agg(F.count("*").alias("n"))


def _streamed(v, make, twice=False):
    """The messages as files in a folder, read as a stream to their end."""
    m = v("t_messages").select("stream_id", "message_id", "author", "text", F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts"), "offset_ms", "sentiment", "is_spam", "event_id")
    spark = m.sparkSession
    source, target, state = (files.scratch(spark, n) for n in ("in", "out", "state"))
    (m.unionByName(m.where("event_id % 4 = 0")) if twice else m).drop("event_id").write.json(source)
    jobs.drain(make(jobs.stream_messages(spark, source)), target, state)
    return spark.read.parquet(target)


@register("stream_messages", "SELECT stream_id, message_id, text, us, is_spam FROM t_messages")
def _(v):
    return _streamed(v, lambda s: s).select("stream_id", "message_id", "text", "us", "is_spam")


@register("stream_dedupe", "SELECT stream_id, message_id, us FROM t_messages")
def _(v):
    return _streamed(v, jobs.stream_dedupe, twice=True).select("stream_id", "message_id", "us")


_LATE = "(SELECT max(us) // 1000 - 3600000 FROM {}) * 1000"


@register("stream_trend", f"SELECT strftime(make_timestamp(us), '%Y-W%W') AS period, sentiment, CAST(count(*) AS BIGINT) AS n FROM t_messages WHERE (us // 86400000000 + 1) * 86400000000 <= {_LATE.format('t_messages')} GROUP BY ALL")
def _(v):
    days = _streamed(v, lambda s: jobs.stream_trend(s, "weekly"))
    return days.groupBy("period", "sentiment").agg(F.sum("n").alias("n"))


@register("stream_reactions", f"WITH a AS (SELECT s.segment_id, m.sentiment, m.us FROM t_segments s JOIN t_messages m ON s.stream_id = m.stream_id AND m.offset_ms >= s.start_ms AND m.offset_ms < s.end_ms AND NOT m.is_spam) SELECT segment_id, sentiment, us // 3600000000 AS hour, count(*) AS n FROM a WHERE (us // 3600000000 + 1) * 3600000000 <= {_LATE.format('a')} GROUP BY ALL")
def _(v):
    rows = _streamed(v, lambda s: jobs.stream_reactions(s, v("t_segments")))
    return rows.select("segment_id", "sentiment", F.floor(F.unix_micros("hour") / 3_600_000_000).alias("hour"), "n")


_CLOSED = _WINDOWS.replace("FROM t_messages)", f"FROM t_messages WHERE us < {_LATE.format('t_messages')})", 1)


@register("stream_greedy_windows", _CLOSED + f", z AS (SELECT stream_id, lo, window_index, min(us) AS start_us, max(us) AS end_us, count(*) AS messages FROM k GROUP BY ALL), o AS (SELECT stream_id, max(lo) AS lo FROM b GROUP BY 1) SELECT z.stream_id, z.window_index, start_us, end_us, messages FROM z JOIN o ON o.stream_id = z.stream_id WHERE z.lo < o.lo OR start_us + 86400000000 <= {_LATE.format('t_messages')}")
def _(v):
    return _streamed(v, lambda s: jobs.stream_greedy_windows(s, 20, 24 * 60, 3))


@register("stream_upsert", "SELECT stream_id, message_id, us FROM t_messages")
def _(v):
    m = v("t_messages").select("stream_id", "message_id", "author", "text", F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts"), "offset_ms", "sentiment", "is_spam", "event_id")
    spark = m.sparkSession
    source, target, state = (files.scratch(spark, n) for n in ("in", "table", "state"))
    for part in (m.where("event_id % 2 = 0"), m.where("event_id % 3 <> 0"), m):  # three polls that overlap
        part.drop("event_id").write.mode("append").json(source)
        jobs.stream_upsert(jobs.stream_messages(spark, source), target, state).awaitTermination()
    return merge.read(spark, f"{target}/messages").select("stream_id", "message_id", "us")
