"""Registry of the engine's own queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from airwave.functions import privacy, text
from airwave.operators import evaluation, filters, joins, lexicon, segment, stats, windows
from airwave.plans.testviews import duck, view

_Q: dict = {}
_SQL: dict = {}
SALT = "airwave"


def register(name: str, sql: str | None = None):
    def keep(f):
        _Q[name] = lambda spark, sf_dir: f(lambda v: view(spark, sf_dir, v))
        if sql:
            _SQL[name] = duck(sql)
        return f

    return keep


def queries():
    from airwave.plans import documents, lookups, models, reports, stories, tables  # noqa: F401  register their own

    return dict(_Q)


def oracle_sql():
    from airwave.plans import documents, lookups, models, reports, stories, tables  # noqa: F401  register their own

    return dict(_SQL)


_WINDOWS = """WITH RECURSIVE m AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY us, event_id) AS rn FROM t_messages),
nx AS (SELECT a.stream_id, a.rn, min(b.rn) AS nxt FROM m a LEFT JOIN m b ON a.stream_id = b.stream_id AND b.rn > a.rn AND (b.us >= a.us + 86400000000 OR b.rn >= a.rn + 20) GROUP BY ALL),
w AS (SELECT stream_id, CAST(1 AS BIGINT) AS rn FROM m WHERE rn = 1 UNION ALL SELECT w.stream_id, nx.nxt FROM w JOIN nx ON w.stream_id = nx.stream_id AND w.rn = nx.rn WHERE nx.nxt IS NOT NULL),
b AS (SELECT w.stream_id, w.rn AS lo, coalesce(lead(w.rn) OVER (PARTITION BY w.stream_id ORDER BY w.rn), 9000000000) AS hi FROM w),
g AS (SELECT m.stream_id, m.message_id, m.event_id, m.us, m.text, m.sentiment, b.lo, count(*) OVER (PARTITION BY m.stream_id, b.lo) AS size FROM m JOIN b ON m.stream_id = b.stream_id AND m.rn >= b.lo AND m.rn < b.hi),
k AS (SELECT *, dense_rank() OVER (PARTITION BY stream_id ORDER BY lo) - 1 AS window_index FROM g WHERE size >= 3) """


def _members(v):
    return windows.greedy_windows(v("t_messages"), 20, 24 * 60, 3)


@register("greedy_windows", _WINDOWS + "SELECT stream_id, message_id, window_index FROM k")
def _(v):
    return _members(v)


@register("window_sentiment", _WINDOWS + """, c AS (SELECT stream_id, window_index, count(*) AS messages, count(sentiment) AS scored, min(us) AS start_us, max(us) AS end_us,
 CAST(count(*) FILTER (sentiment = 'positive') AS DOUBLE) / count(sentiment) AS p, CAST(count(*) FILTER (sentiment = 'negative') AS DOUBLE) / count(sentiment) AS n, CAST(count(*) FILTER (sentiment = 'neutral') AS DOUBLE) / count(sentiment) AS u FROM k GROUP BY ALL)
SELECT stream_id, window_index, messages, scored, start_us, end_us,
 CASE WHEN scored = 0 OR p + n < 0.15 OR abs(p - n) < 0.04 THEN 'neutral' WHEN p > n THEN 'positive' ELSE 'negative' END AS sentiment,
 round(CASE WHEN scored = 0 THEN 1.0 WHEN p + n < 0.15 OR abs(p - n) < 0.04 THEN u ELSE greatest(p, n) / (p + n) END, 6) AS confidence FROM c""")
def _(v):
    return stats.window_sentiment(v("t_messages"), _members(v))


@register("window_documents", _WINDOWS + """SELECT stream_id, window_index, string_agg(text, chr(10) ORDER BY us, event_id) AS content, count(*) AS message_count, min(us) AS start_us, max(us) AS end_us, (max(us) - min(us)) // 1000 AS span_ms,
 CASE WHEN window_index % 2 = 0 THEN 'w' || CAST(window_index AS VARCHAR) || ' · b — ' ELSE '' END || CASE WHEN stream_id % 3 = 0 THEN 'Live chat' ELSE 'Stream ' || CAST(stream_id AS VARCHAR) END || CASE WHEN window_index % 2 = 0 THEN ' (' || strftime(make_timestamp(min(us)), '%d %b %H:%M') || ')' ELSE ' — ' || strftime(make_timestamp(min(us)), '%d %b %H:%M') || ' (' || CAST(count(*) AS VARCHAR) || ' messages)' END AS title, sha256(string_agg(text, chr(10) ORDER BY us, event_id)) AS content_hash FROM k GROUP BY stream_id, window_index""")
def _(v):
    members = _members(v)
    streams = v("t_messages").where("stream_id % 3 <> 0").select("stream_id", F.concat(F.lit("LIVE: Stream "), F.col("stream_id").cast("string")).alias("title")).distinct()
    words = members.where("window_index % 2 = 0").select("stream_id", "window_index", F.array(F.concat(F.lit("w"), F.col("window_index").cast("string")), F.lit("b")).alias("keywords")).distinct()
    return stats.window_documents(v("t_messages"), members, streams, words)


@register("window_messages", _WINDOWS + ", r AS (SELECT *, row_number() OVER (PARTITION BY stream_id, window_index ORDER BY us, event_id) AS rank FROM k) SELECT stream_id, window_index, message_id, rank FROM r WHERE rank <= 5")
def _(v):
    return filters.window_messages(v("t_messages"), _members(v), 5).select("stream_id", "window_index", "message_id", "rank")


@register("stream_rates", _WINDOWS + """, c AS (SELECT stream_id, count(*) AS messages, (max(us) - min(us)) / 60000000.0 AS minutes FROM t_messages GROUP BY 1), n AS (SELECT stream_id, count(DISTINCT window_index) AS windows, count(*) AS kept FROM k GROUP BY 1)
 SELECT c.stream_id, messages, round(CAST(minutes AS DOUBLE), 4) AS minutes, CASE WHEN minutes > 0 THEN round(CAST(messages AS DOUBLE) / minutes, 4) END AS per_minute, coalesce(windows, 0) AS windows, CASE WHEN windows > 0 THEN round(CAST(kept AS DOUBLE) / windows, 4) ELSE 0.0 END AS per_window FROM c LEFT JOIN n USING (stream_id)""")
def _(v):
    return stats.stream_rates(v("t_messages"), _members(v))


_AIR = "FROM t_segments s JOIN t_messages m ON s.stream_id = m.stream_id AND m.offset_ms >= s.start_ms AND m.offset_ms < s.end_ms AND NOT m.is_spam"


@register("chat_count_by_segment", f"SELECT s.segment_id, count(m.message_id) AS chat_count {_AIR.replace('JOIN', 'LEFT JOIN')} GROUP BY 1")
def _(v):
    return joins.chat_count_by_segment(v("t_messages"), v("t_segments"))


@register("segment_messages", f"SELECT s.segment_id, m.message_id, m.offset_ms {_AIR}")
def _(v):
    return joins.segment_messages(v("t_messages"), v("t_segments")).select("segment_id", "message_id", "offset_ms")


@register("bucketed_range_join", "SELECT s.segment_id, m.message_id FROM t_segments s JOIN t_messages m ON s.stream_id = m.stream_id AND m.offset_ms >= s.start_ms AND m.offset_ms < s.end_ms")
def _(v):
    return joins.bucketed_range_join(v("t_messages"), v("t_segments").drop("topic_ord"), "stream_id", "offset_ms", 3 * joins.DAY).select("segment_id", "message_id")


@register("reaction_overview", f"""WITH x AS (SELECT s.segment_id, count(m.message_id) AS total, count(*) FILTER (m.sentiment = 'positive') AS positive, count(*) FILTER (m.sentiment = 'neutral') AS neutral, count(*) FILTER (m.sentiment = 'negative') AS negative {_AIR.replace('JOIN', 'LEFT JOIN')} GROUP BY 1)
SELECT *, CASE WHEN greatest(positive, neutral, negative) = 0 THEN NULL WHEN (CASE WHEN positive = greatest(positive, neutral, negative) THEN 1 ELSE 0 END + CASE WHEN neutral = greatest(positive, neutral, negative) THEN 1 ELSE 0 END + CASE WHEN negative = greatest(positive, neutral, negative) THEN 1 ELSE 0 END) > 1 THEN 'mixed'
 WHEN positive = greatest(positive, neutral, negative) THEN 'positive' WHEN neutral = greatest(positive, neutral, negative) THEN 'neutral' ELSE 'negative' END AS mood FROM x""")
def _(v):
    return joins.reaction_overview(v("t_messages"), v("t_segments"))


#: words of a message that can be keywords, without "view" and "click"
_SAID = r"list_filter(regexp_extract_all(lower(regexp_replace(m.text, '@[A-Za-z0-9_.-]+', ' ', 'g')) || {more}, '[\p{{L}}\p{{M}}\p{{N}}]+'), lambda t: length(t) >= 2 AND NOT regexp_matches(t, '^\p{{Nd}}+$') AND regexp_matches(t, '[a-z]') AND t NOT IN ('view', 'click'))"
_MORE = _SAID.format(more="CASE WHEN m.event_id % 3 = 0 THEN ' ça va' ELSE '' END")


@register("reaction_words", f"WITH w AS (SELECT s.segment_id, unnest({_MORE}) AS word {_AIR}), c AS (SELECT segment_id, word, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY n DESC, word) AS rank FROM c) SELECT * FROM r WHERE rank <= 8")
def _(v):
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.upper("text"), F.lit(" <b>ÇA</b> &amp; va!!"))).otherwise(F.col("text"))
    return joins.reaction_words(v("t_messages").withColumn("text", said), v("t_segments"), stop=["view"], exclude=["click"])


@register("enrichment_plan", f"WITH c AS (SELECT s.segment_id, s.position, count(m.message_id) AS n {_AIR.replace('JOIN', 'LEFT JOIN')} GROUP BY ALL) SELECT segment_id, 'headline' AS kind FROM c WHERE position % 4 <> 0 UNION ALL SELECT segment_id, 'reaction' AS kind FROM c WHERE n >= 5 AND position % 3 <> 0")
def _(v):
    done = v("t_segments").withColumn("enriched_by", F.when(F.col("position") % 4 == 0, "llm").when(F.col("position") % 4 == 1, "rules")).withColumn("chat_summary", F.when(F.col("position") % 3 == 0, "said").when(F.col("position") % 3 == 1, " "))
    return joins.enrichment_plan(done, joins.chat_count_by_segment(v("t_messages"), v("t_segments")))


@register("segment_cards", """SELECT segment_id, end_ms - start_ms AS duration_ms, CAST(start_ms // 1000 // 3600 AS VARCHAR) || ':' || lpad(CAST(start_ms // 1000 // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(start_ms // 1000 % 60 AS VARCHAR), 2, '0') AS timecode, greatest(start_ms // 1000 - 2, 0) AS link_s,
 CASE WHEN length(d.text) > 600 THEN rtrim(substr(d.text, 1, 600)) || '…' ELSE d.text END AS preview, coalesce(t.slug, 'unknown') AS label, CASE WHEN t.ord IS NULL THEN '#94a3b8' ELSE '#' || lpad(CAST(t.ord * 60000 AS VARCHAR), 6, '0') END AS colour
 FROM t_segments s JOIN documents d ON d.doc_id = s.stream_id LEFT JOIN t_taxonomy t ON t.ord = s.topic_ord AND t.ord < 12""")
def _(v):
    colours = v("t_taxonomy").where("ord < 12").withColumn("colour", F.concat(F.lit("#"), F.lpad((F.col("ord") * 60000).cast("string"), 6, "0")))
    text_of = v("t_documents").select(F.col("id").alias("stream_id"), F.col("content").alias("text"))
    return filters.segment_cards(v("t_segments").join(text_of, "stream_id"), colours)


@register("segment_listing", "SELECT segment_id, start_ms, (SELECT count(*) FROM t_segments WHERE topic_ord = 3) AS total FROM t_segments WHERE topic_ord = 3 ORDER BY stream_id, start_ms LIMIT 50 OFFSET 10")
def _(v):
    return filters.segment_listing(v("t_segments"), topic=3, limit=50, offset=10).select("segment_id", "start_ms", "total")


@register("explore", "SELECT id, sentiment_confidence, (SELECT count(*) FROM t_documents WHERE sentiment = 'positive' AND sentiment_confidence >= 0.2) AS total FROM t_documents WHERE sentiment = 'positive' AND sentiment_confidence >= 0.2 ORDER BY sentiment_confidence DESC, id LIMIT 20 OFFSET 20")
def _(v):
    return filters.explore(v("t_documents"), sentiment="positive", min_confidence=0.2, sort="confidence", page=2).select("id", "sentiment_confidence", "total")


@register("search_literal", "SELECT id FROM t_documents WHERE contains(lower(title), '%') OR contains(lower(content), '%') OR contains(lower(source || ' %5 ' || CAST(id % 11 AS VARCHAR)), '%5 1')")
def _(v):
    docs = v("t_documents")
    summary = F.concat("source", F.lit(" %5 "), (F.col("id") % 11).cast("string"))
    by_text = filters.search_literal(docs, " % ").select("id")
    by_summary = filters.search_literal(docs.withColumn("summary", summary), " %5 1 ").select("id")
    return by_text.union(by_summary).distinct()


@register("unclear_predictions", "SELECT message_id, sentiment, sentiment_confidence IS NULL OR sentiment_confidence < 0.5 AS unclear FROM t_messages")
def _(v):
    return filters.unclear(v("t_messages")).select("message_id", "sentiment", "unclear")


@register("upsert_messages", "SELECT stream_id, message_id, count(*) AS n FROM t_messages GROUP BY ALL")
def _(v):
    m = v("t_messages")
    both = filters.upsert_messages(m.where("event_id % 3 <> 0"), m.where("event_id % 2 = 0 OR event_id % 3 = 0").union(m.where("event_id % 4 = 0")))
    return both.groupBy("stream_id", "message_id").agg(F.count("*").alias("n"))


@register("upsert_streams", """WITH s AS (SELECT DISTINCT stream_id FROM t_messages), x AS (SELECT *, stream_id % 3 <> 0 AS o, stream_id % 2 = 0 AS n FROM s) SELECT stream_id, CASE WHEN n AND stream_id % 4 <> 0 THEN 'new' WHEN o THEN 'old' END AS title, CASE WHEN n THEN 'poll' ELSE 'file' END AS collector,
 CASE WHEN n AND stream_id % 10 <> 0 THEN 'u2' WHEN o THEN 'u1' END AS url, CASE WHEN o THEN 'c' || CAST(stream_id AS VARCHAR) END AS channel, CASE WHEN n THEN stream_id % 8 = 0 ELSE true END AS is_live FROM x WHERE o OR n""")
def _(v):
    s = v("t_messages").select("stream_id").distinct()
    old = s.where("stream_id % 3 <> 0").selectExpr("stream_id", "'old' AS title", "'file' AS collector", "'u1' AS url", "'c' || cast(stream_id as string) AS channel", "true AS is_live")
    new = s.where("stream_id % 2 = 0").selectExpr("stream_id", "if(stream_id % 4 = 0, '', 'new') AS title", "'poll' AS collector", "if(stream_id % 10 = 0, null, 'u2') AS url", "stream_id % 8 = 0 AS is_live")
    return filters.upsert_streams(old, new)


@register("delete_documents", "SELECT doc_id AS id, CASE WHEN doc_id % 5 <> 0 THEN doc_id END AS news_id FROM documents")
def _(v):
    d = v("t_documents").select("id")
    members = d.withColumn("news_id", F.col("id")).withColumnRenamed("id", "member")
    return filters.delete_documents(d, members, d.where("id % 5 = 0"))[1].select(F.col("member").alias("id"), "news_id")


@register("dedupe_documents", "SELECT sha256(content) AS content_hash, min(id) AS id FROM t_documents GROUP BY 1")
def _(v):
    return filters.dedupe_documents(v("t_documents"))


@register("dedupe_entities", "SELECT doc_id, token AS text, CASE WHEN pos % 3 = 0 THEN 'PERSON' ELSE 'LOCATION' END AS label, min(pos) AS pos FROM t_tokens GROUP BY ALL")
def _(v):
    label = F.when(F.col("pos") % 3 == 0, "PERSON").otherwise("LOCATION")
    return filters.dedupe_entities(v("t_tokens").select("doc_id", F.col("token").alias("text"), label.alias("label"), "pos"))


@register("validate_labelled", """WITH r AS (SELECT *, min(id) OVER (PARTITION BY title) AS ft, min(id) OVER (PARTITION BY content) AS fc FROM t_documents)
SELECT id, 'empty title' AS problem, CAST(NULL AS BIGINT) AS first_id FROM r WHERE trim(title) = '' UNION ALL SELECT id, 'short content', NULL FROM r WHERE length(content) < 40
UNION ALL SELECT id, 'unknown topic', NULL FROM r WHERE topic_ord > 12 UNION ALL SELECT id, 'unknown sentiment', NULL FROM r WHERE sentiment = 'neutral'
UNION ALL SELECT id, 'duplicate title', ft FROM r WHERE id <> ft UNION ALL SELECT id, 'duplicate content', fc FROM r WHERE id <> fc""")
def _(v):
    rows = v("t_documents").select("id", "title", "content", F.col("topic_ord").alias("topic"), "sentiment")
    return filters.validate_labelled(rows, [*range(13)], ["positive", "negative"])


@register("dashboard_totals", """SELECT d.*, m.*, t.topic_ord AS top_topic, t.n AS top_count FROM
(SELECT count(*) AS documents, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) FILTER (sentiment = 'negative') AS negative, count(*) FILTER (source_type = 'chat_window') AS chat_windows, count(*) FILTER (source_type = 'article') AS articles, round(avg(topic_confidence), 4) AS avg_topic_confidence, round(avg(sentiment_confidence), 4) AS avg_sentiment_confidence FROM t_documents) d,
(SELECT count(*) AS messages, count(sentiment) AS scored, count(*) FILTER (is_spam) AS noise, count(DISTINCT stream_id) AS streams FROM t_messages) m,
(SELECT topic_ord, count(*) AS n FROM t_documents GROUP BY 1 ORDER BY n DESC, topic_ord LIMIT 1) t""")
def _(v):
    return stats.dashboard_totals(v("t_documents"), v("t_messages"))


@register("by_topic", "SELECT t.ord, t.slug, count(d.id) AS n FROM t_taxonomy t LEFT JOIN t_documents d ON d.topic_ord = t.ord GROUP BY ALL")
def _(v):
    return stats.zero_fill(v("t_taxonomy"), v("t_documents"), "topic_ord")


@register("by_sentiment", "SELECT CAST(s.ord AS INT) AS ord, s.sentiment, count(d.id) AS n, coalesce(round(count(d.id) * 100.0 / (SELECT count(*) FROM t_documents WHERE sentiment <> 'neutral'), 1), 0)::DOUBLE AS percentage FROM (VALUES (0, 'positive'), (1, 'neutral'), (2, 'negative')) s(ord, sentiment) LEFT JOIN t_documents d ON d.sentiment = s.sentiment AND d.sentiment <> 'neutral' GROUP BY ALL")
def _(v):
    return stats.by_sentiment(v("t_documents").where("sentiment <> 'neutral'"))


@register("topic_sentiment", "SELECT topic_ord, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) FILTER (sentiment = 'negative') AS negative, count(*) AS total FROM t_documents GROUP BY 1")
def _(v):
    return stats.topic_sentiment(v("t_documents"))


for _name, _format in (("daily", "%Y-%m-%d"), ("weekly", "%Y-W%W"), ("monthly", "%Y-%m")):

    @register(f"trend_{_name}", _trend_sql := f"SELECT strftime(published_at, '{_format}') AS period, count(*) AS total, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) FILTER (sentiment = 'negative') AS negative FROM t_documents GROUP BY 1")
    def _(v, name=_name):
        return stats.trend(v("t_documents"), name)


@register("trend", _trend_sql)
def _(v):
    return stats.trend(v("t_documents"), "monthly")


@register("keyword_cloud", "SELECT token AS word, count(*) AS count, CAST(max(pos) AS DOUBLE) AS score FROM (SELECT doc_id, token, max(pos) AS pos FROM t_tokens GROUP BY ALL) JOIN t_documents ON id = doc_id WHERE topic_ord = 4 GROUP BY 1 ORDER BY count DESC, word LIMIT 40")
def _(v):
    words = v("t_tokens").groupBy("doc_id", F.col("token").alias("word")).agg(F.max("pos").cast("double").alias("score"))
    return stats.keyword_cloud(words.join(v("t_documents").select(F.col("id").alias("doc_id"), "topic_ord"), "doc_id"), topic=4)


@register("stream_counters", "SELECT stream_id, count(*) AS message_count, min(us) AS first_us, max(us) AS last_us FROM t_messages GROUP BY 1")
def _(v):
    return stats.stream_counters(v("t_messages"))


@register("streams_by_size", "SELECT stream_id, count(*) AS message_count FROM t_messages GROUP BY 1 ORDER BY message_count DESC, stream_id LIMIT 25")
def _(v):
    return stats.stream_counters(v("t_messages")).orderBy(F.desc("message_count"), "stream_id").limit(25).select("stream_id", "message_count")


@register("ingest_report", _WINDOWS + """, ws AS (SELECT stream_id, count(DISTINCT window_index) AS windows FROM k GROUP BY 1), p AS (SELECT stream_id, count(*) AS messages, count(*) FILTER (NOT is_spam) AS scored, count(*) FILTER (is_spam) AS skipped FROM t_messages GROUP BY 1)
 SELECT p.stream_id, CAST(sum(messages) AS BIGINT) AS messages, CAST(sum(scored) AS BIGINT) AS scored, CAST(sum(skipped) AS BIGINT) AS skipped, CAST(sum(coalesce(windows, 0)) AS BIGINT) AS windows, count(*) AS streams FROM p LEFT JOIN ws ON p.stream_id = ws.stream_id GROUP BY ROLLUP (p.stream_id)""")
def _(v):
    return stats.ingest_report(v("t_messages"), _members(v))


@register("fit_idf", "SELECT token AS term, count(DISTINCT doc_id) AS df FROM t_tokens GROUP BY 1")
def _(v):
    return stats.fit_idf(v("t_tokens"))


def _candidates(v):
    """(doc_id, tokens, title_tokens) with the tokens that may become keywords."""
    t = lambda c: F.filter(text.tokenize(F.col(c)), lambda x: F.length(x) >= 2)
    return v("t_documents").select(F.col("id").alias("doc_id"), t("content").alias("tokens"), t("title").alias("title_tokens"))


_TFIDF = """WITH t AS (SELECT doc_id, token FROM t_tokens WHERE length(token) >= 2), h AS (SELECT DISTINCT id AS doc_id, unnest(regexp_extract_all(lower(title), '[\\p{L}\\p{M}\\p{N}]+|\\p{So}')) AS token FROM t_documents),
tf AS (SELECT doc_id, token, count(*) AS occ FROM t GROUP BY ALL), per AS (SELECT doc_id, sum(occ) AS total FROM tf GROUP BY 1), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM t_documents),
s AS (SELECT tf.doc_id, tf.token, round(CAST(occ AS DOUBLE) / total * {weight} * CASE WHEN h.token IS NULL THEN 1.0 ELSE CAST(1.6 AS DOUBLE) END, 6) AS score FROM tf JOIN df USING (token) JOIN per ON tf.doc_id = per.doc_id LEFT JOIN h ON h.doc_id = tf.doc_id AND h.token = tf.token, n),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, token) AS rank FROM s) """
_FITTED = _TFIDF.replace("{weight}", "(ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1)")


def _keywords(v, k=10):
    idf = stats.fit_idf(v("t_tokens").where("length(token) >= 2"))
    return stats.tfidf_keywords(_candidates(v), idf, v("t_documents").count(), k)


@register("tfidf_keywords", _FITTED + "SELECT doc_id, token, score, rank FROM r WHERE rank <= 10")
def _(v):
    return _keywords(v).select("doc_id", "token", "score", "rank")


@register("top_keywords_per_doc", _TFIDF.replace("{weight}", "(1 + least(length(tf.token), 12) / CAST(12 AS DOUBLE))") + "SELECT doc_id, token, score, rank FROM r WHERE rank <= 3")
def _(v):
    return stats.tfidf_keywords(_candidates(v), None, k=3).select("doc_id", "token", "score", "rank")


def _arrays(v):
    """(doc_id, tokens) of every document."""
    return v("t_documents").select(F.col("id").alias("doc_id"), text.tokenize(F.col("content")).alias("tokens"))


def _matches(v):
    return lexicon.term_matches(_arrays(v), v("t_terms"))


@register("gazetteer_topic", """WITH h AS (SELECT doc_id, topic_ord, sum(CAST(weight AS DECIMAL(18, 6))) AS score FROM t_tokens JOIN t_terms ON token = term GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, topic_ord) AS r, sum(score) OVER (PARTITION BY doc_id) AS total, coalesce(sum(CASE WHEN topic_ord = 5 THEN score END) OVER (PARTITION BY doc_id), 0) AS own FROM h)
SELECT d.id AS doc_id, CAST(CASE WHEN b.score IS NULL OR b.score < 30.9 THEN 5 ELSE b.topic_ord END AS INT) AS topic_ord, CASE WHEN b.score IS NULL THEN CAST(1 AS DOUBLE) ELSE (CAST(CASE WHEN b.score < 30.9 THEN b.own ELSE b.score END AS DOUBLE) + CAST(0.02 AS DOUBLE)) / (CAST(b.total AS DOUBLE) + CAST(0.3 AS DOUBLE)) END AS confidence FROM t_documents d LEFT JOIN b ON d.id = b.doc_id AND b.r = 1""")
def _(v):
    docs = v("t_documents").select(F.col("id").alias("doc_id"))
    return stats.gazetteer_topic(docs, lexicon.term_counts(_arrays(v), v("t_terms")), v("t_terms"), least=30.9, fallback=5)


_FACTOR = "CASE token " + " ".join(f"WHEN '{w}' THEN {x}" for w, x in lexicon.MODIFIERS.items()) + " ELSE 1.0 END"
_NO = ", ".join(f"'{w}'" for w in lexicon.NEGATORS)
#: the test view's terms are single words, so that no token lies inside a match
_EVIDENCE = f"""WITH f AS (SELECT t.doc_id, t.pos, t.token, m.term, m.polarity AS base, CAST({_FACTOR} AS DOUBLE) AS factor FROM t_tokens t LEFT JOIN t_terms m ON t.token = m.term),
g AS (SELECT *, count(term) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nth, max(CASE WHEN term IS NULL AND token IN ({_NO}) THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS no_at, coalesce(lead(factor) OVER (PARTITION BY doc_id ORDER BY pos), 1) AS after FROM f),
p AS (SELECT *, product(CASE WHEN term IS NULL THEN factor ELSE 1 END) OVER (PARTITION BY doc_id, nth ORDER BY pos) * after AS m FROM g),
e AS (SELECT doc_id, pos, term, base, coalesce(pos <= no_at + 3, false) AS negated, round(m, 6) AS multiplier, round(base * round(m, 6) * CASE WHEN coalesce(pos <= no_at + 3, false) THEN CAST(-0.8 AS DOUBLE) ELSE 1 END, 6) AS score FROM p WHERE term IS NOT NULL) """


def _evidence(v):
    return lexicon.sentiment_evidence(_arrays(v), v("t_terms"))


@register("sentiment_evidence", _EVIDENCE + "SELECT * FROM e")
def _(v):
    return _evidence(v)


@register("lexicon_sentiment", _EVIDENCE + """, t AS (SELECT doc_id, round(sum(score), 6) + 0.0::DOUBLE AS total FROM e GROUP BY 1), w AS (SELECT doc_id, count(*) AS words FROM t_tokens GROUP BY 1),
d AS (SELECT id AS doc_id, coalesce(words, 0) AS words, coalesce(total, 0) AS total FROM t_documents LEFT JOIN w ON w.doc_id = id LEFT JOIN t ON t.doc_id = id),
l AS (SELECT *, 1.6 * total AS a, 1.6 * 1.4 * (0.35 - abs(total)) AS b, -1.6 * total AS c, greatest(1.6 * total, 1.6 * 1.4 * (0.35 - abs(total)), -1.6 * total) AS z FROM d),
x AS (SELECT doc_id, total, CASE WHEN abs(total) < 0.35 THEN 'neutral' WHEN total > 0 THEN 'positive' ELSE 'negative' END AS sentiment, CASE WHEN words > 0 THEN round(exp(a - z) / (exp(a - z) + exp(b - z) + exp(c - z)), 6) ELSE 0 END AS positive, CASE WHEN words > 0 THEN round(exp(b - z) / (exp(a - z) + exp(b - z) + exp(c - z)), 6) ELSE 1 END AS neutral, CASE WHEN words > 0 THEN round(exp(c - z) / (exp(a - z) + exp(b - z) + exp(c - z)), 6) ELSE 0 END AS negative FROM l)
SELECT *, CASE sentiment WHEN 'positive' THEN positive WHEN 'neutral' THEN neutral ELSE negative END AS confidence FROM x""")
def _(v):
    docs = v("t_documents").select(F.col("id").alias("doc_id"), F.size(text.tokenize(F.col("content"))).alias("words"))
    return lexicon.lexicon_sentiment(docs, _evidence(v))


_ENDS = """WITH e AS (SELECT *, greatest(least(least(coalesce(lead(start_ms) OVER (PARTITION BY video_id ORDER BY start_ms, cue_idx), start_ms + greatest(duration_ms, 1000)), start_ms + duration_ms), start_ms + 10000), start_ms) AS end_ms FROM t_cues) """


def _cues(v):
    return windows.resolve_cue_ends(v("t_cues"))


@register("resolve_cue_ends", _ENDS + "SELECT video_id, cue_idx, start_ms, end_ms FROM e")
def _(v):
    return _cues(v).select("video_id", "cue_idx", "start_ms", "end_ms")


_BLOCKS = _ENDS + """, o AS (SELECT *, unnest(range(start_ms // 30000, (end_ms - 1) // 30000 + 1)) AS block FROM e),
said AS (SELECT video_id, block, coalesce(string_agg(text, '' ORDER BY cue_idx) FILTER (NOT non_speech), '') AS text, CAST(sum(CASE WHEN non_speech THEN end_ms - start_ms ELSE 0 END) AS BIGINT) AS non_speech_ms FROM o GROUP BY ALL),
fin AS (SELECT video_id, max(end_ms) AS fin FROM e GROUP BY 1 HAVING max(end_ms) > 0), grid AS (SELECT video_id, fin, unnest(range(0, (fin - 1) // 30000 + 1)) AS block FROM fin),
b AS (SELECT g.video_id, g.block, g.block * 30000 AS start_ms, least(g.block * 30000 + 30000, fin) AS end_ms, coalesce(s.text, '') AS text, CAST(length(coalesce(s.text, '')) AS INT) AS chars, coalesce(s.non_speech_ms, 0) AS non_speech_ms, length(coalesce(s.text, '')) >= 40 AS usable FROM grid g LEFT JOIN said s ON s.video_id = g.video_id AND s.block = g.block) """


@register("cue_block_overlap", _BLOCKS + "SELECT video_id, cue_idx, block FROM o")
def _(v):
    return joins.cue_block_overlap(_cues(v)).select("video_id", "cue_idx", "block")


@register("build_blocks", _BLOCKS + "SELECT * FROM b")
def _(v):
    return segment.build_blocks(_cues(v))


@register("music_gaps", _BLOCKS + "SELECT video_id, block FROM b WHERE block > 0 AND non_speech_ms >= 4000")
def _(v):
    return segment.music_gaps(segment.build_blocks(_cues(v))).select("video_id", "block")


@register("transcript_facts", _ENDS + "SELECT video_id, count(*) AS cue_count, CAST(sum(CASE WHEN non_speech THEN 0 ELSE length(text) END) AS BIGINT) AS speech_chars, CAST(sum(CASE WHEN non_speech THEN 0 ELSE end_ms - start_ms END) AS BIGINT) AS covered_ms, max(end_ms) AS duration_ms FROM e GROUP BY 1")
def _(v):
    return segment.transcript_facts(_cues(v))


@register("cue_start_offsets", "SELECT video_id, cue_idx, CAST(coalesce(sum(length(text)) OVER (PARTITION BY video_id ORDER BY cue_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM t_cues WHERE NOT non_speech")
def _(v):
    return segment.cue_start_offsets(v("t_cues"))


def _terms(v):
    return v("t_tokens").where("length(token) > 1").select(F.col("doc_id").alias("video_id"), F.floor(F.col("pos") / 20).alias("block"), F.col("token").alias("term"))


def _grid(v):
    last = v("t_tokens").groupBy(F.col("doc_id").alias("video_id")).agg(F.max(F.floor(F.col("pos") / 20)).alias("_last"))
    return last.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("block"))


#: similarities h of counts c (video_id, block, term, n) over the gaps gr (video_id, gap)
_SIMILAR = """s AS (SELECT video_id, term, n, block + k AS gap, 1 AS side FROM c, (VALUES (1), (2), (3)) x(k) UNION ALL SELECT video_id, term, n, block - k AS gap, 0 AS side FROM c, (VALUES (0), (1), (2)) x(k)),
f AS (SELECT video_id, gap, term, sum(n * side) AS l, sum(n * (1 - side)) AS r FROM s GROUP BY ALL),
y AS (SELECT video_id, gap, round(CASE WHEN sum(l * l) > 0 AND sum(r * r) > 0 THEN CAST(sum(l * r) AS DOUBLE) / sqrt(CAST(sum(l * l) AS DOUBLE) * CAST(sum(r * r) AS DOUBLE)) ELSE 0 END, 6) AS similarity FROM f GROUP BY ALL),
h AS (SELECT gr.video_id, gr.gap, CASE WHEN gr.gap = 0 THEN CAST(1 AS DOUBLE) ELSE coalesce(y.similarity, 0) END AS similarity FROM gr LEFT JOIN y ON y.video_id = gr.video_id AND y.gap = gr.gap) """
_COHESION = """WITH c AS (SELECT doc_id AS video_id, pos // 20 AS block, token AS term, count(*) AS n FROM t_tokens WHERE length(token) > 1 GROUP BY ALL), z AS (SELECT doc_id AS video_id, max(pos // 20) AS last FROM t_tokens GROUP BY 1),
gr AS (SELECT video_id, unnest(range(0, last + 1)) AS gap FROM z), """ + _SIMILAR


@register("cohesion", _COHESION + "SELECT video_id, gap, similarity FROM h")
def _(v):
    return segment.cohesion(_grid(v), _terms(v))


_DEEP = """q AS (SELECT *, lag(similarity) OVER w AS lg, lead(similarity) OVER w AS ld FROM h WINDOW w AS (PARTITION BY video_id ORDER BY gap)),
g AS (SELECT *, sum(CASE WHEN lg < similarity THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY gap) AS lb, sum(CASE WHEN ld < similarity THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY gap DESC) AS rb FROM q),
d AS (SELECT video_id, gap, round(CASE WHEN lg IS NULL OR ld IS NULL THEN 0 ELSE first_value(similarity) OVER (PARTITION BY video_id, lb ORDER BY gap) + first_value(similarity) OVER (PARTITION BY video_id, rb ORDER BY gap DESC) - 2 * similarity END, 6) AS depth FROM g),
cutoff AS (SELECT video_id, avg(depth) + 0.5 * stddev_pop(depth) AS cut FROM d WHERE depth > 0 GROUP BY 1), dips AS (SELECT d.video_id, gap, depth FROM d JOIN cutoff l ON d.video_id = l.video_id WHERE depth >= cut - 1e-9 AND depth > 0 AND gap > 0) """
_DEPTH = _COHESION + ", " + _DEEP


@register("depth_scores", _DEPTH + "SELECT video_id, gap, depth FROM d")
def _(v):
    return windows.depth_scores(segment.cohesion(_grid(v), _terms(v))).select("video_id", "gap", F.round("depth", 6).alias("depth"))


@register("depth_cutoff", _DEPTH + "SELECT video_id, gap, depth FROM dips")
def _(v):
    d = windows.depth_scores(segment.cohesion(_grid(v), _terms(v))).withColumn("depth", F.round("depth", 6))
    return windows.depth_cutoff(d).select("video_id", "gap", "depth")


_LABELS = "WITH l AS (SELECT stream_id, us, event_id, CASE sentiment WHEN 'positive' THEN 2 WHEN 'neutral' THEN 1 ELSE 0 END AS label, row_number() OVER (PARTITION BY stream_id ORDER BY us, event_id) AS rn FROM t_messages), s AS (SELECT stream_id, rn, CASE WHEN lag(label) OVER w = lead(label) OVER w AND label <> lag(label) OVER w THEN lag(label) OVER w ELSE label END AS smoothed FROM l WINDOW w AS (PARTITION BY stream_id ORDER BY rn)) "


def _smoothed(v):
    label = F.when(F.col("sentiment") == "positive", 2).when(F.col("sentiment") == "neutral", 1).otherwise(0)
    rows = v("t_messages").withColumn("label", label).withColumn("rn", F.row_number().over(W.partitionBy("stream_id").orderBy("us", "event_id")))
    return windows.smooth_labels(rows, "stream_id", "rn", "label").select("stream_id", "rn", "smoothed")


@register("smooth_labels", _LABELS + "SELECT stream_id, rn, smoothed FROM s")
def _(v):
    return _smoothed(v)


@register("label_changes", _LABELS + ", c AS (SELECT *, lag(smoothed) OVER w AS b, lead(smoothed) OVER w AS a FROM s WINDOW w AS (PARTITION BY stream_id ORDER BY rn)) SELECT stream_id, rn, smoothed FROM c WHERE smoothed <> b AND smoothed = a")
def _(v):
    return windows.label_changes(_smoothed(v), "stream_id", "rn")


@register("label_by_majority", "WITH c AS (SELECT user_id AS stream_id, CAST(event_id % 7 AS INT) AS label, count(*) AS votes FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY votes DESC, label) AS k FROM c) SELECT stream_id, label, votes FROM r WHERE k = 1")
def _(v):
    return windows.majority(v("t_messages").select("stream_id", (F.col("event_id") % 7).cast("int").alias("label")), "stream_id", "label")


@register("stratified_sample", "WITH h AS (SELECT *, md5('0:' || CAST(id AS VARCHAR)) AS h FROM t_predictions), c AS (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY h, id) AS c FROM h) SELECT id, y_true FROM c ORDER BY CASE WHEN c > 3 THEN 1 ELSE 0 END, h, id LIMIT 50")
def _(v):
    return windows.stratified_sample(v("t_predictions"), "y_true").select("id", "y_true")


@register("stratified_folds", "SELECT id, CAST((row_number() OVER (PARTITION BY y_true ORDER BY md5(CAST(id AS VARCHAR)), id) - 1) % 5 AS INT) AS fold FROM t_predictions")
def _(v):
    return windows.stratified_folds(v("t_predictions"), "y_true").select("id", F.col("fold").cast("int").alias("fold"))


@register("stratified_split", "SELECT id, row_number() OVER (PARTITION BY y_true ORDER BY md5(CAST(id AS VARCHAR)), id) <= floor(count(*) OVER (PARTITION BY y_true) * 0.2 + 0.5) AS is_test FROM t_predictions")
def _(v):
    return windows.stratified_split(v("t_predictions"), "y_true").select("id", "is_test")


_CONFUSION = "WITH g AS (SELECT CAST(a AS INT) AS actual, CAST(p AS INT) AS predicted FROM range(2) x(a), range(2) y(p)), m AS (SELECT g.actual, g.predicted, count(t.id) AS n FROM g LEFT JOIN t_predictions t ON t.y_true = g.actual AND t.y_a = g.predicted GROUP BY ALL) "


@register("confusion_matrix", _CONFUSION + "SELECT * FROM m")
def _(v):
    return evaluation.confusion_matrix(v("t_predictions"), "y_true", "y_a", [0, 1])


_METRICS = """, a AS (SELECT actual AS label, sum(n) AS support, sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS tp FROM m GROUP BY 1), p AS (SELECT predicted AS label, sum(n) AS guessed FROM m GROUP BY 1), x AS (SELECT a.label, support, tp, CASE WHEN guessed > 0 THEN CAST(tp AS DOUBLE) / guessed ELSE 0 END AS pr, CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0 END AS re FROM a JOIN p ON a.label = p.label),
 y AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f FROM x)
SELECT CAST(label AS VARCHAR) AS label, CAST(support AS BIGINT) AS support, round(pr, 6) AS precision, round(re, 6) AS recall, round(f, 6) AS f1 FROM y
UNION ALL SELECT 'accuracy', CAST(sum(support) AS BIGINT), NULL, round(CAST(sum(tp) AS DOUBLE) / sum(support), 6), NULL FROM y
UNION ALL SELECT 'macro', CAST(sum(support) AS BIGINT), round(avg(pr), 6), round(avg(re), 6), round(avg(f), 6) FROM y
UNION ALL SELECT 'weighted', CAST(sum(support) AS BIGINT), round(sum(pr * support) / sum(support), 6), round(sum(re * support) / sum(support), 6), round(sum(f * support) / sum(support), 6) FROM y"""


@register("classification_metrics", _CONFUSION + _METRICS)
def _(v):
    return evaluation.classification_metrics(evaluation.confusion_matrix(v("t_predictions"), "y_true", "y_a", [0, 1]))


@register("model_leaderboard", """WITH u AS (SELECT 'a' AS model, y_true AS actual, y_a AS predicted FROM t_predictions UNION ALL SELECT 'b', y_true, y_b FROM t_predictions), l AS (SELECT model, actual AS label, count(*) AS support, count(*) FILTER (actual = predicted) AS tp FROM u GROUP BY ALL), p AS (SELECT model, predicted AS label, count(*) AS guessed FROM u GROUP BY ALL),
 b AS (SELECT l.model, CAST(sum(tp) AS DOUBLE) / sum(support) AS acc, avg(2.0 * tp / (support + coalesce(guessed, 0)))::DOUBLE AS f, CAST(sum(support) AS BIGINT) AS rows FROM l LEFT JOIN p ON l.model = p.model AND l.label = p.label GROUP BY 1)
SELECT model, round(acc, 6) AS accuracy, round(f, 6) AS macro_f1, rows, CAST(0.5 AS DOUBLE) AS baseline, round(acc - 0.5, 6) AS gain, model = 'b' AS active FROM b""")
def _(v):
    t = v("t_predictions")
    one = lambda m: t.select(F.lit(m).alias("model"), F.col("y_true").alias("actual"), F.col(f"y_{m}").alias("predicted"))
    return evaluation.leaderboard(one("a").unionByName(one("b")), 2, active="b")


_COMP = "SELECT count(*) FILTER (y_a = y_true AND y_b = y_true) AS both, count(*) FILTER (y_a = y_true AND y_b <> y_true) AS only_a, count(*) FILTER (y_a <> y_true AND y_b = y_true) AS only_b, count(*) FILTER (y_a <> y_true AND y_b <> y_true) AS neither, round(CAST(count(*) FILTER (y_a = y_true OR y_b = y_true) AS DOUBLE) / count(*), 6) AS ceiling FROM t_predictions"


@register("complementarity", _COMP)
def _(v):
    return evaluation.complementarity(v("t_predictions"))


#: fixed values: coefficients of a published polynomial for the complementary error function (error below 2e-7)
_ERFC = "exp(-z * z) * (0.254829592 * u - 0.284496736 * pow(u, 2) + 1.421413741 * pow(u, 3) - 1.453152027 * pow(u, 4) + 1.061405429 * pow(u, 5))"


_EXACT = "least(1.0, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1), lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1)))) / pow(2, only_a + only_b))"


@register("mcnemar", f"""WITH g AS (SELECT id % 8 AS part, y_true, y_a, y_b FROM t_predictions UNION ALL SELECT -1, y_true, y_a, y_b FROM t_predictions), c AS (SELECT part, count(*) FILTER (y_a = y_true AND y_b <> y_true) AS only_a, count(*) FILTER (y_b = y_true AND y_a <> y_true) AS only_b FROM g GROUP BY part),
 s AS (SELECT *, CASE WHEN only_a + only_b > 0 THEN pow(greatest(abs(only_a - only_b) - 1, 0), 2) / (only_a + only_b) ELSE 0.0 END AS x FROM c), z AS (SELECT *, sqrt(x / 2) AS z, 1 / (1 + 0.3275911 * sqrt(x / 2)) AS u FROM s)
 SELECT part, only_a, only_b, round(x, 6) AS statistic, round(CASE WHEN only_a + only_b < 25 THEN {_EXACT} ELSE {_ERFC} END, 6) AS p_value FROM z""")
def _(v):
    parts = v("t_predictions").withColumn("part", F.explode(F.array(F.col("id") % 8, F.lit(-1).cast("bigint"))))
    return evaluation.mcnemar(parts, "part")


@register("confidence_bands", """WITH b AS (SELECT CAST(CASE WHEN confidence_a < 0.4 THEN 0 WHEN confidence_a < 0.6 THEN 1 WHEN confidence_a < 0.8 THEN 2 ELSE 3 END AS INT) AS band, count(*) AS n, count(*) FILTER (y_a = y_true) AS k FROM t_predictions GROUP BY 1)
 SELECT band, n, round(CAST(k AS DOUBLE) / n, 6) AS accuracy, round(CAST(n AS DOUBLE) / sum(n) OVER (), 6) AS share, round(CAST(sum(n) OVER w AS DOUBLE) / sum(n) OVER (), 6) AS coverage, round(CAST(sum(k) OVER w AS DOUBLE) / sum(n) OVER w, 6) AS kept_accuracy FROM b WINDOW w AS (ORDER BY band DESC)""")
def _(v):
    return evaluation.confidence_bands(v("t_predictions"))


@register("label_distribution", """WITH t AS (SELECT y_true AS label, count(*) AS actual FROM t_predictions GROUP BY 1), p AS (SELECT y_a AS label, count(*) AS predicted FROM t_predictions GROUP BY 1), j AS (SELECT coalesce(t.label, p.label) AS label, coalesce(actual, 0) AS actual, coalesce(predicted, 0) AS predicted FROM t FULL JOIN p ON t.label = p.label)
 SELECT *, count(*) FILTER (predicted > 0) OVER () AS distinct_predicted, count(*) FILTER (predicted > 0) OVER () <= greatest(1, count(*) FILTER (actual > 0) OVER () // 3) AS collapsed FROM j""")
def _(v):
    return evaluation.label_distribution(v("t_predictions"))


@register("blend", """WITH r AS (SELECT id, k AS label, round(0.85 * CASE WHEN y_a = k THEN confidence_a ELSE 1 - confidence_a END + (1 - 0.85) * CASE WHEN y_b = k THEN 0.7 ELSE 0.3 END, 9) AS p FROM t_predictions, (VALUES (0), (1)) x(k)), s AS (SELECT *, sum(p) OVER (PARTITION BY id) AS s, row_number() OVER (PARTITION BY id ORDER BY p DESC, label) AS k FROM r)
SELECT id, label, round(p / s, 6) AS confidence FROM s WHERE k = 1""")
def _(v):
    t = v("t_predictions").withColumn("label", F.explode(F.array(F.lit(0), F.lit(1))))
    t = t.withColumn("p_model", F.when(F.col("y_a") == F.col("label"), F.col("confidence_a")).otherwise(1 - F.col("confidence_a"))).withColumn("p_rules", F.when(F.col("y_b") == F.col("label"), 0.7).otherwise(0.3))
    return evaluation.blend(t, 0.85)


_HANDLE = "@([A-Za-z0-9_.\\-]{3,})"
_D = "substring(sha256('airwave|' || {}), 1, 8)"
_NAMED = "CASE WHEN event_id % 3 = 0 THEN 'Some Name-' || CAST(stream_id AS VARCHAR) WHEN event_id % 3 = 1 THEN author END"


def _named(v):
    """Messages whose authors are handles, plain names and nobody."""
    return v("t_messages").withColumn("author", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Some Name-"), F.col("stream_id").cast("string"))).when(F.col("event_id") % 3 == 1, F.col("author")))


@register("pseudonymise", f"SELECT message_id, 'viewer #' || {_D.format(_NAMED)} AS author, regexp_replace(text, '@user[0-9]+', '@viewer-' || {_D.format("regexp_extract(text, '(@user[0-9]+)', 1)")}) AS text FROM t_messages")
def _(v):
    return privacy.pseudonymise(_named(v), SALT).select("message_id", "author", "text")


@register("pseudonymise_documents", f"SELECT stream_id, count(*) AS n, string_agg(regexp_replace(text, '@user[0-9]+', '@viewer-' || {_D.format("regexp_extract(text, '(@user[0-9]+)', 1)")}), chr(10) ORDER BY us, event_id) AS content FROM t_messages GROUP BY 1")
def _(v):
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("us", "event_id", "text"))), lambda x: x["text"]), "\n")
    docs = v("t_messages").groupBy("stream_id").agg(F.count("*").alias("n"), joined.alias("content"))
    return privacy.pseudonymise_documents(docs.withColumn("title", F.lit(None).cast("string")).withColumn("summary", F.lit("")), SALT).select("stream_id", "n", "content")


@register("anonymise_report", f"WITH h AS (SELECT regexp_extract_all(text, '{_HANDLE}', 1) AS h, {_NAMED} AS author FROM t_messages) SELECT count(*) FILTER (len(h) > 0) AS rows, CAST(sum(len(h)) AS BIGINT) AS mentions, (SELECT count(DISTINCT x) FROM (SELECT unnest(h) AS x FROM h)) AS handles, count(author) AS authored, count(DISTINCT author) AS authors FROM h")
def _(v):
    return privacy.anonymise_report(_named(v))


@register("privacy_audit", """WITH a AS (SELECT id, len(regexp_extract_all(content, '([A-Za-z0-9._]+@[A-Za-z0-9-]+\\.[A-Za-z]+)', 1)) AS emails, len(list_filter(regexp_extract_all(content, '([0-9]{9,})', 1), lambda d: len(list_distinct(string_split(d, ''))) >= 4)) AS digit_runs,
 len(regexp_extract_all(content, '(?:^|[^A-Za-z0-9._])@([A-Za-z0-9_.\\-]{3,})', 1)) AS handles FROM t_documents) SELECT * FROM a WHERE emails > 0 OR digit_runs > 0 OR handles > 0""")
def _(v):
    return privacy.privacy_audit(v("t_documents"))


@register("vocabulary_audit", "WITH w AS (SELECT DISTINCT id, unnest(string_split_regex(content || ' @u' || CAST(id % 50 AS VARCHAR), '[ \\n]+')) AS term FROM t_documents) SELECT term, count(*) AS df FROM w WHERE regexp_matches(term, '^" + privacy.HANDLE.replace("\\", "\\") + "$') AND NOT starts_with(term, '" + privacy.MENTION + "') GROUP BY 1")
def _(v):
    """Handles in a vocabulary of what stands between blanks."""
    said = F.concat("content", F.lit(" @u"), (F.col("id") % 50).cast("string"))
    terms = v("t_documents").select(F.col("id").alias("doc_id"), F.explode(F.array_distinct(F.split(said, "[ \n]+"))).alias("token"))
    return privacy.vocabulary_audit(stats.fit_idf(terms))


@register("script_ratio", "SELECT id, round(CASE WHEN length(regexp_replace(content, '\\s', '', 'g')) > 0 THEN CAST(length(regexp_replace(content, '[^a-zA-Z]', '', 'g')) AS DOUBLE) / length(regexp_replace(content, '\\s', '', 'g')) ELSE 0 END, 6) AS ratio FROM t_documents")
def _(v):
    return v("t_documents").select("id", F.round(text.script_ratio(F.col("content")), 6).alias("ratio"))


#: cleaning written for an engine without back-references: mentions and runs of the marks that the messages hold
_CLEAN = """trim(regexp_replace(regexp_replace(regexp_replace(text, '@[A-Za-z0-9_.-]+', ' ', 'g'), '"+', '"', 'g'), '\\s+', ' ', 'g'))"""
_SCRIPT = "CAST(length(regexp_replace(t, '[^a-zA-Z]', '', 'g')) AS DOUBLE) / length(regexp_replace(t, '\\s', '', 'g'))"


@register("thai_ratio", "WITH d AS (SELECT id, CASE WHEN id % 2 = 0 THEN title || ' ข่าววันนี้' ELSE title END AS t FROM t_documents) SELECT id, round(CASE WHEN length(regexp_replace(t, '\\s', '', 'g')) > 0 THEN CAST(length(regexp_replace(t, '[^\\x{0E00}-\\x{0E7F}]', '', 'g')) AS DOUBLE) / length(regexp_replace(t, '\\s', '', 'g')) ELSE 0 END, 6) AS ratio FROM d")
def _(v):
    said = F.when(F.col("id") % 2 == 0, F.concat("title", F.lit(" ข่าววันนี้"))).otherwise(F.col("title"))
    return v("t_documents").select("id", F.round(text.script_ratio(said, "\u0e00-\u0e7f"), 6).alias("ratio"))


@register("is_noise", "WITH c AS (SELECT token, count(*) AS n FROM t_tokens GROUP BY 1) SELECT token, length(token) < 2 OR NOT regexp_matches(token, '\\p{L}') OR (length(token) < 15 AND CAST(length(regexp_replace(token, '[^a-z]', '', 'g')) AS DOUBLE) / length(token) < 0.9) AS noise FROM c")
def _(v):
    return v("t_tokens").select("token").distinct().select("token", text.is_noise(F.col("token"), "a-z", 0.9).alias("noise"))


@register("noise_filter", f"WITH c AS (SELECT message_id, substr({_CLEAN}, CAST(1 + event_id % 16 AS INT)) AS t FROM t_messages) SELECT message_id FROM c WHERE NOT (length(trim(t)) < 2 OR NOT regexp_matches(t, '\\p{{L}}') OR (length(trim(t)) < 15 AND {_SCRIPT} < 0.6))")
def _(v):
    short = F.expr("substr(trim(regexp_replace(regexp_replace(text, '@[A-Za-z0-9_.-]+', ' '), '\\\\s+', ' ')), CAST(1 + event_id % 16 AS INT))")
    return filters.noise_filter(v("t_messages").withColumn("text", short), min_ratio=0.6).select("message_id")


@register("tokenize", "SELECT doc_id, count(*) AS tokens, count(DISTINCT token) AS unique_tokens FROM t_tokens GROUP BY 1")
def _(v):
    t = v("t_documents").select(F.col("id").alias("doc_id"), text.tokenize(F.col("content")).alias("t")).where("size(t) > 0")
    return t.select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("unique_tokens"))


@register("sentence_split", "WITH s AS (SELECT id, unnest(regexp_split_to_array(content, '[.!?\\n]')) AS s FROM t_documents) SELECT id, count(*) AS sentences, CAST(sum(length(trim(s))) AS BIGINT) AS chars FROM s WHERE trim(s) <> '' GROUP BY 1")
def _(v):
    s = v("t_documents").select("id", F.explode(text.sentence_split(F.col("content"))).alias("s"))
    return s.groupBy("id").agg(F.count("*").alias("sentences"), F.sum(F.length("s")).alias("chars"))


@register("word_ngrams", "WITH b AS (SELECT token || '_' || lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM t_tokens) SELECT g AS gram, count(*) AS n FROM (SELECT g FROM b WHERE g IS NOT NULL UNION ALL SELECT token FROM t_tokens) GROUP BY 1")
def _(v):
    t = v("t_documents").select(F.explode(text.word_ngrams(text.tokenize(F.col("content")))).alias("gram"))
    return t.groupBy("gram").agg(F.count("*").alias("n"))


@register("content_hash", "SELECT id, sha256(content) AS content_hash FROM t_documents")
def _(v):
    return v("t_documents").select("id", F.sha2("content", 256).alias("content_hash"))
