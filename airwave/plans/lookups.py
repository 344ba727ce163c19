"""Registered lookups, evidence tables and reports with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from airwave.functions import text
from airwave.operators import joins, lexicon, lookups
from airwave.plans.catalog import _WINDOWS, _arrays, _members, register
from airwave.plans.testviews import SENTIMENTS, TERMS

_COUNTS = ", ".join(f"count(*) FILTER (sentiment = '{s}') AS {s}" for s in SENTIMENTS)
_KEY = "sha256(trim(regexp_replace(content, '[ \\t\\n\\r]+', ' ', 'g')))"


@register("class_balance", f"WITH r AS (SELECT topic_ord, {_COUNTS}, count(*) AS total FROM t_documents GROUP BY ROLLUP (topic_ord)) SELECT *, min(total) FILTER (topic_ord IS NOT NULL) OVER () AS smallest, max(total) FILTER (topic_ord IS NOT NULL) OVER () AS largest FROM r")
def _(v):
    return lookups.class_balance(v("t_documents"), SENTIMENTS)


@register("documents_with_analysis", "SELECT d.id, d.title, p.y_true, p.confidence_a FROM t_documents d LEFT JOIN t_predictions p ON d.id = p.id")
def _(v):
    return lookups.documents_with_analysis(v("t_documents").select("id", "title"), v("t_predictions").select("id", "y_true", "confidence_a"))


@register("semi_filter", "SELECT id, title FROM t_documents WHERE id IN (SELECT id FROM t_predictions WHERE y_true = 1)")
def _(v):
    return v("t_documents").select("id", "title").join(v("t_predictions").where("y_true = 1").select("id"), "id", "left_semi")


@register("label_join", "SELECT d.id, t.slug FROM t_documents d LEFT JOIN t_taxonomy t ON d.topic_ord = t.ord")
def _(v):
    docs, taxonomy = v("t_documents").select("id", "topic_ord"), v("t_taxonomy")
    return docs.join(taxonomy, docs["topic_ord"] == taxonomy["ord"], "left").select("id", "slug")


@register("programme_overview", """WITH c AS (SELECT s.segment_id, s.stream_id, s.position, count(m.message_id) AS n FROM t_segments s LEFT JOIN t_messages m
 ON m.stream_id = s.stream_id AND NOT m.is_spam AND m.offset_ms >= s.start_ms AND m.offset_ms < s.end_ms GROUP BY ALL),
 f AS (SELECT doc_id AS stream_id, 1 + length(text) - length(replace(text, chr(10), '')) AS cue_count FROM documents),
 o AS (SELECT stream_id, count(*) AS segment_count, count(*) FILTER (n > 0) AS chat_segments, CAST(sum(n) AS BIGINT) AS chat_messages, count(*) FILTER (position % 4 <> 0) AS pending_headlines, count(*) FILTER (n >= 5 AND position % 3 <> 0) AS pending_reactions FROM c GROUP BY stream_id)
 SELECT o.*, f.cue_count FROM o LEFT JOIN f ON f.stream_id = o.stream_id""")
def _(v):
    done = v("t_segments").withColumn("enriched_by", F.when(F.col("position") % 4 == 0, "llm")).withColumn("chat_summary", F.when(F.col("position") % 3 == 0, "said"))
    facts = v("t_cues").groupBy("video_id").agg(F.count("*").alias("cue_count"))
    return lookups.programme_overview(done, joins.chat_count_by_segment(v("t_messages"), v("t_segments")), facts)


@register("window_membership_join", _WINDOWS + "SELECT m.stream_id, m.message_id, k.window_index FROM t_messages m LEFT JOIN k ON m.stream_id = k.stream_id AND m.message_id = k.message_id")
def _(v):
    return lookups.window_membership(v("t_messages"), _members(v))


@register("interval_lookup", """WITH f AS (SELECT stream_id, position, sum(end_ms - start_ms) OVER w - (end_ms - start_ms) AS lo, sum(end_ms - start_ms) OVER w AS hi,
 lead(position) OVER w IS NULL AS final FROM t_segments WINDOW w AS (PARTITION BY stream_id ORDER BY position))
 SELECT m.message_id, f.position AS fragment FROM t_messages m JOIN f ON m.stream_id = f.stream_id AND m.offset_ms >= f.lo AND (m.offset_ms < f.hi OR f.final)""")
def _(v):
    fragments = v("t_segments").select("stream_id", F.col("position").alias("fragment"), (F.col("end_ms") - F.col("start_ms")).alias("duration"))
    return joins.interval_lookup(v("t_messages").select("stream_id", "message_id", F.col("offset_ms").alias("at")), fragments, "stream_id").select("message_id", "fragment")


@register("token_stats", """SELECT d.id, coalesce(x.n, 0) AS token_count, coalesce(x.u, 0) AS unique_count, coalesce(x.s, 0) AS stopword_removed FROM t_documents d LEFT JOIN
 (SELECT doc_id, count(*) AS n, count(DISTINCT token) AS u, count(*) FILTER (token IN (SELECT term FROM t_terms) OR length(token) < 2 OR regexp_matches(token, '^\\p{Nd}+$') OR NOT regexp_matches(token, '[\\p{L}\\p{N}]')) AS s FROM t_tokens GROUP BY doc_id) x ON d.id = x.doc_id""")
def _(v):
    tokens = F.coalesce(text.tokenize(F.col("content")), F.array().cast("array<string>"))
    kept = text.kept_tokens(F.col("t"), [t for t, *_ in TERMS])
    rows = v("t_documents").select("id", tokens.alias("t")).withColumn("k", kept)
    return rows.select("id", F.size("t").cast("long").alias("token_count"), F.size(F.array_distinct("t")).cast("long").alias("unique_count"), (F.size("t") - F.size("k")).cast("long").alias("stopword_removed"))


@register("filter_tokens", "SELECT doc_id, pos, token FROM t_tokens WHERE token IN ('it') OR (token NOT IN (SELECT term FROM t_terms) AND length(token) >= 2 AND NOT regexp_matches(token, '^\\p{Nd}+$') AND regexp_matches(token, '[\\p{L}\\p{N}]'))")
def _(v):
    return lookups.filter_tokens(v("t_tokens"), v("t_terms"), ["it"])


@register("keyword_candidates", "SELECT doc_id, count(*) AS candidates FROM t_tokens WHERE token NOT IN (SELECT term FROM t_terms) AND length(token) >= 2 AND regexp_matches(token, '[a-z]') AND token NOT IN ('und', 'les') GROUP BY 1")
def _(v):
    c = text.keyword_candidates(text.tokenize(F.col("content")), [t for t, *_ in TERMS], exclude=["und", "les"])
    return v("t_documents").select(F.col("id").alias("doc_id"), F.size(c).cast("long").alias("candidates")).where("candidates > 0")


@register("topic_evidence", "SELECT doc_id, pos, term, 'exact' AS via, topic_ord, weight FROM t_tokens JOIN t_terms ON token = term")
def _(v):
    return lookups.topic_evidence(lexicon.term_matches(_arrays(v), v("t_terms")), v("t_terms"))


@register("name_lexicon", """SELECT name, CAST(sum(CASE WHEN source_type = 'chat_window' THEN 3 ELSE 1 END) AS BIGINT) AS support FROM (SELECT doc_id, token, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS name FROM t_tokens) JOIN t_documents ON id = doc_id
 WHERE token IN ('the', 'la', 'der') AND length(name) >= 2 AND regexp_matches(name, '[a-z]') AND name NOT IN ('the', 'la', 'der') AND name NOT IN (SELECT term FROM t_terms) GROUP BY name""")
def _(v):
    rows = v("t_documents").select("source_type", text.tokenize(F.col("content")).alias("tokens"))
    chat = F.col("source_type") == "chat_window"
    return lookups.name_lexicon(rows.where(chat), rows.where(~chat), ["the", "la", "der"], v("t_terms"))


_HEADLINE = r"""l AS (SELECT content_key, trim(regexp_replace(regexp_extract(headline, '([^\n]*[^ \t\n\f\r][^\n]*)', 1), '[ \t\n\f\r]+', ' ', 'g'), '"''“”‘’「」 ') AS l FROM c),
 u AS (SELECT content_key, trim(regexp_replace(l, '^(?i:headline|title|summary)[ ]*[:：][ ]*', ''), '"''“”‘’「」 ') AS headline FROM l),
 f AS (SELECT * FROM u WHERE regexp_matches(headline, '[A-Za-z]') AND NOT regexp_matches(headline, '[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{0400}-\x{04ff}]'))"""


@register("enrichment_lookup", f"""WITH c AS (SELECT {_KEY} AS content_key, max(CASE WHEN id % 8 = 0 THEN 'Headline: ' || title WHEN id % 12 = 0 THEN '""' ELSE title END) AS headline FROM t_documents WHERE source_type = 'chat_window' GROUP BY ALL), {_HEADLINE}
 SELECT d.id, d.content_key, f.headline FROM (SELECT id, {_KEY} AS content_key FROM t_documents) d LEFT JOIN f ON d.content_key = f.content_key""")
def _(v):
    said = F.when(F.col("id") % 8 == 0, F.concat(F.lit("Headline: "), "title")).when(F.col("id") % 12 == 0, F.lit('""')).otherwise(F.col("title"))
    docs = v("t_documents").select("id", said.alias("title"), "content", "source_type")
    cache = docs.where("source_type = 'chat_window'").groupBy(lookups.content_key(F.col("content")).alias("content_key")).agg(F.max("title").alias("headline"))
    cache = cache.withColumn("model", F.lit("m1")).withColumn("version", F.lit(2))
    stale = cache.withColumn("headline", F.lit("of another model")).withColumn("model", F.lit("m0")).unionByName(cache.withColumn("headline", F.lit("old shape")).withColumn("version", F.lit(1)))
    return lookups.enrichment_lookup(docs, cache.unionByName(stale), "m1", 2).select("id", "content_key", "headline")


@register("split_overlap_check", f"SELECT {_KEY} AS content_key FROM t_documents WHERE source_type = 'article' INTERSECT SELECT {_KEY} FROM t_documents WHERE source_type = 'chat_window'")
def _(v):
    docs = v("t_documents").select("content", "source_type")
    return lookups.split_overlap(docs.where("source_type = 'article'"), docs.where("source_type = 'chat_window'"))
