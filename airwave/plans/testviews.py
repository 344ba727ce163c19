"""Adapters from the given tables to the shapes that the operators take, in Spark SQL and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: fixed values: labels in their order
TOPICS = ["politics", "economy", "crime", "accident", "sport", "health", "education", "weather", "culture", "technology", "society", "world", "royal", "traffic", "other"]
SENTIMENTS = ["positive", "neutral", "negative"]
#: words frequent in the documents, as a small lexicon: term, topic number, weight, polarity
TERMS = [("the", 0, 1.0, 0.5), ("of", 1, 1.5, -0.7), ("and", 2, 0.5, 0.2), ("to", 0, 2.0, -0.4), ("in", 3, 1.0, 0.9), ("is", 4, 1.2, -1.0), ("that", 1, 0.7, 0.6), ("it", 5, 0.8, -0.3), ("der", 6, 1.0, 0.4), ("la", 7, 1.1, -0.6)]

_MESSAGES = """SELECT user_id AS stream_id, CAST(event_id AS {string}) AS message_id, event_id, '@user' || CAST(user_id % 7 AS {string}) AS author,
 event_type || ' @user' || CAST(user_id % 5 AS {string}) || ' ' || props AS text, {us} AS us,
 CAST(floor(({us} - min({us}) OVER (PARTITION BY user_id)) / 1000) AS BIGINT) AS offset_ms,
 CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive' WHEN event_type = 'error' THEN 'negative' ELSE 'neutral' END AS sentiment,
 CAST(event_id % 101 AS DOUBLE) / 100 AS sentiment_confidence, value < 5 AS is_spam FROM events"""
_DOCUMENTS = """SELECT doc_id AS id, substring(text, 1, 60) AS title, text AS content, source, CAST(doc_id % 15 AS INT) AS topic_ord,
 CAST(doc_id % 97 AS DOUBLE) / 96 AS topic_confidence, CASE n_chars % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' ELSE 'negative' END AS sentiment,
 CAST(n_chars % 101 AS DOUBLE) / 100 AS sentiment_confidence, CASE WHEN doc_id % 4 = 0 THEN 'chat_window' ELSE 'article' END AS source_type,
 CASE WHEN doc_id % 4 = 0 THEN n_chars % 300 END AS message_count, {published} AS published_at FROM documents"""
_CUES = """SELECT doc_id AS video_id, {idx} AS cue_idx, {idx} * 7000 AS start_ms, 9000 AS duration_ms, CASE WHEN {idx} % 13 = 12 THEN '' ELSE {line} END AS text,
 {idx} % 13 = 12 AS non_speech, {idx} % 4 = 0 AS speaker_change FROM {lines}"""
_PREDICTIONS = """SELECT d.doc_id AS id, CAST(l.quality AS INT) AS y_true, CASE WHEN d.n_chars > 1500 THEN 1 ELSE 0 END AS y_a, CAST(1 - l.toxic AS INT) AS y_b,
 CAST(d.n_chars % 101 AS DOUBLE) / 100 AS confidence_a FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""
_TERMS = "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {o}, CAST({w} AS DOUBLE), CAST({p} AS DOUBLE))" for t, o, w, p in TERMS) + ") AS x(term, topic_ord, weight, polarity)"
_TAXONOMY = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(TOPICS)) + ") AS x(ord, slug)"

_SPARK = {
    "t_messages": _MESSAGES.format(string="STRING", us="unix_micros(CAST(ts AS TIMESTAMP))"),
    "t_segments": "SELECT stream_id * 100 + i AS segment_id, stream_id, CAST(i AS INT) AS position, i * 172800000 AS start_ms, (i + 1) * 172800000 AS end_ms, CAST((stream_id + i) % 15 AS INT) AS topic_ord FROM (SELECT DISTINCT user_id AS stream_id FROM events) LATERAL VIEW explode(sequence(0L, 14L)) x AS i",
    "t_documents": _DOCUMENTS.format(published="timestamp'2024-01-01 00:00:00' + make_dt_interval(0, CAST(doc_id % 700 AS INT), 0, 0)"),
    "t_cues": _CUES.format(idx="CAST(pos AS BIGINT)", line="line", lines="documents LATERAL VIEW posexplode(split(text, '\\n')) x AS pos, line"),
    "t_predictions": _PREDICTIONS,
    "t_tokens": "SELECT doc_id, CAST(pos AS BIGINT) AS pos, token FROM documents LATERAL VIEW posexplode(regexp_extract_all(lower(text), '([\\\\p{L}\\\\p{M}\\\\p{N}]+|\\\\p{So})', 1)) x AS pos, token",
    "t_terms": _TERMS,
    "t_taxonomy": _TAXONOMY,
}
DUCK = {
    "t_messages": _MESSAGES.format(string="VARCHAR", us="epoch_us(ts)").replace("floor((epoch_us", "((epoch_us").replace(") / 1000)", ") // 1000)"),
    "t_segments": "SELECT stream_id * 100 + i AS segment_id, stream_id, CAST(i AS INT) AS position, CAST(i AS BIGINT) * 172800000 AS start_ms, CAST(i + 1 AS BIGINT) * 172800000 AS end_ms, CAST((stream_id + i) % 15 AS INT) AS topic_ord FROM (SELECT DISTINCT user_id AS stream_id FROM events), range(15) r(i)",
    "t_documents": _DOCUMENTS.format(published="TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 700 AS INT))"),
    "t_cues": _CUES.format(idx="idx", line="line", lines="(SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS idx, unnest(string_split(text, chr(10))) AS line FROM documents)"),
    "t_predictions": _PREDICTIONS,
    "t_tokens": "SELECT doc_id, CAST(generate_subscripts(ts, 1) - 1 AS BIGINT) AS pos, unnest(ts) AS token FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+|\\p{So}') AS ts FROM documents)",
    "t_terms": _TERMS,
    "t_taxonomy": _TAXONOMY,
}
_BASE = {"t_messages": ["events"], "t_segments": ["events"], "t_documents": ["documents"], "t_cues": ["documents"], "t_predictions": ["documents", "labels"], "t_tokens": ["documents"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = _SPARK[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _BASE.get(name, [])}
    for t in frames:
        sql = sql.replace(f" {t} ", f" {{{t}}} ").replace(f" {t})", f" {{{t}}})")
        if sql.endswith(f" {t}"):
            sql = sql[: -len(t)] + "{" + t + "}"
    if name == "t_tokens":  # its pattern has braces of its own
        frames["documents"].createOrReplaceTempView("airwave_documents")
        return spark.sql(_SPARK[name].replace("FROM documents", "FROM airwave_documents"))
    return spark.sql(sql, **frames)


def duck(sql: str) -> str:
    """``sql`` over the views it names, in DuckDB."""
    used = [f"{n} AS ({q})" for n, q in DUCK.items() if n in sql]
    if sql.lstrip().upper().startswith("WITH"):
        head, rest = sql.lstrip()[4:].lstrip(), ""
        recursive = head.upper().startswith("RECURSIVE")
        head = head[9:].lstrip() if recursive else head
        return f"WITH {'RECURSIVE ' * recursive}{', '.join([*used, head])}{rest}"
    return f"WITH {', '.join(used)} {sql}" if used else sql
