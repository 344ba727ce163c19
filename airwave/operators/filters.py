"""Explorer, listings and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean_text, is_noise

#: sort keys of the explorer; the id closes every tie
SORTS = {
    "newest": [F.desc, "published_at"],
    "oldest": [F.asc, "published_at"],
    "confidence": [F.desc, "sentiment_confidence"],
    "messages": [F.desc_nulls_last, "message_count"],
}


def search_literal(docs: DataFrame, needle: str) -> DataFrame:
    """Documents that hold the trimmed needle, case ignored, in title, content or summary (where they have one); % and _
    are plain characters."""
    n, found = F.lower(F.lit(needle.strip())), F.lit(False)
    for column in ("title", "content", "summary"):
        if column in docs.columns:
            found = found | F.coalesce(F.contains(F.lower(column), n), F.lit(False))
    return docs.where(found)


def explore(docs, search=None, topic=None, sentiment=None, source_type=None, date_from=None, date_to=None, min_confidence=None, sort="newest", page=1, page_size=20) -> DataFrame:
    """One page of the documents that satisfy every given filter, with the total; bounds are inclusive,
    an unknown sort or sentiment is an error, a page past the end is empty."""
    if sort not in SORTS or sentiment not in (None, "positive", "neutral", "negative"):
        raise ValueError("unknown sort or sentiment")
    out = search_literal(docs, search) if search else docs
    for column, value in (("topic_ord", topic), ("sentiment", sentiment), ("source_type", source_type)):
        out = out.where(F.col(column) == value) if value is not None else out
    out = out.where(F.col("published_at") >= F.lit(date_from).cast("timestamp")) if date_from else out
    out = out.where(F.col("published_at") <= F.lit(date_to).cast("timestamp")) if date_to else out
    out = out.where(F.col("sentiment_confidence") >= min_confidence) if min_confidence is not None else out
    total = out.agg(F.count("*").alias("total"))
    order, column = SORTS[sort]
    return out.orderBy(order(column), "id").offset((page - 1) * page_size).limit(page_size).crossJoin(F.broadcast(total))


def window_messages(messages: DataFrame, membership: DataFrame, per_window: int = 200) -> DataFrame:
    """The first messages of every window by time."""
    rows = membership.join(messages, ["stream_id", "message_id"])
    w = W.partitionBy("stream_id", "window_index").orderBy("us", F.col("message_id").cast("long"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_window)


def segment_cards(segments: DataFrame, labels: DataFrame, fallback: str = "#94a3b8", preview: int = 600, lead_s: int = 2) -> DataFrame:
    """Duration, timecode H:MM:SS, the second a link starts from (two before the segment, not below 0), the first
    characters of the text, and the topic's label and colour of ``labels`` (ord, slug, colour), with fallbacks."""
    s = F.floor(F.col("start_ms") / 1000)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    code = F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60))
    short = F.when(F.length("text") > preview, F.concat(F.rtrim(F.substring("text", 1, preview)), F.lit("…"))).otherwise(F.col("text"))
    named = segments.join(labels.select(F.col("ord").alias("topic_ord"), F.col("slug").alias("_slug"), F.col("colour").alias("_colour")), "topic_ord", "left")
    return named.select(
        "segment_id", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), code.alias("timecode"), F.greatest(s - lead_s, F.lit(0)).alias("link_s"),
        short.alias("preview"), F.coalesce("_slug", F.lit("unknown")).alias("label"), F.coalesce("_colour", F.lit(fallback)).alias("colour"),
    )


def segment_listing(segments: DataFrame, streams: DataFrame | None = None, topic: int | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of the segments, of chosen ``streams`` (stream_id) and a topic if given, by stream and start, with the total."""
    rows = segments if streams is None else segments.join(streams, "stream_id", "left_semi")
    rows = rows if topic is None else rows.where(F.col("topic_ord") == topic)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy("stream_id", "start_ms", "segment_id").offset(offset).limit(limit).crossJoin(F.broadcast(total))


def noise_filter(messages: DataFrame, letters: str = "a-zA-Z", min_ratio: float = 0.2, min_len: int = 2) -> DataFrame:
    """Messages with something to analyse, judged on their cleaned text."""
    return messages.where(~is_noise(clean_text(F.coalesce("text", F.lit(""))), letters, min_ratio, min_len))


def unclear(messages: DataFrame, threshold: float = 0.5) -> DataFrame:
    c = F.col("sentiment_confidence")
    return messages.withColumn("unclear", c.isNull() | (c < threshold))


def identity():
    """message_id, or a fingerprint of author, text and time where it is null or empty."""
    parts = F.concat_ws("|", "author", "text", F.col("us").cast("string"))
    return F.coalesce(F.nullif(F.col("message_id"), F.lit("")), F.concat(F.lit("fp_"), F.substring(F.sha2(parts, 256), 1, 32)))


def new_messages(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows of ``batch`` whose identity in their stream is new, once each."""
    new = batch.withColumn("_id", identity())
    new = new.withColumn("_nth", F.row_number().over(W.partitionBy("stream_id", "_id").orderBy("us", "text"))).where("_nth = 1")
    known = existing.select("stream_id", identity().alias("_id"))
    return new.join(known, ["stream_id", "_id"], "left_anti").drop("_id", "_nth")


def upsert_messages(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Existing rows and, once each, the batch's rows whose identity is new."""
    return existing.unionByName(new_messages(existing, batch))


#: of a stream's metadata, what an empty new value leaves as it was; anything else always takes the new value
_KEPT = ("title", "url", "channel")


def upsert_streams(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Streams by stream_id: of those in both, title, url and channel take the batch's value unless it is null or empty,
    and all other columns of the batch take it as it is; columns that the batch lacks stay. Rows of one side alone stay."""
    columns = [*existing.columns, *(c for c in batch.columns if c not in existing.columns)]
    old = existing.select("stream_id", F.struct(*existing.columns).alias("_old"))
    both = old.join(batch.select("stream_id", F.struct(*batch.columns).alias("_new")), "stream_id", "full")

    def value(c: str) -> Column:
        before = F.col(f"_old.{c}") if c in existing.columns else F.lit(None)
        if c not in batch.columns:
            return before
        new = F.col(f"_new.{c}")
        return F.coalesce(F.nullif(new, F.lit("")), before) if c in _KEPT else F.when(F.col("_new").isNotNull(), new).otherwise(before)

    return both.select("stream_id", *(value(c).alias(c) for c in columns if c != "stream_id"))


def delete_documents(docs: DataFrame, members: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents without ``ids``, and members whose document went with its reference set to null."""
    left = docs.join(ids, "id", "left_anti")
    gone = ids.select("id", F.lit(True).alias("_gone"))
    return left, members.join(gone, members["news_id"] == gone["id"], "left").select(*(F.when(F.col("_gone"), None).otherwise(F.col(c)).alias(c) if c == "news_id" else F.col(c) for c in members.columns))


def dedupe_documents(docs: DataFrame) -> DataFrame:
    """The first document of each content hash."""
    h = docs.select("id", F.sha2("content", 256).alias("content_hash"))
    return h.groupBy("content_hash").agg(F.min("id").alias("id"))


def dedupe_entities(rows: DataFrame) -> DataFrame:
    """Distinct (doc_id, text, label) at their first position: a name may be a place and a person."""
    return rows.groupBy("doc_id", "text", "label").agg(F.min("pos").alias("pos"))


def validate_labelled(rows: DataFrame, topics: list | None = None, sentiments: list | None = None) -> DataFrame:
    """Problems (id, problem, first_id) of rows (id, title, content, topic, sentiment): empty title, short content,
    labels outside the given ones, repeated title or content with the first row that has it. Repeats meet by hash
    and count, so contents are not sorted and a title that all rows share is counted before it is shuffled."""
    none = F.lit(None).cast("long")
    rules = [("empty title", F.trim(F.coalesce("title", F.lit(""))) == ""), ("short content", F.length(F.coalesce("content", F.lit(""))) < 40)]
    rules += [("unknown topic", ~F.coalesce(F.col("topic").isin(topics), F.lit(False)))] if topics is not None else []
    rules += [("unknown sentiment", ~F.coalesce(F.col("sentiment").isin(sentiments), F.lit(False)))] if sentiments is not None else []
    found = F.filter(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules)), lambda x: x.isNotNull())
    parts = [rows.select("id", F.explode(found).alias("problem"), none.alias("first_id"))]
    for column in ("title", "content"):
        keyed = rows.where(F.col(column).isNotNull()).select("id", F.sha2(column, 256).alias("_h"))
        first = keyed.groupBy("_h").agg(F.min("id").alias("first_id"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
        parts.append(keyed.join(first, "_h").where("id <> first_id").select("id", F.lit(f"duplicate {column}").alias("problem"), "first_id"))
    return union_problems(*parts)


def union_problems(*parts: DataFrame) -> DataFrame:
    """All problem lists (id, problem, first_id) as one; none gives an error."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def union_corpora(**parts: DataFrame) -> DataFrame:
    """Named corpora one after the other with their name in ``part``; a column that one lacks is null there."""
    out = None
    for name, rows in parts.items():
        rows = rows.withColumn("part", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def top_probabilities(rows: DataFrame, k: int = 4) -> DataFrame:
    """(id, rank, label, probability): the k likeliest labels of a map of probabilities, ties to the smaller label."""
    ordered = F.array_sort(F.transform(F.map_entries("probabilities"), lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("label"))))
    return rows.select("id", F.posexplode(F.slice(ordered, 1, k)).alias("_p", "x")).select("id", (F.col("_p") + 1).alias("rank"), "x.label", (-F.col("x.minus")).alias("probability"))
