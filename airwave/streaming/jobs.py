"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions.text import utc_datetime
from ..operators import filters, stats
from ..sources import files, merge

def stream_messages(spark: SparkSession, path: str) -> DataFrame:
    """New snapshot files under ``path`` become micro-batches; header lines, lines that are no JSON object and blank texts
    go; times and offsets are read as leniently as in batch; a missing id becomes a fingerprint."""
    rows = files.snapshot_records(spark.readStream.option("recursiveFileLookup", True).schema("value string").text(path))
    field = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    plain = files.record_fields()
    ts = F.coalesce(utc_datetime(field("ts", "string")), plain["published_at"])
    rows = rows.select(field("stream_id", "bigint").alias("stream_id"), plain["message_id"].alias("message_id"), plain["author"].alias("author"), plain["text"].alias("text"), ts.alias("ts"), plain["offset_ms"].alias("offset_ms"), field("sentiment", "string").alias("sentiment"), F.coalesce(field("is_spam", "boolean"), F.lit(False)).alias("is_spam"))
    return rows.where("text <> ''").withColumn("us", F.unix_micros("ts")).withColumn("message_id", filters.identity())


def stream_dedupe(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each (stream, message) once within the watermark; state is dropped behind it."""
    return messages.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["stream_id", "message_id"])


def stream_trend(messages: DataFrame, granularity: str = "daily", delay: str = "1 hour") -> DataFrame:
    """Messages per day, week or month by sentiment (an unknown one counts as neutral), emitted once a day, from which
    weeks and months are summed, is behind the watermark."""
    s = F.when(F.col("sentiment").isin("positive", "negative"), F.col("sentiment")).otherwise("neutral")
    w = messages.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), s.alias("sentiment")).agg(F.count("*").alias("n"))
    return w.select(stats.period(F.col("w.start"), granularity).alias("period"), "sentiment", "n")


def stream_reactions(messages: DataFrame, segments: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Live chat against the known segments on air, a stream-static range join, as totals per segment, sentiment and
    hour, each emitted once its hour is behind the watermark."""
    rows = stream_on_air(messages, segments).withWatermark("ts", delay)
    sums = rows.groupBy(F.window("ts", "1 hour").alias("w"), "segment_id", "sentiment").agg(F.count("*").alias("n"))
    return sums.select("segment_id", "sentiment", F.col("w.start").alias("hour"), "n")


def stream_on_air(messages: DataFrame, segments: DataFrame) -> DataFrame:
    """Each message with the segment during which it came, spam left out."""
    s = segments.select("segment_id", F.col("stream_id").alias("_s"), "start_ms", "end_ms")
    on_air = (F.col("stream_id") == F.col("_s")) & (F.col("offset_ms") >= F.col("start_ms")) & (F.col("offset_ms") < F.col("end_ms"))
    return messages.where(~F.col("is_spam")).join(s, on_air).select("segment_id", "stream_id", "message_id", "offset_ms", "sentiment", "ts")


#: what a closed window says
_CLOSED = "stream_id long, window_index long, start_us long, end_us long, messages long"


class _Windows(StatefulProcessor):
    """One stream's windows: the open one, the number of those before it, and the messages that wait for the watermark,
    each a state of its own. A timer wakes the stream when its first waiting message or its open window falls due; a
    stream that has neither and is silent for ``expiry`` is forgotten, and counts from 0 if it comes back."""

    def __init__(self, size: int, span: int, least: int, expiry_ms: int):
        self.size, self.span, self.least, self.expiry_ms = size, span, least, expiry_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start long, last long, count long")
        self.number = handle.getValueState("number", "number long, seen_ms long")
        self.waiting = handle.getListState("waiting", "us long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        new = [(int(x),) for pdf in rows for x in pdf["us"]]
        if new:
            self.waiting.appendList(new)
        number, seen = self.number.get() if self.number.exists() else (0, 0)
        self.number.update((number, max([seen, *(us // 1000 for us, in new)])))
        yield from self._advance(key, timerValues)
        yield pd.DataFrame({c.split()[0]: pd.Series([], dtype="int64") for c in _CLOSED.split(", ")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._advance(key, timerValues)

    def _advance(self, key, timers):
        """Take the messages behind the watermark in order, close what is over, and set the next timer."""
        import pandas as pd

        line = timers.getCurrentWatermarkInMs() * 1000
        waiting = sorted(us for (us,) in self.waiting.get()) if self.waiting.exists() else []
        start, last, count = self.open.get() if self.open.exists() else (0, 0, 0)
        number, seen = self.number.get() if self.number.exists() else (0, 0)
        ready, out = [us for us in waiting if us < line], []

        def close():
            nonlocal number
            if count >= self.least:
                out.append((key[0], number, start, last, count))
                number += 1

        for us in ready:
            if count and (us - start >= self.span or count == self.size):
                close()
                count = 0
            start, last, count = (us if not count else start), us, count + 1
        if count and start + self.span <= line:
            close()
            count = 0
        left = waiting[len(ready) :]
        if ready:
            if left:
                self.waiting.put([(us,) for us in left])
            else:
                self.waiting.clear()
        if count:
            self.open.update((start, last, count))
        else:
            self.open.clear()
        self.number.update((number, seen))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = min([*([start + self.span] if count else []), *left[:1]], default=None)
        if due is not None:
            self.handle.registerTimer(max(due // 1000, timers.getCurrentWatermarkInMs()) + 1)
        elif seen + self.expiry_ms > timers.getCurrentWatermarkInMs():
            self.handle.registerTimer(seen + self.expiry_ms)
        else:
            self.number.clear()
        if out:
            yield pd.DataFrame(out, columns=["stream_id", "window_index", "start_us", "end_us", "messages"])

    def close(self) -> None:
        pass


def stream_greedy_windows(messages: DataFrame, size: int = 200, minutes: int = 60, min_messages: int = 5, delay: str = "1 hour", expiry_hours: int = 24) -> DataFrame:
    """(stream_id, window_index, start_us, end_us, messages) of closed windows: as ``greedy_windows``, one stream's open
    window as state. Messages wait until the watermark passes them, so that they are taken in order; a window is also
    closed by the watermark once its time is over. Windows under the floor go and take no number; the state of a stream
    that is silent for ``expiry_hours`` is dropped. States are kept by the RocksDB store."""
    if size < 1:
        raise ValueError("size must be at least 1")
    spark = messages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    windows = _Windows(size, int(minutes * 60_000_000) if minutes else 1 << 62, min_messages, expiry_hours * 3_600_000)
    rows = messages.withWatermark("ts", delay).select("stream_id", "ts", "us")
    return rows.groupBy("stream_id").transformWithStateInPandas(windows, _CLOSED, "append", "EventTime")


def stream_upsert(messages: DataFrame, path: str, checkpoint: str, buckets: int = 64):
    """Each micro-batch is merged into two tables: ``path/messages``, where an identity that is known stays as it is and
    each new one is added once, and ``path/streams``, where a stream's metadata (those of title, url, channel, collector
    and is_live that the messages carry) is refreshed. A batch reads and writes the buckets that it touches; one that
    runs again after a failure changes nothing. Returns the query; the caller waits for it."""
    about = [c for c in ("title", "url", "channel", "collector", "is_live") if c in messages.columns]

    def store(batch: DataFrame, number: int) -> None:
        rows = batch.drop("ts", *about)
        merge.merge(rows, f"{path}/messages", ["stream_id", filters.identity()], filters.upsert_messages, checkpoint, number, buckets)
        streams = batch.groupBy("stream_id").agg(*(F.max_by(c, "ts").alias(c) for c in about)) if about else batch.select("stream_id").distinct()
        merge.merge(streams, f"{path}/streams", ["stream_id"], filters.upsert_streams, checkpoint, number, buckets)

    return messages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run over all available input, into Parquet."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
