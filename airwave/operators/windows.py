"""Order-dependent operators over streams, cues and labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.files import keep


#: messages of a stream beyond which it is cut into pieces, and seconds of the time ranges that pieces are made of
PIECE, RANGE_S = 1 << 18, 60


def greedy_windows(messages: DataFrame, size: int = 200, minutes: int = 60, min_messages: int = 5) -> DataFrame:
    """(stream_id, message_id, window_index): a window ends when ``size`` is reached or a message comes
    ``minutes`` or more after its first (0: no time bound); windows under the floor go, the rest are numbered
    from 0. Messages come in order of time, then of their id as a number, then as text.

    A stream of up to ``PIECE`` messages is read in order by one task. A larger one is cut at counted time ranges
    into pieces, which tasks share: wherever a window begins before a piece, the next one begins among the piece's
    first ``size`` messages, so a piece says for each of these where it would leave off. Following these summaries
    from the stream's first message gives each piece its first window and number."""
    if size < 1:
        raise ValueError("size must be at least 1")
    span = int(minutes * 60_000_000) if minutes else np.iinfo(np.int64).max // 2
    rows = messages.select("stream_id", "message_id", "us", F.col("message_id").try_cast("bigint").alias("_id"))
    crowded = rows.groupBy("stream_id").agg(F.count("*").alias("_n")).where(F.col("_n") > PIECE).select("stream_id")
    crowded = keep(crowded, "crowded")
    if not crowded.limit(1).count():
        return _scanned(rows, size, span, min_messages)
    few = _scanned(rows.join(crowded, "stream_id", "left_anti"), size, span, min_messages)
    return few.unionByName(_pieced(rows.join(crowded, "stream_id", "left_semi"), size, span, min_messages))


def _scanned(rows: DataFrame, size: int, span: int, min_messages: int) -> DataFrame:
    """Streams in order, in Arrow batches; the open window and the messages that wait for it to reach the floor are the
    only state, so a stream is read once in bounded memory."""

    def scan(batches):
        stream = start = None
        count = number = 0
        waiting: list = []  # messages of the open window, from batches before, while it is under the floor
        for pdf in batches:
            if not len(pdf):
                continue
            ids, us, rows = pdf["stream_id"].to_numpy(), pdf["us"].to_numpy(), pdf[["stream_id", "message_id"]]
            out, at, first = np.full(len(pdf), -1), 0, 0
            for end in np.r_[np.flatnonzero(ids[1:] != ids[:-1]) + 1, len(ids)]:
                if ids[at] != stream:
                    stream, start, count, number, first = ids[at], us[at], 0, 0, at
                    waiting.clear()
                while at < end:
                    to = at + min(end - at, size - count, int(np.searchsorted(us[at:end], start + span)))
                    count, at = count + to - at, to
                    if count >= min_messages:
                        out[first:at] = number
                        while waiting:
                            yield waiting.pop(0).assign(window_index=number)
                    if at < end:
                        number += count >= min_messages
                        start, count, first = us[at], 0, at
                        waiting.clear()
            yield rows.assign(window_index=out)[out >= 0]
            if count < min_messages:
                waiting.append(rows.iloc[first:])

    ordered = rows.repartition("stream_id").sortWithinPartitions("stream_id", "us", "_id", "message_id")
    return ordered.mapInPandas(scan, "stream_id long, message_id string, window_index long")


def _pieced(rows: DataFrame, size: int, span: int, least: int) -> DataFrame:
    """As ``_scanned`` for streams of any length."""
    minute = F.floor(F.col("us") / (RANGE_S * 1_000_000)).alias("_range")
    ranges = rows.groupBy("stream_id", minute).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("stream_id").orderBy("_range")) - F.col("_n")  # a row per stream and range
    ranges = ranges.select("stream_id", "_range", F.floor(before / PIECE).alias("piece"))
    pieces = keep(rows.withColumn("_range", minute).join(ranges, ["stream_id", "_range"]).drop("_range"), "pieces")

    def steps(us):
        """The next window's first message after a window that begins at each message; the piece's length if beyond."""
        return np.minimum(np.minimum(np.arange(len(us)) + size, np.searchsorted(us, us + span)), len(us))

    def summary(key, pdf):
        import pandas as pd

        us = np.sort(pdf["us"].to_numpy())
        n, to = len(us), steps(us)
        last, closed = np.where(to < n, to, np.arange(n)), ((to < n) & (to - np.arange(n) >= least)).astype(np.int64)
        while (last[last] != last).any():  # by doubled steps: the last window that begins here, and those kept before it
            closed, last = closed + closed[last], last[last]
        m = min(size, n)
        row = (*key, n, us[:m], n - last[:m], us[last[:m]] + span, closed[:m])
        return pd.DataFrame([row], columns=["stream_id", "piece", "n", "first", "open", "until", "closed"])

    kind = "stream_id long, piece long, n long, first array<long>, open array<long>, until array<long>, closed array<long>"
    said = pieces.groupBy("stream_id", "piece").applyInPandas(summary, kind)

    def follow(batches):
        """Summaries of a stream in order, with the open window as only state."""
        import pandas as pd

        stream, number, open_, until, waiting = None, 0, 0, 0, []

        def settled():
            nonlocal number
            own = number if open_ >= least else -1
            number += own >= 0
            for row in waiting:  # those that begin with this window, or are all of it, and the one in which it begins
                row["lead_number" if row["base"] < 0 else "tail"] = own
            out, waiting[:] = pd.DataFrame(waiting), []
            return own, out

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.stream_id != stream:
                    if waiting:
                        yield settled()[1]
                    stream, number, open_ = r.stream_id, 0, 0
                lead = min(size - open_, int(np.searchsorted(r.first, until)), r.n) if open_ else 0
                row = {"stream_id": stream, "piece": r.piece, "lead": lead, "lead_number": -1, "base": -1, "tail": -1}
                open_ += lead
                if lead < r.n:
                    if waiting:
                        row["lead_number"], out = settled()
                        yield out
                    row["base"] = number
                    number += int(r.closed[lead])
                    open_, until = int(r.open[lead]), int(r.until[lead])
                waiting.append(row)
        if waiting:
            yield settled()[1]

    dealt = said.repartition("stream_id").sortWithinPartitions("stream_id", "piece")
    plan = dealt.mapInPandas(follow, "stream_id long, piece long, lead long, lead_number long, base long, tail long")

    def numbered(pdf):
        pdf = pdf.sort_values(["us", "_id", "message_id"], na_position="first", kind="stable")
        us, (lead, lead_number, number, tail) = pdf["us"].to_numpy(), pdf[["lead", "lead_number", "base", "tail"]].iloc[0]
        out, to, at = np.full(len(us), -1), steps(us), int(lead)
        out[:at] = lead_number
        while at < len(us):
            end = int(to[at])
            if end == len(us):
                out[at:] = tail
            elif end - at >= least:
                out[at:end] = number
                number += 1
            at = end
        return pdf[["stream_id", "message_id"]].assign(window_index=out)[out >= 0]

    return pieces.join(keep(plan, "plan"), ["stream_id", "piece"]).groupBy("stream_id", "piece").applyInPandas(numbered, "stream_id long, message_id string, window_index long")


def resolve_cue_ends(cues: DataFrame, max_gap_ms: int = 10_000) -> DataFrame:
    """Adds end_ms: the next start or start + duration, whichever is earlier, within [start, start + max_gap]."""
    after = F.coalesce(F.lead("start_ms").over(W.partitionBy("video_id").orderBy("start_ms", "cue_idx")), F.col("start_ms") + F.greatest(F.col("duration_ms"), F.lit(1000)))
    own = F.when(F.col("duration_ms") > 0, F.least(after, F.col("start_ms") + F.col("duration_ms"))).otherwise(after)
    return cues.withColumn("end_ms", F.greatest(F.least(own, F.col("start_ms") + max_gap_ms), F.col("start_ms")))


def smooth_labels(rows: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """Adds smoothed: a single label between two equal other ones takes theirs (original neighbours)."""
    w = W.partitionBy(key).orderBy(order)
    before, after = F.lag(label).over(w), F.lead(label).over(w)
    return rows.withColumn("smoothed", F.when((before == after) & (F.col(label) != before), before).otherwise(F.col(label)))


def label_changes(rows: DataFrame, key: str, order: str, label: str = "smoothed", run: int = 2) -> DataFrame:
    """Rows whose label differs from the one before and holds for ``run`` rows."""
    w = W.partitionBy(key).orderBy(order)
    hit = F.col(label) != F.lag(label).over(w)
    for i in range(1, run):
        hit &= F.lead(label, i).over(w) == F.col(label)
    return rows.withColumn("_hit", hit).where("_hit").drop("_hit")


def majority(rows: DataFrame, key: str, label: str) -> DataFrame:
    """The label most frequent for each key; ties to the smallest label."""
    counts = rows.groupBy(key, label).agg(F.count("*").alias("votes"))
    return counts.groupBy(key).agg(F.max_by(label, F.struct(F.col("votes"), -F.col(label))).alias(label), F.max("votes").alias("votes"))


def depth_scores(rows: DataFrame, key: str = "video_id", order: str = "gap", value: str = "similarity") -> DataFrame:
    """Adds depth: the climb to the peak on either side while values do not fall. A run of climbing is an
    island between direction breaks; its peak is the island's outermost value. Ends have depth 0."""
    w = W.partitionBy(key).orderBy(order)
    rows = rows.withColumn("_lag", F.lag(value).over(w)).withColumn("_lead", F.lead(value).over(w))
    rows = rows.withColumn("_lb", F.sum(F.when(F.col("_lag") < F.col(value), 1).otherwise(0)).over(w))
    rows = rows.withColumn("_rb", F.sum(F.when(F.col("_lead") < F.col(value), 1).otherwise(0)).over(W.partitionBy(key).orderBy(F.desc(order))))
    left = F.first(value).over(W.partitionBy(key, "_lb").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    right = F.first(value).over(W.partitionBy(key, "_rb").orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0))
    depth = F.when(F.col("_lag").isNull() | F.col("_lead").isNull(), 0.0).otherwise(left - F.col(value) + right - F.col(value))
    return rows.withColumn("depth", depth).drop("_lag", "_lead", "_lb", "_rb")


def depth_cutoff(rows: DataFrame, key: str = "video_id", order: str = "gap") -> DataFrame:
    """Rows after the first whose depth reaches mean + half a population deviation of the positive depths."""
    positive = F.when(F.col("depth") > 0, F.col("depth"))
    w = W.partitionBy(key)
    line = F.avg(positive).over(w) + 0.5 * F.stddev_pop(positive).over(w)
    return rows.withColumn("cutoff", line).where((F.col("depth") >= F.col("cutoff") - 1e-12) & (F.col("depth") > 0) & (F.col(order) > 0))


def merge_short_spans(spans: DataFrame, min_ms: int = 60_000) -> DataFrame:
    """(video_id, start_ms, end_ms): a span below the minimum joins the one before; a short first one absorbs
    what follows. A programme's spans are folded in order in Arrow batches with the open span as only state."""

    def scan(batches):
        import pyarrow as pa

        video = start = end = None
        open_ = False
        for batch in batches:
            out = []
            for v, s, e in zip(*(batch.column(c).to_pylist() for c in ("video_id", "start_ms", "end_ms"))):
                short = open_ and v == video and (_short(s, e, min_ms) or _short(start, end, min_ms))
                if not short:
                    if open_:
                        out.append((video, start, end))
                    video, start, open_ = v, s, True
                end = e
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), batch.schema)], schema=batch.schema)
            schema = batch.schema
        if open_:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((video, start, end), schema)], schema=schema)

    rows = spans.select("video_id", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"))
    return rows.repartition("video_id").sortWithinPartitions("video_id", "start_ms", "end_ms").mapInArrow(scan, rows.schema)


def _short(start: int | None, end: int | None, least: int) -> bool:
    return start is not None and end is not None and end - start < least


def _ranked(rows: DataFrame, label: str, h) -> DataFrame:
    """Adds _h, _rank (from 1, in hash order within the class) and _size of the class. A row's place is its place in
    a range of hashes after the counted ranges before it, so that a class of any size is dealt out."""
    rows = rows.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 3))
    counts = rows.groupBy(label, "_b").agg(F.count("*").alias("_n"))  # 4,096 rows a class at most
    w = W.partitionBy(label)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(label).alias("_l"), F.col("_b").alias("_c"), before.alias("_before"), F.sum("_n").over(w).alias("_size"))
    near = rows.join(counts, rows[label].eqNullSafe(counts["_l"]) & (rows["_b"] == counts["_c"])).drop("_l", "_c")
    within = F.row_number().over(W.partitionBy(label, "_b").orderBy("_h", "id"))
    return near.withColumn("_rank", F.col("_before") + within).drop("_before", "_b")


def stratified_sample(rows: DataFrame, label: str, per: int = 3, total: int = 50, seed: int = 0) -> DataFrame:
    """At least ``per`` of each class in hash order, the rest of ``total`` filled in hash order over all."""
    ranked = _ranked(rows, label, F.md5(F.concat_ws(":", F.lit(seed), F.col("id"))))
    return ranked.orderBy((F.col("_rank") > per).cast("int"), "_h", "id").limit(total).drop("_h", "_rank", "_size")


def stratified_folds(rows: DataFrame, label: str, k: int = 5) -> DataFrame:
    """Adds fold: classes dealt evenly in hash order."""
    return _ranked(rows, label, F.md5(F.col("id").cast("string"))).withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_h", "_rank", "_size")


def fold_count(rows: DataFrame, label: str, k: int = 5) -> int:
    """Folds that every class can fill; fewer than two mean that nothing can be validated."""
    least = rows.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] or 0
    return min(k, least)


def stratified_split(rows: DataFrame, label: str, share: float = 0.2) -> DataFrame:
    """Adds is_test: the first share of each class in hash order."""
    ranked = _ranked(rows, label, F.md5(F.col("id").cast("string")))
    return ranked.withColumn("is_test", F.col("_rank") <= F.floor(F.col("_size") * F.lit(share) + F.lit(0.5))).drop("_h", "_rank", "_size")
