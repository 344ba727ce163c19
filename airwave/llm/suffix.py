"""Substring dedup by bucket-pointer refinement over a sparse suffix array.

Every string of ``span`` bytes holds, at a place that its content alone decides, one anchor: the
position whose q-gram hash is smallest among its q-grams. Two equal strings therefore have equal
anchors, and only suffixes at anchors need buckets.

1. Initial buckets are the anchors' q-grams; buckets of one go.
2. A bucket is refined by the identifiers of longer stretches around the anchor. Identifiers are
   functions of content, made from prefix sums over the text, so the pointer of any later offset is
   read off where the text is and bucket sizes alone are shuffled. A sub-bucket (the anchor's windows
   at one block of offsets) with two members or more is settled whole: all its windows repeat.
3. Where a q-gram bucket fell into several sub-buckets, one representative of each is refined again
   down to single windows; settled sub-buckets take part, so nothing is missed at their edges.

Sorting a bucket is grouping by its members' identifiers, with partial counts before each shuffle: a
passage that a third of all documents share sends one row per task and sub-bucket. Matches never cross
documents and are judged on the input.

Defined cases: a null text is empty; texts shorter than ``span`` bytes lose nothing; a repeated row
is the same text elsewhere, so both are removed; a repeated doc_id with another text is a document of
its own; other columns pass through ``strip``; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .hashing import _powers, concatenate, mix
from .pieces import slices

#: bytes of a q-gram (a power of two), offsets that one sub-bucket covers, windows hashed at a time
Q, BLOCK, STEP = 64, 32, 1 << 18
#: sub-buckets of one bucket up to which one task refines them side by side
LOCAL = 1000

_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LEVEL = mix(np.arange(1, 40, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_PLACE = np.uint64((1 << 20) - 1)


def anchors_of(buf: np.ndarray, starts: np.ndarray, span: int):
    """(text, position in it, q-gram id, least and largest distance from a window's start) of every anchor."""
    width = span - Q + 1
    edge = np.zeros(len(buf) + 1, np.int8)
    sizes = np.diff(starts) - 1
    long_ = np.flatnonzero(sizes >= span)
    edge[starts[long_]] += 1
    edge[starts[long_] + sizes[long_] - span + 1] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    out = []
    for s in range(0, len(buf), STEP):
        n = min(STEP, len(buf) - s - span + 1)
        if n <= 0 or not inside[s : s + n].any():
            continue
        h, k, level = _BYTE[buf[s : s + n + span - 1]], 1, 0
        while k < Q:
            h = h[:-k] * _LEVEL[level] + h[k:]
            if level == 3:
                h ^= h >> np.uint64(29)
            k, level = k * 2, level + 1
        g = mix(h)
        m = (g & ~_PLACE) | np.arange(len(g), dtype=np.uint64)
        k = 1
        while 2 * k <= width:
            m = np.minimum(m[:-k], m[k:])
            k *= 2
        m = np.minimum(m[:n], m[width - k : width - k + n])
        i = np.flatnonzero(inside[s : s + n])
        a = (m[i] & _PLACE).astype(np.int64)
        new = np.r_[True, (a[1:] != a[:-1]) | (i[1:] != i[:-1] + 1)]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(i)] - 1
        doc = np.searchsorted(starts, s + i[first], "right") - 1
        at = a[first]
        out.append((doc, s + at - starts[doc], g[at], at - i[last], at - i[first]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]


class _Ids:
    """Identifiers of any stretch of a buffer."""

    def __init__(self, buf: np.ndarray):
        up, self.down = _powers(len(buf) + 1)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * up[: len(buf)])])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.total[b] - self.total[a]) * self.down[a] + (b - a).astype(np.uint64))


def store(docs: DataFrame) -> DataFrame:
    """(row, text, rest): documents dealt by row_key once, with all other columns inside ``rest``."""
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("rest")
    return common.bucketed(docs.select(common.row_key().alias("row"), F.col("text").cast("string").alias("text"), rest), "row")


def _lists(batch_column) -> tuple[np.ndarray, np.ndarray]:
    """A list<struct> column's values as one 2-D array, and each list's number of entries."""
    import pyarrow.compute as pc

    column = batch_column.combine_chunks()
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    return np.stack([f.to_numpy(zero_copy_only=False).astype(np.int64) for f in flat.flatten()], 1) if len(flat) else np.zeros((0, 3), np.int64), n


def _with_lists(stored: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Texts with what was found in them: each text's list is bounded by its own length."""
    found = rows.groupBy("row").agg(F.collect_list(F.struct(*columns)).alias("found"))
    return stored.select("row", F.coalesce("text", F.lit("")).alias("text")).join(found, "row").select("row", "text", "found")


def _places(found: np.ndarray, n: np.ndarray, starts: np.ndarray, span: int):
    """Every window of the listed stretches (lo, wide, known), each once: its place, text and whether it is known."""
    doc = np.repeat(np.arange(len(n)), n)
    times = found[:, 1] + 1
    p = np.repeat(found[:, 0] + starts[doc], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    known = np.repeat(found[:, 2], times)
    order = np.lexsort((-known, p))
    p, known = p[order], known[order]
    one = np.r_[True, p[1:] != p[:-1]] if len(p) else np.zeros(0, bool)
    return p[one], np.searchsorted(starts, p[one], "right") - 1, known[one]


def repeats(stored: DataFrame, span: int = 200) -> DataFrame:
    """(row, lo, hi): every window of ``span`` bytes that starts at lo..hi in the text of row ``row`` of a
    ``store`` also starts elsewhere."""

    def anchor_rows(batches):
        import pyarrow as pa

        for part in slices(batches, "text", 4 << 20):
            buf, starts = concatenate(part.column("text").to_pylist())
            doc, at, key, near, far = anchors_of(buf, starts, span)
            row = part.column("row").to_numpy()[doc]
            cols = [pa.array(key.view(np.int64)), pa.array(row), pa.array(at), pa.array(near.astype(np.int16)), pa.array(far.astype(np.int16))]
            yield pa.RecordBatch.from_arrays(cols, ["key", "row", "at", "near", "far"])

    anchors = common.cut(stored.select("row", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(anchor_rows, "key long, row long, at long, near short, far short"), "anchors")
    shared = common.cut(anchors.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    hits = common.cut(anchors.join(shared, "key").select("row", "at", "near", "far"), "hits")
    common.discard(anchors, shared)

    def sub_buckets(batches):
        import pyarrow as pa

        for part in slices(batches, "text", 2 << 20):
            buf, starts = concatenate(part.column("text").to_pylist())
            found, n = _lists(part.column("found"))
            doc = np.repeat(np.arange(part.num_rows), n)
            at, near, far = found[:, 0] + starts[doc], found[:, 1], found[:, 2]
            order = np.argsort(at, kind="stable")  # the texts lie in order, so this keeps documents together
            at, near, far, doc = at[order], near[order], far[order], doc[order]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
            at, doc = at[first], doc[first]
            near, far = (np.minimum.reduceat(near, first) // BLOCK, np.maximum.reduceat(far, first) // BLOCK) if len(first) else (near, far)
            times = far - near + 1
            b = np.repeat(near, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            at, doc = np.repeat(at, times), np.repeat(doc, times)
            # windows start between these, within the text
            lo = np.maximum(at - (b * BLOCK + BLOCK - 1), starts[doc])
            hi = np.minimum(at - b * BLOCK, starts[doc + 1] - 1 - span)
            ok = lo <= hi
            at, doc, b, lo, hi = at[ok], doc[ok], b[ok], lo[ok], hi[ok]
            ids = _Ids(buf)
            grp = mix(ids.of(at, at + Q) + b.astype(np.uint64))
            cls = mix(ids.of(lo, hi + span) * np.uint64(0x9FB21C651E98DF25) + (at - lo).astype(np.uint64)) ^ grp
            row = part.column("row").to_numpy()[doc]
            cols = [pa.array(grp.view(np.int64)), pa.array(cls.view(np.int64)), pa.array(row), pa.array(lo - starts[doc]), pa.array((hi - lo).astype(np.int16))]
            yield pa.RecordBatch.from_arrays(cols, ["grp", "cls", "row", "lo", "wide"])

    members = common.cut(_with_lists(stored, hits, ["at", "near", "far"]).mapInArrow(sub_buckets, "grp long, cls long, row long, lo long, wide short"), "members")
    common.discard(hits)
    classes = members.groupBy("grp", "cls").agg(F.count("*").alias("n"), F.min(F.struct("row", "lo", "wide")).alias("one"))
    classes = common.cut(classes, "classes")
    settled = members.join(classes.where("n > 1").select("cls"), "cls").select("row", "lo", (F.col("lo") + F.col("wide")).alias("hi"))
    settled = common.cut(settled, "settled")
    common.discard(members)
    mixed = common.cut(classes.groupBy("grp").agg(F.count("*").alias("m")).where("m > 1").select("grp", (F.col("m") > LOCAL).alias("crowded")), "mixed")
    again = classes.join(mixed, "grp").select("grp", "crowded", F.col("one.row").alias("row"), F.col("one.lo").alias("lo"), F.col("one.wide").alias("wide"), (F.col("n") > 1).cast("int").alias("known"))
    again = common.cut(again, "again")
    common.discard(classes, mixed)

    def stretches(batches):
        import pyarrow as pa

        for part in slices(batches, "text", 2 << 20):
            raw = [t.encode() for t in part.column("text").to_pylist()]
            rows = [(f["grp"], r, f["lo"], f["wide"], f["known"], t[f["lo"] : f["lo"] + f["wide"] + span]) for r, t, found in zip(part.column("row").to_pylist(), raw, part.column("found").to_pylist()) for f in found]
            for at in range(0, len(rows), 8192):
                cols = list(zip(*rows[at : at + 8192]))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int8(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["grp", "row", "lo", "wide", "known", "bytes"])

    def resolved(batches):
        """Buckets of a few sub-buckets, side by side: equal windows within a bucket."""
        import pyarrow as pa

        def judge(table):
            buf, starts = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8), None
            grp, row, lo, wide, known = (table.column(c).to_numpy() for c in ("grp", "row", "lo", "wide", "known"))
            size = wide.astype(np.int64) + span
            starts = np.cumsum(size) - size
            i = np.repeat(np.arange(len(grp)), size - span + 1)
            p = starts[i] + np.arange(len(i)) - np.searchsorted(i, i)
            # a text that repeats itself closely reaches one window from two anchors: it counts once, as known if either is
            order = np.argsort(-known[i], kind="stable")
            i, p = i[order], p[order]
            bucket = mix(grp.view(np.uint64))[i]
            place = mix(mix(row.view(np.uint64))[i] + (lo[i] + p - starts[i]).astype(np.uint64)) ^ bucket
            one = np.unique(place, return_index=True)[1]
            i, p = i[one], p[one]
            key = _Ids(buf).of(p, p + span) ^ bucket[one]
            _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
            good = (n[inverse] > 1) & (known[i] == 0)
            at = lo[i[good]] + (p[good] - starts[i[good]])
            return pa.RecordBatch.from_arrays([pa.array(row[i[good]]), pa.array(at), pa.array(at)], ["row", "lo", "hi"])

        held = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 16_384:
                continue
            table = pa.Table.from_batches(held)
            grp = table.column("grp").to_numpy()
            cut = int(np.searchsorted(grp, grp[-1]))
            if cut:
                yield judge(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held:
            yield judge(pa.Table.from_batches(held))

    few = again.where(~F.col("crowded"))
    side = _with_lists(stored, few, ["grp", "lo", "wide", "known"]).mapInArrow(stretches, "grp long, row long, lo long, wide short, known byte, bytes binary")
    late = common.cut(side.repartition(common.partitions(stored.sparkSession), "grp").sortWithinPartitions("grp").mapInArrow(resolved, "row long, lo long, hi long"), "late")

    def windows(batches):
        import pyarrow as pa

        for part in slices(batches, "text", 1 << 20):
            buf, starts = concatenate(part.column("text").to_pylist())
            p, doc, known = _places(*_lists(part.column("found")), starts, span)
            ids = _Ids(buf).of(p, p + span)
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(part.column("row").to_numpy()[doc]), pa.array(p - starts[doc]), pa.array(known.astype(np.int8))], ["id", "row", "lo", "known"])

    crowded = again.where("crowded")
    fine = common.cut(_with_lists(stored, crowded, ["lo", "wide", "known"]).mapInArrow(windows, "id long, row long, lo long, known byte"), "windows")
    twice = common.cut(fine.groupBy("id").agg(F.count("*").alias("n"), F.min("known").alias("k")).where("n > 1 and k = 0").select("id"), "twice")
    last = common.cut(fine.where("known = 0").join(twice, "id").select("row", "lo", F.col("lo").alias("hi")), "last")
    common.discard(again, fine, twice)
    return settled.unionByName(late).unionByName(last)


def removed(stored: DataFrame, span: int = 200) -> DataFrame:
    """(row, spans array<struct<start, stop>>): the maximal runs of bytes that repeated windows cover."""
    found = repeats(stored, span).groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            spans = []
            for pairs in batch.column(1):
                lo, hi = (pairs.values.field(i).to_numpy() for i in (0, 1))
                order = np.argsort(lo, kind="stable")
                lo, end = lo[order], np.maximum.accumulate(hi[order] + span)
                first = np.flatnonzero(np.r_[True, lo[1:] > end[:-1]])
                spans.append([{"start": a, "stop": b} for a, b in zip(lo[first].tolist(), end[np.r_[first[1:], len(lo)] - 1].tolist())])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["row", "spans"])

    return found.mapInArrow(run, "row long, spans array<struct<start:long,stop:long>>")


def _kept(raw: bytes, spans) -> bytes:
    out, at = [], 0
    for s in spans or ():
        out.append(raw[at : s["start"]])
        at = s["stop"]
    return b"".join([*out, raw[at:]])


def strip(docs: DataFrame, span: int = 200) -> DataFrame:
    """doc_id, n_bytes, spans, kept (binary): what is left of every document."""
    stored = store(docs.select("doc_id", "text"))
    spans = common.cut(removed(stored, span), "spans")

    def run(batches):
        import pyarrow as pa

        for part in slices(batches, "text", 2 << 20):
            raw = [(t or "").encode() for t in part.column("text").to_pylist()]
            kept = [_kept(r, s) for r, s in zip(raw, part.column("spans").to_pylist())]
            cols = [part.column("doc_id").combine_chunks(), pa.array([len(r) for r in raw], pa.int64()), part.column("spans").combine_chunks(), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "spans", "kept"])

    rows = stored.join(spans, "row", "left").select(F.col("rest.doc_id").cast("long").alias("doc_id"), "text", "spans")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")


def shorten(docs: DataFrame, span: int = 200) -> DataFrame:
    """``docs`` with the repeated bytes cut from text; a character that a cut splits goes too, n_chars follows."""
    stored = store(docs)
    spans = common.cut(removed(stored, span), "spans")

    def run(batches):
        import pyarrow as pa

        for part in slices(batches, "text", 2 << 20):
            text = [t if t is None or s is None else _kept(t.encode(), s).decode(errors="ignore") for t, s in zip(part.column("text").to_pylist(), part.column("spans").to_pylist())]
            out = pa.table([pa.array(text, pa.string()), part.column("rest")], ["text", "rest"])
            yield from out.to_batches()

    rows = stored.join(spans, "row", "left").select("text", "spans", "rest")
    cut_ = rows.mapInArrow(run, T.StructType([T.StructField("text", T.StringType()), stored.schema["rest"]]))
    # positions, not names: a column may bear any name
    field = {c: F.col("rest").getField(c) for c in docs.columns if c != "text"}
    if "n_chars" in field:
        field["n_chars"] = F.when(field["n_chars"].isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)
    return cut_.select(*(F.col("text") if c == "text" else field[c].alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = strip(common.read(spark, sf_dir, "documents"))
    cut = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>")), F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", cut.alias("n_removed"), F.greatest(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
