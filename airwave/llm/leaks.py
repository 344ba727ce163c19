"""Benchmark decontamination as a prefix-filtered set join.

An item is cut into windows of ``width`` consecutive words (a shorter item is one window), and a window
into word shingles. Shingles are ordered by rarity: each is counted over all documents. A document that
contains a window contains all of its shingles, so a prefix of one is enough - the window's rarest - and a
window with a shingle that no document has is done. Documents are joined to windows on these prefix
shingles alone; an occurrence fixes where the window would begin, which has to leave room for all of it
inside the document's words (positional and length bounds), and what is left is verified byte by byte over
the whole window.

The windows are the join's small side. They are broadcast in blocks of at most ``PAIRS`` pairs of window
and item, so a worker's memory is bounded whatever the benchmark; a larger one takes another scan of the
documents for each block, and the blocks' findings are united. Documents are never shuffled for one block.

Defined cases: null and wordless texts have no words, null and wordless items no window; an item that
stands twice is one; an item without an id marks words but is not listed; repeated rows of documents are
judged each; other columns, whatever their names, pass through ``clean`` and reach nothing else; without
benchmark rows nothing is hit; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .hashing import ALNUM, LOWER, Probe, concatenate, mix, same_bytes, words
from .pieces import slices

#: words of a shingle, pairs of window and item that are broadcast at once, bytes of text judged at a time, and
#: possible places of windows that are verified at once
SHINGLE, PAIRS, STEP, PLACES = 3, 1 << 19, 4 << 20, 1 << 20

#: words first..last-1 of a text and the bytes start..stop-1 that they cover
_SPANS = "array<struct<first:long,last:long,start:long,stop:long>>"


class Text(NamedTuple):
    """Words of some texts: their hashes and texts, and their places in the texts' bytes and in the folded words joined by blanks."""

    starts: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    plain: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def read_words(texts: list[str]) -> Text:
    buf, starts = concatenate(texts)
    h, doc, first, last = words(buf, starts, ALNUM)
    inside = ALNUM[buf]
    keep = inside.copy()
    keep[last] = True  # the byte after a word stands for the blank
    plain = np.where(inside, LOWER[buf], np.uint8(32))[keep]
    size = last - first
    end = np.cumsum(size + 1) - 1
    return Text(starts, h, doc, first, last, plain, end - size, end)


def shingles(t: Text, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every run of ``k`` words within a text."""
    n = len(t.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    x = mix(t.hash[:n] + np.uint64(k))
    for i in range(1, k):
        x = mix(x * np.uint64(0x9FB21C651E98DF25) + t.hash[i : n + i])
    at = np.flatnonzero(t.doc[:n] == t.doc[k - 1 :])
    return x[at], at


def windows_of(benchmark: DataFrame, width: int) -> DataFrame:
    """(item_id, window binary, size): every item's windows, words folded and joined by blanks."""

    def run(batches):
        import pyarrow as pa

        for part in slices(batches, "text", STEP):
            t = read_words(part.column("text").to_pylist())
            count = np.bincount(t.doc, minlength=part.num_rows)
            size = np.minimum(count, width)
            n = np.where(count > 0, count - size + 1, 0)
            item = np.repeat(np.arange(part.num_rows), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + (np.cumsum(count) - count)[item]
            raw, size = t.plain.tobytes(), size[item]
            windows = [raw[a:b] for a, b in zip(t.begin[at].tolist(), t.end[at + size - 1].tolist())]
            ids = part.column("item_id").combine_chunks().take(pa.array(item))
            yield pa.RecordBatch.from_arrays([ids, pa.array(windows, pa.binary()), pa.array(size, pa.int32())], ["item_id", "window", "size"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "item_id long, window binary, size int").distinct()


def shingles_of(windows: DataFrame) -> DataFrame:
    """(window, shingle, k, place): every window's shingles of k words and the word at which each begins."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw, size = batch.column(0), batch.column(1).to_numpy()
            t = read_words([w.decode() for w in raw.to_pylist()])
            from_word = np.searchsorted(t.doc, np.arange(batch.num_rows))
            for k in np.unique(np.minimum(size, SHINGLE)).tolist():
                x, at = shingles(t, k)
                mine = np.minimum(size[t.doc[at]], SHINGLE) == k
                x, at = x[mine], at[mine]
                own = t.doc[at]
                cols = [raw.take(pa.array(own)), pa.array(x.view(np.int64)), pa.array(np.full(len(x), k, np.int32)), pa.array((at - from_word[own]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["window", "shingle", "k", "place"])

    return windows.select("window", "size").mapInArrow(run, "window binary, shingle long, k int, place int")


def counted(docs: DataFrame, keys: np.ndarray, sizes: list[int]) -> DataFrame:
    """(shingle, n): how often documents hold each of the shingles ``keys``."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches):
        import pyarrow as pa

        probe = Probe(shared.value)
        n = np.zeros(len(probe.keys), np.int64)
        for part in slices(batches, "text", STEP):
            t = read_words(part.column("text").to_pylist())
            for k in sizes:
                _, which = probe(shingles(t, k)[0])
                n += np.bincount(which, minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(probe.keys[some].view(np.int64)), pa.array(n[some])], ["shingle", "n"])

    return docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


class Index(NamedTuple):
    """Windows by their prefix shingle: keys in order, where each one's windows begin, and of each window its
    bytes, its size, the prefix's place in it and its items."""

    keys: np.ndarray
    from_key: np.ndarray
    blob: np.ndarray
    stop: np.ndarray
    size: np.ndarray
    place: np.ndarray
    items: np.ndarray
    item_stop: np.ndarray


def index_of(docs: DataFrame, pairs: DataFrame) -> Index | None:
    """The index over ``pairs`` (item_id, window, size), of which there are ``PAIRS`` or so."""
    windows = pairs.groupBy("window").agg(F.first("size").alias("size"), F.sort_array(F.collect_set("item_id")).alias("items"))
    parts = common.cut(shingles_of(windows), "shingles")
    sizes = [r["k"] for r in parts.select("k").distinct().collect()]
    keys = np.sort(np.array([r["shingle"] for r in parts.select("shingle").distinct().collect()], np.int64).view(np.uint64))
    if not len(keys):
        return None
    rarity = common.cut(counted(docs, keys, sizes), "rarity")
    ranked = parts.join(rarity, "shingle", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "place")).alias("p"))
    rows = ranked.where("p.n > 0").join(windows, "window").select("p.shingle", "p.place", "size", "window", "items").collect()
    rows.sort(key=lambda r: r["shingle"] & (1 << 64) - 1)
    if not rows:
        return None
    key = np.array([r["shingle"] for r in rows], np.int64).view(np.uint64)
    known, first = np.unique(key, return_index=True)
    ints = lambda values: np.array(values, np.int64)
    return Index(
        known, np.r_[first, len(rows)], np.frombuffer(b"".join(bytes(r["window"]) for r in rows), np.uint8), np.cumsum([len(r["window"]) for r in rows]),
        ints([r["size"] for r in rows]), ints([r["place"] for r in rows]), ints([i for r in rows for i in r["items"]]), np.cumsum([len(r["items"]) for r in rows]),
    )


def verified(t: Text, probe: Probe, index: Index, k: int, n_texts: int):
    """(first word, window) of every occurrence of windows whose prefix has ``k`` words."""
    x, at = shingles(t, k)
    some, which = probe(x)
    at = at[some]
    from_word = np.searchsorted(t.doc, np.arange(n_texts + 1))
    n = index.from_key[which + 1] - index.from_key[which]
    done = np.cumsum(n)
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + PLACES, "right")))
        m = n[lo:hi]
        w = np.repeat(index.from_key[which[lo:hi]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        p = np.repeat(at[lo:hi], m)
        begin, doc = p - index.place[w], t.doc[p]
        ok = (begin >= from_word[doc]) & (begin + index.size[w] <= from_word[doc + 1]) & (np.minimum(index.size[w], SHINGLE) == k)
        begin, w = begin[ok], w[ok]
        stop = index.stop[w]
        start = np.where(w > 0, index.stop[w - 1], 0)
        ok = same_bytes(t.plain, t.begin[begin], t.end[begin + index.size[w] - 1], index.blob, start, stop)
        yield begin[ok], w[ok]
        lo = hi


def scanned(docs: DataFrame, index: Index | None) -> DataFrame:
    """``docs`` (text and others) without text and with n_words, spans (runs of hit words) and items."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    others = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches):
        import pyarrow as pa

        index = shared.value
        probe = Probe(index.keys) if index else None
        sizes = np.unique(np.minimum(index.size, SHINGLE)).tolist() if index else []
        for part in slices(batches, "text", STEP):
            rows = part.num_rows
            t = read_words(part.column("text").to_pylist())
            edge, pairs = np.zeros(len(t.hash) + 1, np.int64), [np.zeros((0, 2), np.int64)]
            for k in sizes:
                for begin, w in verified(t, probe, index, k, rows):
                    edge += np.bincount(begin, minlength=len(edge)) - np.bincount(begin + index.size[w], minlength=len(edge))
                    pairs.append(np.unique(np.stack([t.doc[begin], w], 1), axis=0))
            hit = np.cumsum(edge[:-1]) > 0
            pair = np.unique(np.concatenate(pairs), axis=0)
            n = index.item_stop[pair[:, 1]] - np.where(pair[:, 1] > 0, index.item_stop[pair[:, 1] - 1], 0) if len(pair) else np.zeros(0, np.int64)
            item = index.items[np.repeat(index.item_stop[pair[:, 1]] - np.cumsum(n), n) + np.arange(n.sum())] if len(pair) else n
            found = np.unique(np.stack([np.repeat(pair[:, 0], n), item], 1), axis=0)
            opens = hit & np.r_[True, ~hit[:-1] | (t.doc[1:] != t.doc[:-1])] if len(hit) else hit
            closes = hit & np.r_[~hit[1:] | (t.doc[1:] != t.doc[:-1]), True] if len(hit) else hit
            own, from_word = t.doc[opens], np.searchsorted(t.doc, np.arange(rows + 1))
            parts = [np.flatnonzero(opens) - from_word[own], np.flatnonzero(closes) + 1 - from_word[own], t.first[opens] - t.starts[own], t.last[closes] - t.starts[own]]
            spans = pa.StructArray.from_arrays([pa.array(x) for x in parts], ["first", "last", "start", "stop"])
            ends = lambda doc: pa.array(np.searchsorted(doc, np.arange(rows + 1)).astype(np.int32))
            cols = [part.column(f.name).combine_chunks() for f in others]
            cols.append(pa.array(np.bincount(t.doc, minlength=rows)))
            cols += [pa.ListArray.from_arrays(ends(own), spans), pa.ListArray.from_arrays(ends(found[:, 0]), pa.array(found[:, 1]))]
            yield from pa.table(cols, [*(f.name for f in others), "n_words", "spans", "items"]).to_batches()

    more = T._parse_datatype_string(f"n_words long, spans {_SPANS}, items array<long>")
    more = T.StructType.fromDDL(f"n_words long, spans {_SPANS}, items array<long>")
    return docs.mapInArrow(run, T.StructType([*others, *more.fields]))


def _united(spans):
    """Maximal runs of spans of words that overlap or follow each other."""
    none = F.array().cast(_SPANS)

    def step(done, s):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"), last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        before = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when((F.size(done) > 0) & (s["first"] <= last["last"]), F.concat(before, F.array(joined))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), none, step)


def marks(docs: DataFrame, benchmark: DataFrame, width: int = 10, rest: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, spans, items (and ``rest``, a struct of all columns); spans are the
    bytes of the text that the words of occurring windows cover, items the ids of the windows' items."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("rest")] if rest else []))
    pairs = common.cut(windows_of(benchmark, width), "pairs")
    blocks = max(1, -(-pairs.count() // PAIRS))
    if blocks == 1:
        return scanned(rows, index_of(rows, pairs))
    # more blocks: each judges all documents; what they find is united by row
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    of_block = F.pmod(F.xxhash64("item_id", "window"), F.lit(blocks))
    found = []
    for b in range(blocks):
        one = scanned(rows.select("row", "text"), index_of(rows, pairs.where(of_block == b)))
        found.append(common.cut(one.where("size(spans) > 0").select("row", F.col("spans").alias("found_spans"), F.col("items").alias("found_items")), "found"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    both = every.groupBy("row").agg(_united(F.flatten(F.collect_set("found_spans"))).alias("found_spans"), F.array_distinct(F.flatten(F.collect_set("found_items"))).alias("found_items"))
    out = scanned(rows, None).join(both, "row", "left")
    return out.withColumns({"spans": F.coalesce("found_spans", "spans"), "items": F.coalesce("found_items", "items")}).drop("row", "found_spans", "found_items")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of the benchmark occurs."""
    return marks(docs, benchmark, width, rest=True).where(F.size("spans") == 0).select("rest.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = marks(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    ids = F.array_sort(F.col("items").cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


_LISTED = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_LISTED} AS w FROM documents),
i AS MATERIALIZED (SELECT item_id, {_LISTED} AS w FROM benchmark),
win AS MATERIALIZED (
  SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)
),
placed AS (
  SELECT r, p, k, array_to_string(w[p:p + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM win))
),
hit AS MATERIALIZED (SELECT DISTINCT r, p, k, item_id FROM placed JOIN win USING (k, g)),
word AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM hit) GROUP BY r),
item AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (r) LEFT JOIN item USING (r)
"""
