"""Exact dedup over an extendible-hash index on shared files.

Texts are addressed by a 64-bit hash. The directory maps the leading bits of a hash to a bucket: it
doubles whenever a bucket as deep as the directory is overfull, and the bucket splits. It is made from
counts of different hashes by leading bits, to a depth that follows the number of hashes, and holds at
most about ``SLOTS`` slots, since a bucket's capacity grows with the table beyond that.

Each task first combines the equal texts of what it reads, so a text that a third of all rows share
sends a row per task and slice. Owner tasks take key ranges: buckets in the order of the directory, which
is the order of the hashes, are dealt evenly to them. An owner reads its entries sorted by hash, chains the
different texts that meet on one hash by comparing their bytes, and files the classes by bucket. A lookup
goes through the directory to the bucket, and there to the hash and the digest of the chained text.

Defined cases: a null text counts as empty; a row that repeats doc_id and text leaves one kept row;
a null doc_id loses against any other and is kept only in a group without ids; other columns, whatever
their names, are left out of the decisions; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .pieces import slices

#: Entries of a bucket before it splits, slots of the directory at most (times four at worst), bytes of texts combined at a time.
CAPACITY, SLOTS, STEP = 50_000, 1 << 16, 16 << 20


class Index(NamedTuple):
    """The filed classes (bucket, hash, chain, text_sha256, keep_id, group_size) and the directory that leads to them."""

    classes: DataFrame
    slots: list[int]


def directory(counts: dict[int, int], capacity: int, max_depth: int) -> list[int]:
    """Bucket of each slot of the final directory, from entry counts by ``max_depth`` leading bits."""
    buckets = {0: (0, 0)}  # bucket -> (depth, leading bits)
    slots, depth = [0], 0
    todo = [0]
    level = counts
    levels = [counts]  # entries by max_depth, max_depth - 1, ... leading bits
    for _ in range(max_depth):
        up: dict[int, int] = {}
        for k, n in level.items():
            up[k >> 1] = up.get(k >> 1, 0) + n
        levels.append(level := up)
    while todo:
        bucket = todo.pop()
        own, bits = buckets[bucket]
        if own == max_depth or levels[max_depth - own].get(bits, 0) <= capacity:
            continue
        if own == depth:
            slots = [b for b in slots for _ in (0, 1)]
            depth += 1
        new = len(buckets)
        buckets[bucket], buckets[new] = (own + 1, bits << 1), (own + 1, bits << 1 | 1)
        span = 1 << (depth - own - 1)
        first = (bits << 1 | 1) * span
        slots[first : first + span] = [new] * span
        todo += [bucket, new]
    return slots


def _hashed(docs: DataFrame, normalise: Callable[[Column], Column]) -> DataFrame:
    text = normalise(F.col("text"))
    return common.texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", "text", F.xxhash64("text").alias("hash"))


def _slot(slots: list[int]) -> Column:
    """Number of the slot: the leading bits of the hash."""
    depth = (len(slots) - 1).bit_length()
    return F.shiftrightunsigned("hash", 64 - depth).cast("int") if depth else F.lit(0)


def _bucket(slots: list[int]) -> Column:
    return F.element_at(F.lit(slots), _slot(slots) + 1) if len(slots) > 1 else F.lit(0)


def _combined(batches):
    """Equal texts of a slice become one entry (hash, text, keep_id, group_size)."""
    import pyarrow as pa

    for part in slices(batches, "text", STEP):
        one = part.group_by(["hash", "text"], use_threads=False).aggregate([("doc_id", "max"), ([], "count_all")])
        yield from pa.table({"hash": one["hash"], "text": one["text"], "keep_id": one["doc_id_max"], "group_size": one["count_all"]}).to_batches()


def _chained(batches):
    """Classes of entries that come sorted by hash: different texts on one hash are chained in the order of their bytes."""
    import hashlib

    import pyarrow as pa

    names, kinds = ["slot", "hash", "chain", "text_sha256", "keep_id", "group_size"], [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
    done: list[tuple] = []
    here, chain = None, {}

    def close():
        for nth, text in enumerate(sorted(chain)):
            done.append((*here, nth, hashlib.sha256(text).hexdigest(), *chain[text]))

    def batch():
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
        done.clear()
        return out

    for rows in batches:
        columns = [rows.column(c).to_pylist() for c in ("slot", "hash", "keep_id", "group_size")]
        for slot, key, keep, size, text in zip(*columns, rows.column("text").to_pylist()):
            if (slot, key) != here:
                if here is not None:
                    close()
                here, chain = (slot, key), {}
            raw = text.encode()
            best, n = chain.get(raw, (None, 0))  # the chain's texts are compared byte by byte
            chain[raw] = (keep if best is None or keep is not None and keep > best else best, n + size)
        if len(done) > 10_000:
            yield batch()
    if here is not None:
        close()
    if done:
        yield batch()


def build(docs: DataFrame, path: str, normalise: Callable[[Column], Column] = lambda c: c, capacity: int = CAPACITY) -> Index:
    """Write the index under ``path`` and return it."""
    spark = docs.sparkSession
    rows = _hashed(docs, normalise)
    hashes = common.cut(rows.select("hash").distinct(), "hashes")
    entries = hashes.count()
    capacity = max(capacity, -(-entries // SLOTS))
    depth = (entries // capacity).bit_length() + 2 if entries > capacity else 0  # two bits to spare for uneven buckets
    lead = F.shiftrightunsigned("hash", 64 - depth).cast("int") if depth else F.lit(0)
    counts = {r["p"]: r["n"] for r in hashes.groupBy(lead.alias("p")).agg(F.count("*").alias("n")).collect()}  # at most 2 ** depth rows
    slots = directory(counts, capacity, depth)
    owners = 16 * common.partitions(spark)  # several ranges a task even out its share
    entry = rows.select("hash", "text", "doc_id").mapInArrow(_combined, "hash long, text string, keep_id long, group_size long")
    # owner tasks take key ranges of equal length
    owner = F.floor(F.shiftrightunsigned("hash", 48) * owners / F.lit(1 << 16)).cast("int")
    dealt = entry.withColumn("slot", _slot(slots)).repartition(common.partitions(spark), owner).sortWithinPartitions("hash")
    classes = dealt.select("slot", "hash", "text", "keep_id", "group_size").mapInArrow(_chained, "slot int, hash long, chain int, text_sha256 string, keep_id long, group_size long")
    classes = classes.withColumn("bucket", _bucket(slots)).drop("slot")
    return Index(common.cut(classes, "index", path), slots)


def lookup(docs: DataFrame, index: Index, normalise: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = _hashed(docs, normalise).select("doc_id", "hash", _bucket(index.slots).alias("bucket"), F.sha2("text", 256).alias("text_sha256"))
    # of rows that repeat doc_id and text the first can stay; numbered by document, so a text that many share is dealt out
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("doc_id", "text_sha256").orderBy("hash")))
    found = rows.join(index.classes.select("bucket", "hash", "text_sha256", "keep_id", "group_size"), ["bucket", "hash", "text_sha256"])
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, index: Index, normalise: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """The documents that stay, with all their columns, whatever their names."""
    text = normalise(F.coalesce(F.col("text").cast("string"), F.lit("")))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    rows = docs.select(F.xxhash64(text).alias("hash"), F.sha2(text, 256).alias("text_sha256"), F.col("doc_id").cast("long").alias("id"), whole)
    keep = index.classes.select("bucket", "hash", "text_sha256", F.col("keep_id").alias("id"))
    key = F.struct(F.col("id").isNull(), F.coalesce("id", F.lit(0)))
    rows = rows.withColumn("bucket", _bucket(index.slots)).withColumn("key", key).drop("id")
    stay = rows.join(keep.select("bucket", "hash", "text_sha256", key.alias("key")), ["bucket", "hash", "text_sha256", "key"], "left_semi")
    nth = F.row_number().over(W.partitionBy("bucket", "hash", "text_sha256", "key").orderBy("hash"))
    return stay.withColumn("nth", nth).where("nth = 1").select("whole.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return lookup(docs, build(docs, common.new_path(spark, "exact")))


#: of rows that repeat doc_id and text one is kept, as the operator says
SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, ''))
         AND row_number() OVER (PARTITION BY coalesce(text, ''), doc_id) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
