"""Packing token ids into fixed windows by minimum bin slack.

Every document is cut into full windows of ``capacity`` ids and one remainder. Whole windows stand
alone and are numbered where they are cut, after the counts of the tasks before. The remainders are described by one count per length (at most capacity - 1 counts, whatever
the corpus size). Over these counts a bitset subset-sum program finds the multiset of lengths whose
sum comes closest to the capacity, backtracking gives how often each length is in it, and that
pattern is used as often as the counts allow. Each use exhausts some length, so there are few
patterns. Remainders are then dealt to the pattern's places by their rank among their own length;
ranks are formed in salted groups of some ``GROUP`` remainders, so that a very common length needs no
task of its own, whatever the corpus size.

Defined cases: a null text is empty and packs its end id alone; repeated rows are packed each on
its own; other columns of the input are left out; an empty table gives no piece.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .pieces import STEP, slices, units

#: remainders of one length that one task ranks
GROUP = 1 << 18


def tokenize(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids, nth): pieces of at most ``capacity`` ids (little-endian uint32), whole text,
    end id last; nth numbers the full windows of a task from 0 and is null for remainders."""

    def run(batches):
        import pyarrow as pa

        tok, windows = units(path, False), 0
        for part in slices(batches, "text", STEP):
            ids, stop = tok.encode(part.column("text").to_pylist())
            raw = np.insert(ids, stop, end_id).astype("<u4").tobytes()
            out: list[tuple] = []
            begin = 0
            for doc, end in zip(part.column("doc_id").to_pylist(), (stop + np.arange(1, len(stop) + 1)).tolist()):
                n = end - begin
                out += [(doc, at, min(capacity, n - at), n, raw[4 * (begin + at) : 4 * min(begin + at + capacity, end)]) for at in range(0, n, capacity)]
                begin = end
            cols = list(zip(*out)) if out else [[]] * 5
            full = np.array(cols[2], np.int64) == capacity
            nth = pa.array(windows + np.cumsum(full) - 1, mask=~full)
            windows += int(full.sum())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary()), nth], ["doc_id", "start", "length", "doc_tokens", "ids", "nth"])

    source = common.texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary, nth long")


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths within ``counts`` whose sum is the largest up to ``capacity``: a bitset of
    reachable sums after each binary bundle of a length, then backtracking through the bitsets."""
    keep = (1 << (capacity + 1)) - 1
    reach, trail = 1, []
    for length in sorted(counts, reverse=True):
        left, bundle = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(bundle, left)
            trail.append((reach, length, take))
            reach |= (reach << (length * take)) & keep
            left -= take
            bundle *= 2
        if reach >> capacity & 1:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for before, length, take in reversed(trail):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(copies, pattern) until every remainder has a place; the largest length left seeds each search
    only through the order of bundles, so long remainders go first."""
    left = {k: v for k, v in counts.items() if v > 0}
    out = []
    while left:
        seed = max(left)
        rest = dict(left)
        rest[seed] -= 1
        if not rest[seed]:
            del rest[seed]
        used = closest_fill({k: v for k, v in rest.items() if k <= capacity - seed}, capacity - seed)
        used[seed] = used.get(seed, 0) + 1
        copies = min(left[k] // n for k, n in used.items())
        out.append((copies, used))
        for k, n in used.items():
            left[k] -= n * copies
            if not left[k]:
                del left[k]
    return out


def pack(
    docs: DataFrame,
    path: str,
    end_id: int,
    capacity: int = 2048,
    payload: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and the columns of
    ``payload``, made from ids where they are (default: the ids themselves)."""
    spark = docs.sparkSession
    payload = payload or {"ids": F.col("ids")}
    made = tokenize(docs, path, end_id, capacity).select("doc_id", "start", "length", "doc_tokens", *(c.alias(k) for k, c in payload.items()), "nth")
    made = common.cut(made.withColumns({"_row": F.monotonically_increasing_id(), "_task": F.spark_partition_id()}), "pieces")
    windows, rest = made.where("nth is not null"), made.where("nth is null")
    # one row per task that has cut windows, and the windows of the tasks before it
    tasks = windows.groupBy("_task").agg(F.count("*").alias("_n"))
    tasks = common.cut(tasks.withColumn("_before", F.sum("_n").over(W.orderBy("_task").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")), "tasks")
    full = tasks.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    counts = {r["length"]: r["n"] for r in rest.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = spark.createDataFrame([(k, -(-n // GROUP)) for k, n in counts.items()], "length long, _salts long")
    salted = rest.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64("_row"), F.col("_salts")))
    groups = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    # every length's places before this salt: a row for each length, and for each GROUP remainders
    groups = common.cut(groups.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))), "lengths")
    places: list[tuple] = []
    base, taken = full, dict.fromkeys(counts, 0)
    for copies, used in plan(counts, capacity):
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            places.append((length, taken[length], taken[length] + n * copies, n, base, offset))
            taken[length] += n * copies
            offset += length * n
        base += copies
    table = spark.createDataFrame(places, "p_length long, p_from long, p_to long, p_n long, p_base long, p_offset long")
    ranked = (
        salted.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "start", "_row")) - 1)
        .join(F.broadcast(groups.select("length", "_salt", "_before")), ["length", "_salt"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
    )
    # a length has as many intervals as patterns that hold it: found by position, not by comparing with each
    index = table.groupBy(F.col("p_length").alias("length")).agg(F.sort_array(F.collect_list(F.struct("p_from", "p_to", "p_n", "p_base", "p_offset"))).alias("_places"))
    out = ranked.join(F.broadcast(index), "length").withColumn("_p", F.filter("_places", lambda p: (p["p_from"] <= F.col("_rank")) & (F.col("_rank") < p["p_to"]))[0])
    local = F.col("_rank") - F.col("_p.p_from")
    alone = windows.join(F.broadcast(tasks.select("_task", "_before")), "_task")
    alone = alone.select("doc_id", "start", "length", "doc_tokens", *payload, (F.col("_before") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.unionByName(out.select(
        "doc_id", "start", "length", "doc_tokens", *payload,
        (F.col("_p.p_base") + F.floor(local / F.col("_p.p_n"))).cast("long").alias("sequence_id"),
        (F.col("_p.p_offset") + F.pmod(local, F.col("_p.p_n")) * F.col("length")).cast("long").alias("offset"),
    ))


def padding(pieces_: DataFrame, capacity: int) -> DataFrame:
    """Padded ids per sequence: none at the capacity or at a power of two."""
    used = pieces_.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    power = F.bit_count("used") == 1
    return used.select("sequence_id", "used", F.when(power, 0).otherwise(capacity - F.col("used")).alias("padding"))


def tokenizer_path() -> str:
    import public_tokenizers as P

    return P.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None, crc: Callable = F.crc32) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents") if docs is None else docs
    out = pack(docs, tokenizer_path(), 1, 2048, {"ids_crc32": crc(F.col("ids")).cast("long")})
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
