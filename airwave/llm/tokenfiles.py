"""Token files: frequency-ranked ids in byte-aligned variable-length coding, control bytes apart.

Ids are replaced by their frequency rank over the whole corpus, so that common ids take one byte.
Each value has a two-bit length code; four codes share one control byte, and the control bytes of a
block stand apart from its data bytes. Decoding looks lengths up in a table of 256 x 4 and gathers
the data bytes with numpy. A block is a row (shard, block, doc_ids, counts, control, data) of the
Parquet container that Spark's own writer commits, so a lost task leaves no half-written file.

Defined cases: a null text is empty and holds its end id alone; repeated rows are stored each;
rows without doc_id come first; other columns are left out; an empty table gives empty files.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .pieces import STEP, slices, units

#: ids of one block at most (a longer document is a block of its own)
BLOCK = 1 << 19
#: Fixed by the format: bytes of each of the four values that a control byte describes.
LENGTHS = np.array([[1 + (c >> 2 * k & 3) for k in range(4)] for c in range(256)], np.int64)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = values.astype("<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = code
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return control.tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    lens = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    at = np.cumsum(lens) - lens
    out = raw[at].astype(np.uint32)
    for k in range(1, int(lens.max()) if n else 1):
        longer = np.flatnonzero(lens > k)
        out[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _tokenized(docs: DataFrame, path: str, end_id: int) -> tuple[DataFrame, str, int]:
    """(doc_id, n, ids): ids of the whole text and the end id, two bytes each where the vocabulary allows, compressed."""
    import json

    with open(path) as f:
        spec = json.load(f)
    top = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"]), end_id])
    kind = "<u2" if top < 1 << 16 else "<u4"

    def run(batches):
        import pyarrow as pa
        import zstandard

        tok, squeeze = units(path, True), zstandard.ZstdCompressor(level=1)
        for part in slices(batches, "text", STEP):
            ids, stop = tok.encode(part.column("text").to_pylist())
            raw = np.insert(ids, stop, end_id).astype(kind)
            stop = stop + np.arange(1, len(stop) + 1)
            start = np.r_[0, stop[:-1]]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").combine_chunks().cast(pa.int64()),
                    pa.array(stop - start),
                    pa.array([squeeze.compress(raw[a:b].tobytes()) for a, b in zip(start.tolist(), stop.tolist())], pa.binary()),
                ],
                ["doc_id", "n", "ids"],
            )

    out = common.texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, ids binary")
    return out, kind, top + 1


def write(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> None:
    """Write ``path``/blocks and ``path``/tokens (rank, id), documents in ascending doc_id order."""
    spark = docs.sparkSession
    made, kind, size = _tokenized(docs, tokenizer, end_id)
    made = common.cut(made, "ids")

    def count(batches):
        import pyarrow as pa
        import zstandard

        open_, total, held = zstandard.ZstdDecompressor(), np.zeros(size, np.int64), []
        for batch in batches:
            for x in batch.column(0).to_pylist():
                held.append(np.frombuffer(open_.decompress(x), kind))
                if sum(map(len, held[-64:])) > size or len(held) >= 64:
                    total += np.bincount(np.concatenate(held), minlength=size)
                    held = []
        if held:
            total += np.bincount(np.concatenate(held), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    freq = made.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = sorted((-r["n"], r["id"]) for r in freq.collect())  # as many rows as the vocabulary at most
    ids = [i for _, i in ranked]
    spark.createDataFrame([*enumerate(ids)], "rank long, id long").coalesce(1).write.parquet(f"{path}/tokens")
    rank = np.zeros(size, np.uint32)
    rank[ids] = np.arange(len(ids))

    def blocks(batches):
        import pyarrow as pa
        import zstandard

        open_, shard, number = zstandard.ZstdDecompressor(), TaskContext.get().partitionId(), 0
        names: list = []
        held: list = []

        def row():
            nonlocal number
            control, data = encode_values(np.concatenate(held))
            out = [[shard], [number], [names[:]], [[len(x) for x in held]], [control], [data]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            number += 1
            names.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["shard", "block", "doc_ids", "counts", "control", "data"])

        total = 0
        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = rank[np.frombuffer(open_.decompress(x), kind)]
                if held and total + len(values) > BLOCK:
                    yield row()
                    total = 0
                names.append(doc)
                held.append(values)
                total += len(values)
        if held:
            yield row()

    ordered = made.repartitionByRange(max(common.partitions(spark), 1), F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "n", F.xxhash64("ids"))
    schema = "shard int, block int, doc_ids array<long>, counts array<long>, control binary, data binary"
    ordered.select("doc_id", "ids").mapInArrow(blocks, schema).write.option("compression", "zstd").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian uint32)."""
    table = np.array([r["id"] for r in spark.read.parquet(f"{path}/tokens").orderBy("rank").collect()], np.uint32)
    rows = spark.read.parquet(f"{path}/blocks").withColumn("_n", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))
    totals = sorted((r["shard"], r["n"]) for r in rows.groupBy("shard").agg(F.sum("_n").alias("n")).collect())  # one row per shard
    before = dict(zip([s for s, _ in totals], np.cumsum([0] + [n for _, n in totals]).tolist()))
    starts = rows.select("shard", "block", "_n").withColumn("_start", F.coalesce(F.sum("_n").over(W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    base = spark.createDataFrame([*before.items()] or [(0, 0)], "shard int, _base long")
    starts = starts.join(F.broadcast(base), "shard").select("shard", "block", (F.col("_start") + F.col("_base")).alias("_start"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                counts = np.array(r["counts"], np.int64)
                ids = table[decode_values(r["control"], r["data"], int(counts.sum()))].astype("<u4")
                stop = np.cumsum(counts)
                raw = ids.tobytes()
                cut = [raw[4 * (b - n) : 4 * b] for b, n in zip(stop.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(r["_start"] + stop - counts), pa.array(counts), pa.array(cut, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    located = rows.join(starts, ["shard", "block"]).select("doc_ids", "counts", "control", "data", "_start")
    return located.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    path = common.new_path(spark, "tokens")
    write(common.read(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), 0, path)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").cast("long").alias("ids_crc32"))
