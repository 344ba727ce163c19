"""Vector codes (product quantisation) by Lloyd rounds over resident members.

Every vector is scaled to integers and cut into equal parts. A part is a member of the entry of its
position's codebook that is nearest to it, and lives with that entry's owner: members are filed by
(position, entry, salt), where the salt splits a crowded entry into groups of some ``MEMBERS``. In a round the
owners sum the members that reside with them, which gives the new entries; then each owner assigns its
members again where they lie. Those that stay are read where they are in the next round; only parts that
change their entry go through a shuffle, to their new owner's file. What reaches the driver are the codebooks,
bounded by entries times dimensions. All arithmetic is exact: integers, and float products only where every
sum stays below 2 ** 53.

Defined cases: rows whose vector is null or holds null or non-finite components are left out; the codebooks
are of the length that most kept vectors have (the smaller one of equals) among multiples of the number of
parts; vectors of another length, and those whose components are too large for exact sums in 64 bits, stay
with a null code, error and label_error; a repeated vec_id is a vector of its own each time, and starting
entries that tie on it are ordered by their components; a null vec_id comes after all others; fewer vectors
than entries give as many entries; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .hashing import mix

#: members of one (position, entry, salt) if all vectors were in one entry, rows assigned at a time
MEMBERS, STEP = 1024, 4096
#: labels of more than this share of all rows take their sum by broadcast; there are fewer than its inverse
HOT = 1000
_KEYS = ("pos", "entry", "salt")


def finite(column: str = "embedding"):
    v = F.col(column)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & fine, F.lit(False))


def scaled(vectors: DataFrame, parts: int, scale: int) -> tuple[DataFrame, int]:
    """(row, vec_id, label, ints), written: ints is null where a vector can't be coded; and the codebooks' dimension."""
    rows = vectors.where(finite()).select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") * scale).alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).where(f"d > 0 and d % {parts} = 0")
    most = sizes.orderBy(F.desc("n"), "d").first()
    d = most["d"] if most else 0
    limit = min(1 << 30, int((2**62 / max(d, 1)) ** 0.5) // 2)
    good = F.lit(d > 0) & (F.size("v") == d) & F.forall("v", lambda x: F.abs(x) < limit)
    ints = F.when(good, F.transform("v", lambda x: F.floor(F.when(good, x).otherwise(0.0)).cast("int")))
    return common.cut(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", ints.alias("ints")), "vectors"), d


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row of integers (ties: the lower index) and the squared distance."""
    entry = np.zeros(len(x), np.int64)
    if not len(x):
        return entry, entry
    top = max(int(np.abs(x).max()), int(np.abs(book).max()))
    if 3 * book.shape[1] * top * top < 1 << 53:
        own, b = (book * book).sum(1).astype(np.float64), book.T.astype(np.float64)
        for at in range(0, len(x), STEP):
            entry[at : at + STEP] = np.argmin(own - 2 * (x[at : at + STEP].astype(np.float64) @ b), 1)
    else:
        step = max(1, (1 << 22) // book.size)
        for at in range(0, len(x), step):
            entry[at : at + step] = np.argmin(((x[at : at + step, None] - book[None]) ** 2).sum(2), 1)
    return entry, ((x - book[entry]) ** 2).sum(1)


def _part(batch) -> np.ndarray:
    values = batch.column(batch.schema.get_field_index("part")).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values.reshape(batch.num_rows, -1)


def _kept_lists(x: np.ndarray):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.astype(np.int32).ravel()))


def cut_parts(coded: DataFrame, books: np.ndarray, salts: int) -> DataFrame:
    """A member for each part of each vector, with its first entry; vec_id and label stay with part 0."""
    parts, _, width = books.shape

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, parts, width)
            row = batch.column(0)
            salt = pa.array((mix(row.to_numpy().view(np.uint64)) % np.uint64(salts)).astype(np.int32))
            for p in range(parts):
                entry, _ = nearest(x[:, p], books[p])
                ids = [c if p == 0 else pa.nulls(batch.num_rows, c.type) for c in (batch.column(1), batch.column(2))]
                cols = [pa.array(np.full(batch.num_rows, p, np.int32)), pa.array(entry.astype(np.int32)), salt, row, *ids, _kept_lists(x[:, p])]
                yield pa.RecordBatch.from_arrays(cols, [*_KEYS, "row", "vec_id", "label", "part"])

    kinds = {f.name: f for f in coded.schema.fields}
    ddl = T.StructType.fromDDL
    schema = T.StructType([*ddl("pos int, entry int, salt int, row long"), kinds["vec_id"], kinds["label"], *ddl("part array<int>")])
    return coded.select("row", "vec_id", "label", "ints").mapInArrow(run, schema)


def assigned(members: DataFrame, books: np.ndarray) -> DataFrame:
    """``members`` with next (the nearest entry now) and dist (squared distance to it)."""
    names = members.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x, pos = _part(batch), batch.column(0).to_numpy()
            entry, dist = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            for p in np.unique(pos).tolist():
                at = np.flatnonzero(pos == p)
                entry[at], dist[at] = nearest(x[at], books[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(entry.astype(np.int32)), pa.array(dist)], [*names, "next", "dist"])

    return members.mapInArrow(run, T.StructType([*members.schema.fields, *T.StructType.fromDDL("next int, dist long")]))


def means(members: DataFrame, books: np.ndarray) -> np.ndarray:
    """New codebooks: of each entry the floor of its members' mean, component by component; without members it stays."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = _part(batch)
            key = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            sums = np.add.reduceat(x[order], first, 0) if len(first) else x
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * books.shape[2]), pa.array(sums.ravel()))
            n = np.diff(np.r_[first, len(key)])
            yield pa.RecordBatch.from_arrays([pa.array((key[first] >> 32).astype(np.int32)), pa.array((key[first] & 0xFFFFFFFF).astype(np.int32)), pa.array(n), lists], ["pos", "entry", "n", "sums"])

    own = members.select("pos", "entry", "part").mapInArrow(run, "pos int, entry int, n long, sums array<long>")
    flat = own.select("pos", "entry", "n", F.posexplode("sums").alias("i", "s"))
    total = flat.groupBy("pos", "entry", "i").agg(F.sum(F.col("s").cast("decimal(28,0)")).alias("s"), F.sum("n").alias("n"))
    out = books.copy()
    for r in total.collect():
        out[r["pos"], r["entry"], r["i"]] = int(r["s"]) // r["n"]
    return out


def _filed(members: DataFrame) -> DataFrame:
    """``members`` in the owners' files: a bucket per owner, kept in the shared folder. What lies with its owner is
    written where it is; nothing is shuffled here."""
    spark, name = members.sparkSession, f"airwave_{uuid.uuid4().hex}"
    path = common.new_path(spark, "members")
    with common.tidy(spark):
        members.write.bucketBy(common.partitions(spark), *_KEYS).option("path", path).option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name goes, the files stay
    table.airwave_path = path
    return table


def _to_owners(members: DataFrame) -> DataFrame:
    return members.repartition(common.partitions(members.sparkSession), *_KEYS)


def quantize(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, codes array<int>, error long) of every kept row of ``vectors`` (vec_id, label, embedding), and the
    codebooks as an array (part, entry, component)."""
    rows, d = scaled(vectors, parts, scale)
    coded, other = rows.where("ints is not null"), rows.where("ints is null")
    bare = other.select("vec_id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error"))
    n = coded.count()
    if not n:
        return bare, np.zeros((parts, 0, d // parts), np.int64)
    seed = coded.orderBy(F.asc_nulls_last("vec_id"), "ints").limit(entries).select("ints").collect()
    books = np.array([r["ints"] for r in seed], np.int64).reshape(len(seed), parts, d // parts).transpose(1, 0, 2).copy()
    movers = _filed(_to_owners(cut_parts(coded, books, -(-n // MEMBERS))))
    names, residents, held = movers.columns, None, [movers]
    for turn in range(rounds):
        members = movers if residents is None else residents.select(names).unionByName(movers)
        books = means(members, books)
        if turn == rounds - 1:
            break
        judged = _filed(assigned(members, books))
        common.discard(*held)
        residents = judged.where("next = entry")
        moved = judged.where("next <> entry").withColumn("entry", F.col("next")).select(names)
        movers = _filed(_to_owners(moved))
        held = [judged, movers]
    last = assigned(members, books)
    codes = F.transform(F.sort_array(F.collect_list(F.struct("pos", "next"))), lambda s: s["next"])
    out = last.groupBy("row").agg(F.first("vec_id", True).alias("vec_id"), F.first("label", True).alias("label"), codes.alias("codes"), F.sum("dist").alias("error"))
    out = common.cut(out.select("vec_id", "label", "codes", "error"), "codes")
    common.discard(*held)
    return out.unionByName(bare), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error: error summed over the rows of a label (nulls together). The few labels that hold a large share
    of all rows are joined by broadcast, the others by shuffle."""
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(28,0)")).cast("long").alias("label_error"), F.count("*").alias("_n"))
    sums = common.cut(sums.withColumnRenamed("label", "_label"), "labels")
    line = int(sums.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]) // HOT
    hot = coded.join(F.broadcast(sums.where(F.col("_n") > line)), F.col("label").eqNullSafe(F.col("_label")), "left")
    rest = hot.where("_n is null").drop("_label", "label_error", "_n").join(sums.where(F.col("_n") <= line), F.col("label").eqNullSafe(F.col("_label")))
    both = hot.where("_n is not null").unionByName(rest)
    return both.drop("_label", "_n").withColumn("label_error", F.when(F.col("error").isNotNull(), F.col("label_error")))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = quantize(common.read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding"))
    code = F.concat_ws("", F.transform("codes", lambda i: F.lpad(F.lower(F.hex(i)), 2, "0")))
    out = with_label_error(coded)
    return out.select("vec_id", F.when(F.col("codes").isNotNull(), code).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The query in DuckDB: the rounds one after the other, on vectors of 64 components."""
    w = 64 // parts
    steps = []
    for k in range(rounds + 1):
        near = f"SELECT p.row, p.pos, p.part, min(list_sum(list_transform(list_zip(p.part, c.part), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 1024 + c.entry) AS best FROM p JOIN c{k} c USING (pos) GROUP BY ALL"
        steps.append(f"a{k} AS MATERIALIZED (SELECT row, pos, part, CAST(best % 1024 AS INT) AS entry, CAST(best // 1024 AS BIGINT) AS dist FROM ({near}))")
        if k < rounds:
            flat = f"SELECT pos, entry, unnest(range(1, {w + 1})) AS i, unnest(part) AS x FROM a{k}"
            mean = f"SELECT pos, entry, list(m ORDER BY i) AS part FROM (SELECT pos, entry, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM ({flat}) GROUP BY ALL) GROUP BY ALL"
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT pos, entry, coalesce(m.part, c{k}.part) AS part FROM c{k} LEFT JOIN ({mean}) m USING (pos, entry))")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
p AS MATERIALIZED (SELECT row, pos, e[pos * {w} + 1:pos * {w} + {w}] AS part FROM v, range({parts}) t(pos)),
c0 AS MATERIALIZED (SELECT pos, CAST(row - 1 AS INT) AS entry, part FROM p WHERE row <= {entries}),
{", ".join(steps)},
g AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY pos) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{rounds} GROUP BY row),
book AS (SELECT sha256(string_agg(x, ',' ORDER BY pos, entry, i)) AS h FROM (SELECT pos, entry, unnest(range({w})) AS i, CAST(unnest(part) AS VARCHAR) AS x FROM c{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM v JOIN g USING (row), book
"""


SQL = _sql()
