"""Embedding near-dedup over a pivot-permutation index.

A vector is described by its ``NEAREST`` reference points in order of closeness. Inverted lists per
(label, pivot) hold the vectors described by that pivot. Where a list is read, the postings of the
members' other pivots are walked and the shared pivots of each pair that meets there are counted; pairs
that share at least ``SHARED`` are candidates, each in the list of the first pivot it shares, and only
candidates are verified by cosine in double precision. Equal vectors of a label are one class with a
weight, a long list is cut into blocks that meet pairwise, and a block pair returns counts and a
spanning forest, never its pairs. The number of pivots follows the square root of the number of vectors,
so lists grow as slowly; the pivots come from a sample of four times as many, and every row is indexed.

Defined cases: null, zero or empty vectors, vectors with null or non-finite components and rows with
a null label or vec_id link with nothing; vectors of different lengths never link; rows that share a
vec_id are vectors of their own, each with its own links; other columns are left out; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components

#: fewest and most pivots (which bounds what is broadcast), length of the permutation prefix, shared pivots of a candidate, rows of a block
PIVOTS, MOST, NEAREST, SHARED, BLOCK = 256, 4096, 10, 4, 1024
#: pairs whose shared pivots are counted at once
CELLS = 1 << 22
#: cosine that two pivots stay below
APART = 0.8


def usable() -> Column:
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def classes(vectors: DataFrame) -> DataFrame:
    """(label, embedding, rep, least_id, weight): equal vectors of a label; combined before they are shuffled. rep numbers
    the classes once the table is written; the ids of different vectors may be equal."""
    rows = vectors.where(usable()).select("label", "embedding", "vec_id")
    found = rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("weight"))
    return found.withColumn("rep", F.monotonically_increasing_id())


def _unit(vectors) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spread(sample: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of the sample, each at a cosine below APART from those before it: crowded
    reference points would be ordered by noise."""
    near = sample @ sample.T >= APART
    taken, shut = [], np.zeros(len(sample), bool)
    for i in range(len(sample)):
        if len(taken) < most and not shut[i]:
            taken.append(i)
            shut |= near[i]
    return sample[taken]


def describe(reps: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds perm array<int>: the nearest pivots of the vector's length, closest first."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            vectors = batch.column(1).to_pylist()
            perm: list = [None] * len(vectors)
            for size in {len(v) for v in vectors}:
                at = [i for i, v in enumerate(vectors) if len(v) == size]
                near = np.argsort(-(_unit([vectors[i] for i in at]) @ pivots[size].T), axis=1, kind="stable")[:, :NEAREST]
                for i, p in zip(at, near.tolist()):
                    perm[i] = p
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(perm, pa.list_(pa.int32()))], [*batch.schema.names, "perm"])

    rows = reps.select("label", "embedding", "rep", "weight")
    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("perm", T.ArrayType(T.IntegerType()))]))


def _postings(perms: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pivots in order, the members that each describes, and where each pivot's members begin."""
    member = np.repeat(np.arange(len(perms)), [len(p) for p in perms])
    pivot = np.concatenate(perms)
    order = np.argsort(pivot, kind="stable")
    known, first = np.unique(pivot[order], return_index=True)
    return known, member[order], np.r_[first, len(order)]


def candidates(left: list[np.ndarray], right: list[np.ndarray], pivot: int, need: int):
    """(i, j) of members of both sides that share ``need`` pivots, none of them before ``pivot``, from the
    postings of the right side."""
    known, member, first = _postings(right)
    width = len(right)
    for begin in range(0, len(left), max(1, CELLS // width)):
        part = left[begin : begin + max(1, CELLS // width)]
        row = np.repeat(np.arange(len(part)), [len(p) for p in part])
        p = np.concatenate(part)
        at = np.minimum(np.searchsorted(known, p), len(known) - 1)
        row, p, at = (x[known[at] == p] for x in (row, p, at))
        n = first[at + 1] - first[at]
        hit = member[np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        cell = np.repeat(row, n) * width + hit
        shared = np.bincount(cell, minlength=len(part) * width)
        shared[cell[np.repeat(p, n) < pivot]] = 0  # judged in the list of an earlier pivot
        found = np.flatnonzero(shared >= need)
        yield begin + found // width, found % width


def _judge(left, right, pivot: int, least: float, same: bool):
    """Link counts of both blocks' vectors and a forest over the links between them."""
    one, two = ([np.asarray(p) for p in block["perm"]] for block in (left, right))
    need = min(SHARED, *map(len, one), *map(len, two))
    a, b = _unit(left["embedding"].tolist()), _unit(right["embedding"].tolist())
    link = np.zeros((len(left), len(right)), bool)
    for i, j in candidates(one, two, pivot, need):
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            near = np.einsum("ij,ij->i", a[x], b[y]) >= least
            link[x[near], y[near]] = True
    if same:
        np.fill_diagonal(link, False)
    counts = {}
    for rep, n_links in zip(left["rep"], link @ right["weight"].to_numpy()):
        counts[rep] = counts.get(rep, 0) + int(n_links)
    if not same:
        for rep, n_links in zip(right["rep"], link.T @ left["weight"].to_numpy()):
            counts[rep] = counts.get(rep, 0) + int(n_links)
    forest, seen_l, seen_r = [], np.zeros(len(left), bool), np.zeros(len(right), bool)
    lr, rr = left["rep"].to_numpy(), right["rep"].to_numpy()
    for start in np.flatnonzero(link.any(1)):
        if seen_l[start]:
            continue
        seen_l[start] = True
        if same:
            seen_r[start] = True
        todo = [(int(start), True)]
        while todo:
            i, on_left = todo.pop()
            found = np.flatnonzero(link[i] & ~seen_r if on_left else link[:, i] & ~seen_l)
            (seen_r if on_left else seen_l)[found] = True
            if same:
                seen_l[found] = seen_r[found] = True
            forest += [(int(lr[i]), int(rr[j])) if on_left else (int(rr[i]), int(lr[j])) for j in found]
            todo += [(int(j), same or not on_left) for j in found]
    return counts, forest


def links(reps: DataFrame, least: float = 0.98) -> DataFrame:
    """(a, b, n): n links of a where b is null; an edge of a spanning forest a - b where n is null."""
    spark = reps.sparkSession
    most = min(MOST, max(PIVOTS, int(reps.count() ** 0.5)))
    chosen = reps.orderBy(F.xxhash64("embedding", "label"), "rep").limit(4 * most).select("embedding").collect()
    pivots: dict[int, np.ndarray] = {}
    for size in {len(r["embedding"]) for r in chosen}:
        pivots[size] = spread(_unit([r["embedding"] for r in chosen if len(r["embedding"]) == size]), most)
    sized = reps.where(F.size("embedding").isin([*pivots])) if pivots else reps.limit(0)
    other = reps.where(~F.size("embedding").isin([*pivots])) if pivots else reps.limit(0)
    described = describe(sized, pivots)
    alone = other.select("label", "embedding", "rep", "weight", F.array(F.lit(0)).alias("perm"))  # lengths without a pivot: one list each, compared whole
    rows = described.unionByName(alone).withColumn("_size", F.size("embedding"))
    rows = common.cut(rows, "described")
    # of pivots in order the first that a pair shares has SHARED - 1 shared ones after it in both: the others need no list
    first = F.size("perm") - F.least(F.lit(SHARED), F.size("perm")) + 1
    posted = rows.withColumn("pivot", F.explode(F.slice(F.sort_array("perm"), F.lit(1), first)))
    sizes = posted.groupBy("label", "_size", "pivot").agg(F.count("*").alias("_n"))
    sizes = common.cut(sizes.where("_n > 1").withColumn("_blocks", F.ceil(F.col("_n") / BLOCK).cast("int")), "lists")
    posted = posted.join(sizes.select("label", "_size", "pivot", "_blocks"), ["label", "_size", "pivot"])
    own = F.pmod(F.xxhash64("rep"), F.col("_blocks").cast("long")).cast("int")
    cells = posted.withColumn("_own", own).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    cells = cells.withColumn("_lo", F.least("_own", "_j")).withColumn("_hi", F.greatest("_own", "_j"))

    def run(key, pdf):
        import pandas as pd

        lo, hi = key[3], key[4]
        pivot = int(key[2])
        if lo == hi:
            counts, forest = _judge(pdf, pdf, pivot, least, True) if len(pdf) > 1 else ({}, [])
        else:
            a, b = pdf[pdf["_own"] == lo].reset_index(drop=True), pdf[pdf["_own"] == hi].reset_index(drop=True)
            counts, forest = _judge(a, b, pivot, least, False) if len(a) and len(b) else ({}, [])
        rows = [(r, None, n) for r, n in counts.items() if n] + [(a, b, None) for a, b in forest]
        return pd.DataFrame({k: pd.array([r[i] for r in rows], "Int64") for i, k in enumerate("abn")})

    grouped = cells.select("label", "_size", "pivot", "_lo", "_hi", "_own", "embedding", "rep", "weight", "perm")
    return common.cut(grouped.groupBy("label", "_size", "pivot", "_lo", "_hi").applyInPandas(run, "a long, b long, n long"), "links")


def near_duplicates(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    reps = common.cut(classes(rows), "classes")
    found = links(reps, least)
    counts = found.where("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    comp = common.cut(components(found.where("b is not null").select("a", "b")), "components")
    named = reps.select("rep", "least_id").join(comp.withColumnRenamed("node", "rep"), "rep")
    named = comp.join(named.groupBy("component").agg(F.min("least_id").alias("component_id")), "component").select(F.col("node").alias("rep"), "component_id")
    known = reps.join(counts, "rep", "left").join(named, "rep", "left")
    known = common.cut(known.select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id")), "known")
    good = usable()
    tied = rows.withColumn("_l", F.when(good, F.col("label"))).withColumn("_e", F.when(good, F.xxhash64("embedding")))
    known = known.withColumn("_h", F.xxhash64("embedding")).withColumnRenamed("label", "_kl").withColumnRenamed("embedding", "_ke")
    out = tied.join(known, (F.col("_l") == F.col("_kl")) & (F.col("_e") == F.col("_h")) & (F.col("embedding") == F.col("_ke")), "left")
    comp_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), (F.col("vec_id") == comp_id).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "embeddings"))
