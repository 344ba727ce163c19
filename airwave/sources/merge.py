"""A Parquet table that batches are merged into: bucketed by a hash of the key, copied on write, committed by manifest.

``path/version=N/bucket=K`` holds bucket K as commit N left it. A manifest ``path/_commits/N.json`` is written aside and
renamed into place; it names the version of every bucket and, of every source, the last batch that is in. So a reader
sees whole commits only, a merge reads and writes the buckets that its batch touches and no others, and a batch that
comes again after a failure changes nothing. Manifests have a line per bucket, whatever the rows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import discard, keep


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def manifest(spark: SparkSession, path: str) -> dict:
    """The last commit: version, versions (bucket -> version), applied (source -> batch), buckets and schema."""
    fs, folder = _fs(spark, f"{path}/_commits")
    if not fs.exists(folder):
        return {"version": 0, "versions": {}, "applied": {}}
    last = max((f.getPath().getName() for f in fs.listStatus(folder) if f.getPath().getName().endswith(".json")), default=None)
    if last is None:
        return {"version": 0, "versions": {}, "applied": {}}
    stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_commits/{last}"))
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, state: dict) -> None:
    fs, target = _fs(spark, f"{path}/_commits/{state['version']:012d}.json")
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_commits/_{state['version']:012d}")
    out = fs.create(aside, True)
    try:
        out.write(bytearray(json.dumps(state).encode()))
    finally:
        out.close()
    if not fs.rename(aside, target):
        raise RuntimeError(f"commit {state['version']} of {path} is there already: another writer was first")


def read(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame | None:
    """The rows of the last commit, of chosen buckets if given; None before the first."""
    state = manifest(spark, path)
    if "schema" not in state:
        return None
    schema = T.StructType.fromJson(state["schema"])
    found = [f"{path}/version={v}/bucket={b}" for b, v in state["versions"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def merge(batch: DataFrame, path: str, key: list, join: Callable[[DataFrame, DataFrame], DataFrame], source: str, number: int, buckets: int = 64) -> bool:
    """Merge ``batch`` number ``number`` of ``source``: ``join(stored, batch)`` gives the new rows of the buckets that the
    batch's ``key`` touches. Returns whether anything was done: a batch that is in already, or an empty one, is not."""
    spark, state = batch.sparkSession, manifest(batch.sparkSession, path)
    if state["applied"].get(source, -1) >= number:
        return False
    buckets = state.get("buckets", buckets)
    placed = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    rows = keep(batch.withColumn("_bucket", placed), "batch")
    touched = [r["_bucket"] for r in rows.select("_bucket").distinct().collect()]
    version = state["version"] + 1
    if touched:
        stored = read(spark, path, touched)
        plain = rows.drop("_bucket")
        merged = join(plain.limit(0) if stored is None else stored, plain)
        schema = merged.schema
        merged.withColumn("bucket", placed).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={version}")
        state = {**state, "versions": state["versions"] | {str(b): version for b in touched}, "schema": schema.jsonValue()}
    discard(rows)
    _commit(spark, path, {**state, "version": version, "buckets": buckets, "applied": state["applied"] | {source: number}})
    return bool(touched)


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove files that the last commit does not name, and older manifests; their number. No reader may be on them."""
    state, gone = manifest(spark, path), 0
    fs, root = _fs(spark, path)
    live = {f"version={v}/bucket={b}" for b, v in state["versions"].items()}
    for folder in fs.listStatus(root):
        name = folder.getPath().getName()
        if name.startswith("version="):
            for bucket in fs.listStatus(folder.getPath()):
                if bucket.isDirectory() and f"{name}/{bucket.getPath().getName()}" not in live:
                    gone += fs.delete(bucket.getPath(), True)
    for f in fs.listStatus(_fs(spark, f"{path}/_commits")[1]):
        if f.getPath().getName() != f"{state['version']:012d}.json":
            gone += fs.delete(f.getPath(), False)
    return gone
