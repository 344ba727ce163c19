"""Helpers that the training-data operators share.

Row identity: operators address a row by ``row_key`` = xxhash64(doc_id, text), so a null
doc_id, a doc_id that repeats with another text, and a wholly repeated row all have a
defined meaning (a repeated row is the same document twice).
"""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder in the warehouse
    of a session that runs in one process alone; a cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir") + "/airwave-shared"
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/airwave-{name}-{uuid.uuid4().hex}"
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(hadoop).deleteOnExit(p)
    return path


@contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of what is written inside go when it is: its result is in the shared folder."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame, name: str = "cut", path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends there, and
    an executor that is lost later takes nothing with it."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.airwave_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``cut`` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(table.airwave_path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def bucketed(df: DataFrame, key: str, dealt: bool = False) -> DataFrame:
    """``df`` dealt by ``key`` once and kept so in the shared folder: later joins on the key move only the other side.
    ``dealt``: it comes from a join on the key, which has dealt it."""
    spark, n = df.sparkSession, partitions(df.sparkSession)
    name = f"airwave_{uuid.uuid4().hex}"
    writer = (df if dealt else df.repartition(n, key)).write.bucketBy(n, key).option("path", new_path(spark, "bucketed")).option("compression", "zstd")
    with tidy(spark):
        writer.saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name goes, the files stay as long as the application
    return table


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty) alone: other columns, whatever their names, stay out."""
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
