"""A table that is replaced by document, in versions: readers see one version whole, and a failed write leaves the one before.

Rows lie in buckets of a hash of their key. A write reads and replaces only the buckets of its keys, below a
folder of its own, and then hands on a manifest, one small file, that names the version of every bucket. The manifest's
rename is the switch. Files of versions that no manifest names are never read.

A write of rows without key replaces rows without key; an empty table has no version, and a write of nothing makes none;
two writers at once aren't kept apart.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def _bucket(key: str):
    return F.coalesce(F.pmod(F.xxhash64(key), F.lit(BUCKETS)), F.lit(0)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """bucket, version (a folder's name) of the last whole version."""
    if not _exists(spark, f"{path}/manifests"):
        return None
    held = spark.read.schema("bucket int, version string, number long").parquet(f"{path}/manifests")
    last = held.agg(F.max("number")).first()[0]
    return None if last is None else held.where(F.col("number") == last)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the last whole version; None where there is none. A manifest has BUCKETS rows at most."""
    held = manifest(spark, path)
    if held is None:
        return None
    rows = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data")
    return rows.join(F.broadcast(held.select("bucket", "version")), ["version", "bucket"], "left_semi").drop("version", "bucket")


def replace(path: str, rows: DataFrame, keys: DataFrame, key: str) -> str | None:
    """Put rows in place of all rows that have one of keys (a column `key`); the new version's name. Keys without rows are removed."""
    spark, version = rows.sparkSession, uuid.uuid4().hex
    keys = keys.select(key).distinct()
    touched = sorted(r[0] for r in keys.select(_bucket(key)).distinct().collect())  # BUCKETS numbers at most
    if not touched:
        return None
    before, old = manifest(spark, path), current(spark, path)
    new = rows.withColumn("bucket", _bucket(key))
    if old is not None:
        gone = keys.withColumnRenamed(key, "_gone")
        kept = old.withColumn("bucket", _bucket(key)).where(F.col("bucket").isin(touched)).join(gone, F.col(key).eqNullSafe(F.col("_gone")), "left_anti")
        new = kept.unionByName(new)
    new.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/data/version={version}")
    number = 0 if before is None else before.first()["number"] + 1
    names = spark.createDataFrame([(b, version) for b in touched], "bucket int, version string")
    if before is not None:
        names = names.unionByName(before.where(~F.col("bucket").isin(touched)).select("bucket", "version"))
    names.withColumn("number", F.lit(number).cast("long")).coalesce(1).write.mode("append").parquet(f"{path}/manifests")
    return version
