"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; a temporary one only where that is unset and Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusflow-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/corpusflow-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """df as a Parquet table in a fresh shared folder, read back: what several branches need is computed once."""
    path = f"{folder(df.sparkSession)}/{name}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """df with `name`: the place of a row, from 0, within its group by `order`.

    A group may hold most rows, so it is dealt by ranges of (group, order); rows are numbered within a range, and
    ranges are carried over by their counts, a row a range and group.
    """
    ranged = df.repartitionByRange(group, order).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    count = ranged.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    count = count.select(F.col(group).alias("_of"), F.col("_part").alias("_in"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(group, "_part").orderBy(order)) - 1
    joined = ranged.withColumn("_own", own).join(count, F.col(group).eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_in")))
    return joined.withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_own", "_of", "_in", "_before")


def components(edges: DataFrame) -> DataFrame:
    """id, component: every node of edges (a, b) with the smallest node that it is connected with.

    Each round a node takes the smallest label among its neighbours' and then its label's label, until none changes. Labels go to the shared folder between rounds.
    """
    e = edges.select("a", "b").where("a <> b")
    e = written(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = written(e.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).select(F.col("a").alias("id"), "c"), "labels")
    while True:
        near = e.join(now, F.col("b") == F.col("id")).groupBy("a").agg(F.min("c").alias("near"))
        step = now.join(near, F.col("id") == F.col("a")).select("id", F.col("c").alias("old"), F.least("c", "near").alias("c"))
        up = now.select(F.col("id").alias("u"), F.col("c").alias("top"))
        step = written(step.join(up, F.col("c") == F.col("u"), "left").select("id", "old", F.least("c", F.coalesce("top", "c")).alias("c")), "labels")
        if step.where("c <> old").isEmpty():
            return step.select("id", F.col("c").alias("component"))
        now = step.select("id", "c")
