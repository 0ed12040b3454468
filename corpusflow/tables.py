"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables whose rows are texts, of which a megabyte is work for a task; and the bytes of a task's share of a small table.
TEXTS = ("documents", "pages", "conversations")
SHARE = 256 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Texts that lie in fewer splits than there are cores, as in a file of one row group, are dealt over the cores; larger tables stay as their splits are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in TEXTS:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = min(spark.sparkContext.defaultParallelism, size // SHARE)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"
