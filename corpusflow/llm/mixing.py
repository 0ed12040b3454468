"""Mixing sources to target weights by weighted sampling without replacement (operator 8).

Sources, in order of their code points with null last, weigh 5, 2, 1, repeating. Together they
share `total` times all words; no source gets more than `most` times its own words, and what it
can't take goes to the others by weight. A source first gives its whole epochs. The rest of its
target is filled in the order of Efraimidis-Spirakis keys, -ln(u) / w, smallest first, where u is a
hash of the document and w its quality weight; a running sum of sizes stops at the target, and the
document that crosses it is taken if that brings the sum nearer.

A source can hold most rows, so running sums are taken in range partitions of (source, key) and
carried over by partition totals; no window holds a source's rows.

Edge cases: null texts have size 0 and are never taken; a null source is one source; repeated
rows are separate documents; ties of keys are ordered by doc_id and size; an empty table gives no
rows; a source without words has target 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.llm import storage

WEIGHTS = (5.0, 2.0, 1.0)
WORD = r"[^\x20\x09-\x0D]+"


def quality_weight() -> Column:
    """From 0.25 to 1, by the share of lower-case letters and blanks among a text's characters; 1 is plain prose."""
    plain = F.length(F.regexp_replace("text", r"[^\p{Ll} ]", ""))
    return F.lit(0.25) + 0.75 * F.coalesce(F.try_divide(plain, F.length("text")), F.lit(0.0))


def targets(sources: DataFrame, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size -> target, times (whole epochs), rest (words beyond them). One row a source.

    Water-filling in closed form: with sources ordered by cap over weight, those before some point
    are at their caps and the others share the remainder by weight.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    place = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("left", F.sum(F.col("source_size")).over(Window.partitionBy()) * F.lit(total) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.greatest(F.lit(0.0), F.col("left")) / F.sum("weight").over(after))
    level = F.max("level").over(Window.partitionBy())  # it rises while sources are at their caps and falls after
    s = s.withColumn("target", F.least(F.col("cap"), F.col("weight") * level))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0)
    return s.withColumn("times", epochs).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("times") * F.col("source_size"))).select("source", "source_size", "target", "times", "rest")


def mix(docs: DataFrame, seed: int = 17, total: float = 1.5, most: float = 2.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """The columns in `carry` (of type long), doc_id, source, size, source_size, target, repeats (times the mix holds the document), taken."""
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(*carry, F.col("doc_id").cast("long"), "source", size.alias("size"), (-F.log(u) / quality_weight()).alias("key"))
    sized = storage.written(sized, "sized")  # small: the texts are read once

    kept = (*carry, "doc_id", "source", "size")
    schema = "".join(f"{c} long, " for c in carry) + "doc_id long, source string, size long, before long, part long"

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, now = TaskContext.get().partitionId(), 0, ()
        for batch in batches:
            source, n = batch.column("source").to_pylist(), batch.column("size").to_numpy()
            before_row = np.zeros(len(n), np.int64)
            edges = [0, *(i for i in range(1, len(n)) if source[i] != source[i - 1]), len(n)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if (source[a],) != now:
                    held, now = 0, (source[a],)
                sums = held + np.cumsum(n[a:b])
                before_row[a:b], held = sums - n[a:b], int(sums[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(before_row, pa.int64()), pa.array(np.full(len(n), part), pa.int64())], [*kept, "before", "part"])

    ordered = sized.repartitionByRange("source", "key", "doc_id", "size").sortWithinPartitions("source", "key", "doc_id", "size")
    summed = storage.written(ordered.mapInArrow(running, schema), "running")
    parts = summed.groupBy("source", "part").agg(F.sum("size").alias("n"))
    sources = parts.groupBy("source").agg(F.sum("n").alias("source_size"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    plan = parts.withColumn("carried", F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("p").join(targets(sources, total, most).alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
    plan = plan.select(F.col("p.source").alias("of"), F.col("part").alias("in_part"), "carried", "source_size", "target", "times", "rest")
    joined = summed.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in_part")))
    at = F.col("carried") + F.col("before")
    extra = (at + F.col("size") / 2 <= F.col("rest")) & (F.col("size") > 0) & (F.col("rest") > 0)
    out = joined.withColumn("repeats", F.col("times") + extra.cast("long"))
    return out.select(*carry, "doc_id", "source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")
