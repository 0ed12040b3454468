"""Connected components of an edge table, by rounds of hanging nodes on smaller ones.

Partitions first shrink their own edges to a forest. Then each round gathers a node's parents, of
which there are no more than partitions, keeps the smallest, hangs the others on it, and
follows every parent to its own parent. Edges stay distributed and go to the shared folder between
rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import storage

#: Edges that a partition shrinks at once, about.
EDGES_A_TASK = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it is connected with) for nodes that aren't the smallest."""
    ids, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = back[: len(a)], back[len(a) :]
    label = np.arange(len(ids))
    while True:
        lx, ly = label[x], label[y]
        open_ = lx != ly
        if not open_.any():
            break
        x, y, lx, ly = x[open_], y[open_], lx[open_], ly[open_]
        np.minimum.at(label, np.maximum(lx, ly), np.minimum(lx, ly))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of a partition's edges (a, b) and whether any of them is open; a > b in every row."""
    parts = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches]
    if parts:
        a, b = forest(*(np.concatenate(p) for p in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _written(edges: DataFrame, rows: int) -> DataFrame:
    few = edges.select("a", "b").coalesce(max(8, -(-rows // EDGES_A_TASK)))
    return storage.written(few.mapInArrow(shrink, "a long, b long"), "edges")


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """id, component (smallest id connected with it) for every id of edges (a, b) that isn't its component's smallest.

    rows: about how many edges there are, if it is known.
    """
    # Edges often come out of Python. They are written before they are shrunk, so that no task holds two Python workers.
    plain = storage.written(edges.select("a", "b").where("a <> b"), "found")
    now = _written(plain, plain.count() if rows is None else rows)
    while True:
        n = now.count()
        up = now.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("up"))
        own = up.select("a", F.explode(F.concat(F.array(F.struct(F.col("a").alias("x"), F.get("up", F.lit(0)).alias("y"))), F.transform(F.slice("up", 2, F.greatest(F.size("up"), F.lit(1))), lambda v: F.struct(v.alias("x"), F.get("up", F.lit(0)).alias("y"))))).alias("e"), (F.size("up") > 1).alias("many"))
        parent = up.select(F.col("a").alias("node"), F.get("up", F.lit(0)).alias("top"))
        hung = own.select("many", "e.x", "e.y").join(parent, F.col("y") == F.col("node"), "left")
        step = storage.written(hung.select(F.col("x").alias("a"), F.coalesce("top", "y").alias("b"), (F.col("many") | F.col("top").isNotNull()).alias("open")).coalesce(max(8, -(-n // EDGES_A_TASK))), "step")
        if step.where("open").isEmpty():
            return step.select(F.col("a").alias("id"), F.col("b").alias("component"))
        now = _written(step, n)
