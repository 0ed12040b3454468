"""A count-min sketch of hashed windows over a whole corpus.

Each partition sketches its windows: for each of DEPTH rows, the counters they fall in, kept as
Elias-Fano coded blocks of counter ranges. Sketches are merged block by block, by adding. Of a merged
counter, only whether it reached 2 is kept, one bit, so a window is estimated to be repeated when
all its counters did. Counts are never underestimated, so no repeated window is lost.

A row has at least twice as many counters as there are windows, up to 2**MOST_BITS; beyond that the
estimate grows looser: of n windows that occur once, a share of about (1 - exp(-n / 2**31)) ** 2 is
taken for repeated, and the exact pass that follows has them to do as well. A merged sketch thus
takes at most DEPTH * 2**MOST_BITS / 8 bytes (512 MB), whatever the input, and a partition sends no
more than two hits of a counter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import arrays, elias_fano, storage

DEPTH = 2
LEAST_BITS, MOST_BITS = 20, 31
#: Windows that a partition sketches at once, and windows in a merged block at most (roughly).
FLUSH, BLOCK = 1 << 21, 1 << 21
_LOADED: dict[str, list[list[np.ndarray]]] = {}
arrays.AT_END.append(_LOADED.clear)


def counters(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return arrays.mix(hashes + np.array([row + 1], np.uint64) * arrays.BASES[1]) >> np.uint64(64 - bits)


@dataclass
class Sketch:
    folder: str
    bits: int
    blocks: int
    depth: int = DEPTH

    def _rows(self) -> list[list[np.ndarray]]:
        """Each row's blocks, as they are in their files: workers of a machine share the pages of local ones."""
        if self.folder not in _LOADED:
            _LOADED.clear()
            _LOADED[self.folder] = [[np.frombuffer(storage.read_file(f"{self.folder}/{row}-{b}.bits"), np.uint8) for b in range(self.blocks)] for row in range(self.depth)]
        return _LOADED[self.folder]

    def repeated(self, hashes: np.ndarray) -> np.ndarray:
        """For each window, whether its estimated count is 2 or more."""
        left = np.arange(len(hashes))
        width = np.uint64(self.bits) - np.uint64(self.blocks.bit_length() - 1)
        for row, blocks in enumerate(self._rows()):
            at = counters(hashes[left], row, self.bits)
            order = np.argsort(at)
            at = at[order]
            cut = np.searchsorted(at, np.arange(self.blocks + 1, dtype=np.uint64) << width)
            inner = at & ((np.uint64(1) << width) - np.uint64(1))
            byte, bit = (inner >> np.uint64(3)).astype(np.int64), (inner & np.uint64(7)).astype(np.uint8)
            seen = np.zeros(len(at), bool)
            for b, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                if i < j:
                    seen[i:j] = blocks[b][byte[i:j]] >> bit[i:j] & 1
            left = left[order[seen]]
        out = np.zeros(len(hashes), bool)
        out[left] = True
        return out


def build(docs: DataFrame, hasher: Callable[[pa.RecordBatch], np.ndarray], expected: int) -> Sketch:
    """Sketch what hasher gives for the rows of docs, about `expected` windows in all."""
    bits = min(MOST_BITS, max(LEAST_BITS, int(2 * expected).bit_length()))
    block_bits = min(bits - 3, max(6, int(expected // BLOCK).bit_length()))
    sketch = Sketch(f"{storage.shared_dir(docs.sparkSession)}/sketch", bits, 1 << block_bits)
    shift = np.uint64(bits - block_bits)
    folder = sketch.folder

    def blocks(hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate(hashes)
        for row in range(DEPTH):
            at = np.sort(counters(h, row, bits))
            more = np.ones(len(at), bool)
            more[2:] = at[2:] != at[:-2]  # two hits of a counter tell as much as a million
            at = at[more]
            cut = np.searchsorted(at >> shift, np.arange((1 << block_bits) + 1, dtype=np.uint64))
            used = [b for b in range(1 << block_bits) if cut[b] < cut[b + 1]]
            coded = [elias_fano.encode(at[cut[b] : cut[b + 1]]) for b in used]
            yield pa.RecordBatch.from_pydict({"row": pa.array([row] * len(used), pa.int64()), "block": pa.array(used, pa.int64()), "held": pa.array(coded, pa.binary())})

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for batch in arrays.sliced(batches):
            kept.append(hasher(batch))
            if sum(map(len, kept)) >= FLUSH:
                yield from blocks(kept)
                kept = []
        if kept:
            yield from blocks(kept)
        arrays.trim()

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        row, block = (k.as_py() for k in key)
        width = 1 << int(shift)
        at = np.sort(np.concatenate([elias_fano.Sequence(b).all() for b in table.column("held").to_pylist()]) - block * width)
        seen = np.zeros(width, np.uint8)
        seen[at[1:][at[1:] == at[:-1]]] = 1
        storage.write_file(f"{folder}/{row}-{block}.bits", [np.packbits(seen, bitorder="little").tobytes()])
        return pa.table({"row": pa.array([row], pa.int64()), "block": pa.array([block], pa.int64()), "n": pa.array([len(at)], pa.int64())})

    spark = docs.sparkSession
    every = spark.range(DEPTH << block_bits).select((F.col("id") % DEPTH).alias("row"), F.expr(f"id div {DEPTH}").alias("block"), F.lit(elias_fano.encode(np.zeros(0, np.int64))).alias("held"))
    parts = docs.mapInArrow(partial, "row long, block long, held binary").unionByName(every)
    with storage.shuffles_removed(spark):
        parts.groupBy("row", "block").applyInArrow(merge, "row long, block long, n long").agg(F.sum("n")).collect()  # one number
    return sketch


def characters(docs: DataFrame) -> int:
    """Characters of all texts."""
    return docs.agg(F.sum(F.length("text"))).first()[0] or 0
