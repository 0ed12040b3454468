"""Removal of passages that an earlier document already has (operator 9).

A window is K consecutive words of one document. A count-min sketch over all windows tells which
may be repeated; only those are grouped, exactly, by a 128-bit hash of their words, to find the
smallest doc_id they start in. A word is removed when a window that covers it also starts in a
document with a smaller doc_id. Windows are judged on the input.

Windows are grouped in blocks of hash range, packed into arrays. A task sends a window to its block
only as the smallest document that it has seen holds it; others are late whatever the block finds,
and are dealt by document. So a passage that a third of all documents share is some entries of one
block. What a block finds late goes on in arrays by buckets of documents, not in rows a document.

Edge cases: null and empty texts have no words; a text of fewer than K words keeps all; a document
without doc_id keeps all and removes nothing elsewhere; repeated rows of one doc_id don't remove
each other's words; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import arrays, sketch, storage

K = 13
#: Windows of the corpus to a block, about; only those that may be repeated come to it. Documents are dealt to as many buckets.
GROUP = 1 << 20


def _windows(batch: pa.RecordBatch, k: int) -> tuple:
    data, off = arrays.utf8(batch.column("text"))
    start, end, doc = arrays.words(data, off)
    h, at = arrays.window_hashes(arrays.word_hashes(data, start, end), doc, k)
    return h, at, doc, (data, start, end)


def lateness(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order that brings equal windows together, in that order: whether a smaller document has the window)."""
    order = np.lexsort((doc, h2, h1))
    h1, h2, doc = h1[order], h2[order], doc[order]
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    return order, doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]


def repeated_windows(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, text_hash, starts: word positions of windows that also start in a smaller doc_id, as packed 32-bit integers; a row a document and text."""
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    expected = sketch.characters(docs) // 6
    held = sketch.build(docs.select("text"), lambda batch: _windows(batch, k)[0], expected)
    shift = np.uint64(64 - max(6, int(expected // GROUP).bit_length()))

    def pack(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        """Rows of windows by block. Of each window only what the smallest document has here goes to its block; all else is late for certain."""
        h1, h2, doc, text, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, late = lateness(h1, h2, doc)
        h1, h2, doc, text, place = h1[order], h2[order], doc[order], text[order], place[order]
        block = np.where(late, arrays.mix(doc.view(np.uint64)), h1) >> shift  # late ones are dealt by document
        order = np.lexsort((late, block))
        block, late = block[order], late[order]
        first = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (late[1:] != late[:-1])]))
        edges = np.append(first, len(order))
        own = [order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        columns = {name: pa.array([None if gone and name in ("h1", "h2") else x[o].tobytes() for o, gone in zip(own, late[first].tolist(), strict=True)], pa.binary()) for name, x in (("h1", h1), ("h2", h2), ("doc", doc), ("text_hash", text), ("place", place))}
        yield pa.RecordBatch.from_pydict({"block": pa.array(block[first].astype(np.int64)), **columns})

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        for batch in arrays.sliced(batches):
            h, at, doc, (data, start, end) = _windows(batch, k)
            maybe = held.repeated(h)
            h, at = h[maybe], at[maybe]
            if not len(at):
                continue
            again, where = arrays.window_hashes(arrays.word_hashes(data, start, end, 1), doc, k, 1)
            own = doc[at]
            place = at - np.searchsorted(doc, own)  # position in its document
            parts.append((h, again[np.searchsorted(where, at)], batch.column("doc_id").to_numpy()[own], batch.column("text_hash").to_numpy()[own], place.astype(np.uint32)))
            if sum(len(p[0]) for p in parts) >= sketch.FLUSH // 2:
                yield from pack(parts)
                parts = []
        if parts:
            yield from pack(parts)

    def group(table: pa.Table) -> pa.Table:
        whole = {c: table.column(c).to_pylist() for c in ("h1", "h2", "doc", "text_hash", "place")}
        read = lambda c, t, gone: np.concatenate([np.zeros(0, t), *(np.frombuffer(b, t) for b, h in zip(whole[c], whole["h1"], strict=True) if (h is None) == gone)])
        h1, h2, doc, text, place = (read(c, t, False) for c, t in (("h1", np.uint64), ("h2", np.uint64), ("doc", np.int64), ("text_hash", np.int64), ("place", np.uint32)))
        order, late = lateness(h1, h2, doc)
        order = order[late]
        doc, text, place = (np.concatenate([x[order], read(c, t, True)]) for x, c, t in ((doc, "doc", np.int64), (text, "text_hash", np.int64), (place, "place", np.uint32)))
        bucket = arrays.mix(doc.view(np.uint64)) >> shift
        order = np.argsort(bucket, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]])) if len(doc) else np.zeros(0, np.int64)
        own = np.split(order, first[1:]) if len(first) else []
        columns = {name: pa.array([x[o].tobytes() for o in own], pa.binary()) for name, x in (("doc", doc), ("text_hash", text), ("place", place))}
        return pa.table({"bucket": pa.array(bucket[order][first].astype(np.int64)), **columns})

    def gather(table: pa.Table) -> pa.Table:
        doc, text, place = (np.concatenate([np.frombuffer(b, t) for b in table.column(c).to_pylist()]) for c, t in (("doc", np.int64), ("text_hash", np.int64), ("place", np.uint32)))
        order = np.lexsort((place, text, doc))
        doc, text, place = doc[order], text[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])]))
        edges = np.append(first, len(doc))
        return pa.table({"doc_id": pa.array(doc[first]), "text_hash": pa.array(text[first]), "starts": pa.array([place[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())})

    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    packed = hashed.mapInArrow(probe, "block long, h1 binary, h2 binary, doc binary, text_hash binary, place binary")
    late = packed.groupBy("block").applyInArrow(group, "bucket long, doc binary, text_hash binary, place binary")
    return late.groupBy("bucket").applyInArrow(gather, "doc_id long, text_hash long, starts binary")


def remove_repeats(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by one space) for every row of docs."""
    late = storage.written(repeated_windows(docs, k), "late")
    own = docs.select(F.col("doc_id").cast("long"), "text").withColumn("text_hash", F.xxhash64("text"))
    joined = own.join(late.hint("shuffle_merge"), ["doc_id", "text_hash"], "left").select("doc_id", "text", "starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.sliced(batches):
            n, removed, kept = [], [], []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                words = (text or "").encode().split()  # on \x20 and \x09-\x0D
                n.append(len(words))
                if starts:
                    at = np.frombuffer(starts, np.uint32)
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + np.uint32(k), -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    removed.append(len(words) - int(keep.sum()))
                    words = list(compress(words, keep.tolist()))
                else:
                    removed.append(0)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
