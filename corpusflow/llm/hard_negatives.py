"""Hard-negative mining with exact scores by subset-sum tables (operator 12), the method of Four Russians.

Components become integers. Candidates are stored as bit planes: for eight dimensions and one bit, a byte. For
an anchor and eight dimensions, a table holds the anchor's sums over all 256 subsets of these dimensions, so that a
plane's byte looks up what the plane adds; planes are joined from the sign down by doubling and adding. This
gives the whole integer inner product.

Anchors lie in files of the shared folder, ANCHORS each. A task reads candidates in blocks, keeps a bounded run of them,
and streams the anchor files over it, so every anchor meets every candidate once a pass and neither side is
multiplied in a shuffle. The first pass finds each anchor's positives, the second the negatives within the
bounds that each positive gives; a task hands on no more rows for an anchor and a positive than are asked for.

Edge cases: rows with a null label, a null vector, or a null or non-finite component take no part, nor do rows without
vec_id, as they have no place in the order; vectors meet only vectors of their own length; an empty vector scores 0; rows
that repeat a vec_id are rows of their own, each an anchor where the id is one; a component beyond +-2^19 counts as that, so
that scores fit a long; an anchor without positives has no rows, as has a positive without negatives within its bounds;
equal scores go to the smaller vec_id, then to the smaller label; an empty table gives no rows; columns beside vec_id, embedding
and label are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.llm import arrays, storage

SCALE, WIDEST = 256, 1 << 27
#: Anchors in a file: their tables of eight dimensions take 2 MB or 4. Candidates in a block, and blocks that a task holds.
ANCHORS, ROWS, BLOCKS = 256, 1024, 128
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LOWEST, HIGHEST = 30, 90
#: No bound.
FAR = 1 << 62


def planes(x: np.ndarray) -> np.ndarray:
    """Bit planes of integer rows: (plane, group of eight dimensions, row), the sign's plane last."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    bits = max(low.bit_length() if low >= 0 else (-low - 1).bit_length(), high.bit_length()) + 1
    wide = np.pad(x, ((0, 0), (0, -x.shape[1] % 8)))
    packed = [np.packbits((wide >> b & 1).astype(bool), axis=1, bitorder="little").T for b in range(bits)]
    return np.ascontiguousarray(np.stack(packed))


def tables(anchors: np.ndarray, kind: type) -> np.ndarray:
    """(group, subset, anchor): the sum of the anchor's components over each subset of eight dimensions."""
    wide = np.pad(anchors, ((0, 0), (0, -anchors.shape[1] % 8))).astype(kind)
    groups = wide.T.reshape(-1, 8, len(wide))
    out = np.zeros((len(groups), 256, len(wide)), kind)
    for k in range(8):
        out[:, 1 << k : 2 << k] = out[:, : 1 << k] + groups[:, k : k + 1]
    return out


def scores(table: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """(candidate, anchor) inner products."""
    total = np.zeros((bits.shape[2], table.shape[2]), table.dtype)
    held = np.empty_like(total)
    for b in range(len(bits) - 1, -1, -1):
        sign = b == len(bits) - 1
        if not sign:
            total += total
        for g in range(len(table)):
            np.take(table[g], bits[b, g], axis=0, out=held, mode="clip")
            if sign:
                total -= held
            else:
                total += held
    return total


def _kind(table_bound: int, bits: int) -> type:
    """The narrower integer that holds every partial sum of scores. table_bound: the largest sum of an anchor's absolute components."""
    return np.int32 if table_bound << bits < 1 << 31 else np.int64


def usable(vectors: DataFrame) -> DataFrame:
    """row, vec_id, label and q (integers) of the rows that take part, in the shared folder."""
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), e.alias("e")).where("vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL")
    rows = rows.where(F.forall("e", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    q = F.transform("e", lambda x: F.floor(F.greatest(F.lit(-float(WIDEST)), F.least(F.lit(float(WIDEST)), x * SCALE))).cast("int"))
    return storage.written(rows.select("vec_id", "label", q.alias("q")).withColumn("row", F.monotonically_increasing_id()), "vectors")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _blocks(rows: DataFrame) -> DataFrame:
    """A row for each block of up to ROWS candidates of one length."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}

        def block(dim: int) -> pa.RecordBatch:
            t = pa.Table.from_batches(held.pop(dim))
            bits = planes(_matrix(t.column("q")))
            return pa.RecordBatch.from_pydict({"dim": [dim], "planes": [len(bits)], "bits": [bits.tobytes()], **{c: [t.column(c).to_numpy().astype(np.int64).tobytes()] for c in ("row", "vec_id", "label")}})

        for batch in batches:
            dims = batch.column("q").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                at = 0
                while at < own.num_rows:
                    free = ROWS - sum(x.num_rows for x in held.get(dim, ()))
                    held.setdefault(dim, []).append(own.slice(at, free))
                    at += free
                    if sum(x.num_rows for x in held[dim]) == ROWS:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    return storage.written(rows.mapInArrow(pack, "dim long, planes long, bits binary, row binary, vec_id binary, label binary"), "blocks")


def _files(anchors: DataFrame, name: str, windows: bool) -> DataFrame:
    """dim and path of files of up to about ANCHORS anchors (row, vec_id, label, q; file), with `windows` the bounds (lo, hi) of each positive."""
    folder = f"{storage.shared_dir(anchors.sparkSession)}/{name}"

    def write(key: tuple, table: pa.Table) -> pa.Table:
        dim, file = (k.as_py() for k in key)
        order = np.argsort(table.column("row").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        out = {c: table.column(c).to_numpy().astype(np.int64) for c in ("row", "vec_id", "label")} | {"q": _matrix(table.column("q"))}
        if windows:
            most = np.asarray(pa.compute.list_value_length(table.column("lo").combine_chunks()))
            lo, hi = (np.full((len(order), POSITIVES), x, np.int64) for x in (FAR, -FAR))
            place = np.arange(POSITIVES) < most[:, None]
            lo[place], hi[place] = table.column("lo").combine_chunks().flatten().to_numpy(), table.column("hi").combine_chunks().flatten().to_numpy()
            out |= {"lo": lo, "hi": hi}
        data = io.BytesIO()
        np.savez(data, **out)
        path = f"{folder}/{dim}-{file}.npz"
        storage.write_file(path, [data.getvalue()])
        return pa.table({"dim": pa.array([dim], pa.int64()), "path": [path]})

    return storage.written(anchors.withColumn("dim", F.size("q").cast("long")).groupBy("dim", "file").applyInArrow(write, "dim long, path string"), f"{name}-files")


def _best(anchor: np.ndarray, score: np.ndarray, vec: np.ndarray, label: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The first k of each anchor: higher scores first, ties by vec_id, label, row."""
    order = np.lexsort((row, label, vec, -score, anchor))
    anchor = anchor[order]
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.int64)
    rank = np.arange(len(anchor)) - np.repeat(first, np.diff(np.append(first, len(anchor))))
    keep = rank < k
    order = order[keep]
    return anchor[keep], score[order], vec[order], label[order], row[order]


def _scan(blocks: DataFrame, paths: dict[int, list[str]], same_label: bool, k: int) -> DataFrame:
    """anchor (its row), window, score, vec_id, label, row: of each run of candidates, the first k for an anchor and window."""

    def meet(run: list[dict], dim: int, path: str) -> pa.RecordBatch | None:
        with np.load(io.BytesIO(storage.read_file(path))) as f:
            held = {c: f[c] for c in f.files}
        n, q = len(held["row"]), held["q"]
        bound = int(np.abs(q).sum(1).max()) if q.size else 0
        lo, hi = held.get("lo", np.full((n, 1), -FAR)), held.get("hi", np.full((n, 1), FAR))
        width, made = lo.shape[1], dict[type, np.ndarray]()
        none = np.zeros(0, np.int64)
        best = [(none,) * 5 for _ in range(width)]
        least = lo.copy()  # what a candidate must reach to be among the first k
        for block in run:
            kind = _kind(bound, block["bits"].shape[0])
            if kind not in made:
                made[kind] = tables(q, kind)
            s = scores(made[kind], block["bits"])
            ends = np.iinfo(kind).min, np.iinfo(kind).max  # no score reaches them
            low, high = np.clip(least, *ends).astype(kind), np.clip(hi, *ends).astype(kind)
            fit = (block["label"][:, None] == held["label"]) == same_label
            if same_label:
                fit &= block["row"][:, None] != held["row"]
            for w in range(width):
                good = fit & (s >= low[:, w]) & (s <= high[:, w])
                at, a = np.nonzero(good)
                if not len(at):
                    continue
                if len(at) > 4 * k * n:  # many: only what reaches a column's k-th can stay
                    tried = np.where(good, s, ends[0])
                    kth = np.partition(tried, len(tried) - min(k, len(tried)), axis=0)[len(tried) - min(k, len(tried))]
                    keep = s[at, a] >= kth[a]
                    at, a = at[keep], a[keep]
                new = (a, s[at, a].astype(np.int64), block["vec_id"][at], block["label"][at], block["row"][at])
                best[w] = _best(*(np.concatenate(x) for x in zip(best[w], new, strict=True)), k)
                full = np.flatnonzero(np.bincount(best[w][0], minlength=n) == k)
                last = np.searchsorted(best[w][0], full, "right") - 1
                least[full, w] = best[w][1][last]
        sizes = [len(b[0]) for b in best]
        if not sum(sizes):
            return None
        a, score, vec, label, row = (np.concatenate(x) for x in zip(*best, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (held["row"][a], np.repeat(np.arange(width), sizes), score, vec, label, row)], ["anchor", "window", "score", "vec_id", "label", "row"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, list[dict]] = {}

        def met(dim: int) -> Iterator[pa.RecordBatch]:
            run = runs.pop(dim)
            for path in paths.get(dim, ()):
                if (out := meet(run, dim, path)) is not None:
                    yield out

        for batch in batches:
            for x in batch.to_pylist():
                if x["dim"] not in paths:
                    continue
                ids = {c: np.frombuffer(x[c], np.int64) for c in ("row", "vec_id", "label")}
                bits = np.frombuffer(x["bits"], np.uint8).reshape(x["planes"], -(-x["dim"] // 8), len(ids["row"]))
                runs.setdefault(x["dim"], []).append(ids | {"bits": bits})
                if len(runs[x["dim"]]) == BLOCKS:
                    yield from met(x["dim"])
        for dim in list(runs):
            yield from met(dim)
        arrays.trim()

    return blocks.mapInArrow(scan, "anchor long, window long, score long, vec_id long, label long, row long")


def _paths(files: DataFrame) -> dict[int, list[str]]:
    """The files' names, one for ANCHORS anchors, in order."""
    out: dict[int, list[str]] = {}
    for r in files.orderBy("dim", "path").collect():
        out.setdefault(r["dim"], []).append(r["path"])
    return out


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """rank (from 1) of the first k rows of each key. A task has sent k rows for a key at most."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "label", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors among rows (`usable`)."""
    blocks = _blocks(rows)
    chosen = rows.where(anchors)
    count = chosen.count()
    chosen = storage.written(chosen.withColumn("file", F.pmod(F.xxhash64("row"), F.lit(max(1, -(-count // ANCHORS))))), "anchors")
    near = _scan(blocks, _paths(_files(chosen, "anchors", False)), True, positives)
    near = storage.written(_first(near, ["anchor"], positives).select("anchor", F.col("rank").alias("place"), F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id")), "positives")
    # Whole hundredths: 100 * score lies between lowest * p and highest * p.
    lo = -F.expr(f"(-positive_score * {lowest}) div 100 - IF((-positive_score * {lowest}) % 100 < 0, 1, 0)")
    hi = F.expr(f"(positive_score * {highest}) div 100 - IF((positive_score * {highest}) % 100 < 0, 1, 0)")
    bounds = near.select("anchor", F.struct("place", lo.alias("lo"), hi.alias("hi")).alias("w")).groupBy("anchor").agg(F.array_sort(F.collect_list("w")).alias("w"))
    bounded = chosen.join(bounds, F.col("row") == F.col("anchor")).select(*chosen.columns, F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"))
    far = _scan(blocks, _paths(_files(bounded, "bounded", True)), False, negatives)
    far = _first(far, ["anchor", "window"], negatives).select("anchor", (F.col("window") + 1).alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = chosen.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = far.join(near.withColumn("place", F.col("place").cast("long")), ["anchor", "place"]).join(named, "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine(usable(vectors.withColumn("label", moved)), F.col("vec_id") % 100 == 0)
