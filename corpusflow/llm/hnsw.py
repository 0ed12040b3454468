"""Near-duplicate embeddings by hierarchical navigable small-world graphs (operator 10).

Vectors are dealt to shards by hash; each shard's graph is built in one task from at most
SHARD_BYTES of vectors and stored in the shared folder. Every vector queries every shard, in blocks. A
shard's beam is widened until an audit against brute force passes. It asks for the links of a sample of
all vectors, and, as links may be rare, for those of planted probes: nodes of the shard turned away until
their cosine with themselves is between the threshold and 0.97. The index keeps what the audit wanted
and found. A query whose beam is full of links gets a wider one, up to WIDEST, and is compared with its
whole shard only beyond that. Links are verified by cosine in double precision. Identical vectors are
one class and are searched once; links leave a task as a forest and as counts, never as all pairs.

Edge cases: vectors that are null, all zero, or hold null or non-finite components link with
nothing; vectors of different lengths aren't compared; repeated vec_ids count as separate vectors
of one class; an empty table gives no rows; other columns, labels included, are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import storage
from corpusflow.llm.components import components, forest

COSINE = 0.9
#: Neighbours of a node, candidates when it is linked, and beam at the start.
LINKS, BUILD, BEAM = 24, 64, 48
SHARDS, SHARD_BYTES, QUERY_ROWS = 4, 64 << 20, 1024
#: The widest beam of a query whose beam is full of links: the first one is widened once.
WIDEST = 4 * BEAM
#: Vectors of the audit, planted probes in a shard, and the share of their links that it asks for.
AUDIT_ROWS, PROBES, AUDIT_RECALL = 1024, 512, 0.99
#: Single precision guides the search; what it puts this far below the threshold is still verified.
SLACK = 1e-4
_GRAPHS: dict[str, "Graph"] = {}


def best(ids: np.ndarray, sims: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n most similar of each row, in order."""
    if sims.shape[1] > n:
        part = np.argpartition(-sims, n - 1, axis=1)[:, :n]
        ids, sims = np.take_along_axis(ids, part, 1), np.take_along_axis(sims, part, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def beam_search(vec: np.ndarray, near: np.ndarray, query: np.ndarray, entry: np.ndarray, width: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) of each query's beam; -1 where it isn't full. Queries advance together."""
    n, m = len(query), near.shape[1]
    row = np.arange(n)[:, None]
    seen = np.zeros((n, len(vec) + 1), bool)  # the last column stands for node -1
    seen[:, -1] = True
    entry = np.where(np.take_along_axis(seen, entry, 1), -1, entry)
    seen[row, entry] = True
    sims = np.einsum("nd,nkd->nk", query, vec[entry])
    sims[entry < 0] = -np.inf
    ids, sims = best(entry, sims, width)
    done = ids < 0
    alive = np.arange(n)
    while len(alive):
        ready = np.where(done[alive], -np.inf, sims[alive])
        pick = np.argpartition(-ready, min(expand, ready.shape[1]) - 1, axis=1)[:, :expand]
        usable = np.isfinite(np.take_along_axis(ready, pick, 1))
        going = usable.any(1)
        alive, pick, usable = alive[going], pick[going], usable[going]
        if not len(alive):
            break
        at = alive[:, None]
        done[at, pick] = True
        fresh = np.where(usable[:, :, None], near[ids[at, pick]], -1).reshape(len(alive), -1)
        fresh = np.where(seen[at, fresh], -1, fresh)
        fresh.sort(axis=1)
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
        fresh = -np.sort(-fresh, axis=1)  # real nodes first
        fresh = fresh[:, : max(1, int((fresh >= 0).sum(1).max()))]
        seen[at, fresh] = True
        s = np.einsum("nd,nkd->nk", query[alive], vec[fresh])
        s[fresh < 0] = -np.inf
        all_ids, all_sims = np.concatenate([ids[alive], fresh], 1), np.concatenate([sims[alive], s], 1)
        all_done = np.concatenate([done[alive], fresh < 0], 1)
        keep = min(width, all_sims.shape[1])
        part = np.argpartition(-all_sims, keep - 1, axis=1)[:, :keep]
        if keep > ids.shape[1]:
            pad = keep - ids.shape[1]
            ids, sims, done = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1), np.pad(sims, ((0, 0), (0, pad)), constant_values=-np.inf), np.pad(done, ((0, 0), (0, pad)), constant_values=True)
        ids[alive], sims[alive], done[alive] = np.take_along_axis(all_ids, part, 1), np.take_along_axis(all_sims, part, 1), np.take_along_axis(all_done, part, 1)
    ids[~np.isfinite(sims)] = -1
    return best(ids, sims, width)


def diverse(vec: np.ndarray, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Up to m neighbours of each row's candidates: one is taken unless it is nearer to one taken before; free places go to the nearest others."""
    ids, sims = best(ids, sims, ids.shape[1])
    n, k = ids.shape
    between = np.einsum("nkd,njd->nkj", vec[ids], vec[ids])
    taken, count = np.zeros((n, k), bool), np.zeros(n, np.int64)
    for j in range(k):
        worst = np.where(taken, between[:, :, j], -np.inf).max(1)
        good = (ids[:, j] >= 0) & np.isfinite(sims[:, j]) & (worst <= sims[:, j]) & (count < m)
        taken[:, j] = good
        count += good
    rank = np.where(taken, 0, 1) + (np.arange(k) / k)
    rank[(ids < 0) | ~np.isfinite(sims)] = 9
    order = np.argsort(rank, axis=1)[:, :m]
    out = np.take_along_axis(ids, order, 1)
    out[np.take_along_axis(rank, order, 1) == 9] = -1
    return np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1) if out.shape[1] < m else out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at unit length. The largest component is taken out first, so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True, initial=0)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Graph:
    """Layers of a shard, from all nodes up to a handful; layer l holds the first `counts[l]` nodes."""

    def __init__(self, ids: np.ndarray, weight: np.ndarray, vectors: np.ndarray, layers: list[np.ndarray] | None = None, beam: int = BEAM) -> None:
        self.ids, self.weight, self.vectors, self.beam = ids, weight, vectors, beam
        self.vec = unit(vectors).astype(np.float32)
        self.audited = np.zeros(4, np.int64)  # links wanted and found, of the sample and of probes
        self.layers = layers if layers is not None else self._build()

    def _build(self) -> list[np.ndarray]:
        counts = [len(self.ids)]
        while counts[-1] > 32:
            counts.append(-(-counts[-1] // 16))
        layers: list[np.ndarray] = []
        for size in reversed(counts):
            near = np.full((size, LINKS), -1, np.int64)
            vec = self.vec[:size]
            at, step = 0, 32
            while at < size:
                to = min(size, at + step)
                own = np.arange(at, to)
                sims = vec[own] @ vec[own].T
                np.fill_diagonal(sims, -np.inf)
                ids, sims = best(np.tile(own, (len(own), 1)), sims, min(BUILD, len(own)))
                if at:
                    entry = self._entry(vec[own], layers, at)
                    found, s = beam_search(vec[:at], near[:at], vec[own], entry, BUILD)
                    ids, sims = np.concatenate([ids, found], 1), np.concatenate([sims, np.where(found < 0, -np.inf, s)], 1)
                    ids, sims = best(ids, sims, BUILD)
                near[own] = diverse(vec, np.where(np.isfinite(sims), ids, -1), sims, LINKS)
                self._back(vec, near, own)
                at, step = to, min(256, 2 * step, max(8, (32 << 20) // max(1, size)))
            layers.append(near)
        return layers[::-1]

    def _entry(self, query: np.ndarray, above: list[np.ndarray], below: int) -> np.ndarray:
        """Nodes to start from, out of the layers above (top first), of which the first `below` nodes exist."""
        top = min(below, 32)
        entry = best(np.tile(np.arange(top), (len(query), 1)), query @ self.vec[:top].T, min(8, top))[0]
        for near in above[1:]:
            if len(near) > below:
                break
            entry = beam_search(self.vec[: len(near)], near, query, entry, 8)[0]
        return entry

    @staticmethod
    def _back(vec: np.ndarray, near: np.ndarray, own: np.ndarray) -> None:
        """Add the links back to own, and choose anew where there are too many."""
        a, b = np.repeat(own, near.shape[1]), near[own].ravel()
        a, b = a[b >= 0], b[b >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        target, first, count = np.unique(b, return_index=True, return_counts=True)
        for lo in range(0, len(target), 512):
            t, f, c = target[lo : lo + 512], first[lo : lo + 512], count[lo : lo + 512]
            width = min(int(c.max()), 64)
            place = f[:, None] + np.arange(width)
            new = np.where(np.arange(width) < c[:, None], a[np.minimum(place, len(a) - 1)], -1)
            ids = np.concatenate([near[t], new], 1)
            ids = -np.sort(-ids, axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = np.einsum("nd,nkd->nk", vec[t], vec[ids])
            sims[ids < 0] = -np.inf
            near[t] = diverse(vec, ids, sims, near.shape[1])

    def search(self, query: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) for unit queries in single precision."""
        step = max(1, min(256, (32 << 20) // max(1, len(self.vec))))
        parts = []
        for a in range(0, len(query), step):
            q = query[a : a + step]
            entry = self._entry(q, self.layers[::-1], len(self.vec)) if len(self.layers) > 1 else np.tile(np.arange(len(self.vec)), (len(q), 1))
            parts.append(beam_search(self.vec, self.layers[0], q, entry, width))
        full = max(p[0].shape[1] for p in parts)
        pad = lambda x, v: np.pad(x, ((0, 0), (0, full - x.shape[1])), constant_values=v)
        return np.concatenate([pad(i, -1) for i, _ in parts]), np.concatenate([pad(s, -np.inf) for _, s in parts])

    def probes(self, cosine: float) -> np.ndarray:
        """Some nodes, each turned away in a random direction."""
        rng = np.random.default_rng(len(self.vec))
        v = self.vec[rng.permutation(len(self.vec))[:PROBES]].astype(np.float64)
        away = rng.normal(size=v.shape)
        away -= (away * v).sum(1, keepdims=True) * v
        length = np.linalg.norm(away, axis=1, keepdims=True)
        c = rng.uniform(cosine + SLACK, max(0.97, cosine + 2 * SLACK), (len(v), 1))
        return np.where(length > 1e-9, c * v + np.sqrt(1 - c * c) * away / np.maximum(length, 1e-9), v).astype(np.float32)

    def wanted(self, query: np.ndarray, own: np.ndarray | None, cosine: float) -> list[np.ndarray]:
        """Each query's links by brute force, a slice of queries at a time; own: ids that don't count."""
        out, step = [], max(1, (16 << 20) // max(1, len(self.vec)))
        for a in range(0, len(query), step):
            sims = query[a : a + step] @ self.vec.T
            if own is not None:
                sims[own[a : a + step, None] == self.ids] = -2
            out += [np.flatnonzero(row >= cosine) for row in sims]
        return out

    def audit(self, query: np.ndarray, own: np.ndarray, cosine: float) -> None:
        """Widen the beam until a search as it is done finds AUDIT_RECALL of the links that brute force finds, of the sample and of probes. own: the sample's ids.

        A row with more links than the beam holds counts as any other: its search widens the beam, too.
        """
        sets = [(query, self.wanted(query, own, cosine))]
        probes = self.probes(cosine)
        sets.append((probes, self.wanted(probes, None, cosine)))
        size = np.int64(len(self.vec))
        while True:
            self.audited[:] = 0
            for i, (rows, wanted) in enumerate(sets):
                ask = np.array([k for k, links in enumerate(wanted) if len(links)], np.int64)
                if len(ask):
                    q, node = self.links(rows[ask], cosine)
                    asked = np.repeat(np.arange(len(ask)), [len(wanted[k]) for k in ask]) * size + np.concatenate([wanted[k] for k in ask])
                    self.audited[2 * i] = len(asked)
                    self.audited[2 * i + 1] = len(np.intersect1d(asked, q * size + node))
            if self.beam >= len(self.vec) or (self.audited[1::2] >= AUDIT_RECALL * self.audited[::2]).all():
                break
            self.beam *= 2

    def links(self, query: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of what the beams hold that may reach cosine. A beam whose last node still does is widened."""
        least, width = cosine - SLACK, self.beam
        left = np.arange(len(query))
        pairs: list[tuple[np.ndarray, np.ndarray]] = [(left[:0], left[:0])]
        while len(left) and width <= max(self.beam, WIDEST):
            ids, sims = self.search(query[left], width)
            full = (ids[:, -1] >= 0) & (sims[:, -1] >= least) & (ids.shape[1] < len(self.vec))
            q, k = np.nonzero((ids >= 0) & (sims >= least) & ~full[:, None])
            pairs.append((left[q], ids[q, k]))
            left, width = left[full], 4 * width
        step = max(1, (16 << 20) // max(1, len(self.vec)))
        for a in range(0, len(left), step):
            row, node = np.nonzero(query[left[a : a + step]] @ self.vec.T >= least)
            pairs.append((left[a : a + step][row], node))
        return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, weight=self.weight, vectors=self.vectors, beam=self.beam, **{f"layer{i}": x.astype(np.int32) for i, x in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def load(cls, uri: str) -> "Graph":
        if uri not in _GRAPHS:
            while len(_GRAPHS) >= 2:
                _GRAPHS.pop(next(iter(_GRAPHS)))
            with np.load(io.BytesIO(storage.read_file(uri))) as x:
                layers = [x[f"layer{i}"].astype(np.int64) for i in range(sum(k.startswith("layer") for k in x.files))]
                _GRAPHS[uri] = cls(x["ids"], x["weight"], x["vectors"], layers, int(x["beam"]))
        return _GRAPHS[uri]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1)


def valid(column: str) -> Column:
    e = F.col(column)
    return F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))


def classes_of(rows: DataFrame) -> DataFrame:
    """k1, k2, rep (smallest vec_id), m (members), e, dim of each distinct vector of rows (vec_id, e, k1, k2)."""
    classes = rows.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("e").alias("e"))
    return storage.written(classes.where("rep IS NOT NULL").withColumn("dim", F.size("e")), "classes")


def index_of(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """A row a shard: dim, shard, path, beam, and what its audit wanted and found of the sample's links and of the probes'."""
    spark = classes.sparkSession
    size = classes.agg(F.sum(F.col("dim").cast("long") * 8)).first()[0] or 0
    shards = max(SHARDS, -(-size // SHARD_BYTES))
    sample = classes.orderBy(F.xxhash64("rep")).limit(AUDIT_ROWS).select("rep", "e").collect()  # a fixed number of vectors
    audit: dict[int, list] = {}
    for r in sample:
        audit.setdefault(len(r["e"]), []).append((r["rep"], r["e"]))
    held = {k: (np.array([x for x, _ in v], np.int64), unit(np.array([e for _, e in v])).astype(np.float32)) for k, v in audit.items()}
    folder = f"{storage.shared_dir(spark)}/hnsw"
    counts = ("links_wanted", "links_found", "probes_wanted", "probes_found")

    def build(key: tuple, table: pa.Table) -> pa.Table:
        dim, shard = (k.as_py() for k in key)
        order = np.argsort(table.column("order").to_numpy(), kind="stable")
        graph = Graph(table.column("rep").to_numpy()[order], table.column("m").to_numpy()[order], _matrix(table.column("e"))[order])
        own, query = held.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim), np.float32)))
        graph.audit(query, own, cosine)
        path = f"{folder}/{dim}-{shard}.npz"
        storage.write_file(path, [graph.dump()])
        return pa.table({"dim": [dim], "shard": [shard], "path": [path], "beam": pa.array([graph.beam], pa.int64()), **{c: pa.array([int(n)], pa.int64()) for c, n in zip(counts, graph.audited, strict=True)}})

    dealt = classes.select(F.col("dim").cast("long"), F.pmod(F.xxhash64("rep"), F.lit(shards)).alias("shard"), F.xxhash64("rep", F.lit(5)).alias("order"), "rep", "m", "e")
    schema = "dim long, shard long, path string, beam long, " + ", ".join(f"{c} long" for c in counts)
    return storage.written(dealt.groupBy("dim", "shard").applyInArrow(build, schema), "index")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.withColumn("k1", F.when(valid("e"), F.xxhash64("e"))).withColumn("k2", F.xxhash64(F.lit(1), "e"))
    classes = classes_of(rows)
    index = index_of(classes, cosine)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def row(dim: int) -> pa.RecordBatch:
            part = held.pop(dim)
            return pa.RecordBatch.from_pydict({"dim": [dim], "first": [part[0][0]], "reps": [np.array([p[0] for p in part], np.int64).tobytes()], "vectors": [np.array([p[1] for p in part], np.float64).tobytes()]})

        for batch in batches:
            for dim, rep, e in zip(*(batch.column(c).to_pylist() for c in ("dim", "rep", "e")), strict=True):
                held.setdefault(dim, []).append((rep, e))
                if len(held[dim]) == QUERY_ROWS:
                    yield row(dim)
        for dim in list(held):
            yield row(dim)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, path, reps, data in zip(*(batch.column(c).to_pylist() for c in ("dim", "path", "reps", "vectors")), strict=True):
                graph = Graph.load(path)
                reps = np.frombuffer(reps, np.int64)
                x = unit(np.frombuffer(data, np.float64).reshape(-1, dim))
                q, node = graph.links(x.astype(np.float32), cosine)
                good = graph.ids[node] != reps[q]
                for at in range(0, len(q), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    good[part] &= np.einsum("nd,nd->n", x[q[part]], unit(graph.vectors[node[part]])) >= cosine
                q, node = q[good], node[good]
                n = np.bincount(q, graph.weight[node], len(reps)).astype(np.int64)
                a, b = forest(reps[q], graph.ids[node])
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([reps[some], a])), pa.array(np.concatenate([np.full(len(some), -1), b]), mask=np.arange(len(some) + len(a)) < len(some)), pa.array(np.concatenate([n[some], np.zeros(len(a), np.int64)]))], ["a", "b", "n"])

    blocks = storage.written(classes.select(F.col("dim").cast("long"), "rep", "e").mapInArrow(pack, "dim long, first long, reps binary, vectors binary"), "queries")
    asked = blocks.join(index.select("dim", "path"), "dim").repartition(F.col("first"), F.col("path"))
    found = storage.written(asked.mapInArrow(find, "a long, b long, n long"), "found")
    label = components(found.where("b IS NOT NULL").select("a", "b"))
    count = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    known = classes.select("k1", "k2", "rep", "m").join(label, F.col("rep") == F.col("id"), "left").join(count, "rep", "left")
    known = known.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    out = rows.select("vec_id", "k1", "k2").join(known, ["k1", "k2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op10_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
