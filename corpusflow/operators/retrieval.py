"""Lexical and vector retrieval for a table of queries over a table of chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusflow import sqltext as S
from corpusflow.functions import text as T
from corpusflow.operators.audit import TYPES as KINDS
from corpusflow.operators.cleaning import SPECIALTIES, TOPICS
from corpusflow.operators.quality import SCORED_SQL, scored
from corpusflow.shared import folder, numbered, written
from corpusflow.tables import quoted as q
from corpusflow.tables import table

# Stop words, weights and shapes that results depend on.
STOPWORDS = ("the", "and", "for", "are", "with", "that", "this", "from", "what", "which", "how", "why", "when", "where", "who", "can", "does", "was", "were", "have", "has", "not", "but", "you", "your", "about", "into", "their", "there", "than", "then", "will", "would", "should", "could")
TOKEN = "[a-zA-Z][a-zA-Z0-9-]{2,}"
SUFFIXES = (("ies", 5, 3, "y"), ("ics", 5, 1, ""), ("ing", 5, 3, ""), ("ed", 4, 2, ""), ("es", 4, 2, ""), ("s", 3, 1, ""))
K1, B = 1.5, 0.75
TRUST = {"high": 0.25, "medium": 0.1, "low": -0.25}


def stem(token):
    """A light stemmer: the first suffix that fits."""
    return _stemmed(F.btrim(F.lower(token), F.lit("-")))


def _stemmed(t):
    """The ladder of suffixes over a lower-case token without hyphens at its ends; in a lambda, t has to be its variable."""
    out = t
    for suffix, least, cut, add in reversed(SUFFIXES):
        out = F.when((F.length(t) > least) & F.endswith(t, F.lit(suffix)), F.concat(F.left(t, F.length(t) - cut), F.lit(add))).otherwise(out)
    return out


def _stems(found):
    return F.transform(F.transform(found, lambda t: F.btrim(t, F.lit("-"))), _stemmed)


def tokens(c):
    """Stemmed tokens without stop words, in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({TOKEN})"), 1)
    return F.filter(_stems(found), lambda t: (t != "") & ~t.isin(*STOPWORDS))


def keywords(c):
    """Distinct stemmed letter-only tokens; stop words go before stemming."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-zA-Z][a-zA-Z-]{2,})"), 1)
    return F.array_distinct(_stems(F.filter(found, lambda t: ~t.isin(*STOPWORDS))))


def bm25(queries, chunks, k1=K1, b=B):
    """query_id, chunk_id, score (as integer ten-thousandths) for chunks with a query term; statistics over `chunks`.

    Texts are cut into tokens once. Only postings of terms that some query asks for are shuffled and counted.
    """
    cut = written(chunks.select("chunk_id", tokens(F.col("text")).alias("ts")), "tokens").withColumn("raw", F.size("ts"))
    stats = cut.agg(F.count("*").alias("n"), F.greatest(F.avg("raw"), F.lit(1.0)).alias("avg"))
    asked = written(queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qn")), "asked")
    term = cut.select("chunk_id", F.greatest("raw", F.lit(1)).alias("dl"), F.explode("ts").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    tf = written(term.groupBy("term", "chunk_id", "dl").agg(F.count("*").alias("tf")), "postings")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    hits = asked.join(df, "term").join(tf, "term").join(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg"))) * F.col("qn")
    return hits.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))


def top(scored, k, by="score"):
    """The k best chunks of each query; ties go to the smaller chunk_id."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round(by, 6)), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hashed_embedding(docs, dim=384):
    """doc_id, index, weight: token counts signed and folded into dim places by sha256, of unit length."""
    t = docs.select("doc_id", F.explode(F.filter(F.transform(T.words(F.lower("text")), lambda w: F.regexp_replace(w, r"^[.,;:!?()\[\]\"']+|[.,;:!?()\[\]\"']+$", "")), lambda w: w != "")).alias("t"))
    t = t.groupBy("doc_id", "t").agg(F.count("*").alias("n")).withColumn("h", F.sha2("t", 256))
    t = t.select("doc_id", F.expr(f"CAST(conv(substring(h, 1, 8), 16, 10) AS BIGINT) % {dim}").alias("place"), F.expr("IF(CAST(conv(substring(h, 9, 2), 16, 10) AS INT) % 2 = 0, n, -n)").alias("n"))
    return t.groupBy("doc_id", "place").agg(F.sum("n").alias("n")).where("n <> 0")


EDGES = ".,;:!?()[]\"'"


def hashing_model(dim=384):
    """A model for `encoded`: `hashed_embedding`, of unit length, in Python; words are hashed once a batch."""
    import hashlib

    def model(texts: list[str]) -> np.ndarray:
        known: dict[str, tuple[int, int]] = {}
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts, strict=True):
            for w in text.lower().split():
                w = w.strip(EDGES)
                if w and w not in known:
                    h = hashlib.sha256(w.encode()).hexdigest()
                    known[w] = int(h[:8], 16) % dim, 1 - 2 * (int(h[8:10], 16) % 2)
                if w:
                    place, sign = known[w]
                    row[place] += sign
        return out

    return model


def encoded(rows, model=None, dim=384, batch=256):
    """id, embedding of rows (id, text) by a model from a list of texts to an array; raises where its shape isn't (texts, dim)."""
    model = model or hashing_model(dim)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                got = np.asarray(model([t or "" for t in part["text"]]))
                if got.shape != (len(part), dim):
                    raise ValueError(f"the model returned {got.shape}, expected {(len(part), dim)}")
                yield pd.DataFrame({"id": part["id"], "embedding": list(got)})

    return rows.select("id", "text").mapInPandas(run, "id long, embedding array<double>")


def vector_arm(queries, chunks, k=20):
    """query_id, chunk_id, vector: the k chunks nearest to each query by the cosine of their embeddings; texts without words have none."""
    some = F.exists("embedding", lambda x: x != 0)
    asked = encoded(queries.select(F.col("query_id").alias("id"), "text")).where(some).select(F.col("id").alias("query_id"), "embedding")
    held = encoded(chunks.select(F.col("chunk_id").alias("id"), "text")).where(some).select(F.col("id").alias("vec_id"), "embedding")
    return VectorIndex(written(held, "vectors")).search(asked, k).select("query_id", F.col("vec_id").alias("chunk_id"), F.round("score", 9).alias("vector"))


#: Rows of a block, blocks of queries whose best a task holds at once, vectors to a cell, cells at most, and vectors that cells are fitted on.
BLOCK_ROWS, HELD_BLOCKS, CELL_ROWS, MOST_CELLS, SAMPLE = 1024, 16, 4096, 1024, 8192
#: Vectors that a task holds while it packs blocks, over all cells; beyond that, the fullest cells' blocks go out as they are.
HELD_ROWS = 16 * BLOCK_ROWS
#: Bytes of a row group of blocks: a reader holds a whole group's rows, and a writer looks at sizes from the hundredth row on if it isn't told to do so earlier.
GROUP_BYTES = 16 << 20
#: Cells that a query probes first, and by how much a cell's bound may miss the k-th score for the cell to be left out.
PROBES, MARGIN = 4, 1e-7


def _units(column):
    x = np.array(column.tolist(), np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centres of a sample: some rounds of spherical k-means."""
    rng = np.random.default_rng(1)
    centres = sample[rng.permutation(len(sample))[:cells]]
    for _ in range(6):
        own = (sample @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(length > 1e-9, total / np.maximum(length, 1e-9), centres)
    return centres


class VectorIndex:
    """Vectors at unit length in blocks of one cell each (in the shared folder), and the cells' centres and radii.

    Centres are fitted on at most SAMPLE vectors. Every vector lies in the cell of its nearest centre, and no farther from it than the cell's radius
    (an angle), which bounds the cosine of anything in the cell with a query. One cell where there are fewer than two cells' vectors.
    """

    def __init__(self, rows, cells=None):
        """rows: vec_id, embedding, which isn't zero."""
        spark = rows.sparkSession
        if cells is None:
            cells = max(1, min(MOST_CELLS, rows.count() // CELL_ROWS))
        self.centres = None
        if cells > 1:
            sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()  # a fixed number of vectors
            self.centres = _centres(_units(sample["embedding"]), cells) if len(sample) else None
        self.blocks = self._packed(rows, "vec_id", "v")
        self.radius = None
        if self.centres is not None:
            self.blocks = written(self.blocks, "cells", **{"parquet.block.size": str(GROUP_BYTES), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"})
            far = {r["cell"]: r["far"] for r in self.blocks.groupBy("cell").agg(F.max("far").alias("far")).collect()}  # a row a cell
            self.radius = np.array([far.get(c, -np.inf) for c in range(len(self.centres))])
        self.spark = spark

    def _packed(self, rows, key, name):
        """Blocks of rows by cell: cell, far (the largest angle with its centre), `name`_ids, `name`_units."""
        centres = self.centres

        def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

            def block(cell: int, rest: bool = False) -> Iterator[pd.DataFrame]:
                ids, x = (np.concatenate(p) for p in zip(*held.pop(cell), strict=True))
                whole = len(ids) if rest else len(ids) // BLOCK_ROWS * BLOCK_ROWS
                for at in range(0, whole, BLOCK_ROWS):
                    part = slice(at, min(whole, at + BLOCK_ROWS))
                    far = 0.0 if centres is None else float(np.arccos(np.clip(x[part] @ centres[cell], -1, 1)).max())
                    order = np.argsort(ids[part], kind="stable")
                    yield pd.DataFrame({"cell": [cell], "far": [far], f"{name}_ids": [ids[part][order].tobytes()], f"{name}_units": [x[part][order].tobytes()]})
                if whole < len(ids):
                    held[cell] = [(ids[whole:], x[whole:])]

            for f in frames:
                if not len(f):
                    continue
                x, ids = _units(f["embedding"]), f[key].to_numpy(np.int64)
                own = np.zeros(len(f), np.int64) if centres is None else (x @ centres.T).argmax(1)
                for cell in np.unique(own).tolist():
                    held.setdefault(cell, []).append((ids[own == cell], x[own == cell]))
                    if sum(len(i) for i, _ in held[cell]) >= BLOCK_ROWS:
                        yield from block(cell)
                rows_of = {cell: sum(len(i) for i, _ in parts) for cell, parts in held.items()}
                if sum(rows_of.values()) > HELD_ROWS:
                    for cell in sorted(rows_of, key=rows_of.get, reverse=True):
                        yield from block(cell, True)
                        if sum(rows_of[c] for c in held) <= HELD_ROWS // 2:
                            break
            for cell in list(held):
                yield from block(cell, True)

        return rows.select(key, "embedding").mapInPandas(pack, f"cell long, far double, {name}_ids binary, {name}_units binary")

    def _asked(self, queries, first):
        """Blocks of queries for each cell that they probe: the PROBES best by bound (first), or all others whose bound reaches the query's `least`."""
        centres, radius = self.centres, self.radius

        def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if not len(f):
                    continue
                x, ids = _units(f["embedding"]), f["query_id"].to_numpy(np.int64)
                bound = np.cos(np.maximum(0, np.arccos(np.clip(x @ centres.T, -1, 1)) - radius))
                bound[:, np.isinf(radius)] = -np.inf  # cells without vectors
                order = np.argsort(-bound, axis=1, kind="stable")[:, :PROBES]
                wanted = np.zeros(bound.shape, bool)
                np.put_along_axis(wanted, order, True, 1)
                if not first:
                    wanted = ~wanted & (bound >= f["least"].to_numpy()[:, None] - MARGIN)
                wanted &= bound > -np.inf
                for cell in np.flatnonzero(wanted.any(0)).tolist():
                    own = np.flatnonzero(wanted[:, cell])
                    for at in range(0, len(own), BLOCK_ROWS):
                        part = own[at : at + BLOCK_ROWS]
                        yield pd.DataFrame({"cell": [cell], "q_ids": [ids[part].tobytes()], "q_units": [x[part].tobytes()]})

        columns = ["query_id", "embedding"] if first else ["query_id", "embedding", "least"]
        return queries.select(*columns).mapInPandas(probe, "cell long, q_ids binary, q_units binary")

    def _met(self, asked, k):
        """query_id, vec_id, score: for each block of queries, the k best of the blocks of its cell that a task meets."""

        def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[tuple[bytes, bytes], tuple[np.ndarray, np.ndarray]] = {}

            def best(block: tuple[bytes, bytes]) -> pd.DataFrame:
                score, vec = held.pop(block)
                return pd.DataFrame({"query_id": np.repeat(np.frombuffer(block[0], np.int64), score.shape[1]), "vec_id": vec.ravel(), "score": score.ravel()})

            for f in frames:
                for q_ids, q_, ids, x in zip(f["q_ids"], f["q_units"], f["v_ids"], f["v_units"], strict=True):
                    n, m = len(q_ids) // 8, len(ids) // 8
                    score = np.frombuffer(q_, np.float64).reshape(n, -1) @ np.frombuffer(x, np.float64).reshape(m, -1).T
                    vec = np.broadcast_to(np.frombuffer(ids, np.int64), (n, m))
                    block = q_ids, q_
                    if block in held:
                        score, vec = (np.concatenate(p, 1) for p in zip(held.pop(block), (score, vec), strict=True))
                    elif len(held) == HELD_BLOCKS:
                        yield best(next(iter(held)))
                    order = np.lexsort((vec, -np.round(score, 9)), axis=1)[:, :k]
                    held[block] = np.take_along_axis(score, order, 1), np.take_along_axis(vec, order, 1)
            for block in list(held):
                yield best(block)

        return asked.join(self.blocks.drop("far"), "cell").mapInPandas(nearest, "query_id long, vec_id long, score double")

    def search(self, queries, k=10):
        """query_id, vec_id, score, rank of the k nearest of every query (query_id, embedding; not zero); ties go to the smaller vec_id.

        Exact: after its first cells a query goes on to every cell whose bound still reaches its k-th score.
        """
        if self.centres is None:
            return _ranked(self._met(self._packed(queries, "query_id", "q").drop("far"), k), k)
        queries = written(queries.select("query_id", "embedding"), "asked")
        found = written(self._met(self._asked(queries, True), k), "found")
        least = _ranked(found, k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(F.lit(-2.0)).alias("least"))
        more = self._met(self._asked(queries.join(least, "query_id"), False), k)
        return _ranked(found.unionByName(more), k)


def _ranked(found, k):
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine_top(queries, vectors, k=10, cells=None):
    """query_id, vec_id, score, rank of the k nearest by cosine; repeated query_ids with different vectors aren't told apart."""
    return VectorIndex(vectors, cells).search(queries, k)


def _queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _chunks(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source")


def e1_hashing_embedding(spark, sf):
    return hashed_embedding(table(spark, sf, "documents"))


def e3_cosine_top(spark, sf):
    """Every twentieth vector asks for its ten nearest others."""
    v = table(spark, sf, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return cosine_top(asked, v).select("query_id", "vec_id", "rank")


def e4_filtered(spark, sf):
    """Metadata conjunction as one predicate; language and size stand for trust and year."""
    d = table(spark, sf, "documents")
    return d.where(F.col("lang").isin("en", "fr") & (F.col("n_chars") >= 500) & F.col("source").isNotNull()).select("doc_id", "source")


def e6_upsert(spark, sf):
    """The last write of a point wins."""
    v = table(spark, sf, "embeddings").select("vec_id", "label")
    new = v.where("vec_id % 3 = 0").select((F.col("vec_id") * 2).alias("vec_id"), (F.col("label") + 100).alias("label"), F.lit(1).alias("version"))
    every = v.withColumn("version", F.lit(0)).unionByName(new)
    return every.groupBy("vec_id").agg(F.max_by("label", F.struct("version", "label")).alias("label"))


def f1_stems(spark, sf):
    d = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({TOKEN})"), 1)).alias("token")).distinct()
    return d.select("token", stem(F.col("token")).alias("stem"))


def f2_tokens(spark, sf):
    d = table(spark, sf, "conversations").select("conv_id", "turn", tokens(F.col("text")).alias("ts"))
    return d.select("conv_id", "turn", F.array_join("ts", " ").alias("tokens"))


def f3_bm25(spark, sf):
    s = bm25(_queries(spark, sf), _chunks(spark, sf))
    return s.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.round(F.sum("score"), 3).alias("total"))


def f5_keyword_search(spark, sf):
    return top(bm25(_queries(spark, sf), _chunks(spark, sf)), 20).select("query_id", "chunk_id", "rank")


def f6_keywords(spark, sf):
    d = table(spark, sf, "conversations")
    return d.select("conv_id", "turn", F.array_join(F.array_sort(keywords(F.col("text"))), " ").alias("keywords"))


def f7_lexical_score(spark, sf):
    """1 and a quarter per occurrence, up to five, for each term of the first query; 3 more for the phrase of its sorted terms."""
    terms = ("tion", "thing", "eau")
    d = table(spark, sf, "documents").withColumn("t", F.lower("text"))
    score = F.lit(0.0)
    for x in terms:
        n = (F.length("t") - F.length(F.replace("t", F.lit(x), F.lit("")))) / len(x)
        score = score + F.when(n > 0, 1 + 0.25 * F.least(n, F.lit(5))).otherwise(0)
    return d.select("doc_id", (score + F.when(F.contains("t", F.lit(" ".join(sorted(terms)))), 3).otherwise(0)).alias("score"))


def f8_rewrite(spark, sf):
    d = table(spark, sf, "conversations").where("role = 'user'")
    return d.select("conv_id", "turn", F.substring(F.concat_ws(" ", T.squeezed(F.col("text")), F.array_join(F.array_sort(keywords(F.col("text"))), " ")), 1, 900).alias("rewritten"))


def f9_variants(spark, sf):
    """Cleaned text and its keywords; equal ones, but for case, once."""
    d = table(spark, sf, "conversations").where("role = 'user'").withColumn("a", T.squeezed(F.col("text"))).withColumn("b", F.array_join(F.array_sort(keywords(F.col("text"))), " "))
    d = d.select("conv_id", "turn", F.posexplode(F.when(F.lower("a") == F.lower("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("variant", "query"))
    return d.where("query <> ''")


EVIDENCE, CURRENT, SOURCES = r"(evidence|study|studies|trial|review)", r"(latest|recent|current|today|new)", r"(source|citation|reference|cite)"


def f11_question_flags(spark, sf):
    low = F.lower("text")
    d = table(spark, sf, "conversations")
    return d.select("conv_id", "turn", low.rlike(r"^(what (is|are)|define|meaning of)").alias("definition"), low.rlike(EVIDENCE).alias("evidence"), low.rlike(CURRENT).alias("current"), low.rlike(SOURCES).alias("sources"), low.rlike(r"^(and|also|what about|why|how so)").alias("followup"))


TYPES = ((r"(document|book|chapter|page)", "document"), (r"(translate|language|french|german)", "language"), (r"(emergency|bleeding|urgent)", "emergency"), (r"(pain|ache|swelling|symptom)", "symptom"), (r"(treat|therapy|cure)", "treatment"), (r"(account|password|billing)", "admin"))


def f12_query_type(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.first_pattern(F.lower("text"), TYPES, F.lit("simple")).alias("kind"))


def g2_merge(spark, sf):
    """Candidates of two arms, one row a key with the larger of each score."""
    m = merged(_queries(spark, sf), _chunks(spark, sf))
    return m.select("query_id", "chunk_id", F.round("bm25", 5).alias("bm25"), F.round("vector", 6).alias("vector"))


def merged(queries, chunks, k=20):
    """query_id, chunk_id, bm25, vector: the candidates of both arms; a score that an arm doesn't give is 0."""
    lexical = top(bm25(queries, chunks), k).select("query_id", "chunk_id", F.col("score").alias("bm25"))
    both = lexical.unionByName(vector_arm(queries, chunks, k), allowMissingColumns=True)
    return both.groupBy("query_id", "chunk_id").agg(F.coalesce(F.max("bm25"), F.lit(0.0)).alias("bm25"), F.coalesce(F.max("vector"), F.lit(0.0)).alias("vector"))


def e2_encode(spark, sf):
    """Embeddings by the batch encoder, as sums that SQL can check."""
    d = encoded(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))
    return d.select(F.col("id").alias("doc_id"), F.size(F.filter("embedding", lambda x: x != 0)).alias("n_places"), F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x).cast("long").alias("squares"), F.aggregate(F.transform("embedding", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x).cast("long").alias("moment"))


def e5_index(spark, sf):
    """Index points of texts and of pages: payload with fallbacks, written by kind and read back."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("text").alias("kind"), F.coalesce("source", F.lit("unknown")).alias("document"), F.coalesce("lang", F.lit("xx")).alias("lang"), "text")
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.lit("visual").alias("kind"), F.coalesce(F.nullif(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1), F.lit("")), F.lit("unknown")).alias("document"), F.lit("xx").alias("lang"), F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("text"))
    points = docs.unionByName(pages)
    vectors = encoded(docs).withColumn("kind", F.lit("text")).unionByName(encoded(pages).withColumn("kind", F.lit("visual")))
    index = points.withColumn("n_chars", F.length(F.coalesce("text", F.lit("")))).drop("text").join(vectors, ["kind", "id"])
    path = folder(spark)
    index.write.partitionBy("kind").parquet(path)
    held = spark.read.parquet(path)
    return held.select("kind", "id", "document", "lang", "n_chars", F.size(F.filter("embedding", lambda x: x != 0)).alias("n_places"))


def page_text(pages):
    """page_id, text: what a page is searched by: title, host and path, those that it has."""
    fields = [F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1), F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1), F.translate(F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1), "/-_", "   ")]
    return pages.select("page_id", F.concat_ws(" ", *(F.nullif(F.trim(f), F.lit("")) for f in fields)).alias("text"))


#: The namespace of names that are addresses, of name-based UUIDs (version 5).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def name_uuid(name):
    """The version 5 UUID of a name that is an address."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.substr(F.lit("89ab"), F.lit(1) + (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def active_pages(pages):
    """The last page of each address (host and path); pages without address are all active."""
    address = F.regexp_extract("url", r"^[a-z]+://([^?#]+)", 1)
    keyed = pages.select("page_id", F.when(address != "", address).otherwise(F.col("page_id").cast("string")).alias("address"))
    return pages.join(keyed.groupBy("address").agg(F.max("page_id").alias("page_id")).select("page_id"), "page_id", "left_semi")


def e7_profile_search(spark, sf):
    """The five active pages nearest to each query, with a point id made from the page's name."""
    pages = page_text(active_pages(table(spark, sf, "pages")))
    found = vector_arm(_queries(spark, sf), pages.select(F.col("page_id").alias("chunk_id"), "text"), 5)
    return found.select("query_id", F.col("chunk_id").alias("page_id"), name_uuid(F.concat(F.lit("page:"), F.col("chunk_id").cast("string"))).alias("point_id"))


#: Terms of a query, letters of a term at least, and chunks a query of the candidate fetch.
TERMS, LETTERS, FETCHED = 10, 3, 4000


def trigrams(c):
    """Every three characters side by side of a text, distinct."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit("(?s)(?=(...))"), 1))


def substring_candidates(queries, chunks, k=FETCHED):
    """query_id, chunk_id, points, place: for each query the k best chunks (points, then chunk_id) that hold one of its first tokens anywhere in them.

    queries: query_id, text. chunks: chunk_id, points, body (lower case). A term's chunks are looked up by its rarest three characters and then
    verified. Only postings of characters that are some term's rarest are joined, and a term hands on k chunks at most, as no query can take more.
    """
    terms = F.slice(F.filter(tokens(F.col("text")), lambda t: F.length(t) >= LETTERS), 1, TERMS)
    asked = written(queries.select("query_id", F.explode(F.array_distinct(terms)).alias("term")), "asked")
    parts = written(asked.select("term").distinct().select("term", F.explode(trigrams(F.col("term"))).alias("gram")), "grams")
    held = written(chunks.select("chunk_id", "points", "body"), "bodies")
    postings = held.select("chunk_id", F.explode(trigrams(F.col("body"))).alias("gram")).join(parts.select("gram").distinct(), "gram", "left_semi")
    postings = written(postings, "postings")
    size = postings.groupBy("gram").agg(F.count("*").alias("n"))
    rare = parts.join(size, "gram", "left").groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))).alias("gram"))
    met = rare.join(postings, "gram").select("term", "chunk_id").join(held, "chunk_id").where(F.contains("body", F.col("term"))).select("term", "chunk_id", "points")
    best = Window.partitionBy("term").orderBy(F.desc("points"), "chunk_id")
    met = met.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
    hits = asked.join(met, "term").select("query_id", "chunk_id", "points").distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("points"), "chunk_id"))
    return hits.withColumn("place", place).where(F.col("place") <= k)


def f4_candidates(spark, sf):
    """The candidate fetch over usable chunks: text, title, source, language, type, specialty and topic are searched."""
    # Written before it is filtered and searched: a filter would score each text again, a ladder would cut it into lines again for every needle.
    d = scored(table(spark, sf, "documents")).select("doc_id", "points", "is_noisy", "text", "source", "lang", F.coalesce(F.get(T.lines(F.col("text")), F.lit(0)), F.lit("")).alias("title"), F.lower("text").alias("low"))
    d = written(d, "scored").where("NOT is_noisy AND points >= 55")
    d = d.withColumns({"topic": T.first_match(F.col("low"), TOPICS, F.lit("other")), "specialty": T.first_match(F.col("low"), SPECIALTIES, F.lit("general_dentistry")), "kind": T.first_match(F.lower("title"), KINDS, F.lit("other"))})
    body = F.lower(F.concat_ws("\x01", "text", "title", "source", "lang", "kind", "specialty", "topic"))
    return substring_candidates(_queries(spark, sf), d.select(F.col("doc_id").alias("chunk_id"), "points", body.alias("body")))


def g8_neighbours(spark, sf):
    """The neighbours of the three best chunks of a query, in their source; selected ones first."""
    best = top(bm25(_queries(spark, sf), _chunks(spark, sf)), 3)
    place = numbered(_chunks(spark, sf).select("chunk_id", "source"), "source", "chunk_id", "pos")
    own = best.select("query_id", "chunk_id", "rank").join(place, "chunk_id")
    near = own.select("query_id", "source", F.explode(F.array(F.col("pos") - 1, F.col("pos"), F.col("pos") + 1)).alias("pos"), (F.col("rank") + 0).alias("rank"))
    return near.join(place, ["source", "pos"]).groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))


def g14_sufficiency(spark, sf):
    s = bm25(_queries(spark, sf), _chunks(spark, sf)).groupBy("query_id").agg(F.count_if(F.col("score") >= 8).alias("good"), F.count("*").alias("n"))
    return s.select("query_id", ((F.col("good") >= 2) | (F.col("n") >= 3)).alias("enough"))


def g17_memory(spark, sf):
    """Of the last six turns before the end, the last four that share a keyword with the last user turn, oldest first."""
    c = table(spark, sf, "conversations").where("role <> 'system'").withColumn("ks", keywords(F.col("text")))
    last = c.where("role = 'user'").groupBy("conv_id").agg(F.max_by(F.struct("turn", "ks"), "turn").alias("u")).select("conv_id", F.col("u.turn").alias("asked"), F.col("u.ks").alias("want"))
    d = c.join(last, "conv_id").where("turn < asked").withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("r <= 6")
    d = d.where(F.arrays_overlap("ks", "want")).withColumn("r2", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("r2 <= 4")
    return d.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.substring("text", 1, 320).alias("t")))), lambda x: x["t"]), "\n").alias("memory"))


def g18_citations(spark, sf):
    """Five distinct sources a query, in the order of rank."""
    best = top(bm25(_queries(spark, sf), _chunks(spark, sf)), 20).join(_chunks(spark, sf).select("chunk_id", "source"), "chunk_id")
    first = best.groupBy("query_id", "source").agg(F.min("rank").alias("rank"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("place <= 5").drop("rank")


def g22_cache_key(spark, sf):
    key = F.sha2(F.concat_ws("|", F.lit("1"), F.lower(T.squeezed(F.col("text")))), 256)
    return table(spark, sf, "conversations").where("role = 'user'").groupBy(key.alias("cache_key")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (e2_encode, e5_index, e7_profile_search, f4_candidates, e1_hashing_embedding, e3_cosine_top, e4_filtered, e6_upsert, f1_stems, f2_tokens, f3_bm25, f5_keyword_search, f6_keywords, f7_lexical_score, f8_rewrite, f9_variants, f11_question_flags, f12_query_type, g2_merge, g8_neighbours, g14_sufficiency, g17_memory, g18_citations, g22_cache_key)}

_STOP = "(" + ", ".join(map(q, STOPWORDS)) + ")"


def _stem(t: str) -> str:
    x = f"regexp_replace(lower({t}), '^-+|-+$', '', 'g')"
    return "CASE " + " ".join(f"WHEN length({x}) > {least} AND ends_with({x}, '{s}') THEN left({x}, length({x}) - {cut}) || '{add}'" for s, least, cut, add in SUFFIXES) + f" ELSE {x} END"


def _tokens(c: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(lower(coalesce({c}, '')), '{TOKEN}'), lambda t: {_stem('t')}), lambda t: t <> '' AND t NOT IN {_STOP})"


def _keywords(c: str) -> str:
    return f"list_distinct(list_transform(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-zA-Z][a-zA-Z-]{{2,}}'), lambda t: t NOT IN {_STOP}), lambda t: {_stem('t')}))"


_BM25 = f"""ct AS (SELECT doc_id AS chunk_id, source, {_tokens('text')} AS ts FROM documents), term AS (SELECT chunk_id, unnest(ts) AS term FROM ct), tf AS (SELECT term, chunk_id, count(*) AS tf FROM term GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), st AS (SELECT count(*) AS n, greatest(avg(len(ts)), 1.0) AS av FROM ct), qt AS (SELECT item_id AS query_id, unnest({_tokens('text')}) AS term FROM benchmark),
qn AS (SELECT query_id, term, count(*) AS qn FROM qt GROUP BY ALL),
bm AS (SELECT query_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * {K1 + 1}) / (tf + {K1} * (1 - {B} + {B} * greatest(len(ts), 1) / av)) * qn) AS score FROM qn JOIN df USING (term) JOIN tf USING (term) JOIN ct USING (chunk_id), st GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM bm)"""
_EDGE = r"^[.,;:!?()\[\]\"'']+|[.,;:!?()\[\]\"'']+$"



def _places(name: str, key: str, source: str, text: str) -> str:
    """CTEs that end in `name` (id, place, n): the hashed embedding of source's texts."""
    return f"""{name}_t AS (SELECT {key} AS id, unnest(list_filter(list_transform({S.words(f'lower({text})')}, lambda w: regexp_replace(w, '{_EDGE}', '', 'g')), lambda w: w <> '')) AS t FROM {source}), {name}_h AS (SELECT id, t, count(*) AS n, sha256(t) AS h FROM {name}_t GROUP BY ALL),
{name} AS (SELECT id, ('0x' || substr(h, 1, 8))::BIGINT % 384 AS place, sum(CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 0 THEN n ELSE -n END) AS n FROM {name}_h GROUP BY ALL HAVING sum(CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 0 THEN n ELSE -n END) <> 0)"""


def _nearest(asked: str, held: str, k: int) -> str:
    """CTEs that end in vr (query_id, chunk_id, vector): the k nearest of held to each of asked."""
    return f"""na AS (SELECT id, sqrt(sum(n * n)::DOUBLE) AS len FROM {asked} GROUP BY id), nh AS (SELECT id, sqrt(sum(n * n)::DOUBLE) AS len FROM {held} GROUP BY id), dots AS (SELECT a.id AS qi, b.id AS ci, sum(a.n * b.n)::DOUBLE AS dot FROM {asked} a JOIN {held} b USING (place) GROUP BY ALL),
vs AS (SELECT na.id AS query_id, nh.id AS chunk_id, round(coalesce(dot, 0) / (na.len * nh.len), 9) AS vector FROM na CROSS JOIN nh LEFT JOIN dots ON qi = na.id AND ci = nh.id), vr AS (SELECT * FROM vs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY vector DESC, chunk_id) <= {k})"""


_MERGED = f"""{_BM25}, {_places('pd', 'doc_id', 'documents', 'text')}, {_places('pq', 'item_id', 'benchmark', 'text')}, {_nearest('pq', 'pd', 20)},
mg AS (SELECT query_id, chunk_id, coalesce(max(bm25), 0)::DOUBLE AS bm25, coalesce(max(vector), 0)::DOUBLE AS vector FROM (SELECT query_id, chunk_id, score AS bm25, NULL AS vector FROM rk WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, NULL, vector FROM vr) GROUP BY ALL)"""

ORACLES = {
    "e1_hashing_embedding": f"""WITH t AS (SELECT doc_id, unnest(list_filter(list_transform({S.words('lower(text)')}, lambda w: regexp_replace(w, '{_EDGE}', '', 'g')), lambda w: w <> '')) AS t FROM documents), h AS (SELECT doc_id, t, count(*) AS n, sha256(t) AS h FROM t GROUP BY ALL),
p AS (SELECT doc_id, ('0x' || substr(h, 1, 8))::BIGINT % 384 AS place, CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 0 THEN n ELSE -n END AS n FROM h) SELECT doc_id, place, sum(n) AS n FROM p GROUP BY ALL HAVING sum(n) <> 0""",
    "e3_cosine_top": """WITH v AS (SELECT vec_id, embedding::DOUBLE[64] AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id, array_cosine_similarity(a.e, b.e) AS score FROM v a, v b WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, rank FROM r WHERE rank <= 10""",
    "e4_filtered": "SELECT doc_id, source FROM documents WHERE lang IN ('en', 'fr') AND n_chars >= 500 AND source IS NOT NULL",
    "e6_upsert": "WITH u AS (SELECT vec_id, label, 0 AS version FROM embeddings UNION ALL SELECT vec_id * 2, label + 100, 1 FROM embeddings WHERE vec_id % 3 = 0) SELECT vec_id, label FROM u QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY version DESC, label DESC) = 1",
    "f1_stems": f"WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS token FROM documents) SELECT token, {_stem('token')} AS stem FROM t",
    "f2_tokens": f"SELECT conv_id, turn, array_to_string({_tokens('text')}, ' ') AS tokens FROM conversations",
    "f3_bm25": f"WITH {_BM25} SELECT query_id, count(*) AS n_hits, round(sum(score), 3) AS total FROM bm GROUP BY query_id",
    "f5_keyword_search": f"WITH {_BM25} SELECT query_id, chunk_id, rank FROM rk WHERE rank <= 20",
    "f6_keywords": f"SELECT conv_id, turn, array_to_string(list_sort({_keywords('text')}), ' ') AS keywords FROM conversations",
    "f7_lexical_score": "SELECT doc_id, " + " + ".join(f"CASE WHEN contains(lower(text), '{x}') THEN 1 + 0.25 * least((length(text) - length(replace(lower(text), '{x}', ''))) / {len(x)}, 5) ELSE 0 END" for x in ("tion", "thing", "eau")) + " + CASE WHEN contains(lower(text), 'eau thing tion') THEN 3 ELSE 0 END AS score FROM documents",
    "f8_rewrite": f"SELECT conv_id, turn, substr(concat_ws(' ', {S.squeezed('text')}, array_to_string(list_sort({_keywords('text')}), ' ')), 1, 900) AS rewritten FROM conversations WHERE role = 'user'",
    "f9_variants": f"""WITH a AS (SELECT conv_id, turn, {S.squeezed('text')} AS a, array_to_string(list_sort({_keywords('text')}), ' ') AS b FROM conversations WHERE role = 'user')
SELECT * FROM (SELECT conv_id, turn, 0 AS variant, a AS query FROM a UNION ALL SELECT conv_id, turn, 1, b FROM a WHERE lower(a) <> lower(b)) WHERE query <> ''""",
    "f11_question_flags": "SELECT conv_id, turn, regexp_matches(lower(text), '^(what (is|are)|define|meaning of)') AS definition, regexp_matches(lower(text), " + q(EVIDENCE) + ") AS evidence, regexp_matches(lower(text), " + q(CURRENT) + ") AS current, regexp_matches(lower(text), " + q(SOURCES) + ") AS sources, regexp_matches(lower(text), '^(and|also|what about|why|how so)') AS followup FROM conversations",
    "f12_query_type": f"SELECT conv_id, turn, {S.first_pattern('lower(text)', TYPES, q('simple'))} AS kind FROM conversations",
    "g2_merge": f"WITH {_MERGED} SELECT query_id, chunk_id, round(bm25, 5) AS bm25, round(vector, 6) AS vector FROM mg",
    "e2_encode": f"WITH {_places('pd', 'doc_id', 'documents', 'text')} SELECT d.doc_id, count(place) AS n_places, coalesce(sum(n * n), 0)::BIGINT AS squares, coalesce(sum(n * place), 0)::BIGINT AS moment FROM documents d LEFT JOIN pd ON pd.id = d.doc_id GROUP BY d.doc_id",
    "e5_index": f"""WITH {_places('pd', 'doc_id', 'documents', 'text')}, pt AS (SELECT page_id, url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS t FROM pages), {_places('pp', 'page_id', 'pt', 't')},
nd AS (SELECT id, count(*) AS n FROM pd GROUP BY id), np AS (SELECT id, count(*) AS n FROM pp GROUP BY id) SELECT 'text' AS kind, doc_id AS id, coalesce(source, 'unknown') AS document, coalesce(lang, 'xx') AS lang, length(coalesce(text, '')) AS n_chars, coalesce(n, 0) AS n_places FROM documents LEFT JOIN nd ON id = doc_id
UNION ALL SELECT 'visual', page_id, coalesce(nullif(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), ''), 'unknown'), 'xx', length(t), coalesce(n, 0) FROM pt LEFT JOIN np ON id = page_id""",
    "e7_profile_search": f"""WITH ac AS (SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(regexp_extract(url, '^[a-z]+://([^?#]+)', 1), ''), page_id::VARCHAR) ORDER BY page_id DESC) = 1),
pt AS (SELECT page_id, concat_ws(' ', nullif(trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), ''), nullif(trim(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), ''), nullif(trim(translate(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '/-_', '   ')), '')) AS t FROM ac),
{_places('pp', 'page_id', 'pt', 't')}, {_places('pq', 'item_id', 'benchmark', 'text')}, {_nearest('pq', 'pp', 5)}, h AS (SELECT query_id, chunk_id, sha1(unhex('{URL_NAMESPACE}') || encode('page:' || chunk_id)) AS h FROM vr)
SELECT query_id, chunk_id AS page_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || '89ab'[('0x' || h[17])::INT % 4 + 1] || h[18:20] || '-' || h[21:32] AS point_id FROM h""",
    "f4_candidates": f"""WITH {SCORED_SQL}, bo0 AS (SELECT doc_id AS chunk_id, points, q.text, d.source, d.lang, coalesce({S.lines('q.text')}[1], '') AS title FROM quality q JOIN (SELECT doc_id, source, lang FROM documents) d USING (doc_id) WHERE NOT is_noisy AND points >= 55),
bo AS (SELECT chunk_id, points, lower(concat_ws(chr(1), text, title, source, lang, {S.first_match('lower(title)', KINDS, q('other'))}, {S.first_match('lower(text)', SPECIALTIES, q('general_dentistry'))}, {S.first_match('lower(text)', TOPICS, q('other'))})) AS body FROM bo0),
qt AS (SELECT DISTINCT item_id AS query_id, unnest((list_filter({_tokens('text')}, lambda t: length(t) >= {LETTERS}))[:{TERMS}]) AS term FROM benchmark), hi AS (SELECT DISTINCT query_id, chunk_id, points FROM qt JOIN bo ON contains(body, term))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, chunk_id) AS place FROM hi QUALIFY place <= {FETCHED}""",
    "g8_neighbours": f"WITH {_BM25}, p AS (SELECT chunk_id, source, row_number() OVER (PARTITION BY source ORDER BY chunk_id) AS pos FROM ct), o AS (SELECT query_id, rank, source, pos + d AS pos FROM rk JOIN p USING (chunk_id), (VALUES (-1), (0), (1)) t(d) WHERE rank <= 3) SELECT query_id, chunk_id, min(rank) AS rank FROM o JOIN p USING (source, pos) GROUP BY ALL",
    "g14_sufficiency": f"WITH {_BM25} SELECT query_id, count(*) FILTER (score >= 8) >= 2 OR count(*) >= 3 AS enough FROM bm GROUP BY query_id",
    "g17_memory": f"""WITH c AS (SELECT *, {_keywords('text')} AS ks FROM conversations WHERE role <> 'system'), l AS (SELECT conv_id, max(turn) AS asked, arg_max(ks, turn) AS want FROM c WHERE role = 'user' GROUP BY conv_id),
d AS (SELECT c.*, want FROM c JOIN l USING (conv_id) WHERE turn < asked QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6), e AS (SELECT * FROM d WHERE list_has_any(ks, want) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4)
SELECT conv_id, string_agg(substr(text, 1, 320), chr(10) ORDER BY turn) AS memory FROM e GROUP BY conv_id""",
    "g18_citations": f"WITH {_BM25}, f AS (SELECT query_id, source, min(rank) AS rank FROM rk JOIN ct USING (chunk_id) WHERE rank <= 20 GROUP BY ALL) SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM f QUALIFY place <= 5",
    "g22_cache_key": f"SELECT sha256('1|' || lower({S.squeezed('text')})) AS cache_key, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1",
}
