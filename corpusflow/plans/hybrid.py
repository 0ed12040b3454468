"""Retrieval as one plan: candidates of two arms, usability, relevance, rerank, gate, compression, context, answers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusflow import sqltext as S
from corpusflow.functions import text as T
from corpusflow.operators import audit, cleaning, tagging
from corpusflow.operators import retrieval as R
from corpusflow.operators.quality import SCORED_SQL, scored
from corpusflow.shared import written
from corpusflow.tables import quoted as q
from corpusflow.tables import table

# Weights of relevance and rerank, and the boosts of a reader's role by a document's kind.
LEXICAL, BM25, APPROVED, NOISY = 0.2, 0.35, 0.2, -1.0
TRUST = {"high": 0.25, "medium": 0.1, "low": -0.25}
BOOSTS = {"dentist": {"guideline": 0.15, "research_article": 0.15, "patient_education": -0.1}, "dental_student": {"textbook": 0.15, "guideline": 0.1, "patient_education": -0.05}, "patient": {"patient_education": 0.15, "guideline": 0.05, "research_article": -0.15}}
GATE, FALLBACK, AGAIN, CROSS = 1.1, 0.7, 1.35, 1.25
DEFINITION = r"^(what is|what are|define|meaning of) +(?:the |an? )?([^?.!]+)"
#: A word, as T.words has it.
NOT_SPACE_RUN = f"[^{re.escape(T.SPACES)}]+"
SEPARATOR, BUDGET = "\n\n---\n\n", 1000


def lexical_score(text, terms):
    """1 and a quarter per occurrence (five at most) for each term that occurs; 3 more for the phrase of sorted terms."""
    each = F.aggregate(F.filter(terms, lambda t: F.contains(text, t)), F.lit(0.0), lambda a, t: a + 1 + 0.25 * F.least((F.length(text) - F.length(F.replace(text, t, F.lit("")))) / F.length(t), F.lit(5.0)))
    phrase = F.array_join(F.array_sort(terms), " ")
    return each + F.when((F.length(phrase) > 4) & F.contains(text, phrase), 3.0).otherwise(0.0)


def neighbours(words, text):
    """How many pairs of words side by side occur in a text as they are."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.size(F.filter(F.slice(pairs, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), lambda p: F.contains(text, p)))


def detailed(spark, sf, found, queries=None):
    """found (query_id, chunk_id, bm25, vector) with what ranking needs of chunk and query; only chunks that were found are scored."""
    queries = R._queries(spark, sf) if queries is None else queries
    wanted = table(spark, sf, "documents").join(found.select(F.col("chunk_id").alias("doc_id")), "doc_id", "left_semi")
    chunk = scored(spread(wanted)).select(F.col("doc_id").alias("chunk_id"), "source", F.col("text").alias("chunk"), F.lower("text").alias("low"), "points", "is_noisy")
    chunk = written(chunk.withColumn("kind", T.first_match(F.col("low"), audit.TYPES, F.lit("other"))).withColumn("noisy_block", cleaning.noisy_block(F.col("chunk"))), "chunks")
    label = table(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id"), "quality")
    low = F.lower("text")
    asked = queries.select("query_id", R.keywords(F.col("text")).alias("terms"), F.regexp_extract_all(low, F.lit("([a-zA-Z][a-zA-Z-]{2,})"), 1).alias("said"), F.trim(F.regexp_extract(low, DEFINITION, 2)).alias("subject"))
    rows = spread(found.join(chunk, "chunk_id").join(label, "chunk_id", "left").join(asked, "query_id"))
    trust = F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").otherwise("medium")
    return rows.withColumns({"approved": F.coalesce(F.col("quality") == 1, F.lit(False)), "trust": trust}).drop("quality")


def candidates(spark, sf, k=20):
    """The k best chunks of each arm, merged, with what ranking needs."""
    return detailed(spark, sf, written(R.merged(R._queries(spark, sf), R._chunks(spark, sf), k), "merged"))


def spread(rows):
    """Rows dealt evenly over the cluster's cores: scoring a row costs far more than its bytes suggest, by which small tables are put in one task."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def ranking(spark, sf, role="patient"):
    """The candidates' ranks as a table, so that no filter above computes them anew."""
    return written(ranked(candidates(spark, sf), role), "ranked")


def ladder(column, values):
    out = F.lit(0.0)
    for name, value in values.items():
        out = F.when(column == name, value).otherwise(out)
    return out


def ranked(rows, role="patient"):
    """matches, lexical, relevance and rerank of candidates, and their new place."""
    rows = rows.withColumns({"matches": F.size(F.filter("terms", lambda t: F.contains(F.col("low"), t))), "lexical": lexical_score(F.col("low"), F.col("terms")), "said": F.filter("said", lambda w: F.array_contains("terms", w))})
    quality, n = F.col("points") / 100 - 0.6, F.size("terms")
    relevance = 2.0 * F.col("matches") / F.greatest(n, F.lit(1)) + 0.25 * F.least("lexical", F.lit(6.0)) + F.least(F.lit(1.0), 0.35 * neighbours(F.col("said"), F.col("low"))) + 0.8 * F.greatest(F.lit(0.0), F.col("vector") - 0.35) + 0.3 * F.greatest(F.lit(0.0), quality)
    rows = rows.withColumn("relevance", F.when(n == 0, 0.0).otherwise(F.round(relevance, 3)))
    score = F.col("vector") + BM25 * F.col("bm25") + LEXICAL * F.col("lexical") + F.col("relevance") + ladder(F.col("trust"), TRUST) + F.when(F.col("approved"), APPROVED).otherwise(-APPROVED) + 0.5 * quality + F.when(F.col("is_noisy"), NOISY).otherwise(0.0) + ladder(F.col("kind"), BOOSTS.get(role, {}))
    rows = rows.withColumn("rerank", F.round(score, 5))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank"), "chunk_id")))


def relevant(rows, least=GATE):
    """Enough relevance and enough of the terms; a definition's subject of several words must be there whole; no noisy block."""
    return rows.where(gate(least))


def gate(least=GATE):
    n, m = F.size("terms"), F.col("matches")
    whole = (F.col("subject") == "") | (F.instr("subject", " ") == 0) | F.contains("low", F.col("subject"))
    core = F.when(n == 0, True).otherwise(whole & F.when(n <= 2, m > 0).otherwise(m >= 0.4 * n))
    enough = (m >= F.when(n >= 3, 2).otherwise(1)) | (2 * m >= n)
    return F.when(n == 0, F.col("rerank") >= least).otherwise(core & enough & (F.col("relevance") >= least) & ~F.col("noisy_block"))


def usable(rows):
    return rows.where("NOT is_noisy AND points >= 60")


def sentence_ranks(rows):
    """query_id, place, pos, sentence, score, best: sentences of chunks, 3 for each term and 1 for each pair of sorted terms side by side; ties go to the shorter, then the earlier."""
    s = rows.select("query_id", "place", F.array_sort("terms").alias("terms"), F.posexplode(cleaning.sentences(F.col("chunk"))).alias("pos", "sentence"))
    low = F.lower("sentence")
    s = s.withColumn("score", 3 * F.size(F.filter("terms", lambda t: F.contains(low, t))) + neighbours(F.col("terms"), low)).where("score > 0").drop("terms")
    return s.withColumn("best", F.row_number().over(Window.partitionBy("query_id", "place").orderBy(F.desc("score"), F.length("sentence"), "pos")))


def compressed(rows, k=5, size=BUDGET):
    """query_id, place, context: the k best sentences of a chunk, best first, cut at a blank before `size` characters."""
    s = sentence_ranks(rows).where(F.col("best") <= k)
    s = s.groupBy("query_id", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("best", "sentence"))), lambda x: x["sentence"]), " ").alias("t"))
    head = F.substring("t", 1, size)
    cut = F.when(F.length("t") <= size, F.col("t")).otherwise(F.concat(F.regexp_extract(head, r"(?s)^(.*?)(?: [^ ]*)?$", 1), F.lit(".")))
    return s.select("query_id", "place", cut.alias("context"))


def assembled(rows, k=5):
    """query_id, n_blocks, context: the k best chunks, without those of under 20 characters and those that hold or are held by an earlier one, compressed, with labels; stops beyond BUDGET characters a chunk.

    A fold over a query's k chunks.
    """
    r = rows.where(F.col("place") <= k)
    r = r.join(compressed(r), ["query_id", "place"], "left")
    body = F.when(F.length("context") >= 20, F.col("context")).otherwise(F.substring("chunk", 1, BUDGET))
    r = r.select("query_id", F.struct("place", F.trim("low").alias("low"), tagging.redacted(body).alias("body"), "source", F.round("rerank", 2).alias("score")).alias("c"))
    state = "struct<seen:array<string>,parts:array<string>,total:int>"

    def step(now, c):
        twin = F.exists(now["seen"], lambda x: F.contains(x, c["low"]) | F.contains(c["low"], x))
        take = (F.length(c["low"]) >= 20) & ~twin & (now["total"] <= F.size("cs") * BUDGET)
        label = F.concat(F.lit("[Source "), c["place"].cast("string"), F.lit(": "), F.coalesce(c["source"], F.lit("Unknown")), F.lit("]\n"), c["body"])
        more = F.struct(F.concat(now["seen"], F.array(c["low"])).alias("seen"), F.concat(now["parts"], F.array(label)).alias("parts"), (now["total"] + F.length(c["body"])).alias("total")).cast(state)
        return F.when(take, more).otherwise(now)

    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("parts"), F.lit(0).alias("total")).cast(state)
    g = r.groupBy("query_id").agg(F.array_sort(F.collect_list("c")).alias("cs")).withColumn("s", F.aggregate("cs", start, step))
    return g.select("query_id", F.size("s.parts").alias("n_blocks"), F.array_join("s.parts", SEPARATOR).alias("context"))


def g1_hybrid(spark, sf):
    """The whole plan: the five best relevant, usable chunks of each query; where none is relevant, the best of all usable ones."""
    return _gated_best(usable(ranking(spark, sf)), GATE).select("query_id", "chunk_id", "place")


def _gated_best(rows, least, k=5):
    """The k best rows of each query that pass the gate, or, where none does (gated: 0), of all."""
    rows = rows.select("query_id", "chunk_id", "rerank", F.coalesce(gate(least), F.lit(False)).cast("int").alias("good"))
    rows = rows.withColumn("gated", F.max("good").over(Window.partitionBy("query_id"))).where("good = gated")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank"), "chunk_id"))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def g3_usable(spark, sf):
    return candidates(spark, sf).groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(~F.col("is_noisy") & (F.col("points") >= 60)).alias("usable"))


def g4_relevance(spark, sf):
    return ranking(spark, sf).select("query_id", "chunk_id", "matches", "relevance")


def g5_rerank(spark, sf):
    return ranking(spark, sf, "dentist").select("query_id", "chunk_id", "place")


def overlap_model(queries: list[str], texts: list[str]) -> np.ndarray:
    """A model for `pair_scores`: the share of a query's distinct words that its text has."""
    out = np.zeros(len(queries))
    for i, (query, text) in enumerate(zip(queries, texts, strict=True)):
        asked = set(re.findall(NOT_SPACE_RUN, query.lower()))
        out[i] = len(asked & set(re.findall(NOT_SPACE_RUN, text.lower()))) / len(asked) if asked else 0.0
    return out


def pair_scores(pairs, model=overlap_model, batch=64):
    """query_id, chunk_id, raw of pairs (query_id, chunk_id, query, text), by a model from two lists of texts to an array of scores; raises where its shape isn't (pairs,) or a score isn't finite."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                got = np.asarray(model(part["query"].fillna("").tolist(), part["text"].fillna("").tolist()), np.float64)
                if got.shape != (len(part),) or not np.isfinite(got).all():
                    raise ValueError(f"the model returned {got.shape}, expected {(len(part),)} finite scores")
                yield pd.DataFrame({"query_id": part["query_id"], "chunk_id": part["chunk_id"], "raw": got})

    return pairs.select("query_id", "chunk_id", "query", "text").mapInPandas(run, "query_id long, chunk_id long, raw double")


def g6_scaled(spark, sf):
    """A pair model's scores of the forty first candidates, scaled to 0 to CROSS within a query; equal scores all count as 0."""
    r = ranking(spark, sf).where("place <= 40").join(R._queries(spark, sf).withColumnRenamed("text", "query"), "query_id")
    raw = pair_scores(r.select("query_id", "chunk_id", "query", F.col("chunk").alias("text")))
    w = Window.partitionBy("query_id")
    low, high = F.min("raw").over(w), F.max("raw").over(w)
    return raw.select("query_id", "chunk_id", F.round(CROSS * (F.col("raw") - low) / F.greatest(high - low, F.lit(1e-6)), 5).alias("scaled"))


def g7_gate(spark, sf):
    return relevant(ranking(spark, sf)).select("query_id", "chunk_id")


def g9_compression(spark, sf):
    """The best sentences of each query's best chunk."""
    return compressed(ranking(spark, sf).where("place = 1")).select("query_id", F.md5("context").alias("context"), F.length("context").alias("n"))


def variants(queries):
    """query_id (twice the parent's, plus the variant), parent, text: the query and its sorted keywords."""
    two = F.array(F.col("text"), F.array_join(F.array_sort(R.keywords(F.col("text"))), " "))
    v = queries.select(F.col("query_id").alias("parent"), F.posexplode(two).alias("v", "text"))
    return v.select((2 * F.col("parent") + F.col("v")).alias("query_id"), "parent", "text")


def g10_multi_query(spark, sf):
    """Candidates over a query's variants, merged, ranked for the query itself and gated."""
    v = written(variants(R._queries(spark, sf)), "variants")
    found = R.top(R.bm25(v, R._chunks(spark, sf)), 20).join(v.select("query_id", "parent"), "query_id")
    found = found.groupBy(F.col("parent").alias("query_id"), "chunk_id").agg(F.max("score").alias("bm25")).withColumn("vector", F.lit(0.0))
    return relevant(written(ranked(detailed(spark, sf, written(found, "found"))), "ranked")).select("query_id", "chunk_id")


def g11_second_pass(spark, sf):
    """Confidence of a query's three best chunks; one below the least is asked again, for twice as many candidates, and adds those that are new."""
    r = ranking(spark, sf)
    c = r.where("place <= 3").groupBy("query_id").agg(F.avg("relevance").alias("c"))
    c = written(c.select("query_id", F.round("c", 4).alias("confidence"), (F.col("c") < AGAIN).alias("again")), "confidence")
    low = R._queries(spark, sf).join(c.where("again").select("query_id"), "query_id", "left_semi")
    more = R.top(R.bm25(low, R._chunks(spark, sf)), 40).select("query_id", "chunk_id").join(r.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return c.join(more.groupBy("query_id").agg(F.count("*").alias("added")), "query_id", "left").select("query_id", "confidence", "again", F.coalesce("added", F.lit(0)).alias("added"))


def g12_lexical_fallback(spark, sf):
    """The lexical arm alone: what passes the gate at 70 %, else the five best as they are."""
    best = written(R.top(R.bm25(R._queries(spark, sf), R._chunks(spark, sf)), 20).select("query_id", "chunk_id", F.col("score").alias("bm25"), F.lit(0.0).alias("vector")), "best")
    rows = written(ranked(detailed(spark, sf, best)), "ranked")
    return _gated_best(rows, FALLBACK * GATE).select("query_id", "chunk_id", "place", "gated")


def g13_prune(spark, sf):
    """Ordered anew by rerank, vector and lexical score; kept with half of the gate's least score or a vector score of 0.3."""
    r = ranking(spark, sf).where((F.col("rerank") >= GATE / 2) | (F.col("vector") >= 0.3))
    score = F.round(0.4 * F.col("rerank") + 0.35 * F.col("vector") + 0.25 * F.col("bm25"), 7)
    return r.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_id"))).where("place <= 10").select("query_id", "chunk_id", "place")


def g15_retry(spark, sf):
    """Twice as many candidates: those whose (source, chunk) the first ones lack."""
    first = candidates(spark, sf).select("query_id", "source", "chunk_id")
    more = R.top(R.bm25(R._queries(spark, sf), R._chunks(spark, sf)), 40).select("query_id", "chunk_id").join(R._chunks(spark, sf).select("chunk_id", "source"), "chunk_id")
    return more.join(first, ["query_id", "source", "chunk_id"], "left_anti").groupBy("query_id").agg(F.count("*").alias("added"), F.min("chunk_id").alias("first"))


def g16_context(spark, sf):
    c = assembled(usable(ranking(spark, sf)))
    return c.select("query_id", "n_blocks", F.length("context").alias("n"), F.md5("context").alias("context"))


def g19_extractive_answer(spark, sf):
    """The four best sentences of a query's three best chunks, up to 1200 characters; of a definition's, those with a sign of one."""
    rows = ranking(spark, sf).where("place <= 3")
    s = sentence_ranks(rows).join(rows.select("query_id", "place", "subject"), ["query_id", "place"])
    s = s.where((F.col("subject") == "") | F.lower("sentence").rlike(r"\b(is|are|means|refers to|defined as|called)\b"))
    s = s.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.length("sentence"), "place", "pos"))).where("r <= 4")
    t = F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "sentence"))), lambda x: x["sentence"]), " "), 1, 1200)
    return s.groupBy("query_id").agg(F.md5(t).alias("answer"))


EVIDENCE = (("guideline", "guideline"), ("consensus", "guideline"), ("systematic review", "review"), ("trial", "trial"), ("study", "study"), ("textbook", "textbook"), ("tion", "process"), ("eau", "water"))


def g21_evidence(spark, sf):
    """A label by the first two chunks' text. The last needles fit the synthetic texts."""
    r = ranking(spark, sf).where("place <= 2")
    text = r.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "low"))), lambda x: x["low"]), " ").alias("t"))
    return text.select("query_id", T.first_match(F.col("t"), EVIDENCE, F.lit("other")).alias("evidence"))


#: Words of a passage's start by which documents that hold it are looked up.
KEY_WORDS = 5


def holders(spark, sf):
    """query_id, chunk_id: the documents that hold a passage of `benchmark` whole, in words, whatever the case and white space.

    Passages and documents meet by an equi-join on a passage's first words, and are then compared whole.
    """
    spaced = lambda ws: F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" "))
    items = R._queries(spark, sf).select("query_id", T.words(F.lower("text")).alias("ws")).where(F.size("ws") > 0)
    items = written(items.select("query_id", spaced(F.col("ws")).alias("passage"), run_keys(F.slice("ws", 1, KEY_WORDS), F.least(F.size("ws"), F.lit(KEY_WORDS)))[0].alias("key"), F.least(F.size("ws"), F.lit(KEY_WORDS)).alias("n")), "passages")
    sizes = sorted(r["n"] for r in items.select("n").distinct().collect())  # KEY_WORDS numbers at most
    if not sizes:
        return items.select("query_id", F.col("query_id").alias("chunk_id"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), T.words(F.lower("text")).alias("ws"))
    keys = F.array_distinct(F.flatten(F.array(*(run_keys(F.col("ws"), F.lit(n)) for n in sizes))))
    found = docs.select("chunk_id", F.explode(keys).alias("key")).join(items.select("key", "query_id", "passage"), "key").select("query_id", "chunk_id", "passage")
    found = written(found.distinct(), "found")
    held = docs.join(found.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", spaced(F.col("ws")).alias("t"))
    return found.join(held, "chunk_id").where(F.contains("t", F.col("passage"))).select("query_id", "chunk_id")


def run_keys(ws, n):
    """Hashes of an array's runs of n words (KEY_WORDS at most), in order; shorter arrays have none. Within a row: words aren't dealt and sorted."""
    starts = F.slice(ws, F.lit(1), F.greatest(F.size(ws) - n + 1, F.lit(0)))
    return F.flatten(F.transform(F.array(ws), lambda a: F.transform(starts, lambda w, i: F.xxhash64(n, w, *(F.when(n > j, F.get(a, i + j)) for j in range(1, KEY_WORDS))))))


def retrieval_cases(spark, sf, rows):
    """A case a query that has candidates: whether a document that holds its passage is among the five first, their share, the share of its terms there, the best hit's relevance, and whether it passes.

    A query whose passage no document holds is a negative case: it passes if its best hit isn't the passage's, by its terms.
    """
    held = written(holders(spark, sf), "holders")
    five = rows.where("place <= 5").join(held.withColumn("expected", F.lit(1)), ["query_id", "chunk_id"], "left").withColumn("e", F.coalesce("expected", F.lit(0)))
    found = F.size(F.array_distinct(F.flatten(F.collect_list(F.filter("terms", lambda t: F.contains(F.col("low"), t))))))
    g = five.groupBy("query_id").agg((F.max("e") == 1).alias("hit"), F.avg("e").alias("accuracy"), (found / F.greatest(F.max(F.size("terms")), F.lit(1))).alias("recall"))
    g = g.join(held.select("query_id").distinct().withColumn("known", F.lit(True)), "query_id", "left").withColumn("negative", F.col("known").isNull())
    passed = F.when(F.col("negative"), F.col("recall") < 1.0).otherwise(F.col("hit") & (F.col("recall") >= 0.6))
    return g.select("query_id", "negative", "hit", F.round("accuracy", 4).alias("accuracy"), F.round("recall", 4).alias("recall"), passed.alias("passed"))


def j9_retrieval_cases(spark, sf):
    return retrieval_cases(spark, sf, ranking(spark, sf))


def j12_case_gate(spark, sf):
    """Whether enough retrieval cases pass (70 %) and, of those that have a source, cite it (80 %)."""
    g = j9_retrieval_cases(spark, sf).agg(F.avg(F.col("passed").cast("int")).alias("passed"), F.avg(F.when(~F.col("negative"), F.col("hit").cast("int"))).alias("cited"))
    return g.select(F.round("passed", 4).alias("passed"), F.round("cited", 4).alias("cited"), ((F.col("passed") >= 0.7) & (F.col("cited") >= 0.8)).alias("gate_open"))


def j11_failures(spark, sf):
    """A failed retrieval case's record: its ten best chunks with their scores, in order."""
    every = ranking(spark, sf)
    failed = retrieval_cases(spark, sf, every).where("NOT passed").select("query_id")
    r = every.where("place <= 10")
    one = F.struct("place", F.concat_ws(":", F.col("chunk_id").cast("string"), F.format_string("%.3f", "relevance")).alias("t"))
    return r.join(failed, "query_id").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), ",").alias("chunks"))


FACTORS = {"emergency": 0.8, "symptom": 0.9, "general": 0.95}


def i11_confidence(spark, sf):
    """0.4 of mean relevance over three, a quarter each of distinct sources and of good chunks, by the intent's factor; a label."""
    r = ranking(spark, sf).where("place <= 5")
    g = r.groupBy("query_id").agg(F.avg("relevance").alias("a"), F.countDistinct("source").alias("s"), F.avg((F.col("points") >= 60).cast("int")).alias("q"))
    intent = R._queries(spark, sf).select("query_id", tagging.intent(F.col("text")).alias("intent"))
    factor = F.coalesce(F.nullif(ladder(F.col("intent"), FACTORS), F.lit(0.0)), F.lit(1.0))
    c = factor * (0.4 * F.least(F.lit(1.0), F.col("a") / 3) + 0.25 * F.least(F.lit(1.0), F.col("s") / 3) + 0.25 * F.col("q"))
    return g.join(intent, "query_id").select("query_id", F.round(c, 4).alias("confidence"), F.when(c >= 0.75, "high").when(c >= 0.4, "medium").otherwise("low").alias("label"))


QUERIES = {f.__name__: f for f in (g1_hybrid, g3_usable, g4_relevance, g5_rerank, g6_scaled, g7_gate, g9_compression, g10_multi_query, g11_second_pass, g12_lexical_fallback, g13_prune, g15_retry, g16_context, g19_extractive_answer, g21_evidence, j9_retrieval_cases, j12_case_gate, j11_failures, i11_confidence)}

_LEX = """(coalesce(list_sum(list_transform(list_filter(terms, lambda t: contains(low, t)), lambda t: 1 + 0.25::DOUBLE * least((length(low) - length(replace(low, t, ''))) / length(t)::DOUBLE, 5))), 0)
  + CASE WHEN length(array_to_string(list_sort(terms), ' ')) > 4 AND contains(low, array_to_string(list_sort(terms), ' ')) THEN 3 ELSE 0 END)::DOUBLE"""
_SCORED = SCORED_SQL.replace(chr(10) + "r AS (", chr(10) + "rr AS (").replace("FROM r)", "FROM rr)").replace("a AS (", "qa AS (", 1).replace("FROM a)", "FROM qa)").replace(chr(10) + "b AS (", chr(10) + "qb AS (").replace("FROM b)", "FROM qb)")


def _case(column: str, values: dict[str, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in values.items()) + " ELSE 0 END" if values else "0"


def _near(words: str, text: str) -> str:
    return f"len(list_filter(range(1, len({words})), lambda i: contains({text}, {words}[i] || ' ' || {words}[i + 1])))"


def _details(found: str, role: str = "patient") -> str:
    """CTEs from found (query_id, chunk_id, bm25, vector) to cp, the ranked candidates."""
    return f"""{_SCORED},
ca AS (SELECT m.*, qu.points, qu.is_noisy, d.source, d.text AS chunk, lower(d.text) AS low, coalesce(l.quality = 1, false) AS approved, CASE l.quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' ELSE 'medium' END AS trust, {S.first_match('lower(d.text)', audit.TYPES, q('other'))} AS kind, {R._keywords('be.text')} AS terms,
  regexp_extract_all(lower(be.text), '[a-zA-Z][a-zA-Z-]{{2,}}') AS said0, trim(regexp_extract(lower(be.text), {q(DEFINITION)}, 2)) AS subject FROM {found} m JOIN quality qu ON qu.doc_id = m.chunk_id JOIN documents d ON d.doc_id = m.chunk_id LEFT JOIN labels l ON l.doc_id = m.chunk_id JOIN benchmark be ON be.item_id = m.query_id),
nb AS (SELECT doc_id AS chunk_id, is_noisy AS noisy_block FROM ({cleaning.ORACLES['b28_noisy_block']})),
cm AS (SELECT *, len(list_filter(terms, lambda t: contains(low, t))) AS matches, {_LEX} AS lexical, list_filter(said0, lambda w: list_contains(terms, w)) AS said FROM ca LEFT JOIN nb USING (chunk_id)),
cr AS (SELECT *, CASE WHEN len(terms) = 0 THEN 0 ELSE round(2.0::DOUBLE * matches / greatest(len(terms), 1) + 0.25::DOUBLE * least(lexical, 6) + least(1.0::DOUBLE, 0.35::DOUBLE * {_near('said', 'low')}) + 0.8::DOUBLE * greatest(0, vector - 0.35::DOUBLE) + 0.3::DOUBLE * greatest(0, points / 100.0::DOUBLE - 0.6::DOUBLE), 3) END AS relevance FROM cm),
cs AS (SELECT *, round(vector + {BM25}::DOUBLE * bm25 + {LEXICAL}::DOUBLE * lexical + relevance + {_case('trust', TRUST)} + CASE WHEN approved THEN {APPROVED}::DOUBLE ELSE -{APPROVED}::DOUBLE END + 0.5::DOUBLE * (points / 100.0::DOUBLE - 0.6::DOUBLE) + CASE WHEN is_noisy THEN {NOISY} ELSE 0 END + {_case('kind', BOOSTS.get(role, {}))}, 5) AS rerank FROM cr),
cp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, chunk_id) AS place FROM cs)"""


def _gated(least: float = GATE) -> str:
    return f"CASE WHEN len(terms) = 0 THEN rerank >= {least} ELSE (subject = '' OR NOT contains(subject, ' ') OR contains(low, subject)) AND CASE WHEN len(terms) <= 2 THEN matches > 0 ELSE matches >= 0.4 * len(terms) END AND (matches >= CASE WHEN len(terms) >= 3 THEN 2 ELSE 1 END OR 2 * matches >= len(terms)) AND relevance >= {least} AND NOT noisy_block END"


_BASE = f"{R._MERGED}, {_details('mg')}"
_LEXICAL = f"{R._BM25}, lx AS (SELECT query_id, chunk_id, score AS bm25, 0.0::DOUBLE AS vector FROM rk WHERE rank <= 20), {_details('lx')}"
_SENT = f"list_transform(string_split(regexp_replace(chunk, '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: {S.squeezed('x')})"


def _sentences(rows: str) -> str:
    return f"""se0 AS (SELECT query_id, place, list_sort(terms) AS st, unnest({_SENT}) AS sentence, unnest(generate_series(1, len({_SENT}))) AS pos FROM {rows}), se AS (SELECT *, 3 * len(list_filter(st, lambda t: contains(lower(sentence), t))) + {_near('st', 'lower(sentence)')} AS score FROM se0),
sr AS (SELECT *, row_number() OVER (PARTITION BY query_id, place ORDER BY score DESC, length(sentence), pos) AS best FROM se WHERE score > 0)"""


_SPACED = lambda c: f"' ' || array_to_string({S.words(f'lower({c})')}, ' ') || ' '"
_CASES = f"""ho AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM (SELECT item_id, {_SPACED('text')} AS p FROM benchmark WHERE len({S.words('text')}) > 0) JOIN (SELECT doc_id, {_SPACED('text')} AS t FROM documents) ON contains(t, p)),
fi AS (SELECT cp.*, (ho.chunk_id IS NOT NULL)::INT AS e FROM cp LEFT JOIN (SELECT DISTINCT * FROM ho) ho USING (query_id, chunk_id) WHERE place <= 5),
re AS (SELECT query_id, max(e) = 1 AS hit, avg(e) AS accuracy, len(list_distinct(flatten(list(list_filter(terms, lambda t: contains(low, t)))))) / greatest(max(len(terms)), 1)::DOUBLE AS recall FROM fi GROUP BY query_id),
rc AS (SELECT query_id, query_id NOT IN (SELECT query_id FROM ho) AS negative, hit, round(accuracy, 4) AS accuracy, round(recall, 4) AS recall, CASE WHEN query_id NOT IN (SELECT query_id FROM ho) THEN recall < 1 ELSE hit AND recall >= 0.6 END AS passed FROM re)"""
_CUT = f"CASE WHEN length(t) <= {BUDGET} THEN t ELSE regexp_extract(substr(t, 1, {BUDGET}), '(?s)^(.*?)(?: [^ ]*)?$', 1) || '.' END"
_VQ = f"vq AS (SELECT item_id * 2 AS item_id, text FROM benchmark UNION ALL SELECT item_id * 2 + 1, array_to_string(list_sort({R._keywords('text')}), ' ') FROM benchmark)"

ORACLES = {
    "g1_hybrid": f"WITH {_BASE}, us AS (SELECT *, ({_gated()})::INT AS good FROM cs WHERE NOT is_noisy AND points >= 60), so AS (SELECT *, max(good) OVER (PARTITION BY query_id) AS any_good FROM us) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, chunk_id) AS place FROM so WHERE good = any_good QUALIFY place <= 5",
    "g3_usable": f"WITH {_BASE} SELECT query_id, count(*) AS n, count(*) FILTER (NOT is_noisy AND points >= 60) AS usable FROM ca GROUP BY query_id",
    "g4_relevance": f"WITH {_BASE} SELECT query_id, chunk_id, matches, relevance FROM cr",
    "g5_rerank": f"WITH {R._MERGED}, {_details('mg', 'dentist')} SELECT query_id, chunk_id, place FROM cp",
    "g6_scaled": f"WITH {_BASE}, p0 AS (SELECT query_id, chunk_id, list_distinct({S.words('lower(be.text)')}) AS qw, list_distinct({S.words('lower(chunk)')}) AS cw FROM cp JOIN benchmark be ON be.item_id = query_id WHERE place <= 40), p1 AS (SELECT query_id, chunk_id, CASE WHEN len(qw) = 0 THEN 0 ELSE len(list_intersect(qw, cw)) / len(qw)::DOUBLE END AS raw FROM p0), w AS (SELECT *, min(raw) OVER (PARTITION BY query_id) AS lo, max(raw) OVER (PARTITION BY query_id) AS hi FROM p1) SELECT query_id, chunk_id, round({CROSS}::DOUBLE * (raw - lo) / greatest(hi - lo, 1e-6), 5) AS scaled FROM w",
    "g7_gate": f"WITH {_BASE} SELECT query_id, chunk_id FROM cs WHERE {_gated()}",
    "g9_compression": f"WITH {_BASE}, one AS (SELECT * FROM cp WHERE place = 1), {_sentences('one')}, j AS (SELECT query_id, string_agg(sentence, ' ' ORDER BY best) AS t FROM sr WHERE best <= 5 GROUP BY query_id), k AS (SELECT query_id, {_CUT} AS context FROM j) SELECT query_id, md5(context) AS context, length(context) AS n FROM k",
    "g10_multi_query": f"WITH {_VQ}, {R._BM25.replace('FROM benchmark', 'FROM vq')}, lx AS (SELECT query_id // 2 AS query_id, chunk_id, max(score) AS bm25, 0.0::DOUBLE AS vector FROM rk WHERE rank <= 20 GROUP BY ALL), {_details('lx')} SELECT query_id, chunk_id FROM cs WHERE {_gated()}",
    "g11_second_pass": f"WITH {_BASE}, c AS (SELECT query_id, round(avg(relevance), 4) AS confidence, avg(relevance) < {AGAIN} AS again FROM cp WHERE place <= 3 GROUP BY query_id), m AS (SELECT query_id, count(*) AS added FROM rk WHERE rank <= 40 AND (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM cp) GROUP BY query_id) SELECT query_id, confidence, again, CASE WHEN again THEN coalesce(added, 0) ELSE 0 END AS added FROM c LEFT JOIN m USING (query_id)",
    "g12_lexical_fallback": f"WITH {_LEXICAL}, us AS (SELECT *, ({_gated(FALLBACK * GATE)})::INT AS good FROM cs), so AS (SELECT *, max(good) OVER (PARTITION BY query_id) AS gated FROM us) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, chunk_id) AS place, gated FROM so WHERE good = gated QUALIFY place <= 5",
    "g13_prune": f"WITH {_BASE}, n AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(0.4::DOUBLE * rerank + 0.35::DOUBLE * vector + 0.25::DOUBLE * bm25, 7) DESC, chunk_id) AS n FROM cp WHERE rerank >= {GATE / 2} OR vector >= 0.3) SELECT query_id, chunk_id, n AS place FROM n WHERE n <= 10",
    "g15_retry": f"WITH {R._MERGED} SELECT query_id, count(*) AS added, min(chunk_id) AS first FROM rk WHERE rank <= 40 AND (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM mg) GROUP BY query_id",
    "g19_extractive_answer": f"WITH {_BASE}, three AS (SELECT * FROM cp WHERE place <= 3), {_sentences('three')}, f AS (SELECT sr.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(sentence), place, pos) AS n FROM sr JOIN (SELECT query_id, place, subject FROM three) USING (query_id, place) WHERE subject = '' OR regexp_matches(lower(sentence), '\\b(is|are|means|refers to|defined as|called)\\b')) SELECT query_id, md5(substr(string_agg(sentence, ' ' ORDER BY n), 1, 1200)) AS answer FROM f WHERE n <= 4 GROUP BY query_id",
    "g21_evidence": f"WITH {_BASE}, t AS (SELECT query_id, string_agg(low, ' ' ORDER BY place) AS t FROM cp WHERE place <= 2 GROUP BY query_id) SELECT query_id, {S.first_match('t', EVIDENCE, q('other'))} AS evidence FROM t",
    "j9_retrieval_cases": f"WITH {_BASE}, {_CASES} SELECT * FROM rc",
    "j11_failures": f"WITH {_BASE}, {_CASES} SELECT query_id, string_agg(chunk_id || ':' || format('{{:.3f}}', relevance), ',' ORDER BY place) AS chunks FROM cp WHERE place <= 10 AND query_id IN (SELECT query_id FROM rc WHERE NOT passed) GROUP BY query_id",
    "i11_confidence": f"WITH {_BASE}, g AS (SELECT query_id, avg(relevance) AS a, count(DISTINCT source) AS s, avg((points >= 60)::INT) AS q FROM cp WHERE place <= 5 GROUP BY query_id), i AS (SELECT item_id AS query_id, {S.first_match('lower(text)', tagging.INTENTS, q('general'))} AS intent FROM benchmark), c AS (SELECT query_id, coalesce(nullif({_case('intent', FACTORS)}, 0), 1) * (0.4::DOUBLE * least(1, a / 3) + 0.25::DOUBLE * least(1, s / 3.0::DOUBLE) + 0.25::DOUBLE * q) AS c FROM g JOIN i USING (query_id)) SELECT query_id, round(c, 4) AS confidence, CASE WHEN c >= 0.75 THEN 'high' WHEN c >= 0.4 THEN 'medium' ELSE 'low' END AS label FROM c",
}
ORACLES["j12_case_gate"] = f"WITH c AS ({ORACLES['j9_retrieval_cases']}), g AS (SELECT avg(passed::INT) AS passed, avg(hit::INT) FILTER (NOT negative) AS cited FROM c) SELECT round(passed, 4) AS passed, round(cited, 4) AS cited, passed >= 0.7 AND cited >= 0.8 AS gate_open FROM g"
