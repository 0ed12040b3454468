"""Duplicates, verdicts and cleanup of a document table."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow import sqltext as S
from corpusflow.functions import text as T
from corpusflow.operators.quality import SCORED_SQL, scored
from corpusflow.shared import numbered, written
from corpusflow.tables import quoted as q
from corpusflow.tables import table

# Fixed values.
TYPES = (("guideline", "guideline"), ("consensus", "guideline"), ("journal", "research_article"), ("article", "research_article"), ("trial", "research_article"), ("patient", "patient_education"), ("leaflet", "patient_education"), ("textbook", "textbook"), ("handbook", "textbook"), ("manual", "textbook"))
LEAST_WORDS = 20


def chunks(docs):
    """Documents as chunks of their source, with content hash, points and words."""
    return scored(docs).withColumns({"hash": T.content_hash(F.col("text")), "n_words": T.n_words(F.col("text"))})


def light_chunks(docs):
    """`chunks` without texts, scored once for the branches that follow."""
    return written(chunks(docs).drop("text", "lang", "reasons"), "chunks")


def best():
    """The best member of a group: most points, then longest, then smallest id. An aggregate: a group isn't gathered in one task."""
    return F.min_by("doc_id", F.struct(-F.col("points"), -F.col("n_chars"), F.col("doc_id")))


def d1_exact_groups(spark, sf):
    """Groups of equal content, with the member to keep."""
    c = chunks(table(spark, sf, "documents"))
    g = c.groupBy("hash").agg(F.count("*").alias("n"), best().alias("keep"))
    return g.where("n >= 2")


def d2_candidate_pairs(spark, sf):
    """Pairs of documents that share a blocking key of 2 to 24 members: first four words, or source and size band with the first word."""
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars", F.slice(T.words(F.lower("text")), 1, 4).alias("w"))
    keys = F.array(F.array_join("w", " "), F.concat_ws(":", F.get("w", F.lit(0)), "source", F.floor(F.col("n_chars") / 500)))
    k = d.select("doc_id", F.explode(F.array_distinct(keys)).alias("key"))
    size = k.groupBy("key").agg(F.count("*").alias("n")).where("n BETWEEN 2 AND 24").select("key")
    k = k.join(size, "key")
    return k.alias("a").join(k.alias("b"), "key").where("a.doc_id < b.doc_id").select(F.col("a.doc_id").alias("left_id"), F.col("b.doc_id").alias("right_id")).distinct()


def d4_fingerprint(spark, sf):
    """Hash of the start, middle and end of a source's documents in order."""
    d = numbered(table(spark, sf, "documents").select("doc_id", "source", F.substring("text", 1, 700).alias("text")), "source", "doc_id", "r").withColumn("r", F.col("r") + 1)
    n = d.groupBy("source").agg(F.count("*").alias("n"))
    mid = F.floor(F.col("n") / 2)
    picked = d.join(n, "source").where((F.col("r") <= 2) | ((F.col("r") >= mid) & (F.col("r") <= mid + 1)) | (F.col("r") > F.col("n") - 2))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.substring("text", 1, 700).alias("t")))), lambda x: x["t"]), " ")
    return picked.groupBy("source").agg(T.content_hash(F.substring(joined, 1, 5000)).alias("fingerprint"))


def d5_best_document(spark, sf):
    return scored(table(spark, sf, "documents")).groupBy("source").agg(best().alias("doc_id"))


def d6_average_quality(spark, sf):
    d = scored(table(spark, sf, "documents"))
    return d.groupBy("source").agg(F.round(F.avg(F.col("points") / 100), 4).alias("quality"))


def d7_duplicate_chunks(spark, sf, least=LEAST_WORDS):
    """Members of groups of equal content of at least 20 words, with the one to keep."""
    c = light_chunks(table(spark, sf, "documents")).where(F.col("n_words") >= least)
    groups = c.groupBy("hash").agg(best().alias("keep"), F.count("*").alias("n")).where("n > 1")
    return c.select("doc_id", "hash").join(groups, "hash").select("doc_id", "keep", "n")


def d8_lineage(spark, sf):
    """Canonical and duplicate, of texts of at least 35 words that aren't noisy."""
    return lineage(light_chunks(table(spark, sf, "documents")).where("n_words >= 35 AND NOT is_noisy"))


def lineage(c):
    """doc_id, keep: every chunk that isn't the best of its content, with the one that is."""
    groups = c.groupBy("hash").agg(best().alias("keep"), F.count("*").alias("n")).where("n > 1").drop("n")
    return c.select("doc_id", "hash").join(groups, "hash").where("doc_id <> keep").select("doc_id", "keep")


def d10_language(spark, sf):
    d = table(spark, sf, "documents")
    lang = F.when(F.contains(F.lower("text"), F.lit("chinese")) | F.col("text").rlike(r"[\x{4E00}-\x{9FFF}]"), "Chinese").when(F.col("text").rlike(r"[\x{600}-\x{6FF}]"), "Urdu/Arabic").when(F.lower("lang").isin("english", "en"), "English").otherwise(F.col("lang"))
    return d.select("doc_id", lang.alias("language"))


def d17_summary(spark, sf):
    """Counts of a cleanup, in one pass over the scored chunks."""
    c = light_chunks(table(spark, sf, "documents"))
    late = lineage(c).select("doc_id", F.lit(True).alias("late"))
    c = c.join(late, "doc_id", "left").withColumn("dup", F.coalesce("late", F.lit(False)) & (F.col("n_words") >= LEAST_WORDS))
    return c.agg(F.count("*").alias("total"), F.count_if("is_noisy").alias("noisy"), F.count_if("dup").alias("duplicates"), F.count_if(F.col("dup") | F.col("is_noisy")).alias("removed"), F.countDistinct("hash").alias("distinct_texts"))


def d18_apply(spark, sf):
    """Documents left after the decisions on their ids are applied."""
    labels = table(spark, sf, "labels")
    gone = labels.where("toxic = 1").select("doc_id").unionByName(labels.where("quality = 0 AND doc_id % 2 = 0").select("doc_id")).distinct()
    return table(spark, sf, "documents").join(gone, "doc_id", "left_anti").select("doc_id", "source")


def d20_years(spark, sf):
    """The latest plausible year of a page."""
    years = F.transform(F.regexp_extract_all("html", F.lit("((?:19|20)[0-9]{2})"), 1), lambda y: y.cast("int"))
    return table(spark, sf, "pages").select("page_id", F.array_max(years).alias("year"))


def d22_completeness(spark, sf):
    """Missing values of each column in one pass."""
    d = table(spark, sf, "documents")
    return d.agg(*(F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) == "").alias(f"missing_{c}") for c in d.columns))


def d23_clean_selection(spark, sf):
    """Documents for a clean index: good, and first of their content; with the reason why others are skipped."""
    c = light_chunks(table(spark, sf, "documents"))
    c = c.withColumn("reason", F.when(F.col("is_noisy"), "noisy").when(F.col("points") < 60, "low_quality"))
    first = c.where("reason IS NULL").groupBy("hash").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("first"))
    c = c.join(first, "doc_id", "left")
    c = c.withColumn("reason", F.when(F.col("first"), "kept").otherwise(F.coalesce("reason", F.lit("duplicate"))))
    return c.groupBy("reason").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def d24_vector_deletion(spark, sf):
    gone = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return table(spark, sf, "embeddings").join(gone, "vec_id", "left_anti").select("vec_id", "label")


def d25_known_rejected(spark, sf):
    """New documents (odd ids) whose content is known among the others are refused."""
    d = table(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))
    known = d.where("doc_id % 2 = 0").select("hash").distinct().withColumn("known", F.lit(True))
    return d.where("doc_id % 2 = 1").join(known, "hash", "left").select("doc_id", F.coalesce("known", F.lit(False)).alias("refused"))


def slice_retained_share(spark, sf):
    """Per source: documents, those that pass the quality gate, and those left after first-wins deduplication."""
    c = light_chunks(table(spark, sf, "documents")).withColumn("good", ~F.col("is_noisy"))
    first = c.where("good").groupBy("hash").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("kept"))
    c = c.join(first, "doc_id", "left")
    return c.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if("good").alias("n_good"), F.count_if("kept").alias("n_kept"))


QUERIES = {f.__name__: f for f in (d1_exact_groups, d2_candidate_pairs, d4_fingerprint, d5_best_document, d6_average_quality, d7_duplicate_chunks, d8_lineage, d10_language, d17_summary, d18_apply, d20_years, d22_completeness, d23_clean_selection, d24_vector_deletion, d25_known_rejected, slice_retained_share)}

_C = f"{SCORED_SQL}, c AS (SELECT q.*, d.source, d.n_chars, {S.content_hash('q.text')} AS hash, {S.n_words('q.text')} AS n_words FROM quality q JOIN (SELECT doc_id, source, n_chars FROM documents) d USING (doc_id))"
_BEST = "ORDER BY points DESC, n_chars DESC, doc_id"

ORACLES = {
    "d1_exact_groups": f"WITH {_C} SELECT hash, count(*) AS n, first(doc_id {_BEST}) AS keep FROM c GROUP BY hash HAVING count(*) >= 2",
    "d2_candidate_pairs": f"""WITH d AS (SELECT doc_id, source, n_chars, ({S.words('lower(text)')})[:4] AS w FROM documents), k AS (SELECT DISTINCT doc_id, unnest([array_to_string(w, ' '), concat_ws(':', w[1], source, floor(n_chars / 500)::BIGINT)]) AS key FROM d),
s AS (SELECT key FROM k GROUP BY key HAVING count(*) BETWEEN 2 AND 24), j AS (SELECT k.* FROM k JOIN s USING (key)) SELECT DISTINCT a.doc_id AS left_id, b.doc_id AS right_id FROM j a JOIN j b USING (key) WHERE a.doc_id < b.doc_id""",
    "d4_fingerprint": f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents), p AS (SELECT source, string_agg(substr(text, 1, 700), ' ' ORDER BY r) AS t FROM d WHERE r <= 2 OR r IN (n // 2, n // 2 + 1) OR r > n - 2 GROUP BY source) SELECT source, {S.content_hash('substr(t, 1, 5000)')} AS fingerprint FROM p""",
    "d5_best_document": f"WITH {_C} SELECT source, doc_id FROM c QUALIFY row_number() OVER (PARTITION BY source {_BEST}) = 1",
    "d6_average_quality": f"WITH {_C} SELECT source, round(avg(points / 100.0::DOUBLE), 4) AS quality FROM c GROUP BY source",
    "d7_duplicate_chunks": f"WITH {_C} SELECT doc_id, first_value(doc_id) OVER (PARTITION BY hash {_BEST}) AS keep, count(*) OVER (PARTITION BY hash) AS n FROM c WHERE n_words >= 20 QUALIFY n > 1",
    "d8_lineage": f"WITH {_C}, k AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY hash {_BEST}) AS keep FROM c WHERE n_words >= 35 AND NOT is_noisy) SELECT * FROM k WHERE doc_id <> keep",
    "d10_language": r"SELECT doc_id, CASE WHEN contains(lower(text), 'chinese') OR regexp_matches(text, '[\x{4E00}-\x{9FFF}]') THEN 'Chinese' WHEN regexp_matches(text, '[\x{600}-\x{6FF}]') THEN 'Urdu/Arabic' WHEN lower(lang) IN ('english', 'en') THEN 'English' ELSE lang END AS language FROM documents",
    "d17_summary": f"WITH {_C}, k AS (SELECT *, row_number() OVER (PARTITION BY hash {_BEST}) > 1 AND n_words >= 20 AS dup FROM c) SELECT count(*) AS total, count(*) FILTER (is_noisy) AS noisy, count(*) FILTER (dup) AS duplicates, count(*) FILTER (dup OR is_noisy) AS removed, count(DISTINCT hash) AS distinct_texts FROM k",
    "d18_apply": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 OR (quality = 0 AND doc_id % 2 = 0))",
    "d20_years": "SELECT page_id, list_max(list_transform(regexp_extract_all(html, '(?:19|20)[0-9]{2}'), lambda y: y::INT)) AS year FROM pages",
    "d22_completeness": "SELECT " + ", ".join(f"count(*) FILTER (coalesce({c}::VARCHAR, '') = '') AS missing_{c}" for c in ("doc_id", "text", "lang", "source", "n_chars")) + " FROM documents",
    "d23_clean_selection": f"WITH {_C}, m AS (SELECT *, CASE WHEN is_noisy THEN 'noisy' WHEN points < 60 THEN 'low_quality' END AS reason FROM c), k AS (SELECT n_chars, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY hash, reason IS NULL ORDER BY doc_id) > 1 THEN 'duplicate' ELSE coalesce(reason, 'kept') END AS reason FROM m) SELECT reason, count(*) AS n, sum(n_chars) AS chars FROM k GROUP BY reason",
    "d24_vector_deletion": "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "d25_known_rejected": f"WITH d AS (SELECT doc_id, {S.content_hash('text')} AS hash FROM documents) SELECT doc_id, hash IN (SELECT hash FROM d WHERE doc_id % 2 = 0) AS refused FROM d WHERE doc_id % 2 = 1",
    "slice_retained_share": f"WITH {_C}, k AS (SELECT *, NOT is_noisy AND row_number() OVER (PARTITION BY hash, is_noisy ORDER BY doc_id) = 1 AS kept FROM c) SELECT source, count(*) AS n_docs, count(*) FILTER (NOT is_noisy) AS n_good, count(*) FILTER (kept) AS n_kept FROM k GROUP BY source",
}
