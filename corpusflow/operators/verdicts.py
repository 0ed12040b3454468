"""Audit of documents: inferred metadata, verdicts with reasons, audit, removal and metadata tables.

A document is a row of `documents`; its chunks are runs of CHUNK_WORDS words of its whole text. Its title is the first line, which stands
for the file name too; trust and review come from `labels`. Null texts are documents without chunks; rows that repeat a doc_id count as
one document's chunks; an empty table gives no rows; of labels that repeat, the best counts.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from corpusflow import sqltext as S
from corpusflow.functions import text as T
from corpusflow.functions.quality import holds
from corpusflow.operators import audit as A
from corpusflow.operators import ingest
from corpusflow.operators.quality import SCORED_SQL, scored
from corpusflow.shared import folder, written
from corpusflow.tables import quoted as q
from corpusflow.tables import table

CHUNK_WORDS = 200
# Terms, patterns, ladders and limits that results depend on.
DOMAIN_TERMS = ("dental", "dentistry", "tooth", "teeth", "oral", "orthodont", "endodont", "periodont", "prosthodont", "maxillofacial", "occlusion", "caries", "enamel", "dentin", "gingiva", "implant", "mandible", "maxilla", "cephalometric", "malocclusion", "tmj", "radiology")
USELESS_TITLES = ("spss", "conference", "brochure", r"registration\s+form", r"table\s+of\s+contents", "toc", r"editorial\s+board", r"future\s+issues?", "advertisement", r"call\s+for\s+papers")
SPECIALTIES = (("orthodont", "orthodontics"), ("endodont", "endodontics"), ("periodont", "periodontology"), ("prosthodont", "prosthodontics"), ("radiolog", "oral_and_maxillofacial_radiology"), ("maxillofacial", "oral_and_maxillofacial_surgery"), ("oral surgery", "oral_and_maxillofacial_surgery"), ("implant", "implant_dentistry"), ("tmj", "temporomandibular_disorders"), ("pediatric", "pediatric_dentistry"), ("paediatric", "pediatric_dentistry"), ("caries", "operative_dentistry"))
TOPICS = (("caries", "dental_caries"), ("implant", "implants_and_temporary_anchorage"), ("anchorage", "orthodontic_anchorage"), ("ceph", "cephalometrics"), ("cleft", "cleft_lip_and_palate"), ("tmj", "temporomandibular_disorders"), ("temporomandibular", "temporomandibular_disorders"), ("orthognathic", "orthognathic_surgery"), ("trauma", "dental_trauma"), ("pregnancy", "medically_compromised_dentistry"), ("antibiotic", "medically_compromised_dentistry"), ("allerg", "medically_compromised_dentistry"), ("bracket", "orthodontic_appliances"), ("aligner", "aligner_therapy"), ("occlusion", "occlusion"))
PUBLISHERS = (("quintessence", "Quintessence Publishing"), ("thieme", "Thieme"), ("elsevier", "Elsevier"), ("wiley", "Wiley"), ("springer", "Springer"), ("mosby", "Mosby"), ("z-library", "Z-Library source copy"), ("pdfdrive", "PDFDrive source copy"))
#: A word's ends, for patterns that both engines read alike.
_AT, _END = "(^|[^a-z0-9_])", "([^a-z0-9_]|$)"
TYPES = ((f"{_AT}guideline|clinical practice guideline|consensus{_END}", "guideline"), (f"{_AT}journal|article|case report|study|trial|systematic review{_END}", "research_article"), (f"{_AT}patient|leaflet|brochure{_END}", "patient_education"), (f"{_AT}textbook|handbook|manual|principles|contemporary|orthodontics|radiology{_END}", "textbook"))
LEVELS = ((f"{_AT}fcps|postgraduate|advanced|surgery|cephalometric|biomechanics{_END}", "advanced"), (f"{_AT}handbook|clinical|principles|contemporary{_END}", "intermediate"))
YEAR = r"(?:^|[^0-9A-Za-z_])(19[5-9][0-9]|20[0-3][0-9])"
EDITION = r"([0-9]+)(st|nd|rd|th)[ ]+edition"
NOISY_SHARE, NOISY_APPROVED = 0.5, 0.35


def runs(docs):
    """doc_id, chunk_no, text: runs of CHUNK_WORDS words."""
    runs = F.regexp_extract_all(T.spaced(F.col("text")), F.lit(f"([^ ]++(?: [^ ]++){{0,{CHUNK_WORDS - 1}}}+)"), 1)
    return docs.select("doc_id", F.posexplode(runs).alias("chunk_no", "text"))


def facts(spark, sf):
    """A row a document: what its chunks, text and labels tell. Texts are read twice, for chunks and for what is inferred of the whole."""
    docs = table(spark, sf, "documents")
    c = scored(runs(docs)).withColumn("signal", T.count_of(F.lower("text"), DOMAIN_TERMS) > 0)
    per = c.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.round(F.avg(F.col("points") / 100), 4).alias("quality"), F.avg(F.col("is_noisy").cast("int")).alias("noisy"), F.bool_or("signal").alias("in_text"))
    label = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("good"), F.max("toxic").alias("toxic"))
    title = T.squeezed(T.first_line(F.col("text")))
    d = docs.select("doc_id", "source", "lang", title.alias("title"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("file_hash"), T.content_hash(F.col("text")).alias("fingerprint"), _script(F.col("text")).alias("script"), F.contains(F.coalesce("text", F.lit("")), F.lit("�")).alias("ocr_used"), F.regexp_extract(F.lower("text"), EDITION, 1).alias("edition"))
    d = d.join(per, "doc_id", "left").join(label, "doc_id", "left")
    # A title may be as long as its text (one without line ends): lower case is a projection of its own, patterns wait for their words.
    d, low = d.withColumn("_low", F.lower("title")), F.col("_low")
    years = F.when(holds(F.col("title"), "19", "20"), F.transform(F.regexp_extract_all("title", F.lit(YEAR), 1), lambda y: y.cast("int")))
    d = d.withColumns({"n_chunks": F.coalesce("n_chunks", F.lit(0)), "quality": F.coalesce("quality", F.lit(0.0)), "noisy": F.coalesce("noisy", F.lit(1.0)), "signal": F.coalesce("in_text", T.count_of(low, DOMAIN_TERMS) > 0), "year": F.array_max(years)})
    d = d.withColumns({
        "status": F.when(F.col("n_chunks") == 0, "failed").otherwise("ready"),
        "trust": F.when(F.col("good") == 1, "high").when(F.col("good") == 0, "low").otherwise("medium"),
        "review": F.when((F.col("good") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), "approved").otherwise("unreviewed"),
        "language": F.coalesce("script", F.when(F.lower("lang").isin("english", "en"), "English"), "lang", F.lit("English")),
        "kind": first_pattern(low, TYPES, F.lit("other")), "specialty": T.first_match(low, SPECIALTIES, F.lit("general_dentistry")), "level": first_pattern(low, LEVELS, F.lit("general")),
        "author": _author(F.col("title")), "publisher": T.first_match(low, PUBLISHERS, F.lit("Unknown")),
    })
    return d.withColumn("topic", T.first_match(low, TOPICS, F.col("specialty"))).drop("in_text", "good", "toxic", "_low")


def first_pattern(low, ladder, otherwise):
    """As T.first_pattern, for patterns of plain words within _AT and _END: looked for only where one of their words occurs."""
    out = otherwise
    for pattern, name in reversed(ladder):
        words = pattern.removeprefix(_AT).removesuffix(_END).split("|")
        out = F.when(holds(low, *words) & low.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def _script(text):
    return F.when(F.contains(F.lower(text), F.lit("chinese")) | text.rlike(r"[\x{4E00}-\x{9FFF}]"), "Chinese").when(text.rlike(r"[\x{600}-\x{6FF}]"), "Urdu/Arabic")


def _author(name):
    stem = F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")
    dash, paren = F.regexp_extract(stem, "^([^_-]+?) +- +", 1), F.regexp_extract(stem, r"\(([^,()]+), *(?:19|20)[0-9]{2}\)", 1)
    return F.when(dash != "", F.trim(dash)).when(paren != "", F.trim(paren)).otherwise("Unknown")


def metadata_issues():
    """Array of what a document's stored metadata lacks or contradicts."""
    return F.array_compact(F.array(
        F.when(F.col("lang").isNotNull() & F.col("script").isNotNull() & (F.lower("script") != F.lower("lang")), F.concat(F.lit("language_mismatch:stored="), "lang", F.lit(":inferred="), "script")),
        F.when((F.col("trust") == "high") & ~F.col("signal"), F.lit("high_trust_without_clear_dental_signal")),
        F.when((F.col("review") == "approved") & (F.col("trust") == "high") & (F.col("noisy") > NOISY_APPROVED), F.lit("approved_high_trust_with_many_noisy_chunks")),
        F.when(F.col("title") == "", F.lit("missing_title")), F.when(F.col("year").isNull(), F.lit("missing_publication_year"))))


def judged(d, duplicates):
    """d (facts) with issues, verdict and reasons; duplicates: doc_id of documents of which a better copy is kept."""
    d = d.join(duplicates.select("doc_id", F.lit(True).alias("duplicate")), "doc_id", "left").withColumn("issues", metadata_issues())
    d, low = d.withColumn("_low", F.lower("title")), F.col("_low")
    useless = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(re.match("[a-z]+", p)[0])) & low.rlike(f"{_AT}{p}{_END}"), F.lit(f"title_matches:{p}")) for p in USELESS_TITLES)))
    ladder = (
        (F.coalesce("duplicate", F.lit(False)), "DUPLICATE", F.array(F.lit("duplicate_of_better_copy"))),
        ((F.col("status") == "failed") | (F.col("n_chunks") == 0), "REMOVE_CANDIDATE", F.array(F.lit("failed_or_empty_document"))),
        (F.size("useless") > 0, "QUARANTINE", F.col("useless")),
        (~F.col("signal"), "REVIEW", F.array(F.lit("weak_dental_signal"))),
        (F.col("noisy") > NOISY_SHARE, "REVIEW", F.array(F.concat(F.lit("high_noisy_chunk_ratio:"), F.format_number("noisy", 2)))),
        (F.size("issues") > 0, "REVIEW", F.slice("issues", 1, 3)),
    )
    verdict, reasons = F.lit("KEEP"), F.array(F.lit("useful_dental_content"))
    for holds, name, why in reversed(ladder):
        verdict, reasons = F.when(holds, name).otherwise(verdict), F.when(holds, why).otherwise(reasons)
    return d.withColumn("useless", useless).withColumns({"verdict": verdict, "reasons": F.array_join(reasons, "; ")}).drop("useless", "duplicate", "_low")


def better_copies(d):
    """doc_id, keep: documents of equal file hash but the best: quality, then chunks, a year, a late one, a short name, the smaller id. Empty texts are no copies."""
    rank = F.struct(-F.col("quality"), -F.col("n_chunks"), -F.coalesce("year", F.lit(0)), F.length("title"), F.col("doc_id"))
    best = d.where("n_chunks > 0").groupBy("file_hash").agg(F.min_by("doc_id", rank).alias("keep"), F.count("*").alias("n")).where("n > 1")
    return d.join(best, "file_hash").where("doc_id <> keep").select("doc_id", "keep")


def audited(spark, sf):
    """Facts and verdicts, as a table."""
    d = written(facts(spark, sf), "facts")
    return written(judged(d, better_copies(d)), "audit")


def recommended_trust():
    low = F.when(F.col("signal"), "medium").otherwise("low")
    return F.when(F.col("verdict").isin("QUARANTINE", "REMOVE_CANDIDATE"), "low").when(F.col("kind").isin("guideline", "textbook") & F.col("signal"), "high").when(F.col("kind") == "research_article", "medium").otherwise(low)


def audit_rows(a):
    """The audit's row of each document."""
    return a.select(
        F.col("doc_id").alias("document_id"), F.col("verdict").alias("classification"), "reasons", F.col("title").alias("canonical_title"), ingest.normalised_title(F.col("title")).alias("normalized_title"), F.col("title").alias("original_filename"),
        F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.col("doc_id").cast("string")).alias("storage_path"), "status", F.col("n_chunks").alias("chunk_count"), F.col("quality").alias("quality_average"), F.round("noisy", 4).alias("noisy_chunk_ratio"),
        F.lit("other").alias("document_type"), F.col("kind").alias("inferred_document_type"), F.col("specialty").alias("dental_specialty"), F.col("level").alias("difficulty_level"), F.col("lang").alias("language"), F.col("language").alias("inferred_language"),
        F.col("trust").alias("trust_level"), recommended_trust().alias("recommended_trust_level"), F.col("review").alias("review_status"), F.when(F.col("verdict") == "KEEP", "reviewed").otherwise("unreviewed").alias("recommended_review_status"),
        "file_hash", F.col("fingerprint").alias("content_fingerprint"), "ocr_used", "author", "publisher", F.coalesce(F.col("year").cast("string"), F.lit("")).alias("publication_year"), "edition", F.when(F.col("ocr_used"), "ocr").otherwise("pdf_text").alias("extraction_method"))


def removal_rows(rows):
    return rows.where(F.col("classification").isin("QUARANTINE", "REMOVE_CANDIDATE", "DUPLICATE"))


def issue_rows(a):
    """Documents whose metadata has issues, or whose language isn't told by the stored one."""
    told = F.when(F.col("script").isNotNull(), F.array(F.concat(F.lit("script:"), "script"))).when(~F.lower("lang").isin("english", "en"), F.array(F.lit("stored_language_non_english"))).otherwise(F.array())
    every = F.concat("issues", told)
    return a.where(F.size(every) > 0).select(F.col("doc_id").alias("document_id"), F.col("title").alias("original_filename"), F.array_join(every, "; ").alias("issues"), F.col("lang").alias("stored_language"), F.col("language").alias("inferred_language"), F.col("trust").alias("stored_trust_level"), recommended_trust().alias("recommended_trust_level"), F.col("review").alias("stored_review_status"), F.when(F.col("verdict") == "KEEP", "reviewed").otherwise("unreviewed").alias("recommended_review_status"))


def metadata_rows(a):
    """The enriched row of each document, as if it were kept."""
    trust = F.when(F.col("kind").isin("guideline", "textbook") & F.col("signal"), "high").when((F.col("kind") == "research_article") | F.col("signal"), "medium").otherwise("low")
    a = a.withColumn("t", trust)
    return a.select(F.col("doc_id").alias("document_id"), F.col("title").alias("canonical_title"), F.col("title").alias("original_filename"), "author", "publisher", F.col("year").alias("publication_year"), F.coalesce(F.nullif("edition", F.lit("")), F.lit("Unknown")).alias("edition"), F.col("kind").alias("document_type"), F.col("specialty").alias("dental_specialty"), "topic", F.col("level").alias("difficulty_level"), "language", F.col("t").alias("trust_level"), F.when(F.col("t") == "low", "unreviewed").otherwise("reviewed").alias("review_status"), F.lit("none").alias("duplicate_group_id"), F.col("fingerprint").alias("content_hash"), F.when(F.col("ocr_used"), "ocr").otherwise("pdf_text").alias("extraction_method"))


def d11_types(spark, sf):
    """Type, specialty and level of a document by its title."""
    return facts(spark, sf).select("doc_id", "kind", "specialty", "level")


def d12_trust(spark, sf):
    return audited(spark, sf).select("doc_id", "signal", recommended_trust().alias("trust"))


def d13_verdict(spark, sf):
    return audited(spark, sf).select("doc_id", "verdict", "reasons")


def d14_issues(spark, sf):
    """Share of noisy chunks, and what the metadata lacks."""
    return facts(spark, sf).select("doc_id", F.round("noisy", 6).alias("noisy_share"), F.array_join(metadata_issues(), "; ").alias("issues"))


def d15_audit_rows(spark, sf):
    return audit_rows(audited(spark, sf))


def d15_removal_rows(spark, sf):
    return removal_rows(audit_rows(audited(spark, sf))).select("document_id", "classification", "reasons")


def d15_issue_rows(spark, sf):
    return issue_rows(audited(spark, sf))


def d20_inferred(spark, sf):
    """Year, author, publisher and topic of a document by its title."""
    return facts(spark, sf).select("doc_id", "year", "author", "publisher", "topic")


def d21_metadata(spark, sf):
    return metadata_rows(audited(spark, sf))


def d19_cleanup_job(spark, sf):
    """The cleanup as one job: verdicts decide on documents, then on their chunks: noisy ones go, and of equal ones all but the best; a row a document with its counts refreshed."""
    a = audited(spark, sf)
    c = scored(runs(table(spark, sf, "documents"))).withColumns({"n_words": T.n_words(F.col("text")), "hash": T.content_hash(F.col("text"))}).select("doc_id", "chunk_no", "points", "is_noisy", "n_words", "hash")
    c = written(c.join(a.where("verdict IN ('KEEP', 'REVIEW')").select("doc_id"), "doc_id", "left_semi"), "chunks")
    good = c.where("NOT is_noisy AND n_words >= 35")
    best = good.groupBy("hash").agg(F.min_by(F.struct("doc_id", "chunk_no"), F.struct(-F.col("points"), -F.col("n_words"), F.col("doc_id"), F.col("chunk_no"))).alias("k"))
    kept = best.groupBy(F.col("k.doc_id").alias("doc_id")).agg(F.count("*").alias("n_retained"))
    every = c.groupBy("doc_id").agg(F.count_if("is_noisy").alias("n_noisy"), F.count_if(~F.col("is_noisy") & (F.col("n_words") >= 35)).alias("n_good"))
    out = a.select("doc_id", "verdict", "n_chunks").join(every, "doc_id", "left").join(kept, "doc_id", "left")
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return out.select("doc_id", "verdict", "n_chunks", zero("n_noisy"), (F.coalesce("n_good", F.lit(0)) - F.coalesce("n_retained", F.lit(0))).alias("n_duplicate"), zero("n_retained"))


def a8_audit_bundle(spark, sf):
    """Audit tables written as CSV and their summary as JSON; a row a table with what was read back."""
    docs, at = table(spark, sf, "documents"), folder(spark)
    a = audited(spark, sf)
    rows = audit_rows(a)
    parts = {"audit": rows, "removal": removal_rows(rows), "metadata": issue_rows(a), "exact_groups": A.d1_exact_groups(spark, sf), "chunk_cleaning": written(ingest.chunk_cleaning(docs), "cleaning").where("reasons <> ''"), "lineage": A.lineage(A.light_chunks(docs))}
    out = None
    for name, part in parts.items():
        part.write.options(header=True, quoteAll=True, escape='"').csv(f"{at}/{name}")
        read = spark.read.options(header=True, escape='"').schema(part.schema).csv(f"{at}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = read if out is None else out.unionByName(read)
    out.write.json(f"{at}/summary")
    return spark.read.schema("name string, n long").json(f"{at}/summary")


QUERIES = {f.__name__: f for f in (a8_audit_bundle, d11_types, d12_trust, d13_verdict, d14_issues, d15_audit_rows, d15_removal_rows, d15_issue_rows, d19_cleanup_job, d20_inferred, d21_metadata)}

_RUNS = f"""ru0 AS (SELECT doc_id, {S.words('text')} AS ws FROM documents), ru1 AS (SELECT doc_id, ws, unnest(generate_series(0, (len(ws) - 1) // {CHUNK_WORDS})) AS chunk_no FROM ru0 WHERE len(ws) > 0),
runs AS (SELECT doc_id * 1000000 + chunk_no AS doc_id, array_to_string(ws[chunk_no * {CHUNK_WORDS} + 1 : (chunk_no + 1) * {CHUNK_WORDS}], ' ') AS text FROM ru1)"""
_SCORED = SCORED_SQL.replace("FROM documents", "FROM runs")
_TITLE = S.squeezed(f"coalesce({S.lines('text')}[1], '')")
_STEM = r"regexp_replace(title, '^(.+)\.[^.]+$', '\1')"
_DASH, _PAREN = f"regexp_extract({_STEM}, '^([^_-]+?) +- +', 1)", rf"regexp_extract({_STEM}, '\(([^,()]+), *(?:19|20)[0-9]{{2}}\)', 1)"
_FACTS = f"""{_RUNS}, {_SCORED}, per AS (SELECT doc_id // 1000000 AS doc_id, count(*) AS n_chunks, round(avg(points / 100.0::DOUBLE), 4) AS quality, avg(is_noisy::INT) AS noisy, bool_or({S.any_of('lower(text)', DOMAIN_TERMS)}) AS in_text FROM quality GROUP BY 1),
lab AS (SELECT doc_id, max(quality) AS good, max(toxic) AS toxic FROM labels GROUP BY doc_id),
fa0 AS (SELECT doc_id, source, lang, {_TITLE} AS title, sha256(coalesce(text, '')) AS file_hash, {S.content_hash('text')} AS fingerprint, CASE WHEN contains(lower(text), 'chinese') OR regexp_matches(text, '[\\x{{4E00}}-\\x{{9FFF}}]') THEN 'Chinese' WHEN regexp_matches(text, '[\\x{{600}}-\\x{{6FF}}]') THEN 'Urdu/Arabic' END AS script,
  contains(coalesce(text, ''), chr(65533)) AS ocr_used, regexp_extract(lower(text), {q(EDITION)}, 1) AS edition FROM documents),
fa1 AS (SELECT fa0.*, coalesce(n_chunks, 0) AS n_chunks, coalesce(per.quality, 0) AS quality, coalesce(noisy, 1) AS noisy, coalesce(in_text, false) OR {S.any_of('lower(title)', DOMAIN_TERMS)} AS signal, list_max(list_transform(regexp_extract_all(title, {q(YEAR)}, 1), lambda y: y::INT)) AS year,
  CASE good WHEN 1 THEN 'high' WHEN 0 THEN 'low' ELSE 'medium' END AS trust, CASE WHEN good = 1 AND coalesce(toxic, 0) = 0 THEN 'approved' ELSE 'unreviewed' END AS review, CASE WHEN coalesce(n_chunks, 0) = 0 THEN 'failed' ELSE 'ready' END AS status,
  coalesce(script, CASE WHEN lower(lang) IN ('english', 'en') THEN 'English' END, lang, 'English') AS language, {S.first_pattern('lower(title)', TYPES, q('other'))} AS kind, {S.first_match('lower(title)', SPECIALTIES, q('general_dentistry'))} AS specialty, {S.first_pattern('lower(title)', LEVELS, q('general'))} AS level,
  CASE WHEN {_DASH} <> '' THEN trim({_DASH}) WHEN {_PAREN} <> '' THEN trim({_PAREN}) ELSE 'Unknown' END AS author, {S.first_match('lower(title)', PUBLISHERS, q('Unknown'))} AS publisher FROM fa0 LEFT JOIN per USING (doc_id) LEFT JOIN lab USING (doc_id)),
fa AS (SELECT *, {S.first_match('lower(title)', TOPICS, 'specialty')} AS topic, list_filter([CASE WHEN lower(script) <> lower(lang) THEN 'language_mismatch:stored=' || lang || ':inferred=' || script END, CASE WHEN trust = 'high' AND NOT signal THEN 'high_trust_without_clear_dental_signal' END,
  CASE WHEN review = 'approved' AND trust = 'high' AND noisy > {NOISY_APPROVED} THEN 'approved_high_trust_with_many_noisy_chunks' END, CASE WHEN title = '' THEN 'missing_title' END, CASE WHEN year IS NULL THEN 'missing_publication_year' END], lambda x: x IS NOT NULL) AS issues FROM fa1)"""
_AUDIT = f"""{_FACTS}, du AS (SELECT doc_id FROM fa WHERE n_chunks > 0 QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY quality DESC, n_chunks DESC, coalesce(year, 0) DESC, length(title), doc_id) > 1),
ju0 AS (SELECT *, doc_id IN (SELECT doc_id FROM du) AS dup, list_filter([{', '.join(f"CASE WHEN {S.matches('lower(title)', _AT + p + _END)} THEN {q('title_matches:' + p)} END" for p in USELESS_TITLES)}], lambda x: x IS NOT NULL) AS useless FROM fa),
ju1 AS (SELECT *, CASE WHEN dup THEN 'DUPLICATE' WHEN n_chunks = 0 THEN 'REMOVE_CANDIDATE' WHEN len(useless) > 0 THEN 'QUARANTINE' WHEN NOT signal OR noisy > {NOISY_SHARE} OR len(issues) > 0 THEN 'REVIEW' ELSE 'KEEP' END AS verdict,
  CASE WHEN dup THEN 'duplicate_of_better_copy' WHEN n_chunks = 0 THEN 'failed_or_empty_document' WHEN len(useless) > 0 THEN array_to_string(useless, '; ') WHEN NOT signal THEN 'weak_dental_signal' WHEN noisy > {NOISY_SHARE} THEN 'high_noisy_chunk_ratio:' || format('{{:.2f}}', noisy) WHEN len(issues) > 0 THEN array_to_string(issues[:3], '; ') ELSE 'useful_dental_content' END AS reasons FROM ju0),
ju AS (SELECT *, CASE WHEN verdict IN ('QUARANTINE', 'REMOVE_CANDIDATE') THEN 'low' WHEN kind IN ('guideline', 'textbook') AND signal THEN 'high' WHEN kind = 'research_article' OR signal THEN 'medium' ELSE 'low' END AS advised, CASE WHEN verdict = 'KEEP' THEN 'reviewed' ELSE 'unreviewed' END AS advised_review, {ingest._TITLE.replace(S.lines('text') + '[1]', 'title')} AS norm, CASE WHEN ocr_used THEN 'ocr' ELSE 'pdf_text' END AS method FROM (SELECT *, title AS text FROM ju1))"""
#: The scored documents beside the scored runs, under names of their own.
A_SCORED = SCORED_SQL
for _n in ("a", "b", "r", "scored", "quality"):
    A_SCORED = re.sub(rf"(?m)^{_n} AS \(", f"a{_n} AS (", A_SCORED).replace(f"FROM {_n})", f"FROM a{_n})")
_TOLD = "list_concat(issues, CASE WHEN script IS NOT NULL THEN ['script:' || script] WHEN lower(lang) NOT IN ('english', 'en') THEN ['stored_language_non_english'] ELSE [] END)"

ORACLES = {
    "a8_audit_bundle": f"""WITH {_AUDIT}, {A._C.replace(SCORED_SQL, A_SCORED).replace('FROM quality q', 'FROM aquality q')}, {ingest._CLEANING.replace('quality q', 'aquality q')}, li AS ({ingest._LINEAGE} c) SELECT 'audit' AS name, count(*) AS n FROM ju UNION ALL SELECT 'removal', count(*) FROM ju WHERE verdict IN ('QUARANTINE', 'REMOVE_CANDIDATE', 'DUPLICATE') UNION ALL SELECT 'metadata', count(*) FROM ju WHERE len({_TOLD}) > 0
UNION ALL SELECT 'exact_groups', count(*) FROM (SELECT hash FROM c GROUP BY hash HAVING count(*) > 1) UNION ALL SELECT 'chunk_cleaning', count(*) FROM cc WHERE reasons <> '' UNION ALL SELECT 'lineage', count(*) FROM li WHERE doc_id <> keep""",
    "d11_types": f"WITH {_FACTS} SELECT doc_id, kind, specialty, level FROM fa",
    "d12_trust": f"WITH {_AUDIT} SELECT doc_id, signal, advised AS trust FROM ju",
    "d13_verdict": f"WITH {_AUDIT} SELECT doc_id, verdict, reasons FROM ju",
    "d14_issues": f"WITH {_FACTS} SELECT doc_id, round(noisy, 6) AS noisy_share, array_to_string(issues, '; ') AS issues FROM fa",
    "d15_audit_rows": f"""WITH {_AUDIT} SELECT doc_id AS document_id, verdict AS classification, reasons, title AS canonical_title, norm AS normalized_title, title AS original_filename, coalesce(source, 'unknown') || '/' || doc_id AS storage_path, status, n_chunks AS chunk_count, quality AS quality_average, round(noisy, 4) AS noisy_chunk_ratio,
 'other' AS document_type, kind AS inferred_document_type, specialty AS dental_specialty, level AS difficulty_level, lang AS language, language AS inferred_language, trust AS trust_level, advised AS recommended_trust_level, review AS review_status, advised_review AS recommended_review_status, file_hash, fingerprint AS content_fingerprint, ocr_used, author, publisher, coalesce(year::VARCHAR, '') AS publication_year, edition, method AS extraction_method FROM ju""",
    "d15_removal_rows": f"WITH {_AUDIT} SELECT doc_id AS document_id, verdict AS classification, reasons FROM ju WHERE verdict IN ('QUARANTINE', 'REMOVE_CANDIDATE', 'DUPLICATE')",
    "d15_issue_rows": f"WITH {_AUDIT} SELECT doc_id AS document_id, title AS original_filename, array_to_string({_TOLD}, '; ') AS issues, lang AS stored_language, language AS inferred_language, trust AS stored_trust_level, advised AS recommended_trust_level, review AS stored_review_status, advised_review AS recommended_review_status FROM ju WHERE len({_TOLD}) > 0",
    "d20_inferred": f"WITH {_FACTS} SELECT doc_id, year, author, publisher, topic FROM fa",
    "d21_metadata": f"WITH {_AUDIT}, m AS (SELECT *, CASE WHEN kind IN ('guideline', 'textbook') AND signal THEN 'high' WHEN kind = 'research_article' OR signal THEN 'medium' ELSE 'low' END AS t FROM ju) SELECT doc_id AS document_id, title AS canonical_title, title AS original_filename, author, publisher, year AS publication_year, coalesce(nullif(edition, ''), 'Unknown') AS edition, kind AS document_type, specialty AS dental_specialty, topic, level AS difficulty_level, language, t AS trust_level, CASE t WHEN 'low' THEN 'unreviewed' ELSE 'reviewed' END AS review_status, 'none' AS duplicate_group_id, fingerprint AS content_hash, method AS extraction_method FROM m",
    "d19_cleanup_job": f"""WITH {_AUDIT}, cl AS (SELECT q.doc_id // 1000000 AS doc_id, q.doc_id % 1000000 AS chunk_no, points, is_noisy, {S.n_words('q.text')} AS n_words, {S.content_hash('q.text')} AS hash FROM quality q WHERE q.doc_id // 1000000 IN (SELECT doc_id FROM ju WHERE verdict IN ('KEEP', 'REVIEW'))),
be AS (SELECT doc_id FROM cl WHERE NOT is_noisy AND n_words >= 35 QUALIFY row_number() OVER (PARTITION BY hash ORDER BY points DESC, n_words DESC, doc_id, chunk_no) = 1), ke AS (SELECT doc_id, count(*) AS n_retained FROM be GROUP BY doc_id),
ev AS (SELECT doc_id, count(*) FILTER (is_noisy) AS n_noisy, count(*) FILTER (NOT is_noisy AND n_words >= 35) AS n_good FROM cl GROUP BY doc_id) SELECT doc_id, verdict, n_chunks, coalesce(n_noisy, 0) AS n_noisy, coalesce(n_good, 0) - coalesce(n_retained, 0) AS n_duplicate, coalesce(n_retained, 0) AS n_retained FROM ju LEFT JOIN ev USING (doc_id) LEFT JOIN ke USING (doc_id)""",
}
