"""Queries on chunk quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow import sqltext as S
from corpusflow.functions import quality as Q
from corpusflow.functions import text as T
from corpusflow.shared import written
from corpusflow.tables import quoted as q
from corpusflow.tables import table


def measured(docs, line_aware=False):
    """`scored`, with what its rules read: _c (the text squeezed), _lc, _ls (its lines), _wc (its `word_counts`)."""
    # A text without odd white space has no line ends: it is one line, and squeezed but for its blanks.
    d = docs.withColumn("_odd", F.coalesce(F.col("text").rlike(T.ODD_SPACE_OR_NUL), F.lit(True)))
    one = F.filter(F.array(F.trim("text")), lambda x: x != "")
    d = d.withColumns({"_c": F.when(F.col("_odd") | F.contains("text", F.lit("  ")), T.squeezed(F.col("text"))).otherwise(F.trim("text")), "_ls": F.when(F.col("_odd"), T.lines(F.col("text"))).otherwise(one)}).withColumn("_lc", F.lower("_c"))
    d = d.withColumns({"_wc": Q.word_counts("_c"), "_rl": Q.repeated_lines(F.col("_ls"))})
    parts = [F.col(x) for x in ("_c", "_lc", "_wc", "_ls", "_rl")]
    d = d.withColumn("_fired", Q.fired_rules(*parts, line_aware))
    d = d.withColumns({"points": F.greatest(F.lit(0), 100 - F.aggregate("_fired", F.lit(0), lambda a, x: a + x["cost"])), "reasons": F.transform("_fired", lambda x: x["reason"])})
    return d.withColumn("is_noisy", (F.col("points") < 60) | F.arrays_overlap("reasons", F.array(*map(F.lit, Q.HARD)))).drop("_odd", "_rl", "_fired")


def scored(docs, line_aware=False):
    """docs with points (0 to 100), is_noisy and reasons. What several rules need is a projection of its own, so nothing is evaluated twice."""
    return measured(docs, line_aware).drop("_c", "_lc", "_ls", "_wc")


def clean(docs, least=60):
    """doc_id, source, points of documents that aren't noisy and have the least points. Scores are a table first: the filter would be pushed below them and score anew for each of its terms."""
    d = written(scored(docs).select("doc_id", "source", "points", "is_noisy"), "scored")
    return d.where(~F.col("is_noisy") & (F.col("points") >= least)).drop("is_noisy")


def c1_quality_score(spark, sf):
    d = scored(table(spark, sf, "documents"))
    return d.select("doc_id", "points", "is_noisy", F.array_join("reasons", ",").alias("reasons"))


def c10_line_rules(spark, sf):
    """The rules on lines, on the text's own lines."""
    d = table(spark, sf, "documents").withColumn("ls", T.lines(F.col("text")))
    return d.select("doc_id", Q.table_of_contents(F.col("ls")).alias("contents_page"), Q.table_or_form(F.col("ls")).alias("form_layout"))


def c14_survey_question(spark, sf):
    d = table(spark, sf, "conversations")
    return d.select("conv_id", "turn", Q.survey_question(F.col("text")).alias("is_survey"))


def second_scored(docs):
    """docs with second_points and second_reasons, of the cleanup scorer. As in `scored`, what several rules need is a projection of its own."""
    d = docs.withColumn("_c", T.squeezed(F.col("text")))
    d = d.withColumns({"_lc": F.lower("_c"), "_missing": F.replace("_c", F.lit(" "), F.lit("")), "_n": T.n_words(F.col("_c")), "_lengths": F.transform(F.regexp_extract_all("_c", F.lit(f"({T.LATIN_WORD_OR_LETTER})"), 1), F.length)})
    short = F.size(F.filter("_lengths", lambda n: n <= 2))
    rules = [
        ("very_short_text", F.col("_n") < 35, 35),
        ("administrative_text", F.col("_lc").rlike(ADMIN), 35),
        ("symbol_density", Q.letters_missing(F.col("_missing")) > 0.42, 40),
        ("short_word_garbage", (F.size("_lengths") > 40) & (100 * short > 45 * F.size("_lengths")), 30),
    ]
    d = d.withColumn("_second", F.filter(F.array(*(F.when(cond, F.struct(F.lit(n).alias("reason"), F.lit(cost).alias("cost"))) for n, cond, cost in rules)), lambda x: x.isNotNull()))
    return d.withColumns({"second_points": F.greatest(F.lit(0), 100 - F.aggregate("_second", F.lit(0), lambda a, x: a + x["cost"])), "second_reasons": F.transform("_second", lambda x: x["reason"])}).drop("_c", "_lc", "_missing", "_n", "_lengths", "_second")


ADMIN = r"questionnaire|interviewer|respondent|all rights reserved|copyright|isbn"


def c15_cleanup_score(spark, sf):
    d = second_scored(table(spark, sf, "documents"))
    return d.select("doc_id", F.col("second_points").alias("points"), F.array_join("second_reasons", ",").alias("reasons"))


def c16_effective_score(spark, sf):
    """A stored score of zero counts as missing; noisy if stored or computed says so."""
    labels = table(spark, sf, "labels").select("doc_id", (100 * F.col("quality")).alias("stored"), (F.col("toxic") == 1).alias("marked"))
    d = scored(table(spark, sf, "documents")).join(labels, "doc_id", "left")
    points = F.coalesce(F.expr("nullif(stored, 0)"), F.col("points"), F.lit(0))
    return d.select("doc_id", points.cast("int").alias("points"), (F.coalesce("marked", F.lit(False)) | F.col("is_noisy")).alias("is_noisy"))


def c17_symbol_density(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.floor(1000 * Q.letters_missing(F.regexp_replace("text", f"{T.SPACE}+", ""))).alias("per_mille"))


QUERIES = {"c1_quality_score": c1_quality_score, "c10_line_rules": c10_line_rules, "c14_survey_question": c14_survey_question, "c15_cleanup_score": c15_cleanup_score, "c16_effective_score": c16_effective_score, "c17_symbol_density": c17_symbol_density}


def _missing(c: str) -> str:
    compact = f"regexp_replace({c}, {q(T.SPACE)}, '', 'g')"
    return f"CASE WHEN {compact} = '' THEN 1.0 ELSE 1 - {S.count(compact, chr(92) + 'p{L}')} / length({compact})::DOUBLE END"


def _strip_marks(c: str) -> str:
    return f"regexp_replace({c}, '^[ .:-]+|[ .:-]+$', '', 'g')"


SCORED_SQL = f"""
a AS (SELECT doc_id, text, {S.squeezed('text')} AS c, lower({S.squeezed('text')}) AS lc FROM documents),
b AS (SELECT *, {S.count_of('lc', Q.FORM_TERMS)} AS form, {S.count_of('lc', Q.SCALE_TERMS)} AS scale,
  regexp_extract_all(c, {q(T.LATIN_WORD_OR_LETTER)}) AS ws, regexp_extract_all(lc, {q(T.LATIN_WORD)}) AS rw,
  list_filter(list_transform({S.lines('text')}, lambda x: lower(x)), lambda x: length(x) >= 4 AND length(x) <= 80) AS rl FROM a),
r AS (SELECT *, list_filter([
  CASE WHEN {S.count('c', T.WORD)} < 35 THEN {{'reason': 'very_short_text', 'cost': 35}} END,
  CASE WHEN contains(lc, '{Q.ARTEFACT}') THEN {{'reason': 'who_form_artifact_h17040', 'cost': 55}} END,
  CASE WHEN form > 0 THEN {{'reason': 'questionnaire_or_form_text', 'cost': 35 + 8 * least(form, 3)}} END,
  CASE WHEN scale >= 3 THEN {{'reason': 'questionnaire_scale_options', 'cost': 35}} END,
  CASE WHEN {S.matches(_strip_marks('lc'), Q.HEADING_AT_END)} THEN {{'reason': 'reference_index_or_bibliography', 'cost': 30}} END,
  CASE WHEN {S.count('lc', Q.CITATION)} >= 8 AND {S.count('c', T.LATIN_WORD)} < 240 THEN {{'reason': 'references_only_page', 'cost': 45}} END,
  CASE WHEN {_missing('c')} > 0.38 THEN {{'reason': 'mostly_symbols_numbers_or_table_artifacts', 'cost': 40}} END,
  CASE WHEN {' OR '.join(S.matches('lc', p) for p in Q.GARBAGE)} OR (len(ws) >= 30 AND (100 * len(list_filter(ws, lambda w: length(w) <= 2)) > 35 * len(ws)
    OR len(list_filter(ws, lambda w: length(w) >= 5 AND NOT regexp_matches(w, '[aeiouAEIOU]'))) >= 4)) THEN {{'reason': 'ocr_or_layout_garbage', 'cost': 45}} END,
  CASE WHEN len(rw) >= 30 AND 100 * len(list_filter(list_zip(rw[:-2], rw[2:]), lambda p: p[1] = p[2])) > 18 * len(rw) THEN {{'reason': 'repeated_text', 'cost': 25}} END,
  CASE WHEN len(rl) >= 4 AND 100 * (len(rl) - len(list_distinct(rl))) > 35 * len(rl) THEN {{'reason': 'repeated_headers_or_footers', 'cost': 25}} END
  ], lambda x: x IS NOT NULL) AS fired FROM b),
scored AS (SELECT doc_id, text, greatest(0, 100 - coalesce(list_sum(list_transform(fired, lambda x: x.cost)), 0))::INT AS points,
  list_transform(fired, lambda x: x.reason) AS reasons FROM r),
quality AS (SELECT *, points < 60 OR list_has_any(reasons, [{', '.join(map(q, Q.HARD))}]) AS is_noisy FROM scored)
"""

ORACLES = {
    "c1_quality_score": f"WITH {SCORED_SQL} SELECT doc_id, points, is_noisy, array_to_string(reasons, ',') AS reasons FROM quality",
    "c10_line_rules": f"""WITH l AS (SELECT doc_id, {S.lines('text')} AS ls FROM documents)
SELECT doc_id, len(ls) >= 4 AND {_strip_marks('lower(ls[1])')} IN ('contents', 'table of contents') AND len(list_filter(ls, lambda x: {S.matches('x', Q.TOC_LINE)})) >= 3 AS contents_page,
  len(ls) >= 3 AND ((100 * len(list_filter(ls, lambda x: length(x) < 55)) > 65 * len(ls) AND len(list_filter(ls, lambda x: {S.matches('x', Q.OPTION_LINE)})) >= 2)
  OR len(list_filter(ls, lambda x: {S.matches('x', Q.NUMERIC_LINE)})) >= 4) AS form_layout FROM l""",
    "c14_survey_question": f"SELECT conv_id, turn, {' OR '.join(S.matches('lower(text)', p) for p in Q.SURVEY)} AS is_survey FROM conversations",
    "c15_cleanup_score": f"""WITH a AS (SELECT doc_id, {S.squeezed('text')} AS c FROM documents), b AS (SELECT *, regexp_extract_all(c, {q(T.LATIN_WORD_OR_LETTER)}) AS ws FROM a),
f AS (SELECT doc_id, {S.n_words('c')} < 35 AS r1, {S.matches('lower(c)', ADMIN)} AS r2, {_missing('c')} > 0.42 AS r3, len(ws) > 40 AND 100 * len(list_filter(ws, lambda w: length(w) <= 2)) > 45 * len(ws) AS r4 FROM b)
SELECT doc_id, greatest(0, 100 - 35 * r1::INT - 35 * r2::INT - 40 * r3::INT - 30 * r4::INT)::INT AS points,
  concat_ws(',', CASE WHEN r1 THEN 'very_short_text' END, CASE WHEN r2 THEN 'administrative_text' END, CASE WHEN r3 THEN 'symbol_density' END, CASE WHEN r4 THEN 'short_word_garbage' END) AS reasons FROM f""",
    "c16_effective_score": f"WITH {SCORED_SQL} SELECT d.doc_id, coalesce(nullif(100 * l.quality, 0), d.points, 0)::INT AS points, coalesce(l.toxic = 1, false) OR d.is_noisy AS is_noisy FROM quality d LEFT JOIN labels l USING (doc_id)",
    "c17_symbol_density": f"SELECT doc_id, floor(1000 * ({_missing('text')}))::BIGINT AS per_mille FROM documents",
}
