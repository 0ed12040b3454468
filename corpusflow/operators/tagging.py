"""Safety, intent and answer checks on conversation tables, and their evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusflow import sqltext as S
from corpusflow.functions import text as T
from corpusflow.tables import quoted as q
from corpusflow.tables import table

# Patterns that verdicts depend on.
EMERGENCY = (r"(difficulty|trouble)\s+(breathing|swallowing)", r"facial\s+swelling\s+(spreading|rapid)", r"uncontrollable\s+bleeding", r"swollen\s+eye", r"cellulitis", r"trismus|lockjaw", r"severe\s+(pain|trauma)", r"(knocked|avuls)\s+out", r"abscess\s+(with|and)\s+fever")
UNSAFE = (r"how\s+(to|can\s+I)\s+(extract|remove|pull)\s+(my\s+)?(own\s+)?tooth", r"self[\s-]?(extract|medicate|diagnose|surgery)", r"home\s+remedy\s+(for|to)\s+(treat|cure)\s+(cavity|abscess|infection)", r"can\s+I\s+(ignore|skip|avoid)\s+(treatment|filling|root.canal|extraction)", r"how\s+to\s+(make|prepare|mix)\s+(dental|tooth)\s+(filling|cement|material)\s+at\s+home", r"how\s+to\s+(prescribe|recommend)\s+(antibiotics|medication|drug)\s+for", r"what\s+dosage\s+of\s+\w+\s+(for|should)")
INJECTION = (r"ignore\s+(all\s+)?(previous\s+)?(instructions|rules|prompts|directives)", r"forget\s+(all\s+)?(previous\s+)?(context|rules|instructions)", r"you\s+are\s+now\s+a?\s*(doctor|dentist|surgeon|hacker|assistant)\s+without", r"act\s+as\s+(if\s+you\s+are|though\s+you\s+are)\s+", r"override\s+(your\s+)?(system|safety|guidelines|protocol)", r"disregard\s+(your\s+)?(protocol|guidelines|rules|safety)", r"new\s+role\s*:\s*", r"((system|main)\s+)?prompt\s*:", r"you\s+must\s+(now\s+)?ignore\s+", r"no\s+(ethical|moral|safety|medical)\s+(guidelines|restrictions|boundaries|limits)")
MISUSE = (r"how\s+to\s+(overdose|abuse|misuse)\s+", r"get\s+high\s+(on|from|with)", r"(sale|buy|purchase)\s+(without\s+)?prescription", r"(fake|forged|falsify)\s+prescription")
REDACTED = "[redacted: instructional content in source document]"
INTENTS = (("bleeding", "emergency"), ("emergency", "emergency"), ("image", "image_analysis"), ("photo", "image_analysis"), ("x-ray", "image_analysis"), ("treat", "treatment"), ("filling", "treatment"), ("pain", "symptom"), ("swell", "symptom"), ("research", "research"), ("study", "research"), ("literature", "research"), ("evidence", "research"), ("paper", "research"), ("journal", "research"), ("prescription", "prescription_explain"), ("medication", "prescription_explain"), ("dosage", "prescription_explain"), ("drug", "prescription_explain"), ("report", "report_explain"), ("lab", "report_explain"), ("result", "report_explain"), ("referral", "report_explain"), ("differential", "clinical_decision"), ("guideline", "clinical_decision"), ("contraindication", "clinical_decision"), ("material", "clinical_decision"), ("simple", "patient_education"), ("layman", "patient_education"), ("easy", "patient_education"), ("basic", "patient_education"), ("hello", "conversational"), ("thank", "conversational"))
#: Topics of the synthetic vocabulary, so that each branch is taken.
TOPIC_SETS = (("things", ("thing", "ther")), ("actions", ("tion", "ation")), ("waters", ("eau", "leau")), ("ends", ("ing", "ent")))
ROLES = (("doctor", "dentist"), ("dentist", "dentist"), ("student", "dental_student"), ("user", "patient"), ("patient", "patient"))


def flags(c, patterns, name):
    """name:index for each pattern that a lower-cased text matches."""
    return F.array_compact(F.array(*(F.when(c.rlike(f"(?i){p}"), F.lit(f"{name}:{i}")) for i, p in enumerate(patterns))))


def safety(c):
    """struct(emergency, unsafe, misuse, injection): matched patterns; injection stops at the first."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.struct(flags(low, EMERGENCY, "medical_emergency").alias("emergency"), flags(low, UNSAFE, "unsafe_advice").alias("unsafe"), flags(low, MISUSE, "drug_misuse").alias("misuse"), F.slice(flags(low, INJECTION, "prompt_injection"), 1, 1).alias("injection"))


def verdict(s):
    return F.when(F.size(s["emergency"]) > 0, "emergency").when(F.size(s["injection"]) > 0, "injection").when(F.size(s["misuse"]) > 0, "misuse").when(F.size(s["unsafe"]) > 0, "unsafe").otherwise("pass")


def redacted(c):
    out = c
    for p in INJECTION:
        out = F.regexp_replace(out, f"(?i){p}", REDACTED)
    return out


def intent(c):
    return T.first_match(F.lower(F.coalesce(c, F.lit(""))), INTENTS, F.lit("general"))


def topics(c):
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.array_compact(F.array(*(F.when(T.count_of(low, needles) > 0, F.lit(name)) for name, needles in TOPIC_SETS)))


def word_set(c):
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({T.WORD_CHAR}+)"), 1))


def pairs(c):
    """Each assistant turn with the latest user turn before it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = c.withColumn("question", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w))
    return asked.where("role = 'assistant'").select("conv_id", "turn", "question", F.col("text").alias("answer"))


def i1_safety_flags(spark, sf):
    d = table(spark, sf, "conversations").withColumn("s", safety(F.col("text")))
    return d.select("conv_id", "turn", *(F.size(f"s.{k}").alias(k) for k in ("emergency", "unsafe", "misuse", "injection")))


def i2_verdict(spark, sf):
    return table(spark, sf, "conversations").withColumn("s", safety(F.col("text"))).select("conv_id", "turn", verdict(F.col("s")).alias("verdict"))


def i3_redaction(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(redacted(F.col("text"))).alias("digest"))


def i4_intent(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", intent(F.col("text")).alias("intent"))


GREETING = r"^(hi|hello|hey|thanks?|thank you|bye)[ .!?]*$"


def i6_direct_answer(spark, sf):
    d = table(spark, sf, "conversations")
    return d.select("conv_id", "turn", F.trim(F.lower("text")).rlike(GREETING).alias("direct"))


def i7_roles(spark, sf):
    return table(spark, sf, "conversations").groupBy(T.first_match(F.lower("role"), ROLES, F.lit("patient")).alias("user_role")).agg(F.count("*").alias("n"))


PRESCRIBING = (r"(^|[^a-z0-9_])take +[0-9]+", r"(^|[^a-z0-9_])mg([^a-z0-9_]|$)", r"(^|[^a-z0-9_])tablet([^a-z0-9_]|$)", r"(^|[^a-z0-9_])prescribe([^a-z0-9_]|$)", r"(^|[^a-z0-9_])antibiotic[^a-z0-9_\n](.*[^a-z0-9_\n])?(days?|daily|twice)([^a-z0-9_]|$)")
CAREFUL = ("pain", "dard", "swelling", "fever", "bleeding", "pus", "trauma", "pregnancy", "child", "children", "medicine", "medication", "antibiotic", "dose", "infection")
ROMAN, NOT_ROMAN = ("roman urdu", "hinglish", "in roman"), r"[\x{600}-\x{6FF}\x{750}-\x{77F}\x{8A0}-\x{8FF}\x{900}-\x{97F}]"
GROUNDED_TERMS = 0.25


def self_check(question, answer, context, role):
    """Array of what an answer fails: grounding in context or question, prescribing (but to dentists), a missing safety note, another script than asked for. question, answer, context: lower case."""
    terms = F.array_distinct(F.regexp_extract_all(answer, F.lit("([a-z][a-z-]{2,})"), 1))
    good = F.size(F.filter(terms, lambda t: F.contains(context, t) | F.contains(question, t)))
    prescribes = F.lit(False)
    for p in PRESCRIBING:
        prescribes = prescribes | answer.rlike(p)
    noted = F.contains(answer, F.lit("consult")) | F.contains(answer, F.lit("dentist"))
    return F.array_compact(F.array(
        F.when((context != "") & (F.size(terms) > 0) & (good < GROUNDED_TERMS * F.size(terms)), F.lit("ungrounded")), F.when((role != "dentist") & prescribes, F.lit("prescribing_language")),
        F.when((T.count_of(question, CAREFUL) > 0) & ~noted, F.lit("missing_safety_note")), F.when((T.count_of(question, ROMAN) > 0) & answer.rlike(NOT_ROMAN), F.lit("language_mismatch"))))


def i8_self_check(spark, sf):
    """The four checks of each answer, over the turns before it; every third conversation is a dentist's."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    low = F.lower(F.coalesce("text", F.lit("")))
    c = table(spark, sf, "conversations").withColumns({"low": low, "question": F.coalesce(F.last(F.when(F.col("role") == "user", low), ignorenulls=True).over(w), F.lit("")), "context": F.array_join(F.collect_list(low).over(w), " ")})
    role = F.when(F.col("conv_id") % 3 == 0, "dentist").otherwise("patient")
    return c.where("role = 'assistant'").select("conv_id", "turn", F.array_join(self_check(F.col("question"), F.col("low"), F.col("context"), role), ",").alias("reasons"))


LEAKS = ("as an ai", "system prompt", "[insert", "{{", "lorem ipsum")


def i9_leaks(spark, sf):
    d = table(spark, sf, "conversations").where("role = 'assistant'")
    return d.select("conv_id", "turn", (T.count_of(F.lower("text"), LEAKS) > 0).alias("leaked"))


def i13_topics(spark, sf):
    """Topic counters of a conversation."""
    d = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", F.explode(topics(F.col("text"))).alias("topic"))
    return d.groupBy("conv_id", "topic").agg(F.count("*").alias("n"))


def i14_memory_titles(spark, sf):
    """The five latest conversations' first lines, by source of the id; equal titles once, the latest kept."""
    c = table(spark, sf, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by(F.substring("text", 1, 40), "turn").alias("title"))
    c = c.withColumn("user_id", F.col("conv_id") % 7)
    latest = c.groupBy("user_id", "title").agg(F.max("conv_id").alias("conv_id"))
    return latest.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("conv_id")))).where("r <= 5")


def j1_answer_scores(spark, sf):
    """J1, J5, J6: shares of answer words found in the question, of long words that aren't, of question words answered."""
    p = pairs(table(spark, sf, "conversations")).withColumns({"a": word_set(F.col("answer")), "b": word_set(F.col("question"))})
    both = F.size(F.array_intersect("a", "b"))
    novel = F.size(F.filter(F.array_except("a", "b"), lambda w: F.length(w) > 4))
    return p.select("conv_id", "turn", F.when(F.size("b") == 0, 0.5).otherwise(both / F.greatest(F.size("a"), F.lit(1))).alias("faithfulness"), (1 - novel / F.greatest(F.size("a"), F.lit(1))).alias("supported"), (both / F.greatest(F.size("b"), F.lit(1))).alias("relevance"))


def j3_citations(spark, sf):
    d = table(spark, sf, "conversations").where("role = 'assistant'")
    return d.select("conv_id", "turn", F.least(F.lit(1.0), F.regexp_count("text", F.lit(r"(?i)source [0-9]+")) / 3.0).alias("accuracy"))


def j7_ranking(spark, sf, k=10):
    """precision, recall, reciprocal rank, DCG and its ratio to the best at k for every twentieth vector; relevant: the same label. The discount is the bit length of the rank."""
    from corpusflow.operators.retrieval import cosine_top

    v = table(spark, sf, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    label = v.select("vec_id", "label")
    r = cosine_top(asked, v, k + 1).where("vec_id <> query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= k)
    r = r.join(label, "vec_id").join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id").withColumn("hit", (F.col("label") == F.col("own")).cast("int"))
    gain = F.col("hit") / F.length(F.bin(F.col("rank").cast("long")))
    every = label.groupBy("label").agg((F.count("*") - 1).alias("relevant"))
    g = r.groupBy("query_id", "own").agg(F.sum("hit").alias("hits"), F.coalesce(F.max(F.when(F.col("hit") == 1, 1 / F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank"), F.sum(gain).alias("dcg"))
    g = g.join(every, F.col("own") == F.col("label"))
    best = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("relevant").cast("int")))), lambda i: 1 / F.length(F.bin(i.cast("long")))), F.lit(0.0), lambda a, x: a + x)
    recall = F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")).otherwise(0.0)
    ndcg = F.when(F.col("relevant") > 0, F.col("dcg") / best).otherwise(0.0)
    return g.select("query_id", (F.col("hits") / k).alias("precision"), F.round(recall, 6).alias("recall"), "reciprocal_rank", "dcg", F.round(ndcg, 6).alias("ndcg"))


def j10_summary(spark, sf):
    """Pass rates of conversations by role, and in all."""
    d = table(spark, sf, "conversations").withColumn("passed", (T.n_words(F.col("text")) >= 10).cast("int"))
    return d.rollup("role").agg(F.count("*").alias("n"), F.sum("passed").alias("passed")).select(F.coalesce("role", F.lit("all")).alias("role"), "n", "passed")


def j12_gate(spark, sf):
    d = j10_summary(spark, sf).where("role = 'all'")
    return d.select((F.col("passed") >= 0.7 * F.col("n")).alias("pass_rate_ok"), (F.col("n") > 0).alias("has_cases"))


def j13_balanced(spark, sf):
    """The twelve largest documents of each source."""
    d = table(spark, sf, "documents")
    return d.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).where("r <= 12").select("source", "doc_id", "r")


QUERIES = {f.__name__: f for f in (i1_safety_flags, i2_verdict, i3_redaction, i4_intent, i6_direct_answer, i7_roles, i8_self_check, i9_leaks, i13_topics, i14_memory_titles, j1_answer_scores, j3_citations, j7_ranking, j10_summary, j12_gate, j13_balanced)}


def _n(patterns, first=False) -> str:
    total = "(" + " + ".join(f"{S.matches('lower(text)', '(?i)' + p)}::INT" for p in patterns) + ")"
    return f"least(1, {total})" if first else total


_SAFE = f"s AS (SELECT conv_id, turn, {_n(EMERGENCY)} AS emergency, {_n(UNSAFE)} AS unsafe, {_n(MISUSE)} AS misuse, {_n(INJECTION, True)} AS injection FROM conversations)"
_RED = "text"
for _p in INJECTION:
    _RED = f"regexp_replace({_RED}, {q('(?i)' + _p)}, {q(REDACTED)}, 'g')"
_SET = lambda c: f"list_distinct(regexp_extract_all(lower(coalesce({c}, '')), {q(T.WORD_CHAR + '+')}))"
_PAIRS = f"""p AS (SELECT conv_id, turn, role, text AS answer, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question FROM conversations),
ab AS (SELECT conv_id, turn, {_SET('answer')} AS a, {_SET('question')} AS b FROM p WHERE role = 'assistant')"""
_TOPICS = ", ".join(f"CASE WHEN {S.any_of('lower(text)', needles)} THEN {q(name)} END" for name, needles in TOPIC_SETS)

ORACLES = {
    "i1_safety_flags": f"WITH {_SAFE} SELECT * FROM s",
    "i2_verdict": f"WITH {_SAFE} SELECT conv_id, turn, CASE WHEN emergency > 0 THEN 'emergency' WHEN injection > 0 THEN 'injection' WHEN misuse > 0 THEN 'misuse' WHEN unsafe > 0 THEN 'unsafe' ELSE 'pass' END AS verdict FROM s",
    "i3_redaction": f"SELECT doc_id, md5({_RED}) AS digest FROM documents",
    "i4_intent": f"SELECT conv_id, turn, {S.first_match('lower(text)', INTENTS, q('general'))} AS intent FROM conversations",
    "i6_direct_answer": f"SELECT conv_id, turn, {S.matches('trim(lower(text))', GREETING)} AS direct FROM conversations",
    "i7_roles": f"SELECT {S.first_match('lower(role)', ROLES, q('patient'))} AS user_role, count(*) AS n FROM conversations GROUP BY 1",
    "i8_self_check": f"""WITH l AS (SELECT *, lower(coalesce(text, '')) AS low FROM conversations), c AS (SELECT conv_id, turn, role, low, coalesce(last_value(CASE WHEN role = 'user' THEN low END IGNORE NULLS) OVER w, '') AS question, coalesce(string_agg(low, ' ') OVER w, '') AS context FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, list_distinct(regexp_extract_all(low, '[a-z][a-z-]{{2,}}')) AS terms FROM c WHERE role = 'assistant') SELECT conv_id, turn, concat_ws(',', CASE WHEN context <> '' AND len(terms) > 0 AND len(list_filter(terms, lambda t: contains(context, t) OR contains(question, t))) < {GROUNDED_TERMS} * len(terms) THEN 'ungrounded' END,
 CASE WHEN conv_id % 3 <> 0 AND ({' OR '.join(S.matches('low', p) for p in PRESCRIBING)}) THEN 'prescribing_language' END, CASE WHEN {S.any_of('question', CAREFUL)} AND NOT contains(low, 'consult') AND NOT contains(low, 'dentist') THEN 'missing_safety_note' END, CASE WHEN {S.any_of('question', ROMAN)} AND {S.matches('low', NOT_ROMAN)} THEN 'language_mismatch' END) AS reasons FROM t""",
    "i9_leaks": f"SELECT conv_id, turn, {S.any_of('lower(text)', LEAKS)} AS leaked FROM conversations WHERE role = 'assistant'",
    "i13_topics": f"WITH t AS (SELECT conv_id, unnest([{_TOPICS}]) AS topic FROM conversations WHERE role = 'user') SELECT conv_id, topic, count(*) AS n FROM t WHERE topic IS NOT NULL GROUP BY ALL",
    "i14_memory_titles": "WITH c AS (SELECT conv_id, arg_min(substr(text, 1, 40), turn) AS title, conv_id % 7 AS user_id FROM conversations WHERE role = 'user' GROUP BY conv_id), l AS (SELECT user_id, title, max(conv_id) AS conv_id FROM c GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY conv_id DESC) AS r FROM l QUALIFY r <= 5",
    "j1_answer_scores": f"WITH {_PAIRS} SELECT conv_id, turn, CASE WHEN len(b) = 0 THEN 0.5 ELSE len(list_intersect(a, b)) / greatest(len(a), 1)::DOUBLE END AS faithfulness, 1 - len(list_filter(a, lambda w: length(w) > 4 AND NOT list_contains(b, w))) / greatest(len(a), 1)::DOUBLE AS supported, len(list_intersect(a, b)) / greatest(len(b), 1)::DOUBLE AS relevance FROM ab",
    "j3_citations": "SELECT conv_id, turn, least(1.0::DOUBLE, len(regexp_extract_all(text, '(?i)source [0-9]+')) / 3.0::DOUBLE) AS accuracy FROM conversations WHERE role = 'assistant'",
    "j7_ranking": """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[64] AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id, a.label = b.label AS hit, array_cosine_similarity(a.e, b.e) AS score FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s QUALIFY rank <= 10),
g AS (SELECT query_id, sum(hit::INT) AS hits, coalesce(max(CASE WHEN hit THEN 1.0::DOUBLE / rank END), 0.0) AS reciprocal_rank, sum(hit::INT / length(bin(rank))::DOUBLE) AS dcg FROM r GROUP BY query_id),
l AS (SELECT vec_id AS query_id, count(*) OVER (PARTITION BY label) - 1 AS relevant FROM v)
SELECT query_id, hits / 10.0 AS precision, round(CASE WHEN relevant > 0 THEN hits / relevant::DOUBLE ELSE 0 END, 6) AS recall, reciprocal_rank, dcg, round(CASE WHEN relevant > 0 THEN dcg / list_sum(list_transform(range(1, least(10, relevant) + 1), lambda i: 1.0::DOUBLE / length(bin(i)))) ELSE 0 END, 6) AS ndcg FROM g JOIN l USING (query_id)""",
    "j10_summary": f"SELECT coalesce(role, 'all') AS role, count(*) AS n, sum(({S.n_words('text')} >= 10)::INT) AS passed FROM conversations GROUP BY ROLLUP (role)",
    "j12_gate": f"SELECT sum(({S.n_words('text')} >= 10)::INT) >= 0.7 * count(*) AS pass_rate_ok, count(*) > 0 AS has_cases FROM conversations",
    "j13_balanced": "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents QUALIFY r <= 12",
}
