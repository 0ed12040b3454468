"""Questions, answers and benchmark cases: routing, expansion, citation support, grounding, visuals, case building."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusflow import sqltext as S
from corpusflow.functions import text as T
from corpusflow.operators import directory, tagging
from corpusflow.operators import retrieval as R
from corpusflow.operators.quality import SCORED_SQL, scored
from corpusflow.shared import numbered, written
from corpusflow.tables import quoted as q
from corpusflow.tables import table

# Terms, templates and limits that results depend on.
LAY_TERMS = ((r"\btooth\s+ache\b", "dental pain pulpitis"), (r"\bbad\s+breath\b", "halitosis oral odor"), (r"\bhole\s+in\s+tooth\b", "dental caries cavity"), (r"\bgum\s+bleeding\b", "gingival bleeding periodontal"), (r"\bswollen\s+gums\b", "gingival swelling inflammation"), (r"\bloose\s+tooth\b", "tooth mobility periodontal"), (r"\bsensitive\s+teeth\b", "dental sensitivity dentin hypersensitivity"), (r"\byellow\s+teeth\b", "tooth discoloration staining"), (r"\bwisdom\s+tooth\b", "third molar"), (r"\bbraces\b", "orthodontic appliance fixed appliance"), (r"\bpull\s+out\b", "extraction dental extraction"))
#: Terms of the synthetic vocabulary, so that expansion takes place on it.
OWN_TERMS = ((r" the +the ", " the double "), (r" de +la ", " of the "), (r" der +die ", " article "))
MODES = ("simple", "memory", "multi_query", "hyde", "adaptive", "corrective", "self_rag", "agentic")
SUPPORT, GROUNDED = 0.4, 0.3
DISCLAIMERS = ("dental ai", "medical disclaimer", "does not replace", "consult", "professional", "disclaimer")
PATIENT = ("Would you like me to explain this in even simpler terms?", "Should I break down the key points for you?", "Want to learn about related dental care tips?")
SUGGESTIONS = {"emergency": ("What should I do first?", "When is it urgent?"), "symptom": ("What causes this?", "How is it treated?", "When should I see a dentist?"), "treatment": ("What are the risks?", "What are the alternatives?"), "research": ("Which studies are newest?", "How strong is the evidence?"), "general": ("Tell me more", "What are the sources?", "Is there a summary?")}
LEAKED = "I do not have enough relevant evidence in the uploaded documents."
SAFETY_NOTE = "\n\nSafety Note: This is educational information only. For symptoms, diagnosis, medication, or treatment decisions, consult a licensed dentist."
HEADINGS = {"dentist": "Clinical caution", "dental_student": "Clinical relevance", "patient": "When to get checked"}
NEEDS_NOTE = r"(pain|swell|bleed|medication|dose|symptom|treat|diagnos)"
CITED = r"\b(doi|isbn|et al|journal|vol\.|pp\.)\b"
HEADS = ("references", "bibliography", "index", "table of contents")
BROKEN = r"^[a-z]{1,3}(tion|ment|ing|ive|al)$"
BAD_TERMS = ("tion", "ment", "ive", "cial", "ated", "ology", "ferences", "pdfdrive", "pecific", "ative", "rossbites", "atency", "arent", "fined", "ecades")
KEY_TERMS = ("tooth", "teeth", "dental", "oral", "caries", "enamel", "gum")
#: Key terms that occur in the synthetic texts.
OWN_KEYS = ("the", "de", "der", "que")
#: Quality of a visual that a case may ask for.
VISUAL_POINTS = 55
TEMPLATES = ("What is known about {}?", "How is {} described?", "Explain {} briefly.", "Which points matter for {}?")


def contexts(c):
    """conv_id, turn, question, answer, context: assistant turns with the user turn before and all turns before that."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = c.withColumn("question", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w)).withColumn("context", F.array_join(F.collect_list("text").over(w), " "))
    return asked.where("role = 'assistant'").select("conv_id", "turn", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("text", F.lit("")).alias("answer"), "context")


def _pairs(spark, sf):
    return contexts(table(spark, sf, "conversations"))


def expanded(c, terms=LAY_TERMS):
    for pattern, by in terms:
        c = F.regexp_replace(c, f"(?i){pattern}", by)
    return c


def f10_lay_terms(spark, sf):
    """The question, and with lay terms replaced where any occurs."""
    d = table(spark, sf, "conversations").where("role = 'user'").withColumn("e", expanded(F.trim("text"), LAY_TERMS + OWN_TERMS))
    v = d.select("conv_id", "turn", F.posexplode(F.when(F.col("e") != F.trim("text"), F.array(F.trim("text"), "e")).otherwise(F.array(F.trim("text")))).alias("variant", "query"))
    return v.select("conv_id", "turn", "variant", F.md5("query").alias("query"))


def mode(asked, kind, memory=True):
    """The retrieval mode for a requested one and a question's kind."""
    m = F.lower(F.trim(F.coalesce(asked, F.lit("simple"))))
    m = F.when(m.isin(*MODES), m).otherwise("simple")
    adaptive = F.when(kind == "emergency", "simple").when(kind.isin("symptom", "treatment", "document"), "corrective").otherwise("multi_query")
    return F.when(m == "adaptive", adaptive).when((m == "simple") & F.lit(memory), "memory").otherwise(m)


def f13_modes(spark, sf):
    """Modes for requests that stand in the turn's number."""
    d = table(spark, sf, "conversations").where("role = 'user'")
    asked = F.element_at(F.array(*map(F.lit, ("Adaptive", "simple", "hyde", "no such mode"))), (F.col("conv_id") % 4 + 1).cast("int"))
    return d.select("conv_id", "turn", mode(asked, T.first_pattern(F.lower("text"), R.TYPES, F.lit("simple"))).alias("mode"))


def code_findings(question, context, word="code", sign=" *:"):
    """Up to five distinct phrases after the code that the question names: alone, first or second of two."""
    code = F.regexp_extract(F.lower(question), rf"(?:^|[^\p{{L}}\p{{N}}]){word} +([a-z0-9]+)(?:$|[^\p{{L}}\p{{N}}])", 1)
    shapes = (F.concat(F.lit(f"(?i){word} +"), code, F.lit(rf"{sign} *([^.;]+)")), F.concat(F.lit(f"(?i){word} +"), code, F.lit(rf" +and +{word} +[a-z0-9]+{sign} *([^.;]+)")), F.concat(F.lit(rf"(?i){word} +[a-z0-9]+ +and +{word} +"), code, F.lit(rf"{sign} *([^.;]+)")))
    found = F.flatten(F.array(*(F.regexp_extract_all(context, s, F.lit(1)) for s in shapes)))
    cut = F.filter(F.transform(found, lambda x: F.regexp_replace(x, "^[ ,:-]+|[ ,:-]+$", "")), lambda x: x != "")
    once = F.transform(F.array(cut), lambda a: F.filter(a, lambda x, i: F.array_position(F.transform(a, F.lower), F.lower(x)) == i + 1))[0]
    return F.when(code != "", F.slice(once, 1, 5)).otherwise(F.array().cast("array<string>"))


def g20_codes(spark, sf):
    """What the turns before say of the code that a question names, and of the word after `de`, which the synthetic questions hold."""
    p = _pairs(spark, sf).where("question <> ''")
    return p.select("conv_id", "turn", F.array_join(code_findings(F.col("question"), F.col("context")), "; ").alias("findings"), F.md5(F.array_join(code_findings(F.col("question"), F.col("context"), "de", " +"), "; ")).alias("other"))


def i5_red_flags(spark, sf):
    """Emergency words as substrings, and whether any injection pattern fits."""
    low = F.lower(F.coalesce("text", F.lit("")))
    words = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in ("bleeding", "swelling", "can't breathe", "unconscious"))))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(words, ",").alias("words"), F.element_at(F.concat(F.array_compact(F.array(*(F.when(low.rlike(f"(?i){p}"), F.lit(i)) for i, p in enumerate(tagging.INJECTION)))), F.array(F.lit(-1))), 1).alias("injection"))


def sentences(c):
    """Sentences end at .!? before white space."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, r"([.!?])[ \t\n\r]+", "$1\x01"), "\x01"), T.stripped), lambda x: x != "")


def support(sentence, context):
    """Whether enough of a sentence's distinct words of over three characters stand in the context."""
    ws = F.filter(F.array_distinct(T.words(F.lower(sentence))), lambda w: F.length(w) > 3)
    held = F.size(F.filter(ws, lambda w: F.contains(context, w)))
    return (F.size(ws) == 0) | (held >= SUPPORT * F.size(ws))


def i10_citation_support(spark, sf):
    """Sentences of an answer that the context supports or that are disclaimers; trimmed only if more than three are left."""
    p = _pairs(spark, sf).withColumn("low", F.lower("context")).withColumn("ss", sentences(F.col("answer")))
    free = lambda s: F.exists(F.array(*map(F.lit, DISCLAIMERS)), lambda d: F.contains(F.lower(s), d)) | F.startswith(s, F.lit("[")) | F.startswith(s, F.lit("**"))
    p = p.withColumn("kept", F.filter("ss", lambda s: free(s) | support(s, F.col("low"))))
    gone = F.size("ss") - F.size("kept")
    state = F.when(gone == 0, "passed").when(F.size("kept") > 3, "trimmed").otherwise("flagged_but_kept")
    return p.select("conv_id", "turn", gone.alias("removed"), state.alias("state"), F.md5(F.when(state == "trimmed", F.array_join("kept", " ")).otherwise(F.col("answer"))).alias("answer"))


def i12_suggestions(spark, sf):
    """Up to three follow-ups by mode, role and intent of a question."""
    d = table(spark, sf, "conversations").where("role = 'user'")
    intent, role = tagging.intent(F.col("text")), F.when(F.col("conv_id") % 3 == 0, "patient").otherwise("dentist")
    blocked = F.col("conv_id") % 11 == 0
    lists = F.array(*(F.lit(x) for x in PATIENT))
    other = F.array(*(F.lit(x) for x in SUGGESTIONS["general"]))
    for name, values in SUGGESTIONS.items():
        other = F.when(intent == name, F.array(*map(F.lit, values))).otherwise(other)
    chosen = F.when(blocked, F.array().cast("array<string>")).when(role == "patient", lists).otherwise(other)
    return d.select("conv_id", "turn", F.array_join(F.slice(chosen, 1, 3), "|").alias("suggestions"))


def polished(answer, question, role):
    """An answer with leaked templates replaced, headings by role, and a safety note where it is needed and lacks."""
    leaked = T.count_of(F.lower(answer), tagging.LEAKS) > 0
    out = F.trim(answer)
    for pattern, by in ((r"(?im)^[ \t]*(?:#+ *)?Direct +Answer *: *", ""), (r"(?im)^[ \t]*(?:#+ *)?Explanation *: *", "## Key points\n\n"), (r"\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, by)
    heading = F.lit(HEADINGS["patient"])
    for name, value in HEADINGS.items():
        heading = F.when(role == name, value).otherwise(heading)
    out = F.replace(F.regexp_replace(out, r"(?im)^[ \t]*(?:#+ *)?Safety +Note *: *", "\x01"), F.lit("\x01"), F.concat(F.lit("## "), heading, F.lit("\n\n")))
    out = F.when(F.startswith(out, F.lit("- ")), F.concat(F.lit("## Key points\n\n"), out)).otherwise(out)
    out = F.when(leaked, F.lit(LEAKED)).otherwise(out)
    safe = F.contains(F.lower(out), F.lit("consult")) & F.contains(F.lower(out), F.lit("dentist"))
    return F.when(F.lower(question).rlike(NEEDS_NOTE) & ~safe, F.concat(out, F.lit(SAFETY_NOTE))).otherwise(out)


def i15_polished(spark, sf):
    role = F.element_at(F.array(*map(F.lit, HEADINGS)), (F.col("conv_id") % 3 + 1).cast("int"))
    return _pairs(spark, sf).select("conv_id", "turn", F.md5(polished(F.col("answer"), F.col("question"), role)).alias("answer"))


def groundedness(answer, context):
    """Share of a text's dot-separated sentences with at least 30 % of their distinct words among the context's (an array)."""
    ss = F.filter(F.transform(F.split(answer, r"\."), T.stripped), lambda s: s != "")
    good = F.filter(ss, lambda s: F.size(F.array_intersect(F.array_distinct(T.words(F.lower(s))), context)) >= GROUNDED * F.size(F.array_distinct(T.words(F.lower(s)))))
    return F.size(good) / F.greatest(F.size(ss), F.lit(1))


def j2_groundedness(spark, sf):
    p = _pairs(spark, sf).withColumn("ws", F.array_distinct(T.words(F.lower("context"))))
    return p.select("conv_id", "turn", F.round(F.when(F.col("context") == "", 0.5).otherwise(groundedness(F.col("answer"), F.col("ws"))), 6).alias("groundedness"))


def j4_visual_accuracy(spark, sf):
    """Share of the visuals of an answer that it names."""
    return named_visuals(spark, sf).select("conv_id", "turn", F.round("accuracy", 6).alias("accuracy"))


def named_visuals(spark, sf):
    """conv_id, turn, accuracy of each answer: the share of its visuals whose title it holds, 0 without visuals. The pages whose ids follow the conversation's stand for its visuals."""
    titles = visuals(table(spark, sf, "pages")).where("title <> ''").select("page_id", F.lower("title").alias("name"))
    own = table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    near = own.select("conv_id", "turn", "low", F.explode(F.sequence(F.col("conv_id"), F.col("conv_id") + 2)).alias("page_id")).join(titles, "page_id")
    share = near.groupBy("conv_id", "turn").agg(F.avg(F.contains("low", F.col("name")).cast("int")).alias("share"))
    return own.join(share, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("share", F.lit(0.0)).alias("accuracy"))


def j6_overall(spark, sf):
    """Six scores of an answer over its context, and their mean: faithfulness, groundedness, citations, visuals, no invention, relevance."""
    ws = lambda c: F.array_distinct(T.words(F.lower(c)))
    p = _pairs(spark, sf).withColumns({"a": ws("answer"), "c": ws("context"), "w": ws("question")})
    n, none = F.greatest(F.size("a"), F.lit(1)), F.col("context") == ""
    cited = F.regexp_count("answer", F.lit(r"\[Source [0-9]+\]"))
    p = p.withColumns({
        "faithfulness": F.when(none, 0.5).otherwise(F.size(F.array_intersect("a", "c")) / n), "grounded": F.when(none, 0.5).otherwise(groundedness(F.col("answer"), F.col("c"))), "citations": F.when(cited == 0, 0.5).otherwise(F.least(F.lit(1.0), 1.0 / F.greatest(cited, F.lit(1)))),
        "known": F.when(none, 0.5).otherwise(1 - F.size(F.filter(F.array_except("a", "c"), lambda x: F.length(x) > 4)) / n), "relevance": F.size(F.array_intersect("w", "a")) / F.greatest(F.size("w"), F.lit(1)),
    })
    p = p.join(named_visuals(spark, sf).withColumnRenamed("accuracy", "visuals"), ["conv_id", "turn"])
    six = ("faithfulness", "grounded", "citations", "visuals", "known", "relevance")
    return p.select("conv_id", "turn", *(F.round(c, 6).alias(c) for c in six), F.round(sum(F.col(c) for c in six) / 6, 6).alias("overall"))


def j10_case_summary(spark, sf):
    """Cases by kind of question and in all: how many, how many passed, their mean recall."""
    c = j8_answer_cases(spark, sf).join(_pairs(spark, sf).select("conv_id", "turn", tagging.intent(F.col("question")).alias("kind")), ["conv_id", "turn"])
    g = c.rollup("kind").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"), F.round(F.avg("recall"), 4).alias("recall"))
    return g.select(F.coalesce("kind", F.lit("all")).alias("kind"), "n", "passed", "recall")


def j8_answer_cases(spark, sf):
    """A case a pair: expected terms are the question's first four keywords; recall in the answer, source match, passed."""
    p = _pairs(spark, sf).withColumn("terms", F.slice(F.array_sort(R.keywords(F.col("question"))), 1, 4))
    n, low = F.size("terms"), F.lower("answer")
    recall = F.when(n == 0, 1.0).otherwise(F.size(F.filter("terms", lambda t: F.contains(low, t))) / F.greatest(n, F.lit(1)))
    match = F.arrays_overlap(R.keywords(F.col("answer")), R.keywords(F.col("context")))
    return p.select("conv_id", "turn", F.round(recall, 4).alias("recall"), match.alias("source_match"), ((recall >= 0.8) & match).alias("passed"))


def good_case_chunk(c, keys=KEY_TERMS):
    """Whether a chunk can carry a benchmark case."""
    low = F.lower(T.squeezed(c))
    return _good(low, _long_words(low), keys)


def _long_words(low):
    return F.regexp_extract_all(low, F.lit("([A-Za-z][A-Za-z-]{3,})"), 1)


def _good(low, ws, keys):
    """`good_case_chunk` of a text squeezed and in lower case, and its words."""
    head = F.lit(False)
    for h in HEADS:
        head = head | F.contains(F.substring(low, 1, 220), F.lit(h))
    broken = F.size(F.filter(ws, lambda w: w.rlike(BROKEN)))
    return (T.n_words(low) >= 55) & ~head & (F.regexp_count(low, F.lit(CITED)) < 4) & (F.size(ws) > 0) & (broken <= 0.12 * F.size(ws)) & (T.count_of(low, keys) > 0)


def clean_terms(low):
    """The first four distinct clean words of a chunk, squeezed and in lower case."""
    ws = F.array_distinct(F.regexp_extract_all(low, F.lit("([a-z][a-z-]+)"), 1))
    return F.slice(F.filter(ws, lambda w: F.length(w).between(4, 24) & ~F.endswith(w, F.lit("-")) & ~w.isin(*BAD_TERMS) & w.rlike("[aeiou]")), 1, 4)


def case_rows(docs):
    """source, chunk_id, topic, terms, place (within its source), question: what benchmark cases are made of."""
    # What several rules need is a projection of its own, and terms are a table before they are filtered: text would be squeezed anew for every rule.
    d = docs.select("source", F.col("doc_id").alias("chunk_id"), F.lower(T.squeezed(F.col("text"))).alias("low")).withColumn("ws", _long_words(F.col("low")))
    good = written(d.select("source", "chunk_id", F.when(_good(F.col("low"), F.col("ws"), KEY_TERMS + OWN_KEYS), clean_terms(F.col("low"))).alias("terms")), "terms").where(F.size("terms") >= 3)
    good = numbered(good, "source", "chunk_id", "place")
    topic = F.concat_ws(" ", F.get("terms", F.lit(0)), F.get("terms", F.lit(1)))
    template = F.element_at(F.array(*map(F.lit, TEMPLATES)), (F.col("place") % len(TEMPLATES) + 1).cast("int"))
    detail = F.regexp_extract(F.substring(F.array_join("terms", " "), 1, 90), r"^(.*)$", 1)
    question = F.concat(F.replace(template, F.lit("{}"), topic), F.when(F.contains(topic, detail), F.lit("")).otherwise(F.concat(F.lit(" Focus on "), detail, F.lit("."))))
    return good.select("source", "chunk_id", "place", topic.alias("topic"), F.array_join("terms", ",").alias("terms"), question.alias("question"))


def j14_good_chunks(spark, sf):
    return table(spark, sf, "documents").select("doc_id", good_case_chunk(F.col("text"), KEY_TERMS + OWN_KEYS).alias("good"))


def j15_questions(spark, sf):
    return case_rows(table(spark, sf, "documents")).select("chunk_id", "topic", "terms", "question")


def j16_cases(spark, sf, text=30, visual=8, table_=10, negative=5):
    """Cases by quota: of texts, of visuals, of chunks with a table-like line, and negatives. A question is used once, by the kind that comes first; a quota takes the next in its place."""
    docs = table(spark, sf, "documents")
    rows = case_rows(docs)
    tabled = docs.where(F.exists(T.lines(F.col("text")), lambda x: x.rlike(r"\|.*\|") | x.rlike(directory.CAPTION))).select(F.col("doc_id").alias("chunk_id"))
    kinds = rows.withColumn("priority", F.lit(0)).unionByName(rows.join(tabled, "chunk_id", "left_semi").withColumn("priority", F.lit(2)))
    none = docs.where(~good_case_chunk(F.col("text"), KEY_TERMS + OWN_KEYS)).select("source", F.col("doc_id").alias("chunk_id"), F.concat(F.lit("What does no document say about "), F.col("doc_id").cast("string"), F.lit("?")).alias("question"), F.lit(3).alias("priority"))
    shown = visuals(table(spark, sf, "pages")).where((F.col("points") >= VISUAL_POINTS) & (F.col("title") != ""))
    shown = shown.select(F.col("host").alias("source"), F.col("page_id").alias("chunk_id"), F.concat(F.lit("What does the "), "kind", F.lit(" of "), "title", F.lit(" show?")).alias("question"), F.lit(1).alias("priority"))
    every = kinds.select("source", "chunk_id", "question", "priority").unionByName(none).unionByName(shown)
    once = every.groupBy("question").agg(F.min(F.struct("priority", "chunk_id")).alias("k")).select("question", "k.priority", "k.chunk_id")
    # A quota's first rows by chunk_id: each range gives its own first ones, then those few are numbered.
    quota = F.element_at(F.array(F.lit(text), F.lit(visual), F.lit(table_), F.lit(negative)), F.col("priority") + 1)
    some = once.withColumn("r", F.row_number().over(Window.partitionBy("priority", F.pmod(F.xxhash64("question"), F.lit(64))).orderBy("chunk_id", "question"))).where(F.col("r") <= quota)
    r = F.row_number().over(Window.partitionBy("priority").orderBy("chunk_id", "question"))
    return some.withColumn("r", r).where(F.col("r") <= quota).select("priority", "chunk_id", "question", "r")


# Visuals: pages stand for them, their headings and paragraphs for captions and nearby text.
def visuals_points():
    h = F.lower("html")
    return 25 + 10 * F.contains(h, F.lit("<h1")).cast("int") + 15 * F.contains(h, F.lit("<p")).cast("int") + 10 * F.contains(h, F.lit("<img")).cast("int") + 15 * (F.regexp_count("html", F.lit("<p[ >]")) >= 5).cast("int")


def visuals(pages):
    """page_id, title, caption (first paragraph), kind, quality (points), host."""
    h = F.lower("html")
    clean = lambda c: T.squeezed(F.regexp_replace(c, "<[^>]*>", " "))
    return pages.select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("host"), clean(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title"), clean(F.regexp_extract("html", r"(?s)<p>(.*?)</p>", 1)).alias("caption"), T.first_match(h, directory.VISUALS, F.lit("figure")).alias("kind"), visuals_points().alias("points"))


def chosen_captions(captions, kind, index):
    """struct(best, nearest, of_table): by kind, by the place of an image (from 1), and the n-th that names a table."""
    fit = F.filter(captions, lambda c: F.contains(F.lower(c), kind))
    first = F.coalesce(F.get(captions, F.lit(0)), F.lit(""))
    tables = F.filter(captions, lambda c: F.contains(F.lower(c), F.lit("table")))
    return F.struct(F.coalesce(F.get(fit, F.lit(0)), first).alias("best"), F.coalesce(F.get(captions, F.least(index, F.size(captions)) - 1), F.lit("")).alias("nearest"), F.coalesce(F.get(tables, F.least(index, F.size(tables)) - 1), F.concat(F.lit("Table "), index.cast("string"))).alias("of_table"))


def h3_captions(spark, sf):
    """Paragraphs of a page as captions, chosen for the page's kind of visual."""
    p = table(spark, sf, "pages").select("page_id", T.first_match(F.lower("html"), directory.VISUALS, F.lit("figure")).alias("kind"), F.transform(F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), 1), lambda c: T.squeezed(F.regexp_replace(c, "<[^>]*>", " "))).alias("cs"))
    c = chosen_captions(F.col("cs"), F.col("kind"), (F.col("page_id") % 5 + 1).cast("int"))
    return p.withColumn("c", c).select("page_id", F.md5("c.best").alias("best"), F.md5("c.nearest").alias("nearest"), F.md5("c.of_table").alias("of_table"))


#: Visuals a query that are looked at, best first, and those that are kept.
LOOKED_AT, KEPT_VISUALS = 250, 8


def related_ids(pages):
    """page_id, chunk_id: the chunks that a page is related to: every number of its address and of its links, once."""
    ids = F.regexp_extract_all(F.concat_ws(" ", "url", F.array_join(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1), " ")), F.lit("(?:^|[^0-9])([0-9]{1,15})(?![0-9])"), 1)
    return pages.select("page_id", F.explode(F.array_distinct(F.transform(ids, lambda x: x.cast("long")))).alias("chunk_id"))


def linked_visuals(chunks, pages, looked=LOOKED_AT, k=KEPT_VISUALS):
    """query_id, page_id, n_related, same_page, place: of the best visuals by quality that share a related id with a query's chunks, or stand on one's page, the first k.

    chunks: query_id, chunk_id. Sets meet by their exploded ids; what they share is counted.
    """
    rows = pages.select("page_id", visuals_points().alias("points"))
    shared = chunks.join(related_ids(pages), "chunk_id").groupBy("query_id", "page_id").agg(F.count("*").alias("n_related"))
    same = chunks.select("query_id", F.col("chunk_id").alias("page_id"), F.lit(1).alias("own")).join(pages.select("page_id"), "page_id", "left_semi")
    both = shared.join(same, ["query_id", "page_id"], "full").select("query_id", "page_id", F.coalesce("n_related", F.lit(0)).alias("n_related"), F.col("own").isNotNull().alias("same_page")).join(rows, "page_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("points"), "page_id")
    best = both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= looked)
    return best.where(F.col("place") <= k).select("query_id", "page_id", "n_related", "same_page", "place")


def h7_linked(spark, sf):
    """Visuals linked with the five best chunks of each query."""
    best = R.top(R.bm25(R._queries(spark, sf), R._chunks(spark, sf)), 5).select("query_id", "chunk_id")
    return linked_visuals(best, table(spark, sf, "pages"))


def visual_hits(spark, sf, least=45):
    """query_id, chunk_id (the page), score: BM25 over titles and captions of visuals of some quality."""
    v = visuals(table(spark, sf, "pages")).where(F.col("points") >= least)
    return R.bm25(R._queries(spark, sf), v.select(F.col("page_id").alias("chunk_id"), F.concat_ws(" ", "title", "caption").alias("text")))


def h6_visual_search(spark, sf):
    return R.top(visual_hits(spark, sf), 12).select("query_id", F.col("chunk_id").alias("page_id"), "rank")


def reranked_visuals(spark, sf):
    """query_id, page_id, score, wants: visuals found, with lexical, page, caption and quality parts."""
    found = R.top(visual_hits(spark, sf), 12).select("query_id", F.col("chunk_id").alias("page_id"), F.col("score").alias("found"))
    v = visuals(table(spark, sf, "pages")).select("page_id", "caption", "points", F.lower(F.concat_ws(" ", "title", "caption")).alias("low"))
    asked = R._queries(spark, sf).select("query_id", R.keywords(F.col("text")).alias("terms"), F.lower("text").rlike("(figure|table|image|photo)").alias("wants"))
    best = R.top(R.bm25(R._queries(spark, sf), R._chunks(spark, sf)), 3).select("query_id", F.col("chunk_id").alias("page_id"), F.lit(1).alias("same_page"))
    r = found.join(v, "page_id").join(asked, "query_id").join(best, ["query_id", "page_id"], "left")
    lexical = F.size(F.filter("terms", lambda t: F.contains(F.col("low"), t)))
    score = F.col("found") + 0.18 * lexical + F.when(F.col("wants"), 0.5).otherwise(0.0) + F.when(F.col("same_page") == 1, 0.45).otherwise(0.0) + F.when(F.col("caption") != "", 0.25).otherwise(0.0) + 0.45 * F.greatest(F.lit(0.0), F.col("points") / 100 - 0.45)
    return r.select("query_id", "page_id", F.round(score, 5).alias("score"), "wants")


def h9_rerank(spark, sf):
    r = reranked_visuals(spark, sf)
    return r.select("query_id", "page_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "page_id")).alias("place"))


def h10_threshold(spark, sf, least=8.0, k=4):
    """Visuals above the threshold (three quarters of it if visuals are asked for); else above 70 % of that; the tier is a query's."""
    r = written(reranked_visuals(spark, sf), "visuals").withColumn("t", F.when(F.col("wants"), 0.75 * least).otherwise(least))
    w = Window.partitionBy("query_id")
    tier = F.when(F.max((F.col("score") >= F.col("t")).cast("int")).over(w) == 1, 1).otherwise(2)
    r = r.withColumn("tier", tier).where(F.col("score") >= F.when(F.col("tier") == 1, F.col("t")).otherwise(0.7 * F.col("t")))
    r = r.withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "page_id"))).where(F.col("place") <= k)
    return r.select("query_id", "page_id", "tier", "place")


def h11_caption_match(spark, sf):
    """For a query and its best visual: whether caption and title hold enough of its words, and the confidence in points."""
    best = R.top(visual_hits(spark, sf), 1).select("query_id", F.col("chunk_id").alias("page_id"))
    v = visuals(table(spark, sf, "pages")).select("page_id", "caption", "title")
    r = best.join(v, "page_id").join(R._queries(spark, sf), "query_id")
    r = r.withColumns({"qw": F.array_distinct(T.words(F.lower("text"))), "cw": F.array_distinct(T.words(F.lower("caption"))), "tw": F.array_distinct(T.words(F.lower("title")))})
    both = F.size(F.array_intersect("qw", F.array_union("cw", "tw")))
    match = both >= F.greatest(F.lit(2.0), 0.3 * F.size("qw"))
    own = F.when((F.size("qw") > 0) & (F.size("cw") > 0), F.least(F.lit(0.2), 0.2 * F.size(F.array_intersect("qw", "cw")) / F.size("qw"))).otherwise(0.0)
    score = F.when(F.length("caption") > 20, 0.3).otherwise(0.0) + F.when(match, 0.3).otherwise(0.0) + F.when(F.length("title") > 10, 0.2).otherwise(0.0) + own
    return r.select("query_id", "page_id", match.alias("matched"), F.round(F.least(F.lit(1.0), score), 5).alias("confidence"))


QUERIES = {f.__name__: f for f in (f10_lay_terms, f13_modes, g20_codes, h3_captions, h6_visual_search, h7_linked, h9_rerank, h10_threshold, h11_caption_match, i5_red_flags, i10_citation_support, i12_suggestions, i15_polished, j2_groundedness, j4_visual_accuracy, j6_overall, j10_case_summary, j8_answer_cases, j14_good_chunks, j15_questions, j16_cases)}

_CTX = """cx0 AS (SELECT conv_id, turn, role, text, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER w AS question, string_agg(text, ' ') OVER w AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cx AS (SELECT conv_id, turn, coalesce(question, '') AS question, coalesce(text, '') AS answer, coalesce(context, '') AS context FROM cx0 WHERE role = 'assistant')"""
_EXP = "trim(text)"
for _pattern, _by in LAY_TERMS + OWN_TERMS:
    _EXP = f"regexp_replace({_EXP}, {q('(?i)' + _pattern)}, {q(_by)}, 'g')"


def _codes(word: str, sign: str) -> str:
    code = f"regexp_extract(lower(question), '(?:^|[^\\p{{L}}\\p{{N}}]){word} +([a-z0-9]+)(?:$|[^\\p{{L}}\\p{{N}}])', 1)"
    shapes = (f"'(?i){word} +' || {code} || '{sign} *([^.;]+)'", f"'(?i){word} +' || {code} || ' +and +{word} +[a-z0-9]+{sign} *([^.;]+)'", f"'(?i){word} +[a-z0-9]+ +and +{word} +' || {code} || '{sign} *([^.;]+)'")
    found = f"list_filter(list_transform(list_concat({', '.join(f'regexp_extract_all(context, {s}, 1)' for s in shapes)}), lambda x: regexp_replace(x, '^[ ,:-]+|[ ,:-]+$', '', 'g')), lambda x: x <> '')"
    return f"CASE WHEN {code} <> '' THEN array_to_string(list_filter({found}, lambda x, i: list_position(list_transform({found}, lambda y: lower(y)), lower(x)) = i)[:5], '; ') ELSE '' END"


_SS = f"list_filter(list_transform(string_split(regexp_replace(answer, '([.!?])[ \\t\\n\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {S.stripped('x')}), lambda x: x <> '')"
_LONG = f"list_filter(list_distinct({S.words('lower(s)')}), lambda w: length(w) > 3)"
_FREE = f"({S.any_of('lower(s)', DISCLAIMERS)} OR starts_with(s, '[') OR starts_with(s, '**'))"
_POL = "trim(answer)"
for _pattern, _by in ((r"(?im)^[ \t]*(?:#+ *)?Direct +Answer *: *", ""), (r"(?im)^[ \t]*(?:#+ *)?Explanation *: *", "## Key points\n\n"), (r"\n{3,}", "\n\n"), (r"(?im)^[ \t]*(?:#+ *)?Safety +Note *: *", "\x01")):
    _POL = f"regexp_replace({_POL}, {q(_pattern)}, {q(_by)}, 'g')"
_GW = f"list_distinct({S.words('lower(s)')})"
_GOODCASE = f"""gc0 AS (SELECT doc_id, source, text, {S.squeezed('text')} AS t FROM documents), gc1 AS (SELECT *, lower(t) AS low, regexp_extract_all(lower(t), '[A-Za-z][A-Za-z-]{{3,}}') AS ws, regexp_extract_all(lower(t), '[a-z][a-z-]+') AS tw FROM gc0),
gc AS (SELECT *, {S.n_words('t')} >= 55 AND NOT {S.any_of('substr(low, 1, 220)', HEADS)} AND {S.count('low', CITED)} < 4 AND len(ws) > 0 AND len(list_filter(ws, lambda w: regexp_matches(w, {q(BROKEN)}))) <= 0.12 * len(ws) AND {S.any_of('low', KEY_TERMS + OWN_KEYS)} AS good FROM gc1)"""
# The first of equal words is told by its position, as DuckDB's list_distinct keeps no order.
_TERMS = f"(list_filter(tw, lambda w, i: length(w) BETWEEN 4 AND 24 AND NOT ends_with(w, '-') AND w NOT IN ({', '.join(map(q, BAD_TERMS))}) AND regexp_matches(w, '[aeiou]') AND list_position(tw, w) = i))[:4]"
_CASES = f"""{_GOODCASE}, ct0 AS (SELECT source, doc_id AS chunk_id, {_TERMS} AS terms FROM gc WHERE good), ct1 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY chunk_id) - 1 AS place, terms[1] || ' ' || terms[2] AS topic, substr(array_to_string(terms, ' '), 1, 90) AS detail FROM ct0 WHERE len(terms) >= 3),
cs AS (SELECT source, chunk_id, topic, array_to_string(terms, ',') AS terms, replace([{', '.join(map(q, TEMPLATES))}][place % {len(TEMPLATES)} + 1], '{{}}', topic) || CASE WHEN contains(topic, detail) THEN '' ELSE ' Focus on ' || detail || '.' END AS question FROM ct1)"""
_PTAG = lambda c: S.squeezed(f"regexp_replace({c}, '<[^>]*>', ' ', 'g')")
_VIS = f"""vi AS (SELECT page_id, {_PTAG("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title, {_PTAG("regexp_extract(html, '(?s)<p>(.*?)</p>', 1)")} AS caption,
 {S.first_match('lower(html)', directory.VISUALS, q('figure'))} AS kind, 25 + 10 * contains(lower(html), '<h1')::INT + 15 * contains(lower(html), '<p')::INT + 10 * contains(lower(html), '<img')::INT + 15 * ({S.count('html', '<p[ >]')} >= 5)::INT AS points FROM pages), vd AS (SELECT page_id AS doc_id, concat_ws(' ', title, caption) AS text, '' AS source FROM vi WHERE points >= 45)"""
_VBM = f"{_VIS}, {R._BM25.replace('FROM documents', 'FROM vd')}"
_DBM = R._BM25
for _n in ("ct", "term", "tf", "df", "st", "qt", "qn", "bm", "rk"):
    import re as _re

    _DBM = _re.sub(rf"(?<![\w.']){_n} AS \(", f"d_{_n} AS (", _DBM)
    _DBM = _re.sub(rf"(FROM|JOIN) {_n}(?![\w])", rf"\1 d_{_n}", _DBM)
_DBM = _DBM.replace(", st GROUP", ", d_st GROUP").replace("FROM d_qn JOIN", "FROM d_qn JOIN")
_RV = f"""{_VBM}, {_DBM}, rv AS (SELECT rk.query_id, rk.chunk_id AS page_id, regexp_matches(lower(be.text), '(figure|table|image|photo)') AS wants,
 round(rk.score + 0.18::DOUBLE * len(list_filter({R._keywords('be.text')}, lambda t: contains(lower(concat_ws(' ', vi.title, vi.caption)), t))) + CASE WHEN wants THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN d.chunk_id IS NOT NULL THEN 0.45::DOUBLE ELSE 0 END + CASE WHEN vi.caption <> '' THEN 0.25::DOUBLE ELSE 0 END + 0.45::DOUBLE * greatest(0, vi.points / 100.0::DOUBLE - 0.45::DOUBLE), 5) AS score
 FROM rk JOIN vi ON vi.page_id = rk.chunk_id JOIN benchmark be ON be.item_id = rk.query_id LEFT JOIN (SELECT query_id, chunk_id FROM d_rk WHERE rank <= 3) d ON d.query_id = rk.query_id AND d.chunk_id = rk.chunk_id WHERE rk.rank <= 12)"""
_CAPS = f"list_transform(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), lambda c: {_PTAG('c')})"

_NAMED = f"""{_VIS}, na AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS low, conv_id + d AS page_id FROM conversations, (VALUES (0), (1), (2)) t(d) WHERE role = 'assistant'),
nv AS (SELECT conv_id, turn, coalesce(avg(contains(low, lower(title))::INT), 0) AS accuracy FROM na LEFT JOIN (SELECT page_id, title FROM vi WHERE title <> '') USING (page_id) GROUP BY ALL)"""

ORACLES = {
    "f10_lay_terms": f"WITH e AS (SELECT conv_id, turn, trim(text) AS t, {_EXP} AS e FROM conversations WHERE role = 'user') SELECT conv_id, turn, 0 AS variant, md5(t) AS query FROM e UNION ALL SELECT conv_id, turn, 1, md5(e) FROM e WHERE e <> t",
    "f13_modes": f"WITH k AS (SELECT conv_id, turn, conv_id % 4 AS m, {S.first_pattern('lower(text)', R.TYPES, q('simple'))} AS kind FROM conversations WHERE role = 'user') SELECT conv_id, turn, CASE m WHEN 0 THEN CASE WHEN kind = 'emergency' THEN 'simple' WHEN kind IN ('symptom', 'treatment', 'document') THEN 'corrective' ELSE 'multi_query' END WHEN 2 THEN 'hyde' ELSE 'memory' END AS mode FROM k",
    "g20_codes": f"WITH {_CTX}, f AS (SELECT conv_id, turn, {_codes('code', ' *:')} AS findings, md5({_codes('de', ' +')}) AS other FROM cx WHERE question <> '') SELECT * FROM f",
    "h3_captions": f"WITH c AS (SELECT page_id, {_CAPS} AS cs, {S.first_match('lower(html)', directory.VISUALS, q('figure'))} AS kind, page_id % 5 + 1 AS i FROM pages), t AS (SELECT *, list_filter(cs, lambda c: contains(lower(c), kind)) AS fit, list_filter(cs, lambda c: contains(lower(c), 'table')) AS tb FROM c) SELECT page_id, md5(coalesce(fit[1], cs[1], '')) AS best, md5(coalesce(cs[least(i, len(cs))], '')) AS nearest, md5(CASE WHEN len(tb) > 0 THEN tb[least(i, len(tb))] ELSE 'Table ' || i END) AS of_table FROM t",
    "h6_visual_search": f"WITH {_VBM} SELECT query_id, chunk_id AS page_id, rank FROM rk WHERE rank <= 12",
    "h7_linked": f"""WITH {R._BM25}, {_VIS}, ch AS (SELECT query_id, chunk_id FROM rk WHERE rank <= 5), ids AS (SELECT page_id, list_distinct(list_transform(regexp_extract_all(concat_ws(' ', url, array_to_string(regexp_extract_all(html, 'href="([^"]*)"', 1), ' ')), '[0-9]+'), lambda x: try_cast(x AS BIGINT))) AS ids FROM pages),
qc AS (SELECT query_id, list(chunk_id) AS cs FROM ch GROUP BY query_id), li AS (SELECT query_id, page_id, len(list_intersect(cs, ids)) AS n_related, list_contains(cs, page_id) AS same_page FROM qc JOIN ids ON list_has_any(cs, ids) OR list_contains(cs, page_id))
SELECT query_id, page_id, n_related, same_page, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, page_id) AS place FROM li JOIN vi USING (page_id) QUALIFY place <= {KEPT_VISUALS}""",
    "h9_rerank": f"WITH {_RV} SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS place FROM rv",
    "h10_threshold": f"WITH {_RV}, t AS (SELECT *, CASE WHEN wants THEN 6.0 ELSE 8.0 END AS t FROM rv), u AS (SELECT *, CASE WHEN max((score >= t)::INT) OVER (PARTITION BY query_id) = 1 THEN 1 ELSE 2 END AS tier FROM t) SELECT query_id, page_id, tier, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS place FROM u WHERE score >= CASE WHEN tier = 1 THEN t ELSE 0.7 * t END QUALIFY place <= 4",
    "h11_caption_match": f"WITH {_VBM}, b AS (SELECT query_id, chunk_id AS page_id, caption, title, list_distinct({S.words('lower(be.text)')}) AS qw, list_distinct({S.words('lower(caption)')}) AS cw, list_distinct({S.words('lower(title)')}) AS tw FROM rk JOIN vi ON vi.page_id = chunk_id JOIN benchmark be ON be.item_id = query_id WHERE rank = 1), m AS (SELECT *, len(list_intersect(qw, list_distinct(list_concat(cw, tw)))) >= greatest(2.0, 0.3 * len(qw)) AS matched FROM b) SELECT query_id, page_id, matched, round(least(1.0::DOUBLE, CASE WHEN length(caption) > 20 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN matched THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN length(title) > 10 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN len(qw) > 0 AND len(cw) > 0 THEN least(0.2::DOUBLE, 0.2::DOUBLE * len(list_intersect(qw, cw)) / len(qw)) ELSE 0 END), 5) AS confidence FROM m",
    "i5_red_flags": "SELECT conv_id, turn, concat_ws(',', " + ", ".join(f"CASE WHEN contains(lower(coalesce(text, '')), {q(w)}) THEN {q(w)} END" for w in ("bleeding", "swelling", "can't breathe", "unconscious")) + "), CASE " + " ".join(f"WHEN {S.matches('lower(text)', '(?i)' + p)} THEN {i}" for i, p in enumerate(tagging.INJECTION)) + " ELSE -1 END AS injection FROM conversations",
    "i10_citation_support": f"WITH {_CTX}, s AS (SELECT *, lower(context) AS low, {_SS} AS ss FROM cx), k AS (SELECT *, list_filter(ss, lambda s: {_FREE} OR len({_LONG}) = 0 OR len(list_filter({_LONG}, lambda w: contains(low, w))) >= {SUPPORT} * len({_LONG})) AS kept FROM s), t AS (SELECT *, len(ss) - len(kept) AS removed, CASE WHEN len(ss) = len(kept) THEN 'passed' WHEN len(kept) > 3 THEN 'trimmed' ELSE 'flagged_but_kept' END AS state FROM k) SELECT conv_id, turn, removed, state, md5(CASE WHEN state = 'trimmed' THEN array_to_string(kept, ' ') ELSE answer END) AS answer FROM t",
    "i12_suggestions": f"WITH i AS (SELECT conv_id, turn, {S.first_match('lower(text)', tagging.INTENTS, q('general'))} AS intent FROM conversations WHERE role = 'user') SELECT conv_id, turn, CASE WHEN conv_id % 11 = 0 THEN '' WHEN conv_id % 3 = 0 THEN {q('|'.join(PATIENT[:3]))} " + " ".join(f"WHEN intent = '{k}' THEN {q('|'.join(v[:3]))}" for k, v in SUGGESTIONS.items()) + f" ELSE {q('|'.join(SUGGESTIONS['general']))} END AS suggestions FROM i",
    "i15_polished": f"WITH {_CTX}, r AS (SELECT *, ['dentist', 'dental_student', 'patient'][conv_id % 3 + 1] AS role, {_POL} AS p FROM cx), h AS (SELECT *, replace(p, chr(1), '## ' || CASE role " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in HEADINGS.items()) + f" END || chr(10) || chr(10)) AS o FROM r), k AS (SELECT *, CASE WHEN {S.any_of('lower(answer)', tagging.LEAKS)} THEN {q(LEAKED)} WHEN starts_with(o, '- ') THEN '## Key points' || chr(10) || chr(10) || o ELSE o END AS f FROM h) SELECT conv_id, turn, md5(CASE WHEN regexp_matches(lower(question), {q(NEEDS_NOTE)}) AND NOT (contains(lower(f), 'consult') AND contains(lower(f), 'dentist')) THEN f || {q(SAFETY_NOTE)} ELSE f END) AS answer FROM k",
    "j2_groundedness": f"WITH {_CTX}, s AS (SELECT *, list_distinct({S.words('lower(context)')}) AS cw, list_filter(list_transform(string_split(answer, '.'), lambda x: {S.stripped('x')}), lambda x: x <> '') AS ss FROM cx) SELECT conv_id, turn, round(CASE WHEN context = '' THEN 0.5::DOUBLE ELSE len(list_filter(ss, lambda s: len(list_intersect({_GW}, cw)) >= {GROUNDED} * len({_GW}))) / greatest(len(ss), 1)::DOUBLE END, 6) AS groundedness FROM s",
    "j4_visual_accuracy": f"WITH {_NAMED} SELECT conv_id, turn, round(accuracy, 6) AS accuracy FROM nv",
    "j8_answer_cases": f"WITH {_CTX}, t AS (SELECT *, (list_sort({R._keywords('question')}))[:4] AS terms, list_has_any({R._keywords('answer')}, {R._keywords('context')}) AS source_match FROM cx), r AS (SELECT *, CASE WHEN len(terms) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(terms, lambda t: contains(lower(answer), t))) / len(terms)::DOUBLE END AS recall FROM t) SELECT conv_id, turn, round(recall, 4) AS recall, source_match, recall >= 0.8 AND source_match AS passed FROM r",
    "j6_overall": f"""WITH {_CTX}, {_NAMED}, s AS (SELECT *, list_distinct({S.words('lower(answer)')}) AS a, list_distinct({S.words('lower(context)')}) AS cw, list_distinct({S.words('lower(question)')}) AS w, list_filter(list_transform(string_split(answer, '.'), lambda x: {S.stripped('x')}), lambda x: x <> '') AS ss, {S.count('answer', '[[]Source [0-9]+[]]')} AS cited FROM cx),
x AS (SELECT conv_id, turn, CASE WHEN context = '' THEN 0.5::DOUBLE ELSE len(list_intersect(a, cw)) / greatest(len(a), 1)::DOUBLE END AS faithfulness, CASE WHEN context = '' THEN 0.5::DOUBLE ELSE len(list_filter(ss, lambda s: len(list_intersect({_GW}, cw)) >= {GROUNDED} * len({_GW}))) / greatest(len(ss), 1)::DOUBLE END AS grounded,
 CASE WHEN cited = 0 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, 1.0::DOUBLE / cited) END AS citations, CASE WHEN context = '' THEN 0.5::DOUBLE ELSE 1 - len(list_filter(a, lambda x: length(x) > 4 AND NOT list_contains(cw, x))) / greatest(len(a), 1)::DOUBLE END AS known, len(list_intersect(w, a)) / greatest(len(w), 1)::DOUBLE AS relevance FROM s), y AS (SELECT x.*, nv.accuracy AS visuals FROM x JOIN nv USING (conv_id, turn))
SELECT conv_id, turn, round(faithfulness, 6) AS faithfulness, round(grounded, 6) AS grounded, round(citations, 6) AS citations, round(visuals, 6) AS visuals, round(known, 6) AS known, round(relevance, 6) AS relevance, round((faithfulness + grounded + citations + visuals + known + relevance) / 6, 6) AS overall FROM y""",
    "j14_good_chunks": f"WITH {_GOODCASE} SELECT doc_id, good FROM gc",
    "j15_questions": f"WITH {_CASES} SELECT chunk_id, topic, terms, question FROM cs",
    "j16_cases": f"""WITH {_CASES}, {_VIS}, tb AS (SELECT doc_id AS chunk_id FROM documents WHERE len(list_filter({S.lines('text')}, lambda x: regexp_matches(x, '\\|.*\\|') OR {S.matches('x', directory.CAPTION)})) > 0),
ev AS (SELECT chunk_id, question, 0 AS priority FROM cs UNION ALL SELECT chunk_id, question, 2 FROM cs JOIN tb USING (chunk_id) UNION ALL SELECT doc_id, 'What does no document say about ' || doc_id || '?', 3 FROM gc WHERE NOT good
  UNION ALL SELECT page_id, 'What does the ' || kind || ' of ' || title || ' show?', 1 FROM vi WHERE points >= {VISUAL_POINTS} AND title <> ''),
oc AS (SELECT question, priority, chunk_id FROM ev QUALIFY row_number() OVER (PARTITION BY question ORDER BY priority, chunk_id) = 1) SELECT priority, chunk_id, question, row_number() OVER (PARTITION BY priority ORDER BY chunk_id, question) AS r FROM oc QUALIFY r <= [30, 8, 10, 5][priority + 1]""",
}
ORACLES["j10_case_summary"] = f"WITH c AS ({ORACLES['j8_answer_cases']}), {_CTX.replace('cx0', 'cy0').replace('cx AS', 'cy AS')}, k AS (SELECT c.*, {S.first_match('lower(question)', tagging.INTENTS, q('general'))} AS kind FROM c JOIN cy USING (conv_id, turn)) SELECT coalesce(kind, 'all') AS kind, count(*) AS n, count(*) FILTER (passed) AS passed, round(avg(recall), 4) AS recall FROM k GROUP BY ROLLUP (kind)"
ORACLES["i5_red_flags"] = ORACLES["i5_red_flags"].replace("END), CASE", "END) AS words, CASE")
