"""JSON lines, CSV, and idempotent copies; encrypted columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow import sqltext as S
from corpusflow.functions import text as T
from corpusflow.operators.quality import SCORED_SQL, clean
from corpusflow.shared import folder, numbered
from corpusflow.tables import table

APPROVED = ("approved", "approve", "yes", "y", "1", "true")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and malformed ones are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def approved(rows: DataFrame, flag: str, *needed: str) -> DataFrame:
    """Rows whose flag says yes and whose needed fields aren't blank."""
    keep = F.lower(F.trim(flag)).isin(*APPROVED)
    for c in needed:
        keep = keep & (F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
    return rows.where(keep)


def copied(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """target with source's rows whose key it lacks."""
    return target.unionByName(source.join(target.select(key), key, "left_anti"), allowMissingColumns=True)


def encrypted(c: Column, key: str) -> Column:
    return F.base64(F.aes_encrypt(c, F.lit(key)))


def decrypted(c: Column, key: str) -> Column:
    """The plain text; a value that isn't encrypted stays as it is."""
    return F.coalesce(F.try_aes_decrypt(F.try_to_binary(c, F.lit("base64")), F.lit(key)).cast("string"), c)


def a1_load(spark, sf):
    """Chunks of known documents, in order, with defaults for what is missing; orphans are dropped."""
    d = table(spark, sf, "documents")
    known = table(spark, sf, "labels").select("doc_id", "quality")
    rows = d.join(known, "doc_id").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("quality", F.lit(0)).alias("quality"))
    return numbered(rows, "source", "doc_id", "place")


def a3_jsonl(spark, sf):
    """Turns written as JSON lines among broken lines, and read back."""
    path = folder(spark)
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    good = c.select(F.to_json(F.struct("conv_id", "turn", "role")).alias("value"))
    bad = c.where("turn = 0").select(F.lit("{broken").alias("value")).unionByName(c.where("turn = 1").select(F.lit("").alias("value")))
    good.unionByName(bad).write.text(path)
    return read_jsonl(spark, path, "conv_id long, turn long, role string").where("conv_id IS NOT NULL")


def a4_clean_export(spark, sf):
    """Clean chunks as JSON lines, with the score as a fraction."""
    path = folder(spark)
    clean(table(spark, sf, "documents")).select("doc_id", "source", F.round(F.col("points") / 100, 3).alias("quality")).write.json(path)
    return read_jsonl(spark, path, "doc_id long, source string, quality double")


def a5_review_csv(spark, sf):
    """A review sheet with a fixed list of fields; what is missing is empty."""
    path = folder(spark)
    c = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", T.squeezed(F.col("text")).alias("question"), F.lit(None).cast("string").alias("review"))
    c.na.fill("").write.option("header", True).option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).option("quoteAll", True).option("escape", '"').csv(path)
    return spark.read.schema("conv_id long, turn long, question string, review string").option("header", True).option("escape", '"').csv(path).select("conv_id", "turn", "question", F.coalesce("review", F.lit("")).alias("review"))


def a6_approved(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").withColumn("flag", F.when(F.col("quality") == 1, " Yes ").otherwise("no"))
    return approved(d, "flag", "text", "source").select("doc_id")


def a9_copy(spark, sf):
    source = table(spark, sf, "documents").select("doc_id", "source")
    return copied(source, source.where("doc_id % 2 = 0").withColumn("source", F.lit("kept")), "doc_id")


def a10_personal_export(spark, sf):
    """What is held of each customer: orders and their lines, as counts and sums."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    line = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_lines"))
    return table(spark, sf, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left").join(line, "c_custkey", "left").na.fill(0)


def a11_encryption(spark, sf):
    """Texts encrypted and read back, every third one left plain."""
    key = "0123456789abcdef"
    d = table(spark, sf, "documents").withColumn("held", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(encrypted(F.col("text"), key)))
    return d.select("doc_id", F.md5(decrypted(F.col("held"), key)).alias("digest"))


def k1_resume(spark, sf):
    """Chunks without output yet."""
    return table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id")


def k2_prompts(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(F.concat(F.lit("Write questions on this text.\nSource: "), "source", F.lit("\n"), F.substring("text", 1, 3500))).alias("prompt"))


ITEM = "items array<struct<category:string,instruction:string,output:string>>"


def _generated(spark, sf):
    """Turns as generated JSON, some with words around it, some without items."""
    c = table(spark, sf, "conversations").where("role <> 'system'")
    body = F.to_json(F.struct(F.array(F.struct(F.when(F.col("turn") % 2 == 0, "definition").otherwise("odd").alias("category"), F.substring(T.squeezed(F.col("text")), 1, 30).alias("instruction"), F.when(F.col("turn") % 5 == 4, " ").otherwise(F.col("role")).alias("output"))).alias("items")))
    return c.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Sure: "), body, F.lit(" done"))).when(F.col("turn") % 7 == 6, F.lit("no json")).otherwise(body).alias("raw"))


CATEGORIES = ("definition", "student_explanation", "patient_question")


def _items(spark, sf):
    g = _generated(spark, sf)
    g = g.withColumn("items", F.coalesce(F.from_json("raw", ITEM)["items"], F.from_json(F.regexp_extract("raw", r"(?s)(\{.*\})", 1), ITEM)["items"]))
    i = g.select("conv_id", "turn", F.explode("items").alias("i"))
    i = i.select("conv_id", "turn", F.when(F.col("i.category").isin(*CATEGORIES), F.col("i.category")).otherwise("student_explanation").alias("category"), F.trim("i.instruction").alias("instruction"), F.trim("i.output").alias("output"))
    return g, i.where("instruction <> '' AND output <> ''")


def k4_items(spark, sf):
    return _items(spark, sf)[1].select("conv_id", "turn", "category", "output")


def k5_skipped(spark, sf):
    g, i = _items(spark, sf)
    n = i.groupBy("conv_id", "turn").agg(F.count("*").alias("n"))
    reason = F.when(F.col("items").isNull(), "no_json").when(F.col("n").isNull(), "no_valid_items").otherwise("generated")
    return g.join(n, ["conv_id", "turn"], "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("runs"))


def k6_stale(spark, sf):
    e = table(spark, sf, "events")
    last = e.agg(F.max("ts").alias("now"))
    e = e.join(F.broadcast(last))  # one row
    return e.select("event_id", F.when((F.col("event_type") == "click") & (F.col("ts") < F.col("now") - F.expr("INTERVAL 7 DAYS")), "failed").otherwise("running").alias("state"))


QUERIES = {f.__name__: f for f in (a1_load, a3_jsonl, a4_clean_export, a5_review_csv, a6_approved, a9_copy, a10_personal_export, a11_encryption, k1_resume, k2_prompts, k4_items, k5_skipped, k6_stale)}

_STATE = "CASE WHEN turn % 3 = 0 OR turn % 7 <> 6 THEN turn % 5 = 4 END"
ORACLES = {
    "a1_load": "SELECT doc_id, coalesce(source, '') AS source, coalesce(quality, 0) AS quality, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM documents JOIN labels USING (doc_id)",
    "a3_jsonl": "SELECT conv_id, turn, role FROM conversations",
    "a4_clean_export": f"WITH {SCORED_SQL} SELECT doc_id, source, round(points / 100.0::DOUBLE, 3) AS quality FROM quality JOIN (SELECT doc_id, source FROM documents) USING (doc_id) WHERE NOT is_noisy AND points >= 60",
    "a5_review_csv": f"SELECT conv_id, turn, {S.squeezed('text')} AS question, '' AS review FROM conversations WHERE role = 'user'",
    "a6_approved": "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND trim(coalesce(text, '')) <> '' AND trim(coalesce(source, '')) <> ''",
    "a9_copy": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'kept' ELSE source END AS source FROM documents",
    "a10_personal_export": "WITH o AS (SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1), l AS (SELECT o_custkey, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) SELECT c_custkey, c_name, coalesce(n_orders, 0) AS n_orders, coalesce(spent, 0) AS spent, coalesce(n_lines, 0) AS n_lines FROM customer LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN l ON l.o_custkey = c_custkey",
    "a11_encryption": "SELECT doc_id, md5(text) AS digest FROM documents",
    "k1_resume": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "k2_prompts": "SELECT doc_id, md5('Write questions on this text.' || chr(10) || 'Source: ' || source || chr(10) || substr(text, 1, 3500)) AS prompt FROM documents",
    "k4_items": f"SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'definition' ELSE 'student_explanation' END AS category, role AS output FROM conversations WHERE role <> 'system' AND (turn % 3 = 0 OR turn % 7 <> 6) AND turn % 5 <> 4 AND trim(substr({S.squeezed('text')}, 1, 30)) <> ''",
    "k5_skipped": f"SELECT CASE {_STATE} WHEN true THEN 'no_valid_items' WHEN false THEN 'generated' ELSE 'no_json' END AS reason, count(*) AS runs FROM conversations WHERE role <> 'system' GROUP BY 1",
    "k6_stale": "SELECT event_id, CASE WHEN event_type = 'click' AND ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAYS THEN 'failed' ELSE 'running' END AS state FROM events",
}
