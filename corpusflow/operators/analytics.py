"""Bookings, intervals, reviews, retention and dashboards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusflow.operators.tagging import pairs
from corpusflow.tables import table

#: Which event may follow which, for a user.
ALLOWED = (("signup", "view"), ("view", "click"), ("view", "view"), ("click", "purchase"), ("click", "view"), ("purchase", "view"), ("error", "view"))


def overlaps(intervals, key, start, end, id_):
    """Intervals that overlap an earlier one of their key, by the latest end among rows before: a window, no self-join."""
    w = Window.partitionBy(key).orderBy(start, id_).rowsBetween(Window.unboundedPreceding, -1)
    return intervals.withColumn("latest_end", F.max(end).over(w)).withColumn("conflict", F.coalesce(F.col("latest_end") > F.col(start), F.lit(False)))


def m1_search(spark, sf):
    """Open orders of a segment, newest first, third page of twenty."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"))
    return o.where("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20).select("o_orderkey", "c_name", "o_totalprice")


def m2_upcoming(spark, sf):
    """The three earliest open orders of each customer from a date on."""
    o = table(spark, sf, "orders").where("o_orderdate >= timestamp'1995-01-01' AND o_orderstatus IN ('O', 'P')")
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return o.withColumn("r", r).where("r <= 3").select("o_custkey", "o_orderkey", "r")


def m3_overlap(spark, sf):
    """Events as intervals of their value in hours."""
    e = table(spark, sf, "events").where("value > 0").select("event_id", "user_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * 3600e6)).alias("stop"), F.unix_micros(F.col("ts").cast("timestamp")).alias("start"))
    return overlaps(e, "user_id", "start", "stop", "event_id").select("event_id", "conflict")


def m4_transitions(spark, sf):
    """Events that may not follow the user's one before."""
    e = table(spark, sf, "events")
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    ok = F.concat_ws(">", "before", "event_type").isin(*(f"{a}>{b}" for a, b in ALLOWED))
    return e.withColumn("before", before).select("event_id", (F.col("before").isNull() | ok).alias("valid"))


def m5_availability(spark, sf):
    """Hours of a weekday, and whether a booking starts in them."""
    e = table(spark, sf, "events").select(F.dayofweek("ts").alias("day"), F.date_format("ts", "HH:mm").alias("at"))
    slots = spark.range(7 * 8).select((F.col("id") % 7 + 1).cast("int").alias("day"), F.format_string("%02d:00", 9 + F.expr("id div 7")).alias("slot"), F.format_string("%02d:00", 10 + F.expr("id div 7")).alias("stop"))
    e = e.withColumn("slot", F.concat(F.substring("at", 1, 2), F.lit(":00"))).groupBy("day", "slot").agg(F.count("*").alias("n"))
    return slots.join(e, ["day", "slot"], "left").select("day", "slot", (F.coalesce("n", F.lit(0)) > 0).alias("booked"))


def m6_records(spark, sf):
    """Line items with their order's and customer's facts, newest first, a page of fifty."""
    l = table(spark, sf, "lineitem").where("l_quantity >= 45")  # noqa: E741
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").where(F.lower("c_name").contains("1"))
    return j.orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber").limit(50).select("l_orderkey", "l_linenumber", "c_name")


def rated(spark, sf):
    """Assistant turns with a rating made of labels."""
    r = table(spark, sf, "labels").select(F.col("doc_id").alias("conv_id"), (1 + 2 * F.col("quality") + 2 * (1 - F.col("toxic"))).alias("rating"))
    return pairs(table(spark, sf, "conversations")).join(r, "conv_id")


def m7_feedback(spark, sf):
    """Low ratings, worst first, with the latest question before the answer."""
    return rated(spark, sf).where("rating <= 3").select("conv_id", "turn", "rating", F.md5(F.coalesce("question", F.lit(""))).alias("question"))


def m8_unreviewed(spark, sf):
    """The oldest hundred assistant turns without a review."""
    p = pairs(table(spark, sf, "conversations")).join(table(spark, sf, "labels").select(F.col("doc_id").alias("conv_id")), "conv_id", "left_anti")
    return p.orderBy("conv_id", "turn").limit(100).select("conv_id", "turn")


def m9_review_upsert(spark, sf):
    """One review a conversation; the later wins."""
    a = table(spark, sf, "labels").select("doc_id", "quality", F.lit(0).alias("version"))
    b = a.where("doc_id % 5 = 0").select("doc_id", (1 - F.col("quality")).alias("quality"), F.lit(1).alias("version"))
    return a.unionByName(b).groupBy("doc_id").agg(F.max_by("quality", "version").alias("quality"))


def m10_review_summary(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality").isNull()).alias("unreviewed"), F.count_if(F.expr("quality = 1")).alias("good"), F.count_if(F.expr("toxic = 1")).alias("toxic"))


def m11_dashboard(spark, sf):
    c = table(spark, sf, "conversations")
    return c.agg(F.count_if(F.expr("role = 'assistant'")).alias("answers"), F.count_if(F.expr("role = 'assistant' AND trim(text) = ''")).alias("empty_answers"), F.countDistinct("conv_id").alias("sessions"), F.round(F.avg(F.when(F.col("role") == "assistant", F.length("text"))), 3).alias("mean_chars"))


def m12_queue(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal < 0")
    return c.withColumn("place", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_acctbal", "c_custkey"))).where("place <= 10").select("c_mktsegment", "c_custkey", "place")


def m13_logs(spark, sf):
    """The last five events of each user."""
    e = table(spark, sf, "events")
    return e.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).where("r <= 5").select("user_id", "event_id", "r")


def m14_sessions(spark, sf):
    """Conversations with their last eight turns, oldest first."""
    c = table(spark, sf, "conversations")
    c = c.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("r <= 8")
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",").alias("roles"))


def m15_categories(spark, sf):
    return table(spark, sf, "documents").where("n_chars > 200").groupBy("source").agg(F.count("*").alias("n"))


def m16_retention(spark, sf):
    """Sessions whose last event is older than their user's days, 90 where nothing is set."""
    e = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("updated_at"))
    s = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 60 + 1).cast("int").alias("days"))
    j = e.join(s, "user_id", "left").withColumn("days", F.coalesce("days", F.lit(90)))
    last = table(spark, sf, "events").agg(F.max("ts").alias("now"))
    return j.join(F.broadcast(last)).select("user_id", (F.datediff(F.to_date("now"), F.to_date("updated_at")) > F.col("days")).alias("expired"))  # one row


def m17_expiry(spark, sf):
    e = table(spark, sf, "events")
    last = e.agg(F.max("ts").alias("now"))
    old = F.datediff(F.to_date("now"), F.to_date("ts")) > 10
    return e.join(F.broadcast(last)).agg(F.count_if(old & (F.col("event_type") != "error")).alias("counted"), F.count_if(old).alias("deleted"), F.count_if(~old).alias("kept"))  # one row


def m18_access_log(spark, sf):
    """Audit counts by day and action."""
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def m19_token_usage(spark, sf):
    return table(spark, sf, "conversations").groupBy("role").agg(F.sum(F.greatest(F.lit(1), F.floor(F.length("text") / 4))).alias("tokens"))


def m20_active(spark, sf):
    return table(spark, sf, "events").where("event_type <> 'error'").groupBy("user_id").agg(F.countDistinct(F.to_date("ts")).alias("days"))


def l4_slugs(spark, sf):
    s = table(spark, sf, "supplier")
    slug = F.regexp_replace(F.regexp_replace(F.lower("s_name"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return s.select("s_suppkey", slug.alias("slug"), F.sha2(F.concat_ws("|", "s_name", F.col("s_nationkey").cast("string")), 256).alias("profile_hash"))


def l7_match(spark, sf):
    """New profiles matched by key first, then by name."""
    old = table(spark, sf, "supplier").where("s_suppkey % 4 <> 0")
    new = table(spark, sf, "supplier").select((F.col("s_suppkey") + F.when(F.col("s_suppkey") % 3 == 0, 1_000_000).otherwise(0)).alias("key"), "s_name")
    by_key = new.join(old.select(F.col("s_suppkey").alias("key"), F.col("s_suppkey").alias("k")), "key", "left")
    both = by_key.join(old.groupBy("s_name").agg(F.min("s_suppkey").alias("n")), "s_name", "left")
    return both.select("key", F.coalesce("k", "n").alias("matched"))


def l8_upsert(spark, sf):
    """Unchanged, updated (only by what is given) or inserted profiles."""
    old = table(spark, sf, "supplier").where("s_suppkey % 5 <> 0").select("s_suppkey", F.col("s_name").alias("old_name"), F.col("s_acctbal").alias("old_bal"))
    new = table(spark, sf, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name")).alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")).alias("bal"))
    j = new.join(old, "s_suppkey", "left")
    name = F.coalesce(F.expr("nullif(name, '')"), F.col("old_name"))
    action = F.when(F.col("old_name").isNull(), "insert").when((name == F.col("old_name")) & (F.col("bal") == F.col("old_bal")), "unchanged").otherwise("update")
    return j.select("s_suppkey", action.alias("action"), F.coalesce(name, F.lit("")).alias("name"))


def l9_search(spark, sf):
    """Customers of a segment whose name or nation holds a text; second page of ten, with the total."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    found = c.where(F.col("c_mktsegment") == "MACHINERY").where(F.lower("c_name").contains("7") | F.lower("n_name").contains("an"))
    return found.withColumn("total", F.count("*").over(Window.partitionBy("c_mktsegment"))).orderBy(F.desc("c_acctbal"), "c_custkey").offset(10).limit(10).select("c_custkey", "total")


def l10_specialisations(spark, sf):
    return table(spark, sf, "customer").where("c_acctbal > 0").groupBy(F.initcap(F.replace("c_mktsegment", F.lit("_"), F.lit(" "))).alias("label")).agg(F.count("*").alias("n"))


def l11_scalars(spark, sf):
    return table(spark, sf, "supplier").agg(F.count("*").alias("n"), F.count_if(F.expr("s_acctbal > 0")).alias("active"), F.min("s_name").alias("first_name"))


QUERIES = {f.__name__: f for f in (m1_search, m2_upcoming, m3_overlap, m4_transitions, m5_availability, m6_records, m7_feedback, m8_unreviewed, m9_review_upsert, m10_review_summary, m11_dashboard, m12_queue, m13_logs, m14_sessions, m15_categories, m16_retention, m17_expiry, m18_access_log, m19_token_usage, m20_active, l4_slugs, l7_match, l8_upsert, l9_search, l10_specialisations, l11_scalars)}

_PAIRS = "p AS (SELECT conv_id, turn, role, text AS answer, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question FROM conversations)"

ORACLES = {
    "m1_search": "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40",
    "m2_upcoming": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderstatus IN ('O', 'P') QUALIFY r <= 3",
    "m3_overlap": "WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS start, epoch_us(ts) + floor(value * 3600e6::DOUBLE)::BIGINT AS stop FROM events WHERE value > 0) SELECT event_id, coalesce(max(stop) OVER (PARTITION BY user_id ORDER BY start, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > start, false) AS conflict FROM e",
    "m4_transitions": "WITH e AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, before IS NULL OR before || '>' || event_type IN (" + ", ".join(f"'{a}>{b}'" for a, b in ALLOWED) + ") AS valid FROM e",
    "m5_availability": "WITH s AS (SELECT (i % 7 + 1)::INT AS day, format('{:02d}:00', 9 + i // 7) AS slot FROM range(56) t(i)), e AS (SELECT DISTINCT (dayofweek(ts) + 1)::INT AS day, strftime(ts, '%H:00') AS slot, true AS hit FROM events) SELECT day, slot, coalesce(hit, false) AS booked FROM s LEFT JOIN e USING (day, slot)",
    "m6_records": "SELECT l_orderkey, l_linenumber, c_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey WHERE l_quantity >= 45 AND contains(lower(c_name), '1') ORDER BY l_shipdate DESC, l_orderkey, l_linenumber LIMIT 50",
    "m7_feedback": f"WITH {_PAIRS} SELECT conv_id, turn, 1 + 2 * quality + 2 * (1 - toxic) AS rating, md5(coalesce(question, '')) AS question FROM p JOIN labels ON doc_id = conv_id WHERE role = 'assistant' AND 1 + 2 * quality + 2 * (1 - toxic) <= 3",
    "m8_unreviewed": "SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND conv_id NOT IN (SELECT doc_id FROM labels) ORDER BY conv_id, turn LIMIT 100",
    "m9_review_upsert": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS quality FROM labels",
    "m10_review_summary": "SELECT lang, count(*) AS n, count(*) FILTER (quality IS NULL) AS unreviewed, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
    "m11_dashboard": "SELECT count(*) FILTER (role = 'assistant') AS answers, count(*) FILTER (role = 'assistant' AND trim(text) = '') AS empty_answers, count(DISTINCT conv_id) AS sessions, round(avg(CASE WHEN role = 'assistant' THEN length(text) END), 3) AS mean_chars FROM conversations",
    "m12_queue": "SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS place FROM customer WHERE c_acctbal < 0 QUALIFY place <= 10",
    "m13_logs": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events QUALIFY r <= 5",
    "m14_sessions": "WITH c AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 8) SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM c GROUP BY conv_id",
    "m15_categories": "SELECT source, count(*) AS n FROM documents WHERE n_chars > 200 GROUP BY source",
    "m16_retention": "WITH e AS (SELECT user_id, max(ts) AS updated_at FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events) SELECT user_id, datediff('day', updated_at::DATE, now::DATE) > coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 60 + 1 END, 90) AS expired FROM n, e LEFT JOIN customer ON c_custkey = user_id",
    "m17_expiry": "WITH n AS (SELECT max(ts) AS now FROM events), o AS (SELECT event_type, datediff('day', ts::DATE, now::DATE) > 10 AS old FROM events, n) SELECT count(*) FILTER (old AND event_type <> 'error') AS counted, count(*) FILTER (old) AS deleted, count(*) FILTER (NOT old) AS kept FROM o",
    "m18_access_log": "SELECT ts::DATE AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL",
    "m19_token_usage": "SELECT role, sum(greatest(1, length(text) // 4))::BIGINT AS tokens FROM conversations GROUP BY role",
    "m20_active": "SELECT user_id, count(DISTINCT ts::DATE) AS days FROM events WHERE event_type <> 'error' GROUP BY user_id",
    "l4_slugs": "SELECT s_suppkey, regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, sha256(s_name || '|' || s_nationkey) AS profile_hash FROM supplier",
    "l7_match": "WITH o AS (SELECT * FROM supplier WHERE s_suppkey % 4 <> 0), n AS (SELECT s_suppkey + CASE WHEN s_suppkey % 3 = 0 THEN 1000000 ELSE 0 END AS key, s_name FROM supplier), m AS (SELECT s_name, min(s_suppkey) AS n FROM o GROUP BY s_name) SELECT key, coalesce(o.s_suppkey, m.n) AS matched FROM n LEFT JOIN o ON o.s_suppkey = key LEFT JOIN m ON m.s_name = n.s_name",
    "l8_upsert": "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'insert' WHEN s_suppkey % 2 = 0 THEN 'update' ELSE 'unchanged' END AS action, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 5 = 0 THEN '' ELSE s_name END AS name FROM supplier",
    "l9_search": "SELECT c_custkey, count(*) OVER () AS total FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'MACHINERY' AND (contains(lower(c_name), '7') OR contains(lower(n_name), 'an')) ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 10",
    "l10_specialisations": "SELECT upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS label, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1",
    "l11_scalars": "SELECT count(*) AS n, count(*) FILTER (s_acctbal > 0) AS active, min(s_name) AS first_name FROM supplier",
}
