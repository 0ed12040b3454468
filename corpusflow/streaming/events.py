"""Operational telemetry: windows and states over the event stream. Each stream runs the same expressions as its batch twin."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusflow import shared
from corpusflow.operators import ingest, tagging
from corpusflow.sources import versions
from corpusflow.tables import table

BUCKETS = (10, 25, 50, 75, 100, 250, 500)
#: Events a user in PERIOD seconds, seconds that a first answer is kept, and how late a stream's rows may come.
LIMIT, PERIOD, LIFETIME, LATE = 3, 86_400, 86_400, "1 hour"
SLOW, BURST, QUIET = 100, 1, 2


def latency(events: DataFrame) -> DataFrame:
    """Cumulative buckets of value by event type over five minutes, and the interpolated 95th percentile."""
    g = events.groupBy(F.window("ts", "5 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), *(F.count_if(F.col("value") <= b).alias(f"le_{b}") for b in BUCKETS))
    want, p95, low, below = 0.95 * F.col("n"), F.lit(float(BUCKETS[-1])), 0, F.lit(0)
    parts = []
    for b in BUCKETS:
        parts.append((F.col(f"le_{b}") >= want, low + (b - low) * (want - below) / F.greatest(F.col(f"le_{b}") - below, F.lit(1))))
        low, below = b, F.col(f"le_{b}")
    for cond, value in reversed(parts):
        p95 = F.when(cond, value).otherwise(p95)
    return g.select(F.col("w.start").alias("start"), "event_type", "n", *(f"le_{b}" for b in BUCKETS), F.round(p95, 6).alias("p95"))


def ratios(events: DataFrame) -> DataFrame:
    """Share of errors in sliding windows of ten minutes."""
    g = events.groupBy(F.window("ts", "10 minutes", "5 minutes").alias("w")).agg(F.count("*").alias("n"), F.count_if(F.expr("event_type = 'error'")).alias("errors"))
    return g.select(F.col("w.start").alias("start"), "n", "errors", (20 * F.col("errors") > F.col("n")).alias("alert"))


def counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame) -> DataFrame:
    return events.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def limited(events: DataFrame) -> DataFrame:
    """Batch form: a user's counter starts at an event and ends PERIOD seconds later; events beyond LIMIT are limited.

    Rows are sorted by user and time, and a task passes over them with one counter in hand. Rows without user count as
    one user's; equal times go by event_id; rows without time come first in a period of their own; an empty table gives no rows.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, start, n = None, None, 0
        for frame in frames:
            out = []
            for who, at in zip(frame["user"], frame["at"], strict=True):
                if who != user or start is None or not at - start < PERIOD:
                    user, start, n = who, at, 0
                n += 1
                out.append(n > LIMIT)
            yield pd.DataFrame({"event_id": frame["event_id"], "limited": out})

    keyed = events.select("event_id", F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("user"), F.expr("unix_micros(CAST(ts AS TIMESTAMP)) / 1e6D").alias("at"))
    return keyed.repartition("user").sortWithinPartitions("user", "at", "event_id").mapInPandas(fold, "event_id long, limited boolean")


class Limiter(StatefulProcessor):
    """A counter a user, with a timer at its period's end that clears it. What a batch holds of a user is taken in the order of time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counter = handle.getValueState("counter", "start double, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = self.counter.get()
        start, n = held or (None, 0)
        event, at_ = _in_order(rows)
        out = []
        for at in at_:
            if start is None or at - start >= PERIOD:
                start, n = at, 0
            n += 1
            out.append(n > LIMIT)
        self.counter.update((float(start), int(n)))
        _moved_timer(self.handle, held and held[0], start, PERIOD)
        yield pd.DataFrame({"event_id": event, "limited": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.counter.clear()
        return iter(())

    def close(self) -> None:
        pass


class Replayer(StatefulProcessor):
    """The event that first used a key, for LIFETIME seconds; events of that time are answered by it, the next one after it is a first one again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "event_id long, start double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = self.first.get()
        first, start = held or (None, None)
        event, at_ = _in_order(rows)
        out = []
        for e, at in zip(event.tolist(), at_.tolist(), strict=True):
            if first is None or at - start >= LIFETIME:
                first, start = e, at
            out.append(first)
        if held is None or start != held[1]:
            self.first.update((int(first), float(start)))
        _moved_timer(self.handle, held and held[1], start, LIFETIME)
        yield pd.DataFrame({"event_id": event, "answered_by": out, "replayed": event != out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.first.clear()
        return iter(())

    def close(self) -> None:
        pass


def _in_order(rows: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    """event_id and time of a key's rows, by time. Keys have few rows, of which a frame's own sort is most of the time."""
    event, at = (np.concatenate(x) for x in zip(*((f["event_id"].to_numpy(), f["at"].to_numpy()) for f in rows), strict=True))
    order = np.lexsort((event, at))
    return event[order], at[order]


def _moved_timer(handle: StatefulProcessorHandle, before: float | None, start: float, span: int) -> None:
    """A key's only timer, `span` seconds after start. It is where the state says it is, so timers aren't listed: each call of the handle is a round trip."""
    if before == start:
        return
    if before is not None:
        handle.deleteTimer(int((before + span) * 1000))
    handle.registerTimer(int((start + span) * 1000))


def _stateful(events: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    timed = events.select("event_id", *keys, F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", LATE)
    timed = timed.withColumn("at", F.expr("unix_micros(ts) / 1e6D"))
    return timed.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def limited_stream(events: DataFrame) -> DataFrame:
    """The stream's form of `limited`. Batches come in the order of time, up to LATE; what is later than that is dropped."""
    return _stateful(events, ["user_id"], Limiter(), "event_id long, limited boolean")


def replayed_stream(events: DataFrame) -> DataFrame:
    """event_id, answered_by, replayed: an event is answered by the first of its user and type within LIFETIME; batches as for `limited_stream`."""
    return _stateful(events, ["user_id", "event_type"], Replayer(), "event_id long, answered_by long, replayed boolean")


def tagged(conversations: DataFrame) -> DataFrame:
    """Verdict and intent of each turn, a projection."""
    c = conversations.withColumn("s", tagging.safety(F.col("text")))
    return c.select("conv_id", "turn", tagging.verdict(F.col("s")).alias("verdict"), tagging.intent(F.col("text")).alias("intent"))


def streamed(spark, sf, name: str, transform, mode: str = "append", late: str | None = None) -> DataFrame:
    """The result of a stream over a table's file, run until all is read; kept in the shared folder."""
    folder = shared.folder(spark)
    source = table(spark, sf, name)
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").parquet(_folder(spark, source, folder))
    if late:
        stream = stream.withWatermark("ts", late)
    out = transform(stream)
    if mode == "append":
        q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    else:
        q = out.writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/out/batch={i:08d}")).option("checkpointLocation", f"{folder}/state").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    if mode == "append":
        return spark.read.schema(out.schema).parquet(f"{folder}/out")
    # In complete mode each batch is a whole result of its own, and the last one counts; a batch that fails leaves those before it.
    last = q.lastProgress["batchId"] if q.lastProgress else 0
    return spark.read.schema(out.schema).parquet(f"{folder}/out/batch={last:08d}")


def _folder(spark, source: DataFrame, folder: str) -> str:
    """A stream reads folders; the table, which may be one file, is written to one."""
    source.write.parquet(f"{folder}/in")
    return f"{folder}/in"


def fed(spark, parts: list[DataFrame], transform: Callable[[DataFrame], DataFrame], start: Callable | None = None) -> tuple[DataFrame, list[dict]]:
    """(result, progress reports) of a stream that gets `parts` one after the other, each as a micro-batch.

    After each part the query stops, and the next one resumes from its checkpoint. start: writes the stream to a sink of its
    own, (writer) -> writer; else rows are appended to a table of the shared folder.
    """
    at, reports, name = shared.folder(spark), [], "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in parts:
            part.write.mode("append").parquet(f"{at}/in")
            out = transform(spark.readStream.schema(parts[0].schema).parquet(f"{at}/in"))
            writer = out.writeStream.option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True)
            writer = start(writer) if start else writer.format("parquet").option("path", f"{at}/out")
            query = writer.start()
            query.awaitTermination()
            reports += query.recentProgress
    finally:
        spark.conf.unset(name) if held is None else spark.conf.set(name, held)
    return (out if start else spark.read.schema(out.schema).parquet(f"{at}/out")), reports


def by_time(events: DataFrame, n: int = 4) -> list[DataFrame]:
    """events in n parts of equal spans of time, in order; rows without time are in the first."""
    first, last = events.agg(F.min(F.unix_seconds(F.col("ts").cast("timestamp"))), F.max(F.unix_seconds(F.col("ts").cast("timestamp")))).first()
    if first is None:
        return [events]
    part = F.coalesce(F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - first) * n / (last - first + 1)), F.lit(0))
    return [events.where(part == i) for i in range(n)]


def _events(spark, sf):
    return table(spark, sf, "events")


def s1_latency(spark, sf):
    return latency(_events(spark, sf))


def s2_ratio_alerts(spark, sf):
    return ratios(_events(spark, sf))


def s2_sustained(spark, sf):
    """Alerts that hold in at least two consecutive windows: islands by difference of row numbers."""
    a = ratios(_events(spark, sf)).withColumn("slot", F.floor(F.unix_seconds(F.col("start").cast("timestamp")) / 300))
    w = Window.partitionBy("alert").orderBy("slot")
    i = a.where("alert").withColumn("island", F.col("slot") - F.row_number().over(w))
    return i.groupBy("island").agg(F.min("slot").alias("first_slot"), F.count("*").alias("n")).where("n >= 2").select("first_slot", "n")


def s3_counts(spark, sf):
    """Hourly counts, computed by a stream in complete mode."""
    return streamed(spark, sf, "events", counts, mode="complete")


def s4_rate_limit(spark, sf):
    return limited(_events(spark, sf))


def s4_rate_limit_stream(spark, sf):
    """Four batches in the order of time; the counters go from one to the next in the checkpoint."""
    return fed(spark, by_time(_events(spark, sf)), limited_stream)[0]


def alerts(events: DataFrame) -> DataFrame:
    """start, kind: the alerts of five minutes: errors over a twentieth, a slow 95th percentile, a burst of purchases, little traffic."""
    is_ = lambda t: F.count_if(F.col("event_type") == t)
    g = events.groupBy(F.window("ts", "5 minutes").alias("w")).agg(F.count("*").alias("n"), is_("error").alias("errors"), is_("purchase").alias("sold"), F.percentile("value", F.lit(0.95)).alias("p95"))
    kinds = F.array_compact(F.array(F.when(20 * F.col("errors") > F.col("n"), F.lit("errors")), F.when(F.col("p95") > SLOW, F.lit("slow")), F.when(F.col("sold") >= BURST, F.lit("burst")), F.when(F.col("n") < QUIET, F.lit("quiet"))))
    return g.select(F.col("w.start").alias("start"), F.explode(kinds).alias("kind"))


def s2_alerts(spark, sf):
    return alerts(_events(spark, sf))


def late_counts(events: DataFrame) -> DataFrame:
    """Hourly counts of a stream that may be a day late: a window is handed on once it is closed, and rows that come after that are dropped.

    Events are grouped one by one first, so that the first state's report of dropped rows counts events.
    """
    each = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour").alias("w"), "event_id").agg(F.count("*").alias("n"))
    return each.groupBy("w").agg(F.sum("n").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def _thirds(spark, sf) -> list[DataFrame]:
    """Events out of order: half, four tenths and a tenth of them, each over the whole time."""
    e = _events(spark, sf).select("event_id", "ts")
    return [e.where(x) for x in ("event_id % 10 BETWEEN 1 AND 5", "event_id % 10 > 5", "event_id % 10 = 0")]


def s9_late_data(spark, sf):
    """Windows that closed, their counts, and what came too late for them, by the batch's count of all events."""
    closed, _ = fed(spark, _thirds(spark, sf), late_counts)
    whole = _events(spark, sf).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "total")
    return closed.join(whole, "start").select("start", "n", (F.col("total") - F.col("n")).alias("dropped"))


def s9_dropped_metric(spark, sf):
    """What the stream's own progress reports say of each batch with rows: rows read, and rows dropped as too late."""
    _, reports = fed(spark, _thirds(spark, sf), late_counts)
    rows = [(int(r["numInputRows"]), sum(int(x["numRowsDroppedByWatermark"]) for x in r["stateOperators"])) for r in reports if r["numInputRows"]]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "part int, n_read long, n_dropped long")  # a row a batch


def s8_continuous_ingest(spark, sf):
    """Documents that come in two batches, the second with every fifth of the first's again: each batch runs the whole ingest and replaces its documents' chunks in a versioned table."""
    d, at = table(spark, sf, "documents").select("doc_id", "source", "text"), shared.folder(spark)

    def replace(batch: DataFrame, i: int) -> None:
        rows = shared.written(batch, "batch")
        versions.replace(f"{at}/chunks", ingest.ingested(rows), rows.select("doc_id"), "doc_id")

    fed(spark, [d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1 OR doc_id % 10 = 0")], lambda s: s, lambda w: w.foreachBatch(replace))
    return versions.current(spark, f"{at}/chunks")


def s5_idempotent(spark, sf):
    """Every event with the one that answers it, and whether that is a replay; four batches in the order of time."""
    return fed(spark, by_time(_events(spark, sf)), replayed_stream)[0]


def s6_sessions(spark, sf):
    return sessions(_events(spark, sf))


def s7_topic_counters(spark, sf):
    return streamed(spark, sf, "conversations", lambda c: c.where("role = 'user'").select("conv_id", F.explode(tagging.topics(F.col("text"))).alias("topic")).groupBy("conv_id", "topic").agg(F.count("*").alias("n")), mode="complete")


def s10_tagging(spark, sf):
    return streamed(spark, sf, "conversations", tagged)


QUERIES = {f.__name__: f for f in (s1_latency, s2_alerts, s8_continuous_ingest, s9_late_data, s9_dropped_metric, s2_ratio_alerts, s2_sustained, s3_counts, s4_rate_limit, s4_rate_limit_stream, s5_idempotent, s6_sessions, s7_topic_counters, s10_tagging)}

_B = ", ".join(f"count(*) FILTER (value <= {b}) AS le_{b}" for b in BUCKETS)


def _p95() -> str:
    low, below, out = 0, "0", "CASE"
    for b in BUCKETS:
        out += f" WHEN le_{b} >= 0.95::DOUBLE * n THEN {low} + {b - low} * (0.95::DOUBLE * n - {below}) / greatest(le_{b} - {below}, 1)"
        low, below = b, f"le_{b}"
    return out + f" ELSE {BUCKETS[-1]} END"


_R = "r AS (SELECT start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) - d * INTERVAL 5 MINUTE AS start, event_type FROM events, (VALUES (0), (1)) t(d)) GROUP BY start)"
_LIMITED = f"""WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), r AS (SELECT event_id, user_id, rn, ts AS start, 1 AS n FROM e WHERE rn = 1
UNION ALL SELECT e.event_id, e.user_id, e.rn, CASE WHEN e.ts >= r.start + INTERVAL {PERIOD} SECOND THEN e.ts ELSE r.start END, CASE WHEN e.ts >= r.start + INTERVAL {PERIOD} SECOND THEN 1 ELSE r.n + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1) SELECT event_id, n > {LIMIT} AS limited FROM r"""
_LATE = """e AS (SELECT ts, time_bucket(INTERVAL 1 HOUR, ts) AS start, CASE WHEN event_id % 10 BETWEEN 1 AND 5 THEN 0 WHEN event_id % 10 > 5 THEN 1 ELSE 2 END AS part FROM events),
c AS (SELECT max(ts) FILTER (part = 0) - INTERVAL 1 DAY AS w1, max(ts) FILTER (part < 2) - INTERVAL 1 DAY AS w2, max(ts) - INTERVAL 1 DAY AS w3 FROM e), l AS (SELECT e.*, (part = 1 AND start + INTERVAL 1 HOUR <= w1) OR (part = 2 AND start + INTERVAL 1 HOUR <= w2) AS late FROM e, c)"""
ORACLES = {
    "s4_rate_limit": _LIMITED,
    "s4_rate_limit_stream": _LIMITED,
    "s1_latency": f"WITH g AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n, {_B} FROM events GROUP BY ALL) SELECT *, round({_p95()}, 6) AS p95 FROM g",
    "s2_ratio_alerts": f"WITH {_R} SELECT *, 20 * errors > n AS alert FROM r",
    "s2_sustained": f"WITH {_R}, a AS (SELECT epoch(start)::BIGINT // 300 AS slot FROM r WHERE 20 * errors > n), i AS (SELECT slot, slot - row_number() OVER (ORDER BY slot) AS island FROM a) SELECT min(slot) AS first_slot, count(*) AS n FROM i GROUP BY island HAVING count(*) >= 2",
    "s2_alerts": f"WITH g AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS sold, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY 1), k AS (SELECT start, unnest([CASE WHEN 20 * errors > n THEN 'errors' END, CASE WHEN p95 > {SLOW} THEN 'slow' END, CASE WHEN sold >= {BURST} THEN 'burst' END, CASE WHEN n < {QUIET} THEN 'quiet' END]) AS kind FROM g) SELECT * FROM k WHERE kind IS NOT NULL",
    "s9_late_data": f"WITH {_LATE}, g AS (SELECT start, count(*) AS total, count(*) FILTER (NOT late) AS n FROM l GROUP BY start) SELECT start, n, total - n AS dropped FROM g, c WHERE n > 0 AND start + INTERVAL 1 HOUR <= c.w3",
    "s9_dropped_metric": f"WITH {_LATE} SELECT part, count(*) AS n_read, count(*) FILTER (late) AS n_dropped FROM l GROUP BY part",
    "s3_counts": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "s5_idempotent": f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events), r AS (SELECT event_id, user_id, event_type, rn, ts AS start, event_id AS answered_by FROM e WHERE rn = 1
UNION ALL SELECT e.event_id, e.user_id, e.event_type, e.rn, CASE WHEN e.ts >= r.start + INTERVAL {LIFETIME} SECOND THEN e.ts ELSE r.start END, CASE WHEN e.ts >= r.start + INTERVAL {LIFETIME} SECOND THEN e.event_id ELSE r.answered_by END FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.rn = r.rn + 1)
SELECT event_id, answered_by, event_id <> answered_by AS replayed FROM r""",
    "s6_sessions": "WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s",
    "s7_topic_counters": tagging.ORACLES["i13_topics"],
    "s10_tagging": f"SELECT conv_id, turn, verdict, intent FROM ({tagging.ORACLES['i2_verdict']}) JOIN ({tagging.ORACLES['i4_intent']}) USING (conv_id, turn)",
}
