"""Structured Streaming forms of the event-log operators.

* T1 ``stream_ingest``: file stream of raw events -> enriched events,
  de-duplicated on ``event_id``.
* T2 ``stream_clusters``: failure counts per (day, cluster key), kept current.
* T3 ``stream_lifecycle``: outcomes folded in keyed state, per (template, day),
  into the associative summary of :mod:`refbank.operators.lifecycle`.

Every job runs with ``Trigger.AvailableNow`` into a sink under the shared
checkpoint folder and returns the sink's content as a batch DataFrame.

A watermark bounds the state of every job.  Events that come later than it are
passed over by the stream and made good by a batch step over the log that the
stream reads: the days (T2: day totals, T3: template and day) whose numbers
differ from the log's are counted again, and T1 adds the ids that its sink lacks.
So no result depends on the order of arrival, on files or on batch sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from refbank.operators import lifecycle as L
from refbank.operators import memory as M
from refbank.plans import fixtures as X
from refbank.session import scratch_path
from refbank.sources.bank_io import _exists, is_folder

MAX_FILES_PER_TRIGGER = 64
#: Rows in the state stores after the batches of the last run of each job.
STATE_ROWS: dict[str, list[int]] = {}


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events",
                 max_files_per_trigger: int = MAX_FILES_PER_TRIGGER) -> DataFrame:
    """File stream over one driver table, a single Parquet file or a folder of
    part files (schema taken from the footers).

    ``maxFilesPerTrigger`` bounds every micro-batch (AvailableNow splits a
    backlog into several batches); no result depends on it."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    stream = (spark.readStream.schema(spark.read.parquet(path).schema)
              .option("maxFilesPerTrigger", max_files_per_trigger))
    if is_folder(spark, path):
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _run(query_builder, spark: SparkSession, name: str, out: str | None = None) -> str:
    """Start a stream with AvailableNow and wait.  The sink folder is a fresh
    one unless given; a given one goes on from its checkpoint."""
    out = out or scratch_path(spark, f"stream-{name}")
    q = query_builder(out)
    q.awaitTermination()
    ex = q.exception()
    if ex is not None:
        raise RuntimeError(str(ex))
    STATE_ROWS[name] = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress]
    return out


def stream_ingest(spark: SparkSession, sf_dir: str, watermark: str = "1 day", sink: str | None = None) -> DataFrame:
    """Enriched events, each event id once.

    Ids are remembered as long as the ``watermark`` says.  Afterwards the events
    of the log whose id is not in the sink are appended (late events), and an id
    that came twice further apart than the watermark counts by its first row."""
    stream = M.enrich_events(X.log_events(event_stream(spark, sf_dir)))
    ev = stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])

    def build(out):
        return (ev.writeStream.format("parquet").option("path", f"{out}/data")
                .option("checkpointLocation", f"{out}/_checkpoint")
                .outputMode("append").trigger(availableNow=True).start())

    out = _run(build, spark, "ingest", sink)
    timely = spark.read.schema(ev.schema).parquet(f"{out}/data")
    log = M.enrich_events(X.log_events(X.table(spark, sf_dir, "events")))
    known = timely
    if _exists(spark, f"{out}/late/_SUCCESS"):  # the sink goes on
        known = timely.unionByName(spark.read.schema(ev.schema).parquet(f"{out}/late"))
    late = log.join(known.select("event_id").distinct(), "event_id", "left_anti").select(*timely.columns)
    late.write.mode("append").parquet(f"{out}/late")
    # an id twice in the sink: its rows are further apart than the watermark
    return _first_rows(timely.unionByName(spark.read.schema(ev.schema).parquet(f"{out}/late")))


def _first_rows(events: DataFrame) -> DataFrame:
    """One row per event id; only ids that occur twice are grouped whole."""
    twice = events.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("event_id")
    rest = [c for c in events.columns if c != "event_id"]
    again = (events.join(twice, "event_id", "left_semi").groupBy("event_id")
             .agg(F.min(F.struct(*[F.col(c) for c in ["ts", *[c for c in rest if c != "ts"]]])).alias("r"))
             .select("event_id", *[F.col(f"r.{c}").alias(c) for c in rest]).select(*events.columns))
    return events.join(twice, "event_id", "left_anti").unionByName(again)


def stream_clusters(spark: SparkSession, sf_dir: str, watermark: str = "1 day", sink: str | None = None) -> DataFrame:
    """Failure counts per (1-day window, cluster key), updated per batch; the
    latest value of every window is the result.  The ``watermark`` closes windows;
    days whose failures in the log are more than the windows hold are counted again."""
    failures = lambda rows: M.enrich_events(M.failures(X.log_events(rows)))
    counts = (failures(event_stream(spark, sf_dir)).withWatermark("ts", watermark)
              .groupBy(F.window("ts", "1 day").alias("w"), "cluster_key").agg(F.count("*").alias("samples")))

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.select(F.col("w.start").alias("day"), "cluster_key", "samples", F.lit(batch_id).cast("long").alias("batch_id"))
         .write.mode("overwrite").parquet(f"{write.path}/batch={batch_id}"))  # a repeated batch replaces itself

    def build(out):
        write.path = f"{out}/data"
        return (counts.writeStream.outputMode("update").foreachBatch(write)
                .option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start())

    schema = "day timestamp, cluster_key string, samples long, batch_id long"
    out = _run(build, spark, "clusters", sink)
    held = (_batches(spark, f"{out}/data", schema).groupBy("day", "cluster_key")
            .agg(F.max_by("samples", "batch_id").cast("long").alias("samples")))
    log = failures(X.table(spark, sf_dir, "events")).withColumn("day", F.date_trunc("day", "ts"))
    late = _differing(log.groupBy("day").agg(F.count(F.lit(1)).alias("n")), held.groupBy("day").agg(F.sum("samples").alias("m")), ["day"])
    again = log.join(late, "day", "left_semi").groupBy("day", "cluster_key").agg(F.count(F.lit(1)).alias("samples"))
    return held.join(late, "day", "left_anti").unionByName(again)


def _differing(log: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose number ``n`` in the log is not the ``m`` that the stream holds."""
    return log.join(held, keys, "left").where("m IS NULL OR n <> m").select(*keys)


def _batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What the micro-batches wrote; nothing, if there was no batch at all."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/batch=*")


SUMMARY = ("template_id string, chunk timestamp, n long, n_plus long, n_moves long, first_neutral boolean, total long, "
           "min_p long, max_p long, dd long")
_STATE = "n long, n_plus long, n_moves long, first_neutral boolean, total long, min_p long, max_p long, dd long, until long, waiting binary"
_EVENT = np.dtype([("ts", "<i8"), ("id", "<i8"), ("d", "<i4")])


def fold_steps(d: np.ndarray) -> tuple | None:
    """Summary of steps in order: (n, n_plus, n_moves, first_neutral, total, min_p, max_p, dd)."""
    if not len(d):
        return None
    p = np.cumsum(d)
    return (len(d), int((d > 0).sum()), int((d != 0).sum()), bool(d[0] == 0), int(p[-1]), int(p.min()), int(p.max()),
            int((np.maximum.accumulate(p) - p).max()))


def merge_summaries(a: tuple | None, b: tuple | None) -> tuple | None:
    """The summary of ``a``'s steps followed by ``b``'s; associative."""
    if a is None or b is None:
        return a or b
    return (a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3], a[4] + b[4], min(a[5], a[4] + b[5]), max(a[6], a[4] + b[6]),
            max(a[7], b[7], a[6] - (a[4] + b[5])))


class OutcomeDays(StatefulProcessor):
    """State of one (template, day): the summary of all events before ``until``,
    which the watermark has passed, and the waiting events after it.  Every batch
    gives the day's summary so far; a timer at the day's end plus the watermark's
    delay clears the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("day", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802 - Spark's names
        held = self.state.get() if self.state.exists() else None
        closed = None if held is None or held[0] is None else tuple(held[:8])
        until = -1 if held is None else held[8]
        parts = [] if held is None else [np.frombuffer(held[9], _EVENT)]
        for pdf in rows:
            part = np.empty(len(pdf), _EVENT)
            part["ts"], part["id"] = pdf["us"].to_numpy(), pdf["event_id"].to_numpy()
            part["d"] = np.select([pdf["v"].to_numpy() > 0, pdf["v"].to_numpy() < 0], [2, -5], 0)
            parts.append(part[part["ts"] >= until])  # an earlier one came too late for the order
        waiting = np.sort(np.concatenate(parts), order=["ts", "id"])
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        if mark > until:
            ready = int(np.searchsorted(waiting["ts"], mark))
            closed, waiting, until = merge_summaries(closed, fold_steps(waiting["d"][:ready])), waiting[ready:], mark
        self.state.update((*(closed or (None,) * 8), until, waiting.tobytes()))
        end = int(pd.Timestamp(key[1]).value // 1_000_000) + 86_400_000
        if held is None and end > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(end)
        now = merge_summaries(closed, fold_steps(waiting["d"]))
        if now is not None:
            yield pd.DataFrame([(key[0], key[1], *now)], columns=[c.split()[0] for c in SUMMARY.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.state.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def outcome_days(spark: SparkSession, sf_dir: str, watermark: str, sink: str | None = None) -> DataFrame:
    """The newest summary of every (template, day) the stream has seen."""
    ev = (X.outcome_events(event_stream(spark, sf_dir)).withWatermark("ts", watermark)
          .withColumn("chunk", F.date_trunc("day", "ts")).withColumn("us", F.unix_micros("ts")))
    days = ev.groupBy("template_id", "chunk").transformWithStateInPandas(
        statefulProcessor=OutcomeDays(), outputStructType=SUMMARY, outputMode="Update", timeMode="EventTime")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{write.path}/batch={batch_id}")

    def build(out):
        write.path = f"{out}/data"
        return (days.writeStream.outputMode("update").foreachBatch(write)
                .option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start())

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = _run(build, spark, "lifecycle", sink)
    finally:
        spark.conf.set(provider, before)
    got = _batches(spark, f"{out}/data", f"{SUMMARY}, batch_id long")
    rest = F.struct(*[c for c in got.columns if c not in ("template_id", "chunk", "batch_id")])
    return got.groupBy("template_id", "chunk").agg(F.max_by(rest, "batch_id").alias("s")).select("template_id", "chunk", "s.*")


def stream_lifecycle(spark: SparkSession, sf_dir: str, rules: DataFrame | None = None, watermark: str = "1 hour",
                     sink: str | None = None) -> DataFrame:
    """Rules after the outcome stream.

    The stream keeps one summary per (template, day) and the events that the
    watermark has not passed (:class:`OutcomeDays`).  Reading joins the days' few
    rows in order.  A day whose number of events is not the log's got an event
    too late; its minutes are summarised from the log and take its place."""
    held = outcome_days(spark, sf_dir, watermark, sink)
    log = X.outcomes(spark, sf_dir).withColumn("chunk", F.date_trunc("day", "ts"))
    late = _differing(log.groupBy("template_id", "chunk").agg(F.count(F.lit(1)).alias("n")),
                      held.select("template_id", "chunk", F.col("n").alias("m")), ["template_id", "chunk"])
    again = L.outcome_chunks(log.join(late, ["template_id", "chunk"], "left_semi").drop("chunk"))
    chunks = held.join(late, ["template_id", "chunk"], "left_anti").unionByName(again)
    r = rules if rules is not None else X.rules(spark, sf_dir)
    return L.apply_summary(r, L.combine_chunks(chunks))
