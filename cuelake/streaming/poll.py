"""A poll as a whole: alerts of a batch of polls against what is stored, and everything that the batch changes, written once.

``polls`` has a row a poll: monitor_id, at (epoch milliseconds), ok, error, verdict, errors, warnings, infos, break_count, protocol,
findings, the breaks of the first rendition, and of a stitched output whether it could be read (null where a monitor has
none) with fill_rate and counts of avails. A poll is known by monitor and time; told again, it changes nothing.

``sink`` is made for ``foreachBatch``. Writes are idempotent by key, in an order in which a batch that was lost on the way is done
again with the same alerts: alerts are compared with the polls before the batch's own, and stored before what they hang on.
A batch that was done is noted by its id and left out when it is replayed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cuelake.operators.pairing import latest
from cuelake.runtime import dropped, written
from cuelake.streaming import monitor
from cuelake.streaming.buckets import BUCKETS, Buckets
from cuelake.streaming.store import patched

#: Seconds: the shortest and the longest interval between polls.
INTERVALS = (15, 3600)
BREAK = "array<struct<break_key: string, signalled: double, closed: int, edge_distance: double>>"
POLLS = (
    "monitor_id string, at long, ok boolean, error string, verdict string, errors int, warnings int, infos int, break_count int, protocol string, "
    f"findings array<struct<code: string, severity: string>>, breaks {BREAK}, output_ok boolean, output_error string, fill_rate double, signalled int, filled int, not_stitched int, passthrough int"
)
RUNS = POLLS.replace(f"breaks {BREAK}, ", "") + ", failures int"
MONITORS = "monitor_id string, url string, label string, interval_seconds int, enabled int, webhook_url string, stitched_url string, created_at long, last_run_at long, consecutive_failures int"
ALERTS = "monitor_id string, at long, code string, severity string, detail string, acknowledged int, alert_id long"
BREAKS = "monitor_id string, break_key string, first_seen long, last_seen long, signalled double, closed int, alerted int"


class Store:
    """Monitors, runs, alerts and open breaks below ``folder``, each by monitor."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder = spark, folder.rstrip("/")
        made = lambda name, schema, *key: Buckets(spark, f"{self.folder}/{name}", schema, ("monitor_id", *key), buckets)
        self.monitors, self.runs = made("monitors", MONITORS), made("runs", RUNS, "at")
        self.alerts, self.breaks = made("alerts", ALERTS, "at", "code"), made("breaks", BREAKS, "break_key")

    def create(self, monitors: DataFrame) -> None:
        """New monitors, never polled; those that are there stay as they are."""
        full = monitors.withColumns({"last_run_at": F.lit(None).cast("long"), "consecutive_failures": F.lit(0)})
        self.monitors.add(full)

    def patch(self, patch: DataFrame) -> None:
        """Change the columns of ``patch`` where it has a value; monitors that are not there stay away. An interval is held within
        INTERVALS."""
        if "interval_seconds" in patch.columns:
            patch = patch.withColumn("interval_seconds", F.least(F.greatest("interval_seconds", F.lit(INTERVALS[0])), F.lit(INTERVALS[1])))
        self.monitors.change(patch, lambda old: patched(old, patch))

    def delete(self, gone: DataFrame) -> None:
        """Monitors with all that is stored of them; the monitors go last, so that a deletion that was cut off is told again."""
        for table in (self.runs, self.alerts, self.breaks, self.monitors):
            table.delete(gone)

    def acknowledge(self, alerts: DataFrame) -> None:
        """Mark alerts (monitor_id, alert_id)."""
        ids = alerts.select("monitor_id", "alert_id").distinct().withColumn("_seen", F.lit(1))

        def marked(old: DataFrame) -> DataFrame:
            both = old.join(ids, ["monitor_id", "alert_id"], "left")
            return both.withColumn("acknowledged", F.greatest("acknowledged", F.coalesce("_seen", F.lit(0))))

        self.alerts.change(alerts, marked)

    def is_done(self, name: str) -> bool:
        return self.runs._exists(f"{self.folder}/done/{name}")

    def done(self, name: str) -> None:
        path, files = self.runs._path(f"{self.folder}/done/{name}")
        files.mkdirs(path)


def batch_alerts(polls: DataFrame, before: DataFrame) -> DataFrame:
    """monitor_id, at, severity, code of the alerts of ``polls`` (with failures), the first of each monitor compared with its
    run in ``before``."""
    names = [c for c in before.columns if c in polls.columns]
    both = before.select(*names, F.lit(False).alias("_new")).unionByName(polls.select(*names, F.lit(True).alias("_new")))
    compared = monitor.beside_the_last(both)
    told = monitor._compared(compared.where("_new"))
    lost = polls.where("ok and not output_ok").select("monitor_id", "at", F.lit("warning").alias("severity"), F.lit("PIPELINE_OUTPUT_UNREACHABLE").alias("code"))
    return told.unionByName(lost)


def stuck_alerts(polls: DataFrame, known: DataFrame, told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store of breaks after ``polls``, and the alerts of breaks that stay open: of each monitor's polls in turn, by the
    same state that ``lifecycle`` keeps. ``told`` are alerts of the same polls; one of an overrun speaks for the break."""
    from cuelake.streaming.lifecycle import replayed

    overrun = told.where("code = 'NEW_BREAK_OVERRUN_UNCLOSED'").select("monitor_id", "at", F.lit(True).alias("overrun"))
    rows = polls.where("ok").join(overrun, ["monitor_id", "at"], "left").select("monitor_id", "at", F.coalesce("overrun", F.lit(False)).alias("overrun"), "breaks")
    return replayed(rows, known)


def messages(alerts: DataFrame, monitors: DataFrame) -> DataFrame:
    """(monitor_id, at, webhook_url, payload): what a monitor's webhook is told of a poll, as JSON with a text: the worst
    severity, the monitor, its address, and a line for each alert, gravest first."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    line = F.concat(F.lit("- "), F.col("severity"), F.lit(" "), F.col("code"), F.coalesce(F.concat(F.lit(": "), F.nullif("detail", F.lit(""))), F.lit("")))
    lines = alerts.groupBy("monitor_id", "at").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "code", line.alias("line")))).alias("lines"))
    own = monitors.where("webhook_url is not null and webhook_url <> ''").select("monitor_id", "webhook_url", "label", "url")
    worst = F.element_at(F.array(F.lit("error"), F.lit("warning"), F.lit("info")), F.col("lines")[0]["rank"] + 1)
    text = F.concat_ws("\n", F.concat(F.upper(worst), F.lit(": "), F.col("label")), "url", F.lit(""), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    return lines.join(own, "monitor_id").select("monitor_id", "at", "webhook_url", F.to_json(F.struct(text.alias("text"))).alias("payload"))


def poll_batch(store: Store, polls: DataFrame, name: str, send: Callable[[list[dict]], None] | None = None) -> DataFrame | None:
    """Do what a batch of polls asks for, once: its alerts (returned), runs, breaks and marks of monitors. None if the batch
    of this name was done before."""
    if store.is_done(name):
        return None
    polls = written(monitor.once_each(polls))
    others = store.runs.of(polls).join(polls.select("monitor_id", "at"), ["monitor_id", "at"], "left_anti")
    before = written(latest(others, ["monitor_id"], [F.desc("at")]))
    # a poll behind a stored one came late: its run is kept, nothing is told of it
    dated = polls.join(before.select("monitor_id", F.col("at").alias("_last")), "monitor_id", "left")
    in_time = F.col("_last").isNull() | (F.col("at") > F.col("_last"))
    counted = written(monitor.with_failures(dated.where(in_time).drop("_last"), before))
    told = written(batch_alerts(counted, before))
    breaks, late = stuck_alerts(counted, store.breaks.of(counted), told)
    late = written(late)
    # a code is told once of a poll, but for breaks that stay open, which are told together
    lost = counted.where("ok and not output_ok").select("monitor_id", "at", F.lit("PIPELINE_OUTPUT_UNREACHABLE").alias("code"), F.coalesce("output_error", F.lit("")).alias("detail"))
    alerts = told.select("monitor_id", "at", "code", "severity").join(lost, ["monitor_id", "at", "code"], "left").withColumn("detail", F.coalesce("detail", F.lit("")))
    stuck = late.groupBy("monitor_id", "at", "code").agg(F.min("severity").alias("severity"), F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("Break "), "break_key"))), ", ").alias("detail"))
    alerts = alerts.unionByName(stuck)
    alerts = written(alerts.withColumns({"acknowledged": F.lit(0), "alert_id": F.xxhash64("monitor_id", "at", "code")}))
    breaks = written(breaks)
    behind = dated.where(~in_time).drop("_last").withColumn("failures", F.lit(None).cast("int"))
    store.alerts.add(alerts)
    store.runs.add(counted.unionByName(behind).drop("breaks"))
    many = store.runs.of(polls)
    if not many.groupBy("monitor_id").count().where(F.col("count") > monitor.RUNS_KEPT).isEmpty():
        store.runs.change(polls, lambda old: monitor.pruned(old))
    store.breaks.change(counted, lambda old: old.join(counted.select("monitor_id").distinct(), "monitor_id", "left_anti").unionByName(breaks))
    own = latest(counted, ["monitor_id"], [F.desc("at")]).select("monitor_id", F.col("at").alias("_at"), F.col("failures").alias("_failures"))

    def marked(old: DataFrame) -> DataFrame:
        both = old.join(own, "monitor_id", "left")
        return both.withColumns({"last_run_at": F.coalesce("_at", "last_run_at"), "consecutive_failures": F.coalesce("_failures", "consecutive_failures")})

    store.monitors.change(counted, marked)
    if send is not None:
        monitor.delivered(messages(alerts, store.monitors.of(counted)), send)
    store.done(name)
    dropped(polls, before, counted, told, late, breaks)
    return alerts


def sink(store: Store, query: str = "polls", send: Callable[[list[dict]], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch of the stream named ``query`` is done once, whatever is replayed."""

    def run(polls: DataFrame, batch_id: int) -> None:
        poll_batch(store, polls, f"{query}-{batch_id}", send)

    return run


def watch(polls: DataFrame, store: Store, checkpoint: str, query: str = "polls", send: Callable[[list[dict]], None] | None = None, **trigger) -> StreamingQuery:
    """Start the stream of ``polls`` into ``store``; ``trigger`` as for ``DataStreamWriter.trigger``."""
    return polls.writeStream.foreachBatch(sink(store, query, send)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
