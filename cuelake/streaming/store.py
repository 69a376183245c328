"""The monitor's tables (monitors, runs, alerts, open breaks) as views over what is stored; writes give the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.operators.pairing import latest


def monitors_by_age(monitors: DataFrame) -> DataFrame:
    return monitors.orderBy(F.desc("created_at"), "monitor_id")


def monitor(monitors: DataFrame, monitor_id: str) -> DataFrame:
    return monitors.where(F.col("monitor_id") == monitor_id)


def patched(monitors: DataFrame, patch: DataFrame) -> DataFrame:
    """Monitors with the columns of ``patch`` (monitor_id and some others) where it has a value."""
    names = [c for c in patch.columns if c != "monitor_id"]
    both = monitors.join(patch.withColumnsRenamed({c: f"_{c}" for c in names}), "monitor_id", "left")
    return both.withColumns({c: F.coalesce(f"_{c}", c) for c in names}).select(*monitors.columns)


def without(table: DataFrame, gone: DataFrame) -> DataFrame:
    """Any of the tables without the rows of deleted monitors."""
    return table.join(gone.select("monitor_id"), "monitor_id", "left_anti")


def marked(monitors: DataFrame, runs: DataFrame) -> DataFrame:
    """Monitors after new runs (one each): failures counted on or set back."""
    own = runs.select("monitor_id", "ok", F.col("at").alias("_at"))
    both = monitors.join(own, "monitor_id", "left")
    failures: Column = F.when(F.col("ok").isNull(), F.col("consecutive_failures")).when(F.col("ok"), 0).otherwise(F.col("consecutive_failures") + 1)
    return both.withColumns({"consecutive_failures": failures, "last_run_at": F.coalesce("_at", "last_run_at")}).select(*monitors.columns)


def last_runs(runs: DataFrame, before: int | None = None) -> DataFrame:
    rows = runs if before is None else runs.where(F.col("at") < before)
    return latest(rows, ["monitor_id"], [F.desc("at")])


def latest_alerts(alerts: DataFrame, most: int, monitor_id: str | None = None) -> DataFrame:
    rows = alerts if monitor_id is None else monitor(alerts, monitor_id)
    return rows.orderBy(F.desc("at"), "alert_id").limit(max(1, min(most, 1000)))


def unacknowledged(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("monitor_id").agg(F.count_if(F.col("acknowledged") == 0).alias("unacknowledged"))


def open_breaks(breaks: DataFrame) -> DataFrame:
    return breaks.where("closed = 0")


def details(monitors: DataFrame, runs: DataFrame, alerts: DataFrame, breaks: DataFrame, most_runs: int = 200, most_alerts: int = 100) -> DataFrame:
    """Every monitor with its latest runs and alerts, newest first, and its open breaks by key; empty arrays where it has none."""

    def newest(rows: DataFrame, most: int, name: str, *then: str) -> DataFrame:
        kept = latest(rows, ["monitor_id"], [F.desc("at"), *then], most)
        own = [c for c in kept.columns if c != "monitor_id"]
        listed = F.array_sort(F.collect_list(F.struct((-F.col("at")).alias("_order"), *[F.col(c).alias(f"_{c}") for c in then], F.struct(*own).alias("row"))))
        return kept.groupBy("monitor_id").agg(F.transform(listed, lambda x: x["row"]).alias(name))

    held = open_breaks(breaks)
    keys = ["break_key", *[c for c in held.columns if c not in ("monitor_id", "break_key")]]
    held = held.groupBy("monitor_id").agg(F.array_sort(F.collect_list(F.struct(*keys))).alias("open_breaks"))
    full = monitors
    for part in (newest(runs, most_runs, "runs"), newest(alerts, most_alerts, "alerts", "code"), held):
        full = full.join(part, "monitor_id", "left")
    return full.withColumns({c: F.coalesce(c, F.array().cast(full.schema[c].dataType)) for c in ("runs", "alerts", "open_breaks")})
