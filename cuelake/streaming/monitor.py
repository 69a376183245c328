"""Alerts from poll to poll.

``runs`` has a row a poll: monitor_id, at (epoch milliseconds), ok, verdict, errors, warnings, break_count,
findings (array of struct<code, severity>), fill_rate, not_stitched, passthrough (null without a stitched output). Each
run is compared with the one before it, good or failed. The batch form uses windows; the streaming form keeps the last
run of each monitor as state, and gives the same alerts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cuelake.functions.text import break_key
from cuelake.operators.pairing import coverage, latest

FAILURES_BEFORE_ALERT, FILL_DROP, STUCK_GRACE, DEFAULT_LENGTH, RUNS_KEPT = 2, 0.1, 60.0, 60.0, 2000
BREAK_TTL_MS = 6 * 3600 * 1000

RUNS = (
    "monitor_id string, at long, ok boolean, verdict string, errors int, warnings int, break_count int, "
    "findings array<struct<code string, severity string>>, fill_rate double, not_stitched int, passthrough int"
)
ALERTS = "monitor_id string, at long, severity string, code string"


def _ranked(verdict: Column) -> Column:
    return F.when(verdict == "fail", 2).when(verdict == "warn", 1).when(verdict == "pass", 0)


def once_each(polls: DataFrame) -> DataFrame:
    """One row for each poll, which is known by monitor and time; of several the one that sorts first by what it says."""
    said = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in polls.columns])))
    place = F.row_number().over(Window.partitionBy("monitor_id", "at").orderBy(F.desc("ok"), said))
    return polls.withColumn("_n", place).where("_n = 1").drop("_n")


def with_failures(polls: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Polls with failures: how many have failed in a row up to each, counted on from ``before`` (monitor_id, failures)."""
    upto = Window.partitionBy("monitor_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = polls.withColumn("_good", F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(upto))
    inside = Window.partitionBy("monitor_id", "_good").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("failures", F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(inside).cast("int"))
    if before is None:
        return rows.drop("_good")
    rows = rows.join(before.select("monitor_id", F.col("failures").alias("_before")), "monitor_id", "left")
    start = F.when(F.col("_good") == 0, F.coalesce("_before", F.lit(0))).otherwise(0)
    return rows.withColumn("failures", (F.col("failures") + start).cast("int")).drop("_good", "_before")


def beside_the_last(rows: DataFrame) -> DataFrame:
    """Polls with failures, each beside the one before it (old_...)."""
    by = Window.partitionBy("monitor_id").orderBy("at")
    codes = F.array_distinct(F.transform(F.coalesce("findings", F.array().cast("array<struct<code:string,severity:string>>")), lambda f: f["code"]))
    rows = rows.withColumn("codes", codes)
    names = ("ok", "verdict", "errors", "break_count", "codes", "failures", "fill_rate")
    return rows.withColumns({f"old_{c}": F.lag(c).over(by) for c in names})


def alerts(runs: DataFrame) -> DataFrame:
    """monitor_id, at, severity, code of every alert of all runs. A poll is known by monitor and time; told again, it is left
    out."""
    return _compared(beside_the_last(with_failures(once_each(runs))))


def _compared(rows: DataFrame) -> DataFrame:
    """Alerts of rows that hold a run beside the one before it (old_...)."""
    ok, good = F.col("ok"), F.coalesce("old_ok", F.lit(False)) & F.col("ok")
    fixed = lambda when, severity, code: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))
    gone = F.array_except(F.array_except("old_codes", "codes"), F.array(F.lit("BREAK_IN_PROGRESS")))
    worse = good & (_ranked(F.col("verdict")) > _ranked(F.col("old_verdict")))
    drop = F.col("old_fill_rate") - F.col("fill_rate")
    single = [
        fixed(ok & ~F.col("old_ok") & (F.col("old_failures") >= FAILURES_BEFORE_ALERT), "info", "STREAM_RECOVERED"),
        fixed(good & (F.size(gone) > 0) & (F.col("errors") == 0) & (F.col("old_errors") > 0), "info", "ERRORS_CLEARED"),
        F.when(F.coalesce(worse, F.lit(False)), F.struct(F.when(F.col("verdict") == "fail", "error").otherwise("warning").alias("severity"), F.lit("VERDICT_DEGRADED").alias("code"))),
        fixed(good & (F.col("old_break_count") > 0) & (F.col("break_count") == 0), "error", "SIGNALLING_STOPPED"),
        fixed(good & (F.col("old_break_count") == 0) & (F.col("break_count") > 0), "info", "SIGNALLING_RESUMED"),
        fixed(ok & (F.col("not_stitched") > 0), "error", "AVAILS_NOT_STITCHED"),
        fixed(ok & (F.col("passthrough") > 0), "error", "AVAILS_PASSED_THROUGH"),
        fixed(good & (drop >= FILL_DROP), "error", "FILL_RATE_DROPPED"),
        fixed(good & (-drop >= FILL_DROP), "info", "FILL_RATE_RECOVERED"),
        fixed(~ok & (F.col("failures") == FAILURES_BEFORE_ALERT), "error", "STREAM_UNREACHABLE"),
    ]
    grave = F.filter(F.coalesce("findings", F.array().cast("array<struct<code:string,severity:string>>")), lambda f: (f["severity"] != "info") & ~F.array_contains(F.col("old_codes"), f["code"]))
    first = F.filter(grave, lambda f, i: ~F.exists(F.slice(grave, F.lit(1), i), lambda g: g["code"] == f["code"]))
    new = F.when(good, F.transform(first, lambda f: F.struct(f["severity"].alias("severity"), F.concat(F.lit("NEW_"), f["code"]).alias("code"))))
    none = F.array().cast("array<struct<severity:string,code:string>>")
    every = F.concat(F.filter(F.array(*single), lambda x: x.isNotNull()), F.coalesce(new, none))
    return rows.select("monitor_id", "at", F.inline(every))


class _Monitor(StatefulProcessor):
    """Keeps the last run of a monitor; a poll that comes late, before the last one, is left out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long, ok boolean, verdict string, errors int, break_count int, codes array<string>, failures int, fill_rate double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(rows).sort_values("at")
        out, last = [], self.last.get() if self.last.exists() else None
        for run in frame.to_dict("records"):
            if last is not None and run["at"] <= last[0]:
                continue
            codes = list(dict.fromkeys(f["code"] for f in (run["findings"] if run["findings"] is not None else ())))
            failures = 0 if run["ok"] else 1 + (last[6] if last is not None and not last[1] else 0)
            old = dict(zip(("ok", "verdict", "errors", "break_count", "codes", "failures", "fill_rate"), last[1:], strict=True)) if last is not None else {}
            out.append(run | {"monitor_id": key[0], "codes": codes, "failures": failures} | {f"old_{k}": old.get(k) for k in ("ok", "verdict", "errors", "break_count", "codes", "failures", "fill_rate")})
            clean = lambda x: None if x is None or x != x else x
            last = (run["at"], run["ok"], run["verdict"], clean(run["errors"]), clean(run["break_count"]), codes, failures, clean(run["fill_rate"]))
            last = tuple(int(x) if k in (3, 4) and x is not None else x for k, x in enumerate(last))
        if last is not None:
            self.last.update(last)
        if out:
            yield pd.DataFrame(out)[[c.split()[0] for c in COMPARED.split(", ") if c]].astype({"errors": "Int32", "warnings": "Int32", "break_count": "Int32", "not_stitched": "Int32", "passthrough": "Int32", "failures": "Int32", "old_errors": "Int32", "old_break_count": "Int32", "old_failures": "Int32"})

    def close(self) -> None:
        pass


COMPARED = (
    RUNS.replace("findings array<struct<code string, severity string>>", "findings array<struct<code:string,severity:string>>")
    + ", codes array<string>, failures int, old_ok boolean, old_verdict string, old_errors int, old_break_count int, old_codes array<string>, old_failures int, old_fill_rate double"
)


def alert_stream(runs: DataFrame) -> DataFrame:
    """The alerts of a stream of runs, as ``alerts`` gives them; needs the RocksDB state store."""
    beside = runs.groupBy("monitor_id").transformWithStateInPandas(_Monitor(), COMPARED, "Append", "None")
    return _compared(beside)


def upserted(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Breaks of a store with newly seen ones: (monitor_id, break_key, first_seen, last_seen, signalled, closed,
    alerted). The last sight counts, a known length stays where none is stated, closed stays closed."""
    new = seen.groupBy("monitor_id", "break_key").agg(
        F.min("at").alias("new_first"), F.max("at").alias("new_last"), F.max_by("signalled", F.when(F.col("signalled").isNotNull(), F.col("at"))).alias("new_length"), F.max("closed").alias("new_closed")
    )
    both = known.join(new, ["monitor_id", "break_key"], "full_outer")
    return both.select(
        "monitor_id", "break_key", F.coalesce("first_seen", "new_first").alias("first_seen"), F.coalesce("new_last", "last_seen").alias("last_seen"),
        F.coalesce("new_length", "signalled").alias("signalled"), F.greatest(F.coalesce("closed", F.lit(0)), F.coalesce("new_closed", F.lit(0))).alias("closed"), F.coalesce("alerted", F.lit(0)).alias("alerted"),
    )


def stuck(known: DataFrame, seen: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """The store after a poll's breaks, and the breaks to be alerted: open, seen in this poll, not alerted before and further
    behind the live edge than their length and a grace. ``seen`` has edge_distance and overrun (whether the analysis
    reports an overrun itself). Breaks not seen for BREAK_TTL_MS are dropped."""
    store = upserted(known, seen)
    here = seen.groupBy("monitor_id", "break_key").agg(F.max("edge_distance").alias("edge_distance"), F.max("closed").alias("now_closed"))
    told = seen.groupBy("monitor_id").agg(F.bool_or("overrun").alias("overrun"))
    late = store.where("closed = 0 and alerted = 0").join(here, ["monitor_id", "break_key"]).join(told, "monitor_id")
    late = late.where(~F.col("overrun") & (F.col("now_closed") == 0) & (F.col("edge_distance") > F.coalesce("signalled", F.lit(DEFAULT_LENGTH)) + STUCK_GRACE))
    late = late.select("monitor_id", "break_key", F.lit(now).alias("at"), F.lit("error").alias("severity"), F.lit("BREAK_STUCK_OPEN").alias("code"))
    marked = store.join(late.select("monitor_id", "break_key", F.lit(1).alias("_told")), ["monitor_id", "break_key"], "left")
    kept = marked.withColumn("alerted", F.greatest("alerted", F.coalesce("_told", F.lit(0)))).drop("_told")
    return kept.where(F.col("last_seen") >= now - BREAK_TTL_MS), late


def keyed_breaks(breaks: DataFrame) -> DataFrame:
    """Breaks of polls with a key that stays the same from poll to poll."""
    return breaks.withColumn("break_key", break_key(F.col("event_id"), F.col("period_id"), F.col("pdt"), F.col("start_time")))


def due(monitors: DataFrame, now: int) -> DataFrame:
    """Enabled monitors that were never polled, or not for their interval."""
    return monitors.where((F.col("enabled") == 1) & (F.col("last_run_at").isNull() | (F.lit(now) - F.col("last_run_at") >= F.col("interval_seconds") * 1000)))


def pruned(runs: DataFrame, most: int = RUNS_KEPT) -> DataFrame:
    return latest(runs, ["monitor_id"], [F.desc("at")], most)


def recent(runs: DataFrame, most: int = 60) -> DataFrame:
    return latest(runs, ["monitor_id"], [F.desc("at")], most)


def poll_coverage(runs: DataFrame, interval: float, window: float, now: float) -> DataFrame:
    """Polls of the last ``window`` seconds against the expected number."""
    return coverage(runs.withColumn("s", F.col("at") / 1000), "monitor_id", "s", interval, F.lit(now - window), F.lit(now))


def sliding_coverage(runs: DataFrame, interval: int, window: int, slide: int, late: str | None = None) -> DataFrame:
    """monitor_id, until (epoch milliseconds), polls, expected, ratio and longest_gap of every window of ``window`` seconds,
    one each ``slide`` seconds, that has a poll. For a batch, or with ``late`` (how far behind a poll may come) for a stream.

    The stretch up to the first poll counts beyond one interval, and that behind the last one up to the window's end. A
    window holds a monitor's times until it is over: as many as it polls in that time."""
    rows = runs.select("monitor_id", "at", F.timestamp_millis("at").alias("time"))
    if late is not None:
        rows = rows.withWatermark("time", late)
    held = rows.groupBy("monitor_id", F.window("time", f"{window} seconds", f"{slide} seconds").alias("w")).agg(F.sort_array(F.collect_list("at")).alias("times"))
    start, end = F.unix_millis("w.start"), F.unix_millis("w.end")
    edges = F.concat(F.array(start + interval * 1000), F.col("times"), F.array(end))
    gaps = F.zip_with(F.slice(edges, F.lit(2), F.size(edges) - 1), F.slice(edges, F.lit(1), F.size(edges) - 1), lambda b, a: b - a)
    expected = max(1, round(window / interval))
    polls = F.size("times").cast("long")
    return held.select(
        "monitor_id", end.alias("until"), polls.alias("polls"), F.lit(expected).cast("long").alias("expected"), F.least(F.lit(1.0), polls / expected).alias("ratio"),
        F.greatest(F.lit(0), F.round(F.array_max(gaps) / 1000)).cast("long").alias("longest_gap"),
    )


def dashboard(monitors: DataFrame, runs: DataFrame, interval: float, window: float, now: float, history: int = 60) -> DataFrame:
    """Every monitor with its last run, its latest runs in order of time, and its coverage."""
    last = runs.groupBy("monitor_id").agg(F.max_by(F.struct("at", "ok", "verdict", "errors", "warnings", "break_count"), "at").alias("last_run"))
    past = recent(runs, history).groupBy("monitor_id").agg(F.array_sort(F.collect_list(F.struct("at", "ok", "verdict", "break_count"))).alias("history"))
    return monitors.join(last, "monitor_id", "left").join(past, "monitor_id", "left").join(poll_coverage(runs, interval, window, now), "monitor_id", "left")


def acknowledged(stored: DataFrame, ids: list) -> DataFrame:
    return stored.withColumn("acknowledged", F.when(F.col("alert_id").isin(*ids), 1).otherwise(F.col("acknowledged")))


def delivered(alerts_: DataFrame, send) -> None:
    """Hand each batch's alerts to ``send`` (a list of rows), inside the tasks; what it raises is not passed on."""

    def run(rows):
        batch = [r.asDict() for r in rows]
        if batch:
            try:
                send(batch)
            except Exception as e:  # an alert's sink must not stop the stream
                print(f"alerts were not delivered: {e}")

    alerts_.foreachPartition(run)
