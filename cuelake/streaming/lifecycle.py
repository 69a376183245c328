"""The life of breaks over polls: one state machine, run over a stream or over a batch of polls.

A break is known by monitor and key from its first sight to 6 hours after its last one, told by the monitor's own polls. It is
told once if it stays open: seen, not closed, further behind the live edge than its length and a grace, unless the
analysis reports an overrun itself. The last length that was stated counts; closed stays closed.

On a stream the state of a monitor is a map by break key. A timer in event time frees the state of a monitor that has been
silent for SILENT_MS; seen again after that, its breaks are new.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cuelake.runtime import gathered, written
from cuelake.streaming.monitor import BREAK_TTL_MS, DEFAULT_LENGTH, STUCK_GRACE

SILENT_MS = 7 * 24 * 3600 * 1000
STATE = "first_seen long, last_seen long, signalled double, closed int, alerted int"
TOLD = "monitor_id string, at long, break_key string, severity string, code string"


def _number(x) -> float | None:
    return None if x is None or x != x else float(x)


def seen_in(known: dict[str, list], at: int, overrun: bool, breaks) -> list[str]:
    """Bring ``known`` (break key to the fields of STATE) to the state after a poll; the keys of breaks to be told."""
    told, here = [], {}
    for b in breaks if breaks is not None else ():
        key, length, closed = b["break_key"], _number(b["signalled"]), int(bool(b["closed"]))
        old = known.get(key)
        if old is None:
            known[key] = [at, at, length, closed, 0]
        else:
            old[1], old[2], old[3] = at, old[2] if length is None else length, max(old[3], closed)
        here.setdefault(key, (closed, _number(b["edge_distance"])))
    for key, (closed, distance) in here.items():
        state = known[key]
        if overrun or closed or state[3] or state[4] or distance is None:
            continue
        if distance > (DEFAULT_LENGTH if state[2] is None else state[2]) + STUCK_GRACE:
            state[4] = 1
            told.append(key)
    for key in [k for k, x in known.items() if x[1] < at - BREAK_TTL_MS]:
        del known[key]
    return told


class _Lifecycle(StatefulProcessor):
    """Polls of a monitor in order of time; one that is not later than the last is left out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.breaks = handle.getMapState("breaks", "break_key string", STATE)
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {k[0]: list(v) for k, v in self.breaks.iterator()} if self.breaks.exists() else {}
        before = {k: list(v) for k, v in known.items()}
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        frame = pd.concat(rows).sort_values("at", kind="stable")
        for poll in frame.to_dict("records"):
            at = int(poll["at"])
            if last is not None and at <= last:
                continue
            last = at
            out += [(key[0], at, k, "error", "BREAK_STUCK_OPEN") for k in seen_in(known, at, bool(poll["overrun"]), poll["breaks"])]
        for k in before.keys() - known.keys():
            self.breaks.removeKey((k,))
        for k, state in known.items():
            if before.get(k) != state:
                self.breaks.updateValue((k,), tuple(state))
        if last is not None:
            self.last.update((last,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last + SILENT_MS)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TOLD.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.breaks.clear()
        self.last.clear()
        yield pd.DataFrame([], columns=[c.split()[0] for c in TOLD.split(", ")])

    def close(self) -> None:
        pass


def stuck_stream(polls: DataFrame, late: str = "6 hours") -> DataFrame:
    """TOLD: the stuck breaks of a stream of polls (monitor_id, at, overrun, breaks); needs the RocksDB state store. Time is
    that of the polls; ``late`` is how far behind the newest one a poll may come."""
    rows = polls.select("monitor_id", "at", "overrun", "breaks", F.timestamp_millis("at").alias("time")).withWatermark("time", late)
    return rows.groupBy("monitor_id").transformWithStateInPandas(_Lifecycle(), TOLD, "Append", "EventTime")


STORED = "monitor_id string, break_key string, " + STATE
_BOTH = STORED + ", " + "at long, overrun boolean, breaks array<struct<break_key: string, signalled: double, closed: int, edge_distance: double>>"


def replayed(polls: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store of breaks (STORED) after ``polls`` (monitor_id, at, overrun, breaks), and the breaks to be told (TOLD). Polls
    are sorted by monitor and time, after what is known of it, and streamed: a task holds one batch and one monitor's
    breaks. Monitors that no poll names are left out of the store."""
    names = polls.select("monitor_id").distinct()
    none = lambda kind, *columns: [F.lit(None).cast(kind).alias(c) for c in columns]
    parts = dict(x.strip().split(" ", 1) for x in STATE.split(","))
    stored = known.join(names, "monitor_id", "left_semi").select("monitor_id", F.lit(0).alias("kind"), "break_key", *parts, *none("long", "at"), *none("boolean", "overrun"), *none(polls.schema["breaks"].dataType, "breaks"))
    told = polls.select("monitor_id", F.lit(1).alias("kind"), *none("string", "break_key"), *[F.lit(None).cast(t).alias(c) for c, t in parts.items()], "at", "overrun", "breaks")
    out = "monitor_id string, at long, break_key string, first_seen long, last_seen long, signalled double, closed int, alerted int"

    def run(batches):
        own, known_now, last, made, begun = None, {}, None, [], False

        def ended():
            return [(own, None, k, *x) for k, x in known_now.items()]

        for batch in batches:
            for row in batch.to_pylist():
                if row["monitor_id"] != own or not begun:
                    made, begun = made + ended(), True
                    own, known_now, last = row["monitor_id"], {}, None
                if row["kind"] == 0:
                    known_now[row["break_key"]] = [row[c] for c in parts]
                elif last is None or row["at"] > last:
                    last = row["at"]
                    made += [(own, last, k, None, None, None, None, 1) for k in seen_in(known_now, last, bool(row["overrun"]), row["breaks"])]
            yield _batch(made)
            made = []
        made += ended()
        yield _batch(made)

    def _batch(rows):
        columns = [*zip(*rows, strict=True)] if rows else [()] * 8
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in out.split(", ")])

    both = gathered(stored.unionByName(told), "monitor_id").sortWithinPartitions("monitor_id", "kind", "at")
    found = written(both.mapInArrow(run, out))
    late = found.where("at is not null").select("monitor_id", "at", "break_key", F.lit("error").alias("severity"), F.lit("BREAK_STUCK_OPEN").alias("code"))
    return found.where("at is null").drop("at"), late
